"""Token counts by a cache of content digests.

A count is stored under two digests: of the text and of the tokenizer's file.
The text is digested as the tokenizer sees it first; the byte-level tokenizers
counted here normalise nothing, so that is the text itself, NULL as empty.
Texts are joined with the stored counts; of those that are missing, one copy
each is encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.llm.stored import stored
from skyfare.llm.units import Pieces, chunks, joinable, tokenizer

CACHE_SCHEMA = "version string, digest string, n_tokens bigint"

_counters: dict[str, Counter] = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class Counter:
    """Tokens of whole texts, by the tokenizers library; its byte-level pattern joins one space to the next word."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.rest = Pieces(self._lengths, " ", lambda piece: joinable(piece, special))
        self.heads = Pieces(self._lengths, "", lambda piece: not piece or joinable(piece, special))

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        cut = [text.split(" ") for text in texts]
        heads = [pieces.pop(0) for pieces in cut]
        self.heads.learn(set(heads))
        self.rest.learn(set().union(*cut))
        result = []
        for text, head, pieces in zip(texts, heads, cut, strict=True):
            try:
                result.append(self.heads.table[head] + sum(map(self.rest.table.__getitem__, pieces)))
            except TypeError:  # a piece that can't stand alone
                result += self._lengths([text])
        return result


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                columns = [rows.column("digest"), pa.array(count(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_tokens"])

    return run


def count_tokens(
    documents: DataFrame, path: str, cache: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512
) -> DataFrame:
    """One row for each document row: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is the tokenizer's file, on every machine; ``cache`` a Parquet
    folder of earlier counts that may not exist yet. NULL and empty texts have
    no bytes and no tokens. Repeated rows and NULL ids stay. Texts of other
    columns are not read. One copy of a text is encoded, however many there
    are; each new digest is written to the cache once, by one call at a time.
    """
    version = tokenizer_version(path)
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frame = frame.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    digested = stored(frame.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    missing = digested.join(_counts(documents.sparkSession, cache, version), "digest", "left_anti")
    missing = missing.groupBy("digest").agg(F.min("doc_id").alias("copy")).hint("shuffle_hash")
    one = (frame["digest"] == missing["digest"]) & frame["doc_id"].eqNullSafe(missing["copy"])
    texts = frame.join(missing, one, "left_semi").select("digest", "text")
    new = texts.mapInArrow(_encode(path), "digest string, n_tokens bigint")
    new = new.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    found = digested.join(_counts(documents.sparkSession, cache, version), "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, each digest once."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    own = table.where(F.col("version") == version)
    return own.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
