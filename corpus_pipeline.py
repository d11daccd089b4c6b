"""Documents to training tokens in five stages; each works on all that the one before it kept.

A stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfare.llm.bpe import encode_documents
from skyfare.llm.decontaminate import find_benchmark
from skyfare.llm.pii import redact
from skyfare.llm.quality import keep_good
from skyfare.llm.shingle_join import jaccard_components
from skyfare.llm.units import tokenizer_path
from skyfare.sources.scratch import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_length(docs: DataFrame) -> DataFrame:
    length = F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))
    return docs.withColumn("n_chars", length).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document: that of the least id, those without an id last.

    Texts are told apart by id and digest, so unlike texts under one id are
    documents of their own. Of rows that are equal in both, the first by their
    other columns stays. Texts without words link with nothing and all stay.
    """
    docs = docs.select(*COLUMNS)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    no_id = F.col("doc_id").isNull()
    key = F.struct(
        no_id.alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("digest")
    )
    keyed = docs.where(worded).withColumn("key", key)
    groups = jaccard_components(keyed, doc_id="key")
    least = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    kept = keyed.join(least.hint("shuffle_hash"), "key", "left_semi")
    one = Window.partitionBy("key").orderBy("lang", "source", "n_chars")
    kept = kept.withColumn("place", F.row_number().over(one)).where("place = 1")
    return kept.select(*COLUMNS).union(docs.where(~worded))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that benchmark windows cover."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    packed = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("others"), "text")
    found = find_benchmark(packed, benchmark, doc_id="others", cleaned="cleaned")
    return _with_length(found.select("doc_id.*", F.col("cleaned").alias("text")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in place of personal data."""
    return _with_length(redact(docs.select(*COLUMNS)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids: doc_id, lang, source, n_tokens, ids."""
    packed = docs.select(F.struct("doc_id", "lang", "source").alias("others"), "text")
    found = encode_documents(packed, tokenizer_path("byte_bpe_50k.json"), doc_id="others")
    return found.select("doc_id.*", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("BPE encoding", encoded),
]

# Fitting a model, set similarity and byte-pair encoding are beyond SQL; the
# stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each result stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
