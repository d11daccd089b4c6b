"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.llm.bpe import encode_documents
from skyfare.llm.decontaminate import find_benchmark
from skyfare.llm.hard_negatives import hard_negatives
from skyfare.llm.html_text import extract_text
from skyfare.llm.neighbours import nearest
from skyfare.llm.pii import KINDS, find_personal_data, spans_text
from skyfare.llm.quality import score_quality
from skyfare.llm.repeated_text import remove_repeats
from skyfare.llm.shingle_join import jaccard_components
from skyfare.llm.token_counts import count_tokens
from skyfare.llm.token_files import read_tokens, write_tokens
from skyfare.llm.units import tokenizer_path
from skyfare.llm.url_filter import judge_urls
from skyfare.llm.vector_codes import compress_vectors
from skyfare.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where("vec_id % 50 = 0"), k=5)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-count-cache")
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), cache)


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    documents = table(spark, sf_dir, "documents")
    write_tokens(documents, tokenizer_path("word_bpe_49k.json"), folder, end_id=2)
    read = read_tokens(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    encoded = encode_documents(table(spark, sf_dir, "documents"), path, decoded=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, so that labels and nearness disagree."""
    moved = (F.col("label").cast("decimal(20,0)") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")).cast("bigint")
    embeddings = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(embeddings, F.col("id") % 50 == 0)


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.sha2(F.col("codebooks").cast("binary"), 256).alias("codebooks_sha256"),
    )
