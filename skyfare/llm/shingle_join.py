"""N-gram Jaccard join: near copies by a prefix join on rare n-grams, then exact overlaps.

Think of a matrix of documents by n-grams, a row being the set of a document's
distinct word n-grams. Overlap counts of pairs would be the entries of the
matrix times its transpose. That product is not accumulated block by block: a
partial count of a frequent column would be made for each pair under it, the
square of its rows. Instead, columns propose and rows are compared:

1. The columns that come first when a document's n-grams are ordered from rare
   to frequent. A pair of similarity ``t`` must share one of the first
   ``n - ceil(t n) + 1`` n-grams of both, so only those columns make pairs.
2. The whole rows are intersected, for the pairs that survive the bounds from their sizes and from
   where in the two rows their first shared n-gram stands.

The order of rarity is one table of counts for the whole corpus, by n-gram hash
modulo 2**20: four megabytes at any size. It must only be the same for all
documents; that n-grams share a count costs time, never a link.

Documents with equal sets are one row of the matrix, however many they are. Of
the remaining rows, those under one column are first compared with a few of
them (their least by hash class), which links a large group of near copies by
as many pairs as it has members. After that, only pairs of rows that are not
yet connected are compared, all of them, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfare.llm.components import components
from skyfare.llm.stored import stored
from skyfare.llm.words import SPACE_WORD, find_words, ngrams, slices

NGRAM = 5
PERCENT = 80
TABLE_BITS = 20
CHUNK = 1 << 12  # counts in one row of a partial table
FAN_IN = 256  # partial tables that are added up in one group
PIVOTS = 4  # rows of a column that all its rows are compared with first

Batches = Iterator[pa.RecordBatch]


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    grams, bounds = ngrams(find_words(data, offsets, SPACE_WORD), size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(grams[a:b])


def _counts(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        table = np.zeros(1 << TABLE_BITS, np.int64)
        mask = np.uint64(len(table) - 1)
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                for grams in _sets(data, offsets, size):
                    np.add.at(table, (grams & mask).astype(np.int64), 1)
        if table.any():
            parts = [part.astype("<i8").tobytes() for part in table.reshape(-1, CHUNK)]
            numbers = pa.array(range(len(parts)), pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, pa.array(parts, pa.binary())], names=["chunk", "counts"])

    return run


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in group.column("counts"))
    counts = pa.array([total.astype("<i8").tobytes()], pa.binary())
    return pa.table({"chunk": pa.array(group.column("chunk")[:1]), "counts": counts})


def column_counts(documents: DataFrame, size: int = NGRAM) -> np.ndarray:
    """How many documents hold an n-gram of each hash class: a table of fixed size."""
    parts = documents.select("text").mapInArrow(_counts(size), "chunk int, counts binary")
    parts = parts.withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    schema = "chunk int, counts binary"
    some = parts.groupBy("chunk", "part").applyInArrow(_add_up, schema)
    rows = some.groupBy("chunk").applyInArrow(_add_up, schema).collect()  # 256 rows, 8 MB in all
    table = np.zeros(1 << TABLE_BITS, np.int64)
    for row in rows:
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<i8")
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def prefix_length(n: int, percent: int) -> int:
    return n + (-n * percent // 100) + 1


def _rows(counts: np.ndarray, size: int, percent: int) -> Callable[[Batches], Batches]:
    """doc_id, n, digest of the set, and its first n-grams from rare to frequent."""

    def run(batches: Batches) -> Batches:
        mask = np.uint64(len(counts) - 1)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                n, low, high, heads = [], [], [], []
                for grams in _sets(data, offsets, size):
                    n.append(len(grams))
                    low.append(int(np.bitwise_xor.reduce(grams * np.uint64(0x9E3779B97F4A7C15))) if len(grams) else 0)
                    high.append(int(grams.sum()))
                    order = np.lexsort((grams, counts[(grams & mask).astype(np.int64)]))
                    heads.append(grams[order[: prefix_length(len(grams), percent)]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(low, np.uint64).view(np.int64)),
                        pa.array(np.array(high, np.uint64).view(np.int64)),
                        pa.array(heads, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "low", "high", "head"],
                )

    return run


def _full_sets(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = [x.view(np.int64) for x in _sets(data, offsets, size)]
                columns = [rows.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "grams"])

    return run


def _possible(percent: int) -> F.Column:
    """Whether sizes and the places of a shared n-gram allow the similarity.

    ``i`` and ``j`` count the n-grams before the shared one, ``si`` and ``sj``
    those of them that stand at the head of another row as well. An earlier
    n-gram of both rows is at the head of both, so at most the lesser of ``si``
    and ``sj`` are shared before this one, and what follows in either after it.
    """
    enough = F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-9)
    most = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) + F.least("si", "sj")
    sizes = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return sizes & (most >= enough)


def _side(rows: DataFrame, node: str, place: str) -> DataFrame:
    names = {"id": node, "n": f"n{node}", "place": place, "before": f"s{place}", "component": f"c{node}"}
    return rows.withColumnsRenamed(names)


def _pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, its smaller id first."""
    swap = F.col("a") > F.col("b")
    picked = {
        "a": F.least("a", "b"),
        "b": F.greatest("a", "b"),
        "na": F.when(swap, F.col("nb")).otherwise(F.col("na")),
        "nb": F.when(swap, F.col("na")).otherwise(F.col("nb")),
    }
    return pairs.select(*[column.alias(name) for name, column in picked.items()]).distinct()


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def _sets_of(ids: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """Full sets of the documents with these ids; texts are hashed to them, never sorted."""
    kind = dict(documents.dtypes)["doc_id"]
    needed = documents.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    return stored(needed.mapInArrow(_full_sets(size), f"id {kind}, grams array<bigint>"), "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar, by the exact overlap of their sets."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    either = F.col("na") + F.col("nb") - shared
    return pairs.join(left, "a").join(right, "b").where(shared * 100 >= either * percent).select("a", "b")


def jaccard_components(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = NGRAM, percent: int = PERCENT
) -> DataFrame:
    """One row for each document row: doc_id, n_shingles, component_id.

    Two documents link when 100 * (n-grams both hold) >= percent * (n-grams
    either holds). ``component_id`` is the smallest id that links lead to, the
    document's own included. Words are runs of anything but ASCII white space,
    with A-Z in lower case; a document with fewer than ``size`` words has all
    of them as its one n-gram. Empty and NULL texts have no n-grams and link
    with nothing, not even with each other. Repeated rows stay; rows without an
    id have no component and link nothing. An empty table gives an empty table.
    Other columns are not read.
    """
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(frame.dtypes)["doc_id"]
    counts = column_counts(frame, size)
    schema = f"doc_id {kind}, n bigint, low bigint, high bigint, head array<bigint>"
    rows = stored(frame.mapInArrow(_rows(counts, size, percent), schema), "shingles")

    # equal sets are one row, named by its least document
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "low", "high")
    heads = classes.agg(F.min(F.struct("doc_id", "head")).alias("least"))
    postings = heads.select(F.col("least.doc_id").alias("id"), "n", F.posexplode("least.head").alias("place", "gram"))
    often = postings.groupBy("gram").count().where("count > 1").select("gram")
    in_row = Window.partitionBy("id").orderBy("place")
    shared = postings.join(often, "gram").withColumn("before", F.row_number().over(in_row) - 1)
    shared = stored(shared, "postings")

    # first, every row of a column against a few rows of the column
    some = shared.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("class"))
    pivots = some.agg(F.min(F.struct("id", "n", "place", "before")).alias("least")).select("gram", "least.*")
    tried = _side(pivots, "a", "i").join(_side(shared, "b", "j"), "gram")
    tried = stored(_pairs(tried.where((F.col("a") != F.col("b")) & _possible(percent))), "first-pairs")
    sets = _sets_of(_nodes(tried), frame, size)
    links = stored(_links(tried, sets, percent), "first-links")
    stars = components(links)

    # then, all pairs of a column that are not connected by now
    placed = shared.join(stars.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    divided = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    open_ = stored(placed.join(divided.select("gram"), "gram"), "divided")
    rest = _side(open_, "a", "i").join(_side(open_, "b", "j"), "gram")
    rest = _pairs(rest.where((F.col("ca") < F.col("cb")) & _possible(percent))).join(tried, ["a", "b"], "left_anti")
    rest = stored(rest, "other-pairs")
    fresh = stored(_nodes(rest).join(sets.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "other-rows")
    if not fresh.isEmpty():
        sets = sets.union(_sets_of(fresh, frame, size))
    more = stored(_links(rest, sets, percent), "other-links")
    if not more.isEmpty():
        joined = stars.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        stars = components(joined.union(more))

    named = classes.agg(F.min("doc_id").alias("node")).join(stars, "node", "left")
    named = named.select("n", "low", "high", F.coalesce("component", "node").alias("component"))
    found = rows.select("doc_id", "n", "low", "high").join(named, ["n", "low", "high"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
