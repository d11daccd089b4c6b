"""Hard negatives by Four-Russians scoring: lookups in subset-sum tables in place of products.

A candidate's components are integers. Their bits are dealt out to planes, one
for each power of two, and each plane is packed into bytes of eight dimensions.
For an anchor and eight dimensions, a table of 256 entries holds the sums of
the anchor's components over all subsets of the eight. The byte of a plane picks
the sum that this plane adds to the inner product; planes are added from the
highest, which counts negative (two's complement), by shifting what is there by
one bit. That gives the exact inner product of integers.

Anchors and candidates are dealt to groups by a hash of their ids, and each
group of anchors meets each group of candidates in one tile: the stated anchors
against all rows. The positives need one sweep over the tiles; the score window
of the negatives follows from them and takes a second one. A tile returns what
can still be among the first few of its anchor, so merging is a bounded rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfare.llm.integer_vectors import Shape, integers, packed, shape_of, unpacked, whole
from skyfare.llm.stored import discard, stored

GROUP = 8
ANCHORS_IN_TILE = 4096
CANDIDATES_IN_TILE = 8192
# Scores that are worked out at once: tables and sums stay in a processor's cache.
ANCHOR_STEP = 128
CANDIDATE_STEP = 1024
# Partitions of the tiles at most; beyond it, a task has several tiles one after the other.
MOST_PARTITIONS = 20_000

Batches = Iterator[pa.RecordBatch]
NONE = np.iinfo(np.int64).min


def planes_of(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of integers as bytes, by plane from the lowest and eight dimensions."""
    planes = [np.packbits((cells >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.stack(planes, axis=1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables by eight dimensions, byte and anchor."""
    groups = anchors.shape[1] // GROUP
    tables = np.zeros((groups, 1 << GROUP, len(anchors)), anchors.dtype)
    for g in range(groups):
        for k in range(GROUP):
            own = anchors[:, GROUP * g + k]
            tables[g, 1 << k : 2 << k] = tables[g, : 1 << k] + own
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products of candidates (rows) and anchors (columns)."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    looked_up = np.empty_like(total)
    bits = planes.shape[1]
    for b in range(bits - 1, -1, -1):
        total <<= 1
        add = np.subtract if b == bits - 1 else np.add
        for g in range(len(tables)):
            np.take(tables[g], planes[:, b, g], axis=0, out=looked_up, mode="clip")
            add(total, looked_up, out=total)
    return total


def _first(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest entries that are not NONE, ties to the left: rows and columns."""
    if found.shape[1] > k:
        least = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k, None]
    else:
        least = np.full((len(found), 1), NONE)
    row, column = np.nonzero((found >= least) & (found != NONE))
    order = np.lexsort((column, -found[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _packed_rows(shape: Shape, bits: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            cells = integers(batch.column("vector"), shape.width)
            planes = planes_of(cells, bits)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "label": batch.column("label"),
                    "planes": packed(planes.reshape(len(cells), bits * shape.width // GROUP)),
                }
            )

    return run


def _cells(planes: np.ndarray, bits: int, kind: type) -> np.ndarray:
    """What ``planes_of`` was made from."""
    shaped = np.unpackbits(planes.reshape(len(planes), bits, -1), axis=2, bitorder="little").astype(kind)
    weights = np.array([1 << b for b in range(bits - 1)] + [-(1 << bits - 1)], kind)
    return (shaped * weights[None, :, None]).sum(axis=1, dtype=kind)


def _sorted(table: pa.Table, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, labels and planes."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    planes = unpacked(table.column("planes"), "u1", bits * width // GROUP)
    return ids[order], table.column("label").to_numpy()[order], planes[order]


def _tiles(shape: Shape, bits: int, left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of a step, ids and labels of all candidates of the tile, and scores by anchor and candidate."""
    kind = np.int32 if shape.width * shape.largest * shape.largest < 1 << 31 else np.int64
    ids, labels, planes = _sorted(right, bits, shape.width)
    planes = planes.reshape(len(ids), bits, -1)
    anchors = _cells(unpacked(left.column("planes"), "u1", bits * shape.width // GROUP), bits, kind)
    for first in range(0, len(anchors), ANCHOR_STEP):
        part = slice(first, min(first + ANCHOR_STEP, len(anchors)))
        tables = subset_sums(anchors[part])
        found = np.empty((part.stop - first, len(ids)), np.int64)
        for start in range(0, len(ids), CANDIDATE_STEP):
            found[:, start : start + CANDIDATE_STEP] = scores(tables, planes[start : start + CANDIDATE_STEP]).T
        yield part, ids, labels, found


def _table(schema: dict[str, pa.DataType], parts: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True)] if parts else [[] for _ in schema]
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, schema.values(), strict=True)], names=list(schema))


def _best_alike(shape: Shape, bits: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = {name: pa.int64() for name in ("anchor_id", "id", "score")}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            anchor_ids, anchor_labels = left.column("id").to_numpy(), left.column("label").to_numpy()
            for part, ids, labels, found in _tiles(shape, bits, left, right):
                alike = (anchor_labels[part, None] == labels) & (anchor_ids[part, None] != ids)
                row, column = _first(np.where(alike, found, NONE), k)
                parts.append([anchor_ids[part][row], ids[column], found[row, column]])
        return _table(schema, parts)

    return run


def _best_unlike(shape: Shape, bits: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    schema = {name: pa.int64() for name in names}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            anchor_ids, anchor_labels = left.column("id").to_numpy(), left.column("label").to_numpy()
            positives = left.column("positives").to_pylist()
            for part, ids, labels, found in _tiles(shape, bits, left, right):
                unlike = anchor_labels[part, None] != labels
                own = positives[part]
                for place in range(max(map(len, own))):
                    has = np.flatnonzero([len(x) > place for x in own])
                    score = np.array([own[a][place]["score"] for a in has], np.int64)
                    positive = np.array([own[a][place]["id"] for a in has], np.int64)
                    # no score is above 2**58, so these products fit
                    low, high = -(-score // 2), 19 * score // 20
                    mine = found[has]
                    row, column = _first(np.where(unlike[has] & (mine >= low[:, None]) & (mine <= high[:, None]), mine, NONE), k)
                    parts.append([anchor_ids[part][has[row]], positive[row], score[row], ids[column], mine[row, column]])
        return _table(schema, parts)

    return run


def _ranked(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column | None = None,
    *,
    positives: int = 5,
    negatives: int = 3,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """For each anchor and positive the hard negatives: anchor_id, positive_id, rank, negative_id and the two scores.

    ``anchors`` is a condition on the id, ``id``; None takes all rows. Scores are
    inner products of floor(256 x). An anchor's positives are the ``positives``
    other rows of its label that score highest; the negatives of a positive with
    score p are the ``negatives`` highest rows of other labels with a score from
    50 to 95 per cent of p, both included. Ties go to the smaller id. An anchor
    with fewer rows has what there is; a negative p has none.

    Rows without an id or a label, and vectors that are NULL or hold NULL or
    non-finite components, take no part. Of rows that repeat an id the one with
    the smallest label, then the smallest bytes of its planes, counts. A vector shorter than the longest
    ends in zeros, and integers beyond the square root of 2**58 / width (2**26 at
    64 components) are held there. Empty tables give an empty table. Labels are
    integers; other columns are not read.
    """
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole("vector"))
    shape = shape_of(rows, "vector", GROUP)
    bits = shape.largest.bit_length() + 1
    flat = rows.mapInArrow(_packed_rows(shape, bits), "id bigint, label bigint, planes binary")
    base = stored(_ranked(flat, ["id"], ["label", "planes"], 1).drop("rank"), "bit-planes")
    asked = base if anchors is None else base.where(anchors)
    groups, anchor_groups = -(-shape.rows // CANDIDATES_IN_TILE) or 1, -(-asked.count() // ANCHORS_IN_TILE) or 1
    partitions = min(groups * anchor_groups, MOST_PARTITIONS)

    def dealt(rows: DataFrame, own: str, own_groups: int, other: str, other_groups: int):
        every = F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_groups)).cast("int")).withColumn(other, every)
        return rows.repartition(partitions, "a", "c").groupBy("a", "c")

    right = dealt(base, "c", groups, "a", anchor_groups)
    alike = dealt(asked, "a", anchor_groups, "c", groups).cogroup(right)
    alike = alike.applyInArrow(_best_alike(shape, bits, positives), "anchor_id bigint, id bigint, score bigint")
    best = _ranked(alike, ["anchor_id"], [F.desc("score"), "id"], positives)
    # a handful for each anchor
    best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    with_positives = stored(asked.join(best.withColumnRenamed("anchor_id", "id"), "id"), "positives")

    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    unlike = dealt(with_positives, "a", anchor_groups, "c", groups).cogroup(right)
    unlike = unlike.applyInArrow(_best_unlike(shape, bits, negatives), schema)
    found = _ranked(unlike, ["anchor_id", "positive_id"], [F.desc("negative_score"), "negative_id"], negatives)
    result = stored(
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives"
    )
    discard(base, with_positives)
    return result
