"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are dealt out to groups by a hash of their ids, and every group of
queries meets every group of candidates in one tile. There, unit vectors are
rounded to int8 with a scale each; their product is exact in float32, and the
rounding errors bound how far it lies from the true cosine. Only pairs whose
upper bound reaches the query's k-th best lower bound are computed again from
the original vectors in double precision. The best of each tile are merged by
a bounded heap for each query, before the shuffle and after it.

Every candidate is compared, so the result is exact: recall is 1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES_IN_TILE = 8192
CANDIDATES_IN_TILE = 16384
# Rows of a tile that are multiplied at once, which bounds the product.
QUERY_STEP = 256


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; of rows with one id the smallest vector."""
    ids = table.column("id").to_numpy()
    flat = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64)
    vectors = flat.reshape(len(ids), -1)
    order = np.lexsort([*vectors.T[::-1], ids])
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], vectors[first]


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows (as float32, for the product), their scales, and how far each is from its unit vector."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / largest
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - rounded * scale[:, None]) ** 2).sum(axis=1))
    return rounded.astype(np.float32), scale, error


def _squared(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for column in vectors.T:
        total += column * column
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, all sums from the first component to the last."""
    dot = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
    return dot / (np.sqrt(_squared(a)) * np.sqrt(_squared(b)))


def _few_copies(vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that repeat ``most`` earlier ones: with the smaller ids they always come first."""
    _, group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    sorted_ = group[order]
    place = np.arange(len(group)) - np.searchsorted(sorted_, sorted_)
    return np.sort(order[place < most])


def _tile(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        found: list[list[np.ndarray]] = [[], [], []]
        if len(queries) and len(candidates):
            query_ids, query = _vectors(queries)
            ids, vectors = _vectors(candidates)
            kept = _few_copies(vectors, k + 1)  # a query may be one of them
            ids, vectors = ids[kept], vectors[kept]
            q8, q_scale, q_error = quantised(query)
            c8, c_scale, c_error = quantised(vectors)
            for first in range(0, len(query), QUERY_STEP):
                part = slice(first, first + QUERY_STEP)
                near = (q8[part] @ c8.T) * q_scale[part, None] * c_scale
                # |x y - x' y'| <= |x - x'| + |y - y'| |x'|, and some room for rounding in this sum
                bound = q_error[part, None] + c_error * (1 + q_error[part, None]) + 1e-6
                own = query_ids[part, None] == ids
                low = np.where(own, -np.inf, near - bound)
                if len(ids) > k:
                    least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
                else:
                    least = np.full((len(near), 1), -np.inf)
                row, column = np.nonzero((near + bound >= least) & ~own)
                for start in range(0, len(row), 1 << 16):
                    r, c = row[start : start + (1 << 16)], column[start : start + (1 << 16)]
                    score = cosines(query[first + r], vectors[c])
                    for to, values in zip(found, (query_ids[first + r], ids[c], score), strict=True):
                        to.append(values)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in found]
        order = np.lexsort((flat[1], -flat[2], flat[0]))
        flat = [x[order] for x in flat]
        place = np.arange(len(order)) - np.searchsorted(flat[0], flat[0])
        return pa.table([pa.array(x[place < k]).cast(kind) for x, kind in zip(flat, kinds, strict=True)], names=names)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each query's k nearest rows by cosine, its own id left out: query_id, rank, vec_id, score.

    Ties go to the smaller id. Rows without an id, and vectors that are NULL,
    empty, zero or hold NULL or non-finite components, take no part; vectors
    are compared with those of the same length. Rows that repeat an id count
    once, by the smallest of their vectors. A query with fewer than k
    candidates gets all of them. Other columns are not read.
    """

    def usable(rows: DataFrame) -> DataFrame:
        parts = F.col(vector).cast("array<double>")
        rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), parts.alias("vector"))
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))

    base, asked = usable(vectors), usable(queries)
    n, m = base.count(), asked.count()
    groups, query_groups = -(-n // CANDIDATES_IN_TILE) or 1, -(-m // QUERIES_IN_TILE) or 1

    def dealt(rows: DataFrame, own: str, own_groups: int, other: str, other_groups: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_groups)).cast("int"))
        return rows.withColumn("size", F.size("vector")).withColumn(other, every)

    left = dealt(asked, "q", query_groups, "c", groups).groupBy("q", "c", "size")
    right = dealt(base, "c", groups, "q", query_groups).groupBy("q", "c", "size")
    best = left.cogroup(right).applyInArrow(_tile(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
