"""Vector code compression by ball k-means: a codebook of up to 64 entries for each of 16 parts.

A codebook entry and the parts assigned to it are a ball. Its radius is the
largest distance of one of its parts to the entry. Only entries whose distance
from it is at most twice the radius can take parts over: they are its
neighbours. A part that lies nearer than half the way to the nearest neighbour
is in the stable core and keeps its entry, nothing is computed for it. The rest
of the ball is cut into rings by half the distances to the neighbours, nearest
first, and a part is compared with the neighbours of its ring and those inside
it. All of that is done on squared distances of integers, so nothing is lost to
rounding, and ties go to the lower entry as they would in a full search.

One pass over the vectors makes a round: it assigns the parts and emits, for
each partition of the table, the sums, counts and radii of its balls. Those are
added up by Spark; what comes to the driver is one row for each component of the
codebook. Radii are not measured again after the entries have moved: a ball's
old radius and the way of its entry bound the new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfare.llm.integer_vectors import integers, packed, shape_of, unpacked, whole
from skyfare.llm.stored import discard, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
# Vectors that are worked on at once.
STEP = 32768
# Distinct labels whose sums are broadcast, some megabytes.
MOST_LABELS = 100_000

Batches = Iterator[pa.RecordBatch]


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all entries."""
    return np.stack([((parts - entry) ** 2).sum(axis=1) for entry in entries], axis=1)


class Balls:
    """The neighbours of each entry of one codebook, nearest first, and four times their rings' inner bounds.

    ``radii`` are upper bounds of the squared radii, or None before anything is assigned.
    """

    def __init__(self, entries: np.ndarray, radii: np.ndarray | None) -> None:
        self.entries = entries
        between = distances(entries, entries)
        self.neighbours: list[np.ndarray] = []
        self.rings: list[np.ndarray] = []
        for k in range(len(entries)) if radii is not None else ():
            near = np.flatnonzero(between[k] <= 4 * float(radii[k]))
            near = near[near != k]
            near = near[np.argsort(between[k][near], kind="stable")]
            self.neighbours.append(near)
            self.rings.append(between[k][near])

    def first(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part by a full search."""
        found = distances(parts, self.entries)
        codes = found.argmin(axis=1)
        return codes, found[np.arange(len(parts)), codes]

    def again(self, parts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the entries that the parts were assigned to before."""
        codes = before.astype(np.int64)
        best = ((parts - self.entries[codes]) ** 2).sum(axis=1)
        order = np.argsort(before, kind="stable")
        bounds = np.searchsorted(before[order], np.arange(len(self.entries) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[k] : bounds[k + 1]]
            # how many neighbours are at most twice as far from the entry as the part is
            rings = np.searchsorted(self.rings[k], 4 * best[own], "right")
            # rings of one, two, four neighbours and so on are searched together
            wide = np.minimum(1 << np.ceil(np.log2(np.maximum(rings, 1))).astype(np.int64), len(self.rings[k]))
            wide[rings == 0] = 0
            for ring in np.unique(wide[wide > 0]):
                held = own[wide == ring]
                rivals = np.sort(np.r_[k, self.neighbours[k][:ring]])
                found = distances(parts[held], self.entries[rivals])
                least = found.argmin(axis=1)
                codes[held], best[held] = rivals[least], found[np.arange(len(held)), least]
        return codes, best


def _sums(cells: np.ndarray, codes: np.ndarray, best: np.ndarray, entries: int, into: dict[str, np.ndarray]) -> None:
    """Add one part's vectors to the totals, counts and radii of its balls."""
    into["members"] += np.bincount(codes, minlength=entries)
    np.maximum.at(into["radius"], codes, best)
    np.add.at(into["total"], codes, cells)


def _assign(codebooks: np.ndarray, radii: np.ndarray | None, last: bool) -> Callable[[Batches], Batches]:
    """Assign the parts of vectors; with ``radii`` from their codes before, and not ``last`` with the balls' sums."""
    parts, entries, size = codebooks.shape

    def run(batches: Batches) -> Batches:
        balls = [Balls(codebooks[k], None if radii is None else radii[k]) for k in range(parts)]
        sums = [
            {"members": np.zeros(entries, np.int64), "radius": np.full(entries, -1, np.int64), "total": np.zeros((entries, size), np.int64)}
            for _ in range(parts)
        ]
        for batch in batches:
            for first in range(0, len(batch), STEP):
                rows = batch.slice(first, STEP)
                if radii is None:
                    cells, before = integers(rows.column("vector"), parts * size), None
                else:
                    cells = unpacked(rows.column("cells"), "<i4", parts * size).astype(np.int64)
                    before = unpacked(rows.column("codes"), "u1", parts)
                codes = np.zeros((len(rows), parts), np.uint8)
                error = np.zeros(len(rows), np.int64)
                for k in range(parts):
                    own = cells[:, k * size : (k + 1) * size]
                    found, best = balls[k].first(own) if before is None else balls[k].again(own, before[:, k])
                    codes[:, k] = found
                    error += best
                    if not last:
                        _sums(own, found, best, entries, sums[k])
                named = {"vec_id": rows.column("vec_id"), "label": rows.column("label")}
                if last:
                    named |= {"codes": packed(codes), "error": pa.array(error)}
                else:
                    # all components are below 2**30 in size, see integer_vectors.most
                    named |= {"cells": packed(cells.astype("<i4")), "codes": packed(codes)}
                    named |= {name: pa.nulls(len(rows), pa.int64()) for name in ("part", "entry", "place", "members", "radius", "total")}
                yield pa.RecordBatch.from_pydict(named)
        if not last:
            for k, found in enumerate(sums):
                used = np.flatnonzero(found["members"])
                n = len(used) * size
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": pa.nulls(n, pa.int64()),
                        "label": pa.nulls(n, pa.string()),
                        "cells": pa.nulls(n, pa.binary()),
                        "codes": pa.nulls(n, pa.binary()),
                        "part": pa.array(np.full(n, k, np.int64)),
                        "entry": pa.array(np.repeat(used, size)),
                        "place": pa.array(np.tile(np.arange(size), len(used))),
                        "members": pa.array(np.repeat(found["members"][used], size)),
                        "radius": pa.array(np.repeat(found["radius"][used], size)),
                        "total": pa.array(found["total"][used].ravel()),
                    }
                )

    return run


_ROWS = "vec_id bigint, label string, cells binary, codes binary"
_SUMS = "part bigint, entry bigint, place bigint, members bigint, radius bigint, total bigint"


def _moved(codebooks: np.ndarray, assigned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks, and upper bounds of the squared radii around their entries."""
    sums = assigned.where("part IS NOT NULL").groupBy("part", "entry", "place")
    wide = F.sum(F.col("total").cast("decimal(20,0)"))
    found = sums.agg(F.sum("members").alias("members"), F.max("radius").alias("radius"), wide.alias("total"))
    after, radii = codebooks.copy(), np.zeros(codebooks.shape[:2])
    for row in found.collect():  # one row for each component of the codebooks
        after[row["part"], row["entry"], row["place"]] = int(row["total"]) // row["members"]
        radii[row["part"], row["entry"]] = row["radius"]
    way = np.sqrt(((after - codebooks) ** 2).sum(axis=2).astype(np.float64))
    # a little more than the sum, for the rounding of these square roots
    return after, ((np.sqrt(radii) + way) * (1 + 1e-9) + 1e-6) ** 2


def compress_vectors(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Each vector as one code byte for each part: vec_id, label, codes, error, label_error, codebooks.

    ``codes`` is binary, ``error`` the squared distance of the vector's integers
    floor(256 x) from what the codes stand for, ``label_error`` its sum over the
    rows of a label (NULL labels together), ``codebooks`` all final integers by
    part, entry and place, joined by commas. The codebooks start as the vectors
    of the smallest ids. A part goes to the nearest entry, the lower one in a
    tie; entries without parts stay.

    Vectors that are NULL or hold NULL or non-finite components are dropped. A
    vector shorter than the longest, or than a multiple of ``parts``, ends in
    zeros, an empty one is all zeros, and integers beyond the square root of
    2**58 / width (2**26 at 64 components) are held there. Rows that repeat an
    id are coded each; among the first vectors they come by their components,
    and rows without an id come last. With fewer rows than entries there are
    fewer entries; an empty table gives an empty table. Labels may be of any
    type that text can show. Other columns are not read.
    """
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(whole("vector"))
    shape = shape_of(rows, "vector", parts)
    kind = dict(vectors.select(F.col(label)).dtypes)[label]
    size = shape.width // parts
    # a codebook's worth of rows
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    first = integers(seeds.column("vector"), shape.width)
    codebooks = np.ascontiguousarray(first.reshape(len(first), parts, size).transpose(1, 0, 2))
    radii, assigned = None, []
    for _ in range(rounds if len(first) else 0):
        assigned.append(stored(rows.mapInArrow(_assign(codebooks, radii, False), f"{_ROWS}, {_SUMS}"), "vector-codes"))
        discard(*assigned[:-1])
        codebooks, radii = _moved(codebooks, assigned[-1])
        rows = assigned[-1].where("part IS NULL").select("vec_id", "label", "cells", "codes")
    schema = "vec_id bigint, label string, codes binary, error bigint"
    coded = stored(rows.mapInArrow(_assign(codebooks, radii, True), schema), "vector-codes")
    discard(*assigned)

    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= MOST_LABELS
    same = coded["label"].eqNullSafe(F.col("_label"))
    sums = sums.withColumnRenamed("label", "_label")
    found = coded.join(F.broadcast(sums) if few else sums, same)
    text = ",".join(map(str, codebooks.ravel().tolist()))
    return found.select(
        "vec_id", F.col("label").cast(kind).alias("label"), "codes", "error", "label_error", F.lit(text).alias("codebooks")
    )
