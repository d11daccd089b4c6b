"""Repeated byte strings by distributed prefix doubling on sampled positions.

Of all strings of ``length`` bytes that start in the texts, those that also
start earlier are to go. As in the building of a suffix array by prefix
doubling, a position has a rank for the string of some length that starts
there, pairs of ranks at an offset give the ranks of longer strings, and Spark
brings equal ones together; positions whose rank is unique, or settled
otherwise, leave, the rest go on at a larger offset until the string is as long
as asked for. Ranks are digests, so that any two equal strings have the same one
wherever they are; what Spark decides in each round is who is alone and who is
first. The rounds, for strings of 100 bytes:

1. Rank of 25 bytes. Only one position in about 38 takes part: of each string of
   100 bytes the least of its 76 ranks, the leftmost of equal ones. Equal strings
   choose the same one, so a string whose choice is unique is so itself. The
   strings that choose one position are its cell, a run of starts.
2. Whole cells. Of equal cells, text and all, the later ones are repeats from end
   to end and leave; so do cells whose rank no other cell is left to share.
3. Runs of eight starts, by place before their position. The 93 bytes that all
   strings of a run have in common are a pair of ranks of 50 bytes, at offset 43
   (those of 50 bytes are pairs of 25, at offset 25); runs that are alone with
   theirs leave, and again those that are equal to earlier ones from end to end.
4. Single starts: the pair of ranks of 50 bytes at offset 50 is the string.

Nearly all text is settled in the first two rounds, on one record for each 38
bytes. Only cells at the ends of repeats go further. No group is gathered: the
first of equal records is found by aggregation and joined, records of a
document are as many as its text has bytes at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfare.llm.stored import discard, stored
from skyfare.llm.words import mixed

LENGTH = 100
BLOCK = 8
# Bytes of text that are worked on at once; longer texts come in overlapping chunks.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20250611).integers(1, 1 << 63, 256, dtype=np.uint64)
_LAST_ID = (1 << 63) - 1

Batches = Iterator[pa.RecordBatch]


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_POWERS = _powers(_BASE, 2 * CHUNK_BYTES)
_INVERSES = _powers(_INVERSE, 2 * CHUNK_BYTES)


class Ranks:
    """Digests of any strings of a chunk of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _POWERS[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _INVERSES[starts])

    def doubled(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Ranks of strings of twice ``size`` bytes, from those at their starts and ``size`` further on."""
        first, second = self.of(starts, starts + size), self.of(starts + size, starts + 2 * size)
        return mixed(first * np.uint64(3) + mixed(second))


def first_rank(length: int) -> int:
    """Bytes of the first ranks: doubled twice, they reach the length."""
    return -(-length // 4)


def _signed(found: list[np.ndarray]) -> np.ndarray:
    """All numbers in one array, bit for bit; mixing the two kinds would make them floating."""
    return np.concatenate([np.zeros(0, np.int64), *[x.view(np.int64) for x in found]])


def _chunks(text: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places and bytes of chunks of a text; each start of a string is in one of them, with the whole string."""
    for first in range(0, max(len(text) - length + 1, 0), CHUNK_BYTES):
        yield first, text[first : first + CHUNK_BYTES + length - 1]


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def chosen(ranks: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` ranks the place of the least one, the leftmost of equal ones."""
    bits = np.uint64(len(ranks).bit_length())
    least = ranks >> bits << bits | np.arange(len(ranks), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _cells(text: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """By chunk, the cells of a text: position, first and last start, rank of the position, rank of the cell's text."""
    ranked = first_rank(length)
    window = length - ranked + 1
    for place, data in _chunks(text, length):
        ranks = Ranks(data)
        starts = np.arange(len(data) - ranked + 1)
        least = chosen(ranks.of(starts, starts + ranked), window)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], len(least)] - 1
        at = least[first]
        yield at + place, first + place, last + place, ranks.of(at, at + ranked), ranks.of(first, last + length)


def _cell_lists(length: int) -> Callable[[Batches], Batches]:
    names = ("at", "first", "last", "rank", "whole")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists: dict[str, list[np.ndarray]] = {name: [] for name in names}
            for text in _texts(batch):
                found = list(_cells(text, length))
                for k, name in enumerate(names):
                    lists[name].append(_signed([x[k] for x in found]))
            columns = {"id": batch.column("id"), "twin": batch.column("twin")}
            for name in names:
                sizes = np.cumsum([0, *map(len, lists[name])])
                kind = pa.int64() if name in ("rank", "whole") else pa.int32()
                flat = pa.array(_signed(lists[name])).cast(kind)
                columns[name] = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _run_ranks(length: int, block: int) -> Callable[[Batches], Batches]:
    """Records of the runs that cells or longer runs are cut into: their core's and their whole text's ranks.

    A run holds the starts from ``block`` k to ``block`` (k + 1) - 1 bytes before
    the position, as far as they are in the given range. Its core is the text
    that all strings of the full run share.
    """
    core, ranked = length - block + 1, first_rank(length)

    def of_text(text: np.ndarray, cells: np.ndarray) -> np.ndarray:
        at, first, last = cells.T
        low, high = (at - last) // block, (at - first) // block
        count = high - low + 1
        owner = np.repeat(np.arange(len(at)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
        a = np.maximum(first[owner], at[owner] - block * (k + 1) + 1)
        b = np.minimum(last[owner], at[owner] - block * k)
        origin = at[owner] - block * k
        found = np.zeros((len(owner), 7), np.int64)
        found[:, 0], found[:, 1], found[:, 2], found[:, 3] = origin, a, b, k
        # the runs of a chunk, whose strings it holds
        for place, data in _chunks(text, length):
            own = np.flatnonzero((a >= place) & (a < place + CHUNK_BYTES))
            if not len(own):
                continue
            # a run may begin in this chunk and end beyond it
            piece = text[place : place + CHUNK_BYTES + length + block]
            ranks = Ranks(piece)
            start = origin[own] - place
            left = ranks.doubled(start, ranked)
            right = ranks.doubled(start + core - 2 * ranked, ranked)
            found[own, 4], found[own, 5] = left.view(np.int64), right.view(np.int64)
            found[own, 6] = ranks.of(a[own] - place, b[own] - place + length).view(np.int64)
        return found

    def run(batches: Batches) -> Batches:
        for batch in batches:
            cells = batch.column("cells")
            values = cells.flatten()
            flat = np.stack([np.asarray(values.field(name), np.int64) for name in ("at", "first", "last")], axis=1)
            sizes = np.r_[0, np.cumsum(np.asarray(cells.value_lengths(), np.int64))]
            found = [of_text(text, flat[sizes[k] : sizes[k + 1]]) for k, text in enumerate(_texts(batch))]
            owner = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            rows = np.concatenate(found) if found else np.zeros((0, 7), np.int64)
            named = {"id": batch.column("id").take(owner), "twin": batch.column("twin").take(owner)}
            for k, name in enumerate(("at", "first", "last", "place")):
                named[name] = pa.array(rows[:, k].astype(np.int32))
            for k, name in enumerate(("left", "right", "whole"), 4):
                named[name] = pa.array(rows[:, k])
            yield pa.RecordBatch.from_pydict(named)

    return run


_POSITION = ("id", "twin", "first")


def _sharing(records: DataFrame, rank: list[str]) -> DataFrame:
    """The records whose rank is not theirs alone."""
    shared = records.groupBy(*rank).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return records.join(shared.hint("shuffle_hash"), rank, "left_semi")


def _settled(records: DataFrame, rank: list[str]) -> DataFrame:
    """Whether records repeat an earlier one from end to end, as ``later``.

    Equal records have equal ``rank`` and ``whole``; the first of them is not later.
    """
    same = [*rank, "whole"]
    first = records.groupBy(*same).agg(F.min(F.struct(*_POSITION)).alias("earliest"), F.count(F.lit(1)).alias("n"))
    several = first.where("n > 1").drop("n")
    later = F.col("earliest").isNotNull() & (F.struct(*_POSITION) > F.col("earliest"))
    return records.join(several.hint("shuffle_hash"), same, "left").withColumn("later", later).drop("earliest")


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of starts (id, twin, first, last) of the strings that also start earlier, a start in one of them at most."""
    kinds = "id bigint, twin bigint"
    lists = documents.mapInArrow(
        _cell_lists(length), f"{kinds}, at array<int>, first array<int>, last array<int>, rank array<bigint>, whole array<bigint>"
    )
    lists = stored(lists, "cells")
    ranks = lists.select(F.explode("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    zipped = F.inline(F.arrays_zip("rank", "at", "first", "last", "whole"))
    shared = stored(ranks.where("n > 1").select("rank"), "shared-ranks").hint("shuffle_hash")
    alive = lists.select("id", "twin", zipped).join(shared, "rank", "left_semi")
    # rows that are equal in id and text give the same records, which count once
    texts = lists.groupBy("id", "twin").agg(F.count(F.lit(1)).alias("n"))
    once = texts.where("n > 1").isEmpty()
    records, rank = stored(alive if once else alive.distinct(), "shared-cells"), ["rank"]
    discard(lists)

    found: list[DataFrame] = []
    for block in (0, BLOCK, 1):
        if block:
            cells = F.collect_set(F.struct("at", "first", "last")).alias("cells")
            of_text = _sharing(marked.where("NOT later"), rank).groupBy("id", "twin").agg(cells)
            joined = documents.join(of_text, ["id", "twin"]).select("id", "twin", "text", "cells")
            schema = f"{kinds}, at int, first int, last int, place int, left bigint, right bigint, whole bigint"
            cut = joined.mapInArrow(_run_ranks(length, block), schema)
            rank = ["place", "left", "right"]
            runs = stored(cut if once else cut.distinct(), "runs")
            records = stored(_sharing(runs, rank), "shared-runs")
            discard(runs)
        marked = stored(_settled(records, rank), "settled")
        discard(records)
        found.append(marked.where("later").select("id", "twin", "first", "last"))
    return reduce(DataFrame.unionByName, found)


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Intervals in order, those that touch or overlap as one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]][: len(starts)])
    return np.stack([starts[fresh], np.r_[reach[fresh[1:] - 1], reach[-1:]][: len(fresh)]], axis=1)


def _cut(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            runs = batch.column("runs")
            values = runs.flatten()
            flat = np.stack([np.asarray(values.field(name), np.int64) for name in ("first", "last")], axis=1)
            # a NULL list has no length
            lengths = np.asarray(runs.value_lengths().fill_null(0), np.int64)
            sizes = np.r_[0, np.cumsum(lengths)]
            kept, spans, removed = [], [], []
            for k, text in enumerate(_texts(batch)):
                own = flat[sizes[k] : sizes[k + 1]]
                gone = merged(own[:, 0], own[:, 1] + length)
                between = zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(text)], strict=True)
                kept.append(b"".join(text[a:b].tobytes() for a, b in between))
                spans.append([{"start": a, "end": b} for a, b in gone.tolist()])
                removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
            named = {name: batch.column(name) for name in ("doc_id", "id", "twin")}
            named["n_bytes"] = pa.array([len(text) for text in _texts(batch)], pa.int64())
            named["n_removed"] = pa.array(removed, pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            named["spans"] = pa.array(spans, kind)
            named["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(named)

    return run


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Each text without what it repeats: doc_id, n_bytes, n_removed, spans (start, end), kept.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one. Strings
    are compared as they are in the input, may overlap, and never reach over the
    end of a text. ``spans`` are the maximal runs of removed bytes and ``kept``
    the rest, which need not be valid UTF-8 where a cut is inside a character.

    NULL is an empty text. Texts shorter than ``length`` stay. Rows without an id
    come after all others. Texts under one id come in the order of a hash of
    theirs; of rows that are equal in id and text one is the first, and the
    others lose all they have if it is long enough. Very long texts are worked
    on in chunks; only the last step holds one whole. An empty table gives an
    empty table. Ids are integers; other columns are not read. ``length`` is at
    least 72. Digests have 64 bits, and what decides about a byte are two of them.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.select(
        "doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), F.xxhash64("text").alias("twin"), "text"
    )
    found = repeated_spans(keyed.select("id", "twin", "text"), length)
    runs = found.groupBy("id", "twin").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = keyed.join(runs, ["id", "twin"], "left").select("doc_id", "id", "twin", "text", "runs")
    schema = "doc_id bigint, id bigint, twin bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    cut = stored(joined.mapInArrow(_cut(length), schema), "cut")

    # of rows that are equal in id and text all but one repeat that one
    row = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    placed = cut.select("*", row.alias("row"))
    copies = placed.groupBy("id", "twin").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("one")).where("n > 1")
    copies = stored(copies.drop("n"), "copies")
    if copies.isEmpty():
        return cut.drop("id", "twin")
    whole = (F.col("one") != F.col("row")) & (F.col("n_bytes") >= length)
    marked = placed.join(copies, ["id", "twin"], "left").withColumn("whole", F.coalesce(whole, F.lit(False)))
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    return marked.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("whole"), all_of_it).otherwise(F.col("spans")).alias("spans"),
        F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
