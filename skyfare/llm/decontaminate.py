"""Benchmark decontamination with an FM-index per shard of training text.

The words of a shard become numbers: its rank among the benchmark's distinct
words, or 0. Runs of such words that are at least as long as the shortest
window are laid end to end with a 0 after each; nothing else can hold a
window. That sequence is suffix-sorted, and its last column goes into a
wavelet tree. Every window is searched backwards, word by word, through ranks
of the tree; its occurrences are found by stepping back to the nearest sampled
suffix position. Spans of occurrences that overlap are merged by counting how
many cover each word.

The index never leaves its task: a shard is a slice of bounded size, so memory
is bounded, and a lost executor's shards are simply indexed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfare.llm.stored import stored
from skyfare.llm.words import ALNUM_WORD, find_words, slices

WINDOW = 10
SAMPLE_EVERY = 8

# Words of the benchmark that are searched at once; their windows take some
# 60 MB. A larger benchmark is searched in several passes.
MOST_WORDS = 200_000


class Windows(NamedTuple):
    """Distinct windows of one length class, by their benchmark word numbers (from 1)."""

    vocabulary: np.ndarray  # sorted word hashes
    words: list[np.ndarray]  # one matrix for each length: window by position
    items: list[list[tuple[int, ...]]]  # item numbers of each window
    names: list[str | None]  # item ids as text, by item number; all items without an id have one number
    shortest: int


def _in_order(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def windows_of(items: list[tuple[str | None, bytes]], size: int = WINDOW) -> Windows:
    """All windows of ``size`` words of (item id, lower-cased text); shorter items are one window."""
    data = np.frombuffer(b"".join(text for _, text in items), np.uint8)
    offsets = np.r_[0, np.cumsum([len(text) for _, text in items])].astype(np.int64)
    found = find_words(data, offsets, ALNUM_WORD)
    vocabulary = np.unique(found.hashes)
    numbers = np.searchsorted(vocabulary, found.hashes) + 1
    names = _in_order({name for name, _ in items})
    number_of = {name: k for k, name in enumerate(names)}
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for d, (name, _) in enumerate(items):
        own = numbers[found.bounds[d] : found.bounds[d + 1]]
        if len(own):
            length = min(size, len(own))
            for k in range(len(own) - length + 1):
                by_length.setdefault(length, {}).setdefault(tuple(own[k : k + length].tolist()), set()).add(
                    number_of[name]
                )
    lengths = sorted(by_length)
    return Windows(
        vocabulary,
        [np.array(list(by_length[n]), np.int64).reshape(-1, n) for n in lengths],
        [[tuple(sorted(x)) for x in by_length[n].values()] for n in lengths],
        names,
        lengths[0] if lengths else 0,
    )


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Positions of a sequence by the order of their suffixes; zeros are distinct, the earlier the smaller.

    Prefix doubling. Only suffixes that still tie are sorted again.
    """
    n = len(sequence)
    zeros = np.cumsum(sequence == 0)
    first = np.where(sequence == 0, zeros - 1, sequence + zeros[-1])
    order = np.argsort(first, kind="stable")
    ranks = np.empty(n, np.int64)

    def place(rows: np.ndarray, at: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Give rows ``at`` of the order the rank of their group's first row; return rows of groups that tie."""
        head = np.flatnonzero(fresh)
        size = np.diff(np.r_[head, len(at)])
        ranks[rows] = np.repeat(at[head], size)
        return np.repeat(size > 1, size)

    keys = first[order]
    at = np.arange(n)
    tied = place(order, at, np.r_[True, keys[1:] != keys[:-1]][:n])
    at, step = at[tied], 1
    while len(at):
        rows = order[at]
        # a zero is never tied, so rows + step stays inside the sequence
        follow = ranks[rows + step]
        group = ranks[rows]
        sort = np.lexsort((follow, group))
        rows, follow, group = rows[sort], follow[sort], group[sort]
        order[at] = rows
        fresh = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        tied = place(rows, at, fresh)
        at, step = at[tied], step * 2
    return order


class FMIndex:
    """Backward search and location over one sequence that ends with 0."""

    def __init__(self, sequence: np.ndarray, symbols: int, every: int = SAMPLE_EVERY):
        n = len(sequence)
        order = suffix_order(sequence)
        last = sequence[order - 1]  # position -1 is the closing 0
        self.before = np.r_[0, np.cumsum(np.bincount(sequence, minlength=symbols))]
        self.levels: list[tuple[np.ndarray, int]] = []
        current = last
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (current >> bit & 1).astype(bool)
            self.levels.append((np.r_[0, np.cumsum(ones)].astype(np.int32), bit))
            # a wavelet tree kept by level: the symbols with a 0 bit move to the front, stably
            current = np.r_[current[~ones], current[ones]]
        # sampled suffixes: every few positions, and each first one of a run, so
        # that no walk crosses a 0
        sampled = np.arange(n) % every == 0
        sampled[0] = True
        sampled[1:] |= sequence[:-1] == 0
        marked = sampled[order]
        self.marked = marked
        self.rank_marked = np.r_[0, np.cumsum(marked)]
        self.samples = order[marked]

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before its row."""
        low, high = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        for ones, bit in self.levels:
            up = (symbols >> bit & 1).astype(bool)
            total = len(ones) - 1 - int(ones[-1])
            one_low, one_high = ones[low], ones[high]
            low = np.where(up, total + one_low, low - one_low)
            high = np.where(up, total + one_high, high - one_high)
        return high - low

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        value, at = np.zeros(len(rows), np.int64), rows.astype(np.int64)
        for ones, bit in self.levels:
            one = ones[at + 1] > ones[at]
            total = len(ones) - 1 - int(ones[-1])
            value |= one.astype(np.int64) << bit
            at = np.where(one, total + ones[at], at - ones[at])
        return value

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (rows of a matrix)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.marked), np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, column]
            low[alive] = self.before[symbols] + self.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at these rows."""
        found = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            hit = self.marked[at]
            found[open_[hit]] = self.samples[self.rank_marked[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            if len(at):
                symbols = self.symbol(at)
                at = self.before[symbols] + self.rank(symbols, at)
                steps += 1
        return found


def occurrences(sequence: np.ndarray, windows: Windows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each length class: class, length, windows and positions of all occurrences in the sequence."""
    index = FMIndex(sequence, len(windows.vocabulary) + 1)
    for k, patterns in enumerate(windows.words):
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        size = (high - low)[hit]
        if len(hit):
            rows = np.repeat(low[hit] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            yield k, patterns.shape[1], np.repeat(hit, size), index.locate(rows)


def matched(data: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """Word bounds by text, words' byte starts and ends with hit flags, and item numbers by text."""
    found = find_words(data, offsets, ALNUM_WORD)
    texts = len(offsets) - 1
    hit = np.zeros(len(found.hashes), bool)
    items: list[set[int]] = [set() for _ in range(texts)]
    if len(windows.vocabulary) and len(found.hashes):
        at = np.minimum(np.searchsorted(windows.vocabulary, found.hashes), len(windows.vocabulary) - 1)
        numbers = np.where(windows.vocabulary[at] == found.hashes, at + 1, 0)
        # runs of benchmark words inside one text
        known = numbers > 0
        begin, stop = known.copy(), known.copy()
        begin[1:] &= ~known[:-1]
        stop[:-1] &= ~known[1:]
        edge = found.bounds[1:-1]
        edge = edge[(edge > 0) & (edge < len(known))]
        begin[edge] = known[edge]
        stop[edge - 1] = known[edge - 1]
        first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = last - first >= windows.shortest
        first, size = first[long], (last - first)[long]
        if len(first):
            laid = np.r_[0, np.cumsum(size + 1)]
            word = np.repeat(first - laid[:-1], size + 1) + np.arange(laid[-1])
            sequence = numbers[np.minimum(word, len(numbers) - 1)]
            sequence[laid[1:] - 1] = 0
            cover = np.zeros(len(hit) + 1, np.int64)
            for k, length, which, position in occurrences(sequence, windows):
                start = word[position]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
                text = np.searchsorted(found.bounds, start, "right") - 1
                for d, w in set(zip(text.tolist(), which.tolist(), strict=True)):
                    items[d].update(windows.items[k][w])
            hit = np.cumsum(cover[:-1]) > 0
    return found, hit, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(windows: Windows, cleaned: str, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over doc_id, text and, from an earlier pass, the word ranges and items so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                found, hit, items = matched(data, offsets, windows)
                names = [{windows.names[k] for k in x} for x in items]
                if "words" in rows.schema.names:
                    earlier = zip(rows.column("words").to_pylist(), rows.column("items").to_pylist(), strict=True)
                    for d, (ranges, more) in enumerate(earlier):
                        names[d].update(more)
                        for r in ranges:
                            hit[found.bounds[d] + r["start"] : found.bounds[d] + r["end"]] = True
                n_hit = np.diff(np.r_[0, np.cumsum(hit)][found.bounds])
                words, spans, texts = [], [], []
                for d in range(len(rows)):
                    a, b = found.bounds[d], found.bounds[d + 1]
                    own = hit_ranges(hit[a:b]) if n_hit[d] else []
                    words.append([{"start": p, "end": q} for p, q in own])
                    cut = [(int(found.starts[a + p]), int(found.ends[a + q - 1])) for p, q in own]
                    spans.append([{"start": s - int(offsets[d]), "end": e - int(offsets[d])} for s, e in cut])
                    if cleaned:
                        at, kept = int(offsets[d]), []
                        for s, e in cut:
                            kept.append(data[at:s].tobytes())
                            at = e
                        kept.append(data[at : offsets[d + 1]].tobytes())
                        texts.append(b"".join(kept).decode() if cut else None)
                columns = {"doc_id": rows.column("doc_id")}
                if not last:
                    columns |= {"text": rows.column("text"), "words": pa.array(words, _SPANS)}
                columns["n_words"] = pa.array(np.diff(found.bounds), pa.int64())
                columns["n_hit"] = pa.array(n_hit, pa.int64())
                columns["items"] = pa.array([_in_order(x) for x in names], pa.list_(pa.string()))
                columns["spans"] = pa.array(spans, _SPANS)
                if cleaned:
                    was = rows.column("text")
                    kept_texts = [was[d].as_py() if t is None else t for d, t in enumerate(texts)]
                    columns[cleaned] = pa.array(kept_texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def hit_ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _blocks(benchmark: DataFrame, item: str, text: str, most_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items, a bounded number of words at a time; one block, perhaps empty, at least."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    block, words = [], 0
    for row in rows.where("text IS NOT NULL").toLocalIterator():
        block.append((row["item"], row["text"].encode()))
        words += len(block[-1][1]) // 2 + 1
        if words > most_words:
            yield block
            block, words = [], 0
    yield block


def find_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    cleaned: str = "",
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_hit, items, spans.

    ``spans`` are the byte spans to remove, ``items`` the ids (as text, sorted)
    of the benchmark items with a window in the document, and one NULL at the
    end for all such items without an id. With ``cleaned``, a
    column of that name holds the text without the spans. NULL and empty texts
    have no words; repeated rows and NULL ids stay, each on its own; items
    without text or words match nothing; an empty benchmark matches nothing.
    Other columns are not read.

    A benchmark of more than ``most_words`` words is searched in several
    passes, stored in between; the spans of a document are merged over them.
    """
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(frame.dtypes)["doc_id"]
    ranges = "array<struct<start: bigint, end: bigint>>"
    found = f"n_words bigint, n_hit bigint, items array<string>, spans {ranges}"
    blocks = _blocks(benchmark, item_id, item_text, most_words)
    block = next(blocks)
    for following in blocks:
        between = frame.mapInArrow(_pass(windows_of(block), "", False), f"doc_id {kind}, text string, words {ranges}, {found}")
        frame, block = stored(between.select("doc_id", "text", "words", "items"), "decontaminate"), following
    closing = f", `{cleaned}` string" if cleaned else ""
    return frame.mapInArrow(_pass(windows_of(block), cleaned, True), f"doc_id {kind}, {found}{closing}")
