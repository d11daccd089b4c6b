"""Token ids in compressed files: canonical length-limited Huffman codes in independent blocks.

Documents are laid out in ascending order of their ids. A block holds whole
documents, about ``BLOCK_TOKENS`` ids, and is decoded by itself. In a block,
the bit offset of every ``EVERY``-th id is a checkpoint; decoding proceeds from
all checkpoints at once, one table look-up for each id. The codes come from the
ids' counts over the whole corpus and need only their lengths to be restored.

A folder of token files holds two Parquet tables: ``codes`` (id, length) and
``blocks`` (start, doc_ids, sizes, checkpoints, bits).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.llm.stored import stored
from skyfare.llm.units import tokenizer
from skyfare.llm.words import slices

BLOCK_TOKENS = 1 << 17
EVERY = 128
# Ids that are looked up in a table of places.
LARGEST_TABLE = 1 << 24
# Bits of the longest code, where no more symbols occur than have codes of that length.
LONGEST_CODE = 18
# Distinct pieces of text whose ids a worker remembers, in about 150 MB; it starts anew beyond it.
MOST_PIECES = 1_000_000
# Distinct words of plain pieces, as many in about as much memory. They outlast the pieces.
MOST_WORDS = 800_000
# Characters of the longest word that is remembered.
LONGEST_KEPT = 64
# Bytes of text that are worked on at once.
TEXT_BYTES = 1 << 23

Batches = Iterator[pa.RecordBatch]

# Text that the normaliser leaves as it is, but for white space, and whose words the
# pattern finds by kind of character alone: ASCII without capitals, apostrophes and
# special tokens, and the small letters of Latin-1.
_PLAIN = re.compile(r"[\t\n\r!-&(-;=-@\[-{}~\xdf-\xf6\xf8-\xff]+")
_WORDS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|\0|[^\0\t\n\ra-z0-9\xdf-\xf6\xf8-\xff]+")

# The model spells bytes: printable ones of Latin-1 as they are, the others from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SPELLED = {b: 256 + k for k, b in enumerate(_OTHERS)}

_encoders: dict[str, Encoder] = {}


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts with A-Z in lower case, as the tokenizer's normaliser has them; not where that could make a special token's text."""
    lower = _LOWER[data]
    if b"<|" in data.tobytes():
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b"<|" in data[a:b].tobytes():
                lower[a:b] = data[a:b]
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(lower)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)


class Encoder:
    """Ids of whole texts, for tokenizers that lower-case and drop white space: any piece between spaces stands alone.

    Each distinct piece is looked up once, and each distinct word of new plain
    pieces merged once; the ids of all pieces lie one after the other in one
    array, and texts are put together from it by arrays of places.
    """

    def __init__(self, path: str, most: int = MOST_PIECES) -> None:
        self.tokenizer, self.most = tokenizer(path), most
        self.words: dict[str, bytes] = {"\0": b""}  # pieces are laid end to end with this in between
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    def _merged(self, pieces: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of plain pieces, one after the other, and the number of each piece's."""
        words, merge = self.words, self.tokenizer.model.tokenize
        cut = _WORDS.findall("\0".join([*pieces, ""]))
        unknown = set(cut).difference(words)
        for word in unknown:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED)
            words[word] = array("I", [t.id for t in merge(spelled)]).tobytes()
        ids = list(map(words.__getitem__, cut))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends = np.fromiter(map("\0".__eq__, cut), bool, len(cut))
        for word in unknown:
            if len(word) > LONGEST_KEPT:
                del words[word]
        if len(words) > MOST_WORDS:
            self.words = {"\0": b""}
        return b"".join(ids), np.diff(np.r_[0, np.cumsum(sizes)[ends]])

    def _learn(self, new: list[str]) -> np.ndarray:
        """Remember the ids of new pieces; returns where they are."""
        is_plain = np.fromiter((_PLAIN.fullmatch(x) is not None for x in new), bool, len(new))
        order = np.r_[np.flatnonzero(is_plain), np.flatnonzero(~is_plain)]
        ids, sizes = self._merged([new[k] for k in order[: is_plain.sum()].tolist()])
        rest = self.tokenizer.encode_batch_fast([new[k] for k in order[is_plain.sum() :].tolist()], add_special_tokens=False)
        own = [array("I", e.ids).tobytes() for e in rest]
        self.ids.append(np.frombuffer(b"".join([ids, *own]), np.uint32))
        self.sizes.append(np.r_[sizes, np.fromiter(map(len, own), np.int64, len(own)) // 4])
        at = np.empty(len(new), np.int64)
        at[order] = np.arange(len(self.place), len(self.place) + len(new))
        self.place.update(zip(new, at.tolist(), strict=True))
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of some bytes, one after the other, and the number of each text's."""
        cut = pc.split_pattern(_folded(data, offsets), " ")
        pieces = cut.flatten().dictionary_encode()
        # far faster than to_pylist, which makes a scalar of each
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(distinct) > self.most:
            self._forget()
        found = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            found[fresh] = self._learn([distinct[k] for k in fresh.tolist()])
        flat, size = np.concatenate(self.ids), np.concatenate(self.sizes)
        self.ids, self.sizes = [flat], [size]
        at = found[np.asarray(pieces.indices)]
        counts = size[at]
        ends = np.cumsum(counts)
        first = (np.cumsum(size) - size)[at]
        total = int(ends[-1]) if len(ends) else 0
        # places in arrays of some millions
        found = flat[np.repeat((first - (ends - counts)).astype(np.int32), counts) + np.arange(total, dtype=np.int32)]
        bounds = np.r_[0, np.cumsum(np.asarray(cut.value_lengths(), np.int64))]
        return found, np.diff(np.r_[0, ends][bounds])


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text as unsigned 32-bit integers."""
    raw = [text.encode() for text in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, sizes = _encoder(path).encode(data, np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum(sizes)
    return [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _raw_blocks(path: str, end_id: int) -> Callable[[Batches], Batches]:
    """Blocks of documents in the order they come: part, number of earlier ids in the part, ids."""

    def run(batches: Batches) -> Batches:
        part, before, docs, sizes, waiting, count = None, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(waiting)
            packed = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
            columns = [[part], [before], [docs], [sizes], [packed.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.list_(docs_kind), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "before", "doc_ids", "sizes", "ids"])

        docs_kind = pa.int64()
        for batch in batches:
            docs_kind = batch.schema.field("doc_id").type
            for rows, data, offsets in slices(batch, "text", TEXT_BYTES):
                part = rows.column("part")[0].as_py()
                ids, lengths = _encoder(path).encode(data, offsets)
                ends = np.cumsum(lengths)
                # an end id after each text
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                ids_of, first = rows.column("doc_id").to_pylist(), 0
                while first < len(ids_of):
                    begin = int(ends[first - 1]) if first else 0
                    # up to the text that fills the block
                    last = min(int(np.searchsorted(ends, begin + BLOCK_TOKENS - count)) + 1, len(ids_of))
                    docs += ids_of[first:last]
                    sizes += (lengths[first:last] + 1).tolist()
                    waiting.append(ids[begin : int(ends[last - 1])])
                    count += len(waiting[-1])
                    first = last
                    if count >= BLOCK_TOKENS:
                        yield block()
                        before, count, docs, sizes, waiting = before + count, 0, [], [], []
        if docs:
            yield block()

    return run


def _unpacked(ids: bytes, size: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * size else "<u4")


def _id_counts(batches: Batches) -> Batches:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids, sizes in zip(batch.column("ids").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            counts = np.bincount(_unpacked(ids, sum(sizes)), minlength=len(total))
            counts[: len(total)] += total
            total = counts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of the best prefix code with no code over ``longest`` bits (package-merge).

    Ties in count go by place. One symbol alone has a code of one bit.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols have no codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    rows, is_coin = [], []
    row, kind = coins, np.ones(n, bool)
    for _ in range(longest - 1):
        rows.append(row)
        is_coin.append(kind)
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[coins, packages]
        sort = np.argsort(both, kind="stable")
        row, kind = both[sort], sort < n
    is_coin.append(kind)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for kind in reversed(is_coin):
        used = int(kind[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    result = np.empty(n, np.int64)
    result[order] = lengths
    return result


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for symbol in order.tolist():
        size = int(lengths[symbol])
        code <<= size - last
        codes[symbol], last = code, size
        code += 1
    return codes


class Book:
    """Codes of the ids that occur, for encoding and decoding."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.lengths = ids[order], lengths[order]
        self.codes = canonical_codes(self.lengths)
        self.longest = int(self.lengths.max(initial=1))
        # where each id of a vocabulary stands; ids beyond any vocabulary are searched for
        last = int(self.ids[-1]) if len(self.ids) else 0
        self.place = np.zeros(last + 1, np.int32) if last < LARGEST_TABLE else None
        if self.place is not None and len(self.ids):
            self.place[self.ids] = np.arange(len(self.ids))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of all codes, and the bit offsets of every EVERY-th."""
        at = np.searchsorted(self.ids, ids) if self.place is None else self.place[ids]
        size = self.lengths[at]
        ends = np.cumsum(size)
        starts = ends - size
        bits = int(ends[-1]) if len(ends) else 0
        # each code lies in the 64 bits that begin at a multiple of 32
        placed = self.codes[at] << (64 - (starts & 31) - size).astype(np.uint64)
        word = starts >> 5
        words = bits // 32 + 2
        high = np.bincount(word, (placed >> np.uint64(32)).astype(float), words)
        low = np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(float), words)
        return (high + low).astype(">u4").tobytes(), starts[::EVERY]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length by the next ``longest`` bits."""
        order = np.lexsort((self.ids, self.lengths))
        span = 1 << (self.longest - self.lengths[order])
        left = (1 << self.longest) - int(span.sum())
        return (
            np.r_[np.repeat(self.ids[order], span), np.zeros(left, np.int64)].astype(np.uint32),
            np.r_[np.repeat(self.lengths[order], span), np.ones(left, np.int64)].astype(np.uint8),
        )


def unpack(bits: bytes, checkpoints: np.ndarray, total: int, longest: int, id_of: np.ndarray, size_of: np.ndarray) -> np.ndarray:
    """The ids of a block, from all checkpoints in step."""
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.array(checkpoints, np.int64)
    found = np.zeros((len(at), EVERY), np.uint32)
    last = len(pairs) - 1
    shift, mask = 64 - longest, np.int64((1 << longest) - 1)
    for k in range(EVERY):
        window = pairs[np.minimum(at >> 5, last)] >> (shift - (at & 31)).astype(np.uint64)
        window = window.astype(np.int64) & mask
        found[:, k] = id_of[window]
        at = at + size_of[window]
    return found.reshape(-1)[:total]


def _packed_blocks(starts: dict[int, int], book: Book) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                sizes = row.column("sizes")[0].as_py()
                bits, checkpoints = book.pack(_unpacked(row.column("ids")[0].as_py(), sum(sizes)))
                start = starts[row.column("part")[0].as_py()] + row.column("before")[0].as_py()
                columns = [
                    pa.array([start], pa.int64()),
                    row.column("doc_ids"),
                    row.column("sizes"),
                    pa.array([checkpoints], pa.list_(pa.int64())),
                    pa.array([bits], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["start", "doc_ids", "sizes", "checkpoints", "bits"])

    return run


def write_tokens(
    documents: DataFrame, path: str, folder: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write the token ids of all documents, each with ``end_id`` after it, to a new folder.

    Documents go in ascending order of their ids, NULL ids first; of equal ids
    the smaller text first, and repeated rows all. NULL and empty texts are
    ``end_id`` alone. An empty table makes a folder without blocks. Other
    columns are not read. ``path`` is a tokenizer file, on every machine, of a
    tokenizer that drops white space.
    """
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(frame.dtypes)["doc_id"]
    ordered = frame.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    block = f"part int, before bigint, doc_ids array<{kind}>, sizes array<bigint>, ids binary"
    raw = stored(ordered.mapInArrow(_raw_blocks(path, end_id), block), "raw-tokens", compression="zstd")

    # one number for each write task, and one for each id of the vocabulary
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = raw.groupBy("part").agg(F.sum(size).alias("n")).orderBy("part").collect()
    starts = dict(zip([row["part"] for row in parts], np.cumsum([0] + [row["n"] for row in parts]).tolist()))  # noqa: B905
    counts = raw.select("ids", "sizes").mapInArrow(_id_counts, "id bigint, n bigint")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    ids = np.array([row["id"] for row in counts], np.int64)
    # there are codes for all symbols, however many occur
    longest = max(LONGEST_CODE, (len(ids) - 1).bit_length())
    lengths = code_lengths(np.array([row["n"] for row in counts], np.int64), longest)

    spark: SparkSession = documents.sparkSession
    codes = [(int(i), int(n)) for i, n in zip(ids, lengths, strict=True)]
    spark.createDataFrame(codes, "id bigint, length bigint").coalesce(1).write.parquet(f"{folder}/codes")
    schema = f"start bigint, doc_ids array<{kind}>, sizes array<bigint>, checkpoints array<bigint>, bits binary"
    packed = raw.mapInArrow(_packed_blocks(starts, Book(ids, lengths)), schema)
    packed.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _documents(codes: list[tuple[int, int]], kind: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        book = Book(np.array([i for i, _ in codes], np.int64), np.array([n for _, n in codes], np.int64))
        tables = book.tables()
        for batch in batches:
            for row in range(len(batch)):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                sizes = np.array(one["sizes"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                checkpoints = one["checkpoints"].values.to_numpy()
                ids = unpack(one["bits"].as_py(), checkpoints, int(ends[-1]), book.longest, *tables).astype("<u4")
                texts = [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [
                    one["doc_ids"].values,
                    pa.array(one["start"].as_py() + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of a folder of token files: doc_id, start, n_tokens, ids.

    ``start`` counts the ids of all documents before it; ``ids`` are unsigned
    little-endian 32-bit integers, the end id last.
    """
    codes = [(row["id"], row["length"]) for row in spark.read.parquet(f"{folder}/codes").collect()]
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_documents(codes, kind), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")
