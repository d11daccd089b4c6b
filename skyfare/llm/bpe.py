"""Byte-pair encoding and decoding in linear time.

Encoding looks for the token sequence in which every two neighbours are
compatible: the merges that form them leave the border between them alone.
There is exactly one, the result of merging by rank. From the left, the longest
token that begins at a place is tried first, found by one Aho-Corasick pass
over the word; if it is not compatible with the token before it, the next
shorter token that is its prefix is, and if none is, the token before is taken
back. A place from which the end can't be reached is marked and not tried again.

Decoding copies each token's bytes out of one table by an array of offsets.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfare.llm.units import Pieces, chunks, joinable

# Fixed value: the pattern by which byte-level vocabularies of this kind cut words.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> str:
    """The character that stands for each byte in such vocabularies.

    Printable bytes stand for themselves; the others get the characters from
    U+0100 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))

# Pieces, and parts of them, that a worker remembers: some 350 MB in all. Merging anew costs more than looking up.
MOST_KNOWN = 700_000


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        self.letter_of = dict(enumerate(letters))
        vocabulary: dict[str, int] = described["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.token_of = vocabulary
        self.length = {number: len(token) for token, number in vocabulary.items()}
        # the merge that makes a token, and of which rank
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(described["model"]["merges"]):
            pair = vocabulary[left], vocabulary[right]
            self.merge_rank[pair] = rank
            self.made_of.setdefault(vocabulary[left + right], (rank, *pair))
        # the longest shorter token that a token begins with
        self.shorter: dict[int, int] = {}
        self.matches = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            self.matches.add_word(token, (number, len(token)))
            for end in range(len(token) - 1, 0, -1):
                if token[:end] in vocabulary:
                    self.shorter[number] = vocabulary[token[:end]]
                    break
        self.matches.make_automaton()
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORD_PATTERN)
        # decoding: all tokens' bytes, and where each begins
        byte_of = {letter: b for b, letter in enumerate(letters)}
        tokens = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, number in vocabulary.items():
            tokens[number] = bytes(byte_of[x] for x in token)
        for token, number in self.special.items():
            tokens[number] = token.encode()
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(x) for x in tokens])]
        names = tuple(self.special)
        self.rest = Pieces(self._parts, " ", lambda piece: joinable(piece, names), MOST_KNOWN, MOST_KNOWN)
        self.heads = Pieces(self._parts, "", lambda piece: not piece or joinable(piece, names))
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + ")") if names else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side.

        Goes back through the merges of both, the latest first, and asks at
        each stage whether the tokens then at the border would have merged
        before that stage was over. Of merges of one rank, the left comes first.
        """
        known = self.compatible_pairs.get((left, right))
        if known is not None:
            return known
        x, y, limit, result = left, right, len(self.merge_rank), True
        while True:
            if self.merge_rank.get((x, y), limit) < limit:
                result = False
                break
            made_x, made_y = self.made_of.get(x), self.made_of.get(y)
            if made_x and (not made_y or made_x[0] > made_y[0]):
                limit, x = made_x[0], made_x[2]
            elif made_y:
                # the border pair stands left of y's own merge and wins at equal rank
                limit, y = made_y[0] + 1, made_y[1]
            else:
                break
        self.compatible_pairs[left, right] = result
        return result

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word, given in byte letters."""
        number = self.token_of.get(word)
        if number is not None:
            return [number]
        longest = [0] * len(word)
        reach = [0] * len(word)
        for end, (number, length) in self.matches.iter(word):
            if length > reach[end - length + 1]:
                reach[end - length + 1], longest[end - length + 1] = length, number
        size, shorter, compatible = self.length, self.shorter, self.compatible
        found: list[int] = []
        dead = bytearray(len(word) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not found or compatible(found[-1], token)):
                found.append(token)
                at = end
                if at == len(word):
                    return found
                token = longest[at]
                continue
            while (follow := shorter.get(token)) is None:
                dead[at] = 1
                token = found.pop()
                at -= size[token]
            token = follow

    def _plain(self, text: str) -> bytes:
        ids = array("I")
        for word in self.words.findall(text):
            ids.extend(self.encode_word(word.encode().decode("latin-1").translate(self.letter_of)))
        return ids.tobytes()

    def _parts(self, parts: list[str]) -> list[bytes]:
        return [self._plain(part) for part in parts]

    def _whole(self, text: str) -> bytes:
        if not self.cut_special:
            return self._plain(text)
        cut = self.cut_special.split(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(cut))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts as little-endian unsigned 32-bit integers."""
        cut = [text.split(" ") for text in texts]
        heads = [pieces.pop(0) for pieces in cut]
        self.heads.learn(set(heads))
        self.rest.learn(set().union(*cut))
        result = []
        for text, head, pieces in zip(texts, heads, cut, strict=True):
            try:
                result.append(self.heads.table[head] + b"".join(map(self.rest.table.__getitem__, pieces)))
            except TypeError:  # a piece that can't stand alone
                result.append(self._whole(text))
        return result

    def decode(self, ids: bytes) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        first, size = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        total = np.cumsum(size)
        at = np.repeat(first - total + size, size) + np.arange(total[-1] if len(total) else 0)
        return self.blob[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary of a file, loaded once for each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _encoded(path: str, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                ids = own.encode(texts)
                columns = {"row": rows.column("row"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                columns["ids"] = pa.array(ids, pa.binary())
                if decoded:
                    columns["decoded"] = pa.array([own.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def encode_documents(
    documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """One row for each document row: doc_id, n_tokens, ids and, if asked for, decoded.

    ``path`` is a byte-level vocabulary file, on every machine. ``ids`` are the
    token ids as little-endian unsigned 32-bit integers, ``decoded`` the text
    that they stand for. A special token's text inside a document is that
    token. NULL and empty texts have no tokens and decode to the empty text.
    Repeated rows and NULL ids stay, an empty table gives an empty table, and
    other columns are not read.
    """
    frame = documents.select(F.col(doc_id).alias("row"), F.col(text).alias("text"))
    schema = f"row {dict(frame.dtypes)['row']}, n_tokens bigint, ids binary"
    found = frame.mapInArrow(_encoded(path, decoded), schema + (", decoded string" if decoded else ""))
    return found.withColumnRenamed("row", "doc_id")


def _decoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for batch in batches:
            texts = [own.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    return run


def decode_documents(encoded: DataFrame, path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and decoded text of ids as ``encode_documents`` gives them; NULL ids are none."""
    frame = encoded.select(F.col(doc_id).alias("row"), F.col(ids).alias("ids"))
    found = frame.mapInArrow(_decoded(path), f"row {dict(frame.dtypes)['row']}, decoded string")
    return found.withColumnRenamed("row", "doc_id")
