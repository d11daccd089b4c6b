"""Encode texts piece by piece, each distinct piece once.

A text is cut at every ASCII space. For a tokenizer whose words never reach
over such a cut, the tokens of the text are those of its pieces, one after the
other. Natural text repeats its pieces, so most are found in a table. A piece
that is not is cut once more, before the symbols it ends with, and only parts
that are new as well are encoded.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

# Spark runs a task on each core already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# What a table remembers at most, about 120 MB; it starts anew beyond it.
MOST_PIECES = 400_000
MOST_PARTS = 250_000
# Characters of text that are worked on at once.
BATCH_CHARS = 2_000_000
# Symbols that never join a letter or digit before them.
END_SYMBOLS = "!#$%&*.,;:?()"

_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding, loaded once for each worker."""
    if path not in _tokenizers:
        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def joinable(piece: str, special: tuple[str, ...]) -> bool:
    """Whether a piece stands for itself where spaces belong to the word after them.

    Not so if white space touches the cut, or a special token's text, which is
    found before words are. (U+180E is white space to some.)
    """
    if not piece or piece[0].isspace() or piece[-1].isspace() or "᠎" in piece:
        return False
    return not any(x in piece for x in special)


def split_end(piece: str) -> str:
    """A piece without the symbols at its end; all of it if they may belong together."""
    stem = piece.rstrip(END_SYMBOLS)
    # a letter may become a letter and a mark in lower case
    if stem and stem[-1].isalnum() and stem[-1].lower()[-1].isalnum():
        return stem
    return piece


class Pieces:
    """A table from pieces to what ``encode`` makes of them (numbers or bytes, which add up).

    ``prefix`` precedes each piece in its text. ``alone`` tells whether a piece
    can be encoded by itself; one that can't has the value None.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Iterable[Any]],
        prefix: str = "",
        alone: Callable[[str], bool] | None = None,
        most_pieces: int = MOST_PIECES,
        most_parts: int = MOST_PARTS,
    ):
        self.encode, self.prefix, self.alone = encode, prefix, alone
        self.most_pieces, self.most_parts = most_pieces, most_parts
        self.table: dict[str, Any] = {}
        self.parts: dict[str, Any] = {}
        self.ends: dict[str, Any] = {}

    def _values(self, known: dict[str, Any], parts: list[str], prefix: str) -> Iterable[Any]:
        new = list(set(parts).difference(known))
        known.update(zip(new, self.encode([prefix + x for x in new] if prefix else new), strict=True))
        return map(known.__getitem__, parts)

    def learn(self, pieces: set[str]) -> None:
        unknown = pieces.difference(self.table)
        if len(self.table) + len(unknown) > self.most_pieces:
            self.table, unknown = {}, pieces
        if len(self.parts) > self.most_parts:
            self.parts = {}
        whole = list(unknown)
        stems = list(map(split_end, whole))
        ends = [x[len(stem) :] for x, stem in zip(whole, stems, strict=True)]
        empty = next(iter(self.encode([""])))
        self.ends.setdefault("", empty)
        values = zip(self._values(self.parts, stems, self.prefix), self._values(self.ends, ends, ""), strict=True)
        self.table.update(zip(whole, (a + b if b else a for a, b in values), strict=True))
        if self.alone:
            self.table.update((x, None) for x in whole if not self.alone(x))
        if len(self.ends) > self.most_parts:
            self.ends = {}


def chunks(batch: pa.RecordBatch, column: str, most_chars: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with about so many characters of text at a time; NULL is empty."""
    first, waiting, chars = 0, [], 0
    for text in batch.column(column):
        waiting.append(text.as_py() or "")
        chars += len(waiting[-1])
        if chars > most_chars:
            yield batch.slice(first, len(waiting)), waiting
            first, waiting, chars = first + len(waiting), [], 0
    if waiting:
        yield batch.slice(first, len(waiting)), waiting
