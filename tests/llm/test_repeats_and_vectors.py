"""Repeated text, hard negatives and vector codes against brute force, on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("skyfare.llm")

from skyfare.llm import hard_negatives as negatives
from skyfare.llm import repeated_text, vector_codes
from skyfare.llm.hard_negatives import hard_negatives, planes_of, scores, subset_sums
from skyfare.llm.repeated_text import remove_repeats
from skyfare.llm.vector_codes import Balls, compress_vectors, distances

# --- repeated text


def brute_repeats(rows, length=100):
    """Per row (in the operator's order): removed spans and what is left."""
    seen, result = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        spans, k = [], 0
        while k < len(raw):
            end = k
            while end < len(raw) and gone[end]:
                end += 1
            if end > k:
                spans.append((k, end))
            k = max(end, k + 1)
        result.append((len(raw), spans, bytes(b for b, out in zip(raw, gone, strict=True) if not out)))
    return result


def found_repeats(spark, rows, schema="doc_id bigint, text string, id string, runs int, first int"):
    frame = spark.createDataFrame([(*row, "x", 1, 2) for row in rows], schema).repartition(3)
    return [
        (r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept), r.n_removed)
        for r in remove_repeats(frame).collect()
    ]


def check_repeats(spark, rows):
    """Rows with different ids, given in the order of the ids."""
    expected = [(k, n, spans, kept, sum(b - a for a, b in spans)) for (k, _), (n, spans, kept) in zip(rows, brute_repeats([t for _, t in rows]), strict=True)]
    assert sorted(found_repeats(spark, rows)) == expected


def some_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(rng.randint(5, 80))) for _ in range(6)]
    texts = []
    for _ in range(25):
        text = "".join(rng.choice([*passages, word(), word()]) for _ in range(rng.randint(0, 8)))
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "Z", "é"]) + text[at + rng.randint(0, 2) :]
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    check_repeats(spark, [(k * 3 - 20, text) for k, text in enumerate(some_texts(seed))])


def test_repeats_in_runs_of_one_letter_and_periods(spark):
    passage = "".join(chr(97 + k * k % 26) + str(k) for k in range(60))
    texts = ["a" * 99, "a" * 100, "b" * 350, "ab" * 120, "ba" * 70, "abc" * 60 + "d", passage, "x" + passage + "y" + passage[1:], passage[:-1] + "é" + passage]
    check_repeats(spark, list(enumerate([*texts, "", None, "c" * 101 + "d" * 100])))


def test_repeats_over_the_ends_of_chunks(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [passage, "-" * 77 + passage[500:2500] + passage[100:400], passage[:1000] + passage]
    expected = brute_repeats(texts)
    # chunks are cut inside of tasks; the same code is run here on small ones
    monkeypatch.setattr(repeated_text, "CHUNK_BYTES", 256)
    keep = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    cells = [list(repeated_text._cells(data, 100)) for data in keep]
    starts = [sorted(s for x in found for a, b in zip(x[1], x[2], strict=True) for s in range(a, b + 1)) for found in cells]
    assert starts == [list(range(len(data) - 99)) for data in keep]
    assert all(n == len(t) for (n, _, _), t in zip(expected, texts, strict=True))


def test_repeats_in_a_text_of_several_chunks(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(repeated_text.CHUNK_BYTES + 5000))
    around = long[repeated_text.CHUNK_BYTES - 700 : repeated_text.CHUNK_BYTES + 900]
    check_repeats(spark, [(1, long), (2, f"<{around}>"), (3, long[-300:] + "!" + around[5:])])


def test_repeats_under_one_id_and_without(spark):
    rng = random.Random(7)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b + a), (None, a), (None, None), (2, "short"), (2, "short"), (0, None)]
    found = found_repeats(spark, rows)
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for doc_id, n, spans, kept, _ in found:
        by_id[doc_id].append((n, spans, kept))
    # a stays once, alone or as a part of b + a, and b stays
    assert sum(len(kept) for _, _, kept in by_id[1]) == 600
    assert sorted(by_id[None]) == [(0, [], b""), (300, [(0, 300)], b"")]
    assert by_id[2] == [(5, [], b"short")] * 2 and by_id[0] == [(0, [], b"")]


def test_repeats_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(frame).collect() == []
    assert remove_repeats(spark.createDataFrame([(None, None)], "doc_id bigint, text string")).count() == 1


# --- vectors

ODD = [
    (1, [0.5, -0.25, None], 1),
    (2, [0.5, math.nan, 1.0], 1),
    (3, [math.inf, 0.0, 1.0], 1),
    (4, None, 1),
]
SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, vector int, error string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA).repartition(3)


def usable(rows):
    return [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whole_numbers(vector, width):
    return [math.floor(256 * Fraction(x)) for x in vector] + [0] * (width - len(vector))


def some_vectors(seed, n, width=24, spread=0.6):
    rng = random.Random(seed)
    few = [[rng.uniform(-spread, spread) for _ in range(width)] for _ in range(n // 3)]
    rows = []
    for k in range(n):
        vector = list(rng.choice(few)) if rng.random() < 0.3 else [rng.gauss(0, spread / 3) for _ in range(width)]
        rows.append((k, vector, rng.choice([0, 1, 2, None]) if k % 9 else 1))
    rng.shuffle(rows)
    return rows


def brute_negatives(rows, every, positives=5, most=3):
    width = max((len(v) for _, v, _ in usable(rows)), default=0)
    cells = {i: (x, whole_numbers(v, width)) for i, v, x in usable(rows) if x is not None and i is not None}
    found = []
    for a, (label, vector) in cells.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(vector, other, strict=True)) for i, (_, other) in cells.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if cells[i][0] == label][:positives]:
            hard = [i for i in order if cells[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            found += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(hard[:most], 1)]
    return sorted(found)


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for kind, top in ((np.int32, 300), (np.int64, 1 << 26)):
        anchors, candidates = rng.integers(-top, top + 1, (7, 32)).astype(kind), rng.integers(-top, top + 1, (50, 32))
        candidates[0], candidates[1] = top, -top
        bits = top.bit_length() + 1
        planes = planes_of(candidates, bits)
        assert (scores(subset_sums(anchors), planes) == candidates @ anchors.astype(np.int64).T).all()
        assert (negatives._cells(planes.reshape(50, -1), bits, np.int64) == candidates).all()


@pytest.mark.parametrize("seed", range(2))
def test_negatives_against_brute_force(spark, monkeypatch, seed):
    rows = some_vectors(seed, 120, spread=(0.6, 40.0)[seed]) + [(1000 + i, v, x) for i, v, x in ODD] + [(2000, [0.5] * 7, 1), (2010, [], 2)]
    monkeypatch.setattr(negatives, "ANCHORS_IN_TILE", 9)
    monkeypatch.setattr(negatives, "CANDIDATES_IN_TILE", 40)
    found = hard_negatives(frame_of(spark, rows), negatives.F.col("id") % 10 == 0)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[name] for name in names) for r in found.collect()) == brute_negatives(rows, 10)


def test_negatives_of_odd_tables(spark):
    assert hard_negatives(frame_of(spark, [])).collect() == []
    assert hard_negatives(frame_of(spark, ODD)).collect() == []
    # rows without an id or label take no part, repeated rows count once
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.7, 0.0], 2), (4, [0.8, 0.0], None), (None, [0.9, 0.0], 2)]
    once = sorted(map(tuple, hard_negatives(frame_of(spark, rows)).collect()))
    assert once == sorted(map(tuple, hard_negatives(frame_of(spark, rows * 3)).collect()))
    assert [r[:4] for r in once] == [(1, 2, 1, 3), (2, 1, 1, 3)]
    # integers beyond the bound are held there
    assert hard_negatives(frame_of(spark, [(1, [1e300, -1e300], 1), (2, [1e300, -1e300], 1)])).collect() == []


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = usable(rows)
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts) * parts or parts
    size = width // parts
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cells = [whole_numbers(v, width) for _, v, _ in kept]
    cut = [[c[k * size : (k + 1) * size] for k in range(parts)] for c in cells]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(c[k], books[k])[1]].append(c[k])
            for j, members in held.items():
                books[k][j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [[near(c[k], books[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    text = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        (str(i), bytes(j for _, j in f).hex(), error, by_label[x], digest) for (i, _, x), f, error in zip(kept, found, errors, strict=True)
    )


def found_codes(spark, rows):
    found = compress_vectors(frame_of(spark, rows)).collect()
    return sorted((str(r.vec_id), r.codes.hex(), r.error, r.label_error, hashlib.sha256(r.codebooks.encode()).hexdigest()) for r in found)


@pytest.mark.parametrize("seed", range(2))
def test_codes_against_brute_force(spark, seed):
    rows = some_vectors(seed, 150, width=(32, 20)[seed], spread=(0.6, 30.0)[seed])
    rows += [(None, rows[0][1], None), (5, rows[1][1], 7), *[(1000 + i, v, x) for i, v, x in ODD], (3000, [], 3), (3001, [0.25] * 5, 3)]
    assert found_codes(spark, rows) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert found_codes(spark, []) == [] and found_codes(spark, ODD) == []
    few = some_vectors(3, 5, width=16)
    assert found_codes(spark, few * 2) == brute_codes(few * 2)
    (row,) = found_codes(spark, [(1, [1e308, -1e308], 1)])
    assert row[2] == 0


def test_balls_skip_and_find_the_same():
    rng = np.random.default_rng(4)
    parts = rng.integers(-300, 300, (4000, 4))
    entries = np.concatenate([parts[:60], parts[:4]])
    codes, best = Balls(entries, None).first(parts)
    moved = entries + rng.integers(-9, 10, entries.shape)
    own = ((parts - moved[codes]) ** 2).sum(axis=1)
    radii = np.array([own[codes == k].max(initial=-1) for k in range(len(moved))])
    balls = Balls(moved, radii)
    again, least = balls.again(parts, codes.astype(np.uint8))
    full = distances(parts, moved)
    assert (again == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
    # cores are skipped and rings are short of all entries
    rings = np.array([np.searchsorted(balls.rings[k], 4 * d, "right") for k, d in zip(codes, own, strict=True)])
    assert (rings == 0).any() and rings.mean() < 32
