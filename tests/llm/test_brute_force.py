"""Queries that SQL can't express against plain versions of them, over whole tables."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("skyfare.llm")
xxhash = pytest.importorskip("xxhash")

from skyfare.llm import quality, url_filter
from skyfare.llm.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def read(name, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()]


# --- op1: statistics of one text at a time, least squares, isotonic values by their min-max form


def text_statistics(text):
    data = (text or "").encode()
    fold = data.lower()
    words, raw = re.findall(rb"[^\x20\x09-\x0D]+", fold), re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines, raw_lines = re.findall(rb"[^\n\r]+", fold), re.findall(rb"[^\n\r]+", data)
    n, length = max(len(words), 1), np.array([len(w) for w in raw] or [0.0])
    grams = [tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))] if words else []
    share = lambda pattern: len(re.findall(pattern, data)) / max(len(data), 1)
    return {
        "log_bytes": np.log1p(len(data)),
        "lower": share(rb"[a-z]"),
        "upper": share(rb"[A-Z]"),
        "digit": share(rb"[0-9]"),
        "space": share(rb"[ \t\r]"),
        "newline": share(rb"\n"),
        "beyond_ascii": share(rb"[\x80-\xff]"),
        "mark": share(rb"[.,;:]"),
        "bang": share(rb"[!?]"),
        "bar": share(rb"\|"),
        "symbol": share(rb"[#$%&*+=<>@^_~{}\[\]\\/]"),
        "quote": share(rb"[\"'`()-]"),
        "log_words": np.log1p(len(words)),
        "mean_word": np.log1p(length.mean()),
        "word_spread": np.log1p(length.std()),
        "distinct_words": len(set(words)) / n,
        "top_word": max(Counter(words).values(), default=0) / n,
        "same_as_last": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "distinct_grams": len(set(grams)) / max(len(grams), 1),
        "log_lines": np.log1p(len(lines)),
        "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "mean_line": np.log1p(len(data) / max(len(raw_lines), 1)),
        "short_words": sum(len(w) <= 3 for w in raw) / n,
        "symbol_words": sum(w[-1:] in b"#$%&*+=<>@^_~{}[]\\/!?|" for w in raw) / n,
    }


def min_max_isotonic(total, count):
    """The least-squares non-decreasing values: the largest of the smallest means that hold each place."""
    t, c = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(count)]
    at = range(len(total))
    mean = [[(t[b + 1] - t[a]) / (c[b + 1] - c[a]) if b >= a else None for b in at] for a in at]
    return np.array([max(min(mean[a][b] for b in at if b >= k) for a in at if a <= k) for k in at])


def test_quality_scores_equal_a_plain_fit(spark):
    documents = read("documents", "doc_id", "text")
    x = np.array([[text_statistics(t)[name] for name in quality.FEATURES] for _, t in documents])
    labels = {}
    for doc_id, label in read("labels", "doc_id", "quality"):
        if label is not None:
            labels.setdefault(doc_id, []).append(float(label))
    part = {d: zlib.crc32(str(d).encode()) % 5 for d, _ in documents}
    y = {d: np.mean(v) for d, v in labels.items()}

    rng = np.random.default_rng(7)
    m = quality.RANDOM_FEATURES
    directions = rng.normal(0, np.sqrt(1 / x.shape[1]), (x.shape[1], m))
    phases = rng.uniform(0, 2 * np.pi, m)
    scaled = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
    z = np.sqrt(2 / m) * np.cos(scaled @ directions + phases)
    known = [k for k, (d, _) in enumerate(documents) if d in y]
    fitted = [k for k in known if part[documents[k][0]] in (1, 2, 3)]
    target = np.array([y[documents[k][0]] for k in fitted])
    base = target.mean()
    penalty = np.sqrt(quality.RIDGE * len(fitted)) * np.eye(m)
    weights = np.linalg.lstsq(np.r_[z[fitted], penalty], np.r_[target - base, np.zeros(m)], rcond=None)[0]
    raw = base + z @ weights

    bins: dict[int, list[float]] = {}
    for k in known:
        if part[documents[k][0]] == 4:
            place = int(np.clip(np.floor((raw[k] + 0.5) * quality.SCORE_BINS / 2), 0, quality.SCORE_BINS - 1))
            bins.setdefault(place, []).append(y[documents[k][0]])
    places = sorted(bins)
    total, count = [sum(bins[b]) for b in places], [len(bins[b]) for b in places]
    centre = (np.array(places) + 0.5) * 2 / quality.SCORE_BINS - 0.5
    values = np.round(min_max_isotonic(total, count), 12)
    levels = np.unique(values)
    steps = [np.average(centre[values == v], weights=np.array(count)[values == v]) for v in levels]
    expected = np.clip(0.999 * np.interp(raw, steps, levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)

    found = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, SF_DIR).collect()}
    assert len(found) == len(documents)
    scores = np.array([found[d].score for d, _ in documents])
    assert np.abs(scores - expected).max() < 1e-6
    for d, _ in documents:
        assert found[d].held_out == (part[d] == 0) and found[d].predicted == (found[d].score >= 0.3)

    held = [(found[d].score, y[d]) for d in y if d in found and part[d] == 0]
    good, bad = [s for s, v in held if v == 1], [s for s, v in held if v == 0]
    area = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert area > 0.98, (len(good), len(bad), area)


def test_statistics_do_not_depend_on_the_texts_beside():
    texts = ["same", "same", "", "a b", "b b a", "same\nsame", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    together = quality.statistics(data, np.r_[0, np.cumsum([len(t) for t in texts])])
    alone = [[text_statistics(t)[name] for name in quality.FEATURES] for t in texts]
    assert np.allclose(together, alone)


# --- op8: the contract's rules in the contract's order, and the regression with numpy

FITTING = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), slash + path


def hashed_grams(host, path):
    marked = f"^{host}{path}$"
    padded = marked + "$$"
    return [xxhash.xxh64_intdigest(padded[k : k + 3].encode(), seed=42) % url_filter.BUCKETS for k in range(len(marked))]


def test_url_verdicts_equal_a_plain_version(spark):
    texts = [(s.format(w=w), y) for y, ws in ((0, url_filter.WANTED), (1, url_filter.UNWANTED)) for w in ws for s in url_filter.SHAPES]
    texts += [(t, 0) for t in url_filter.ORDINARY]

    def row(url):
        counts = np.bincount(hashed_grams(*host_and_path(url)), minlength=url_filter.BUCKETS)
        return np.r_[counts / np.sqrt(counts.sum()), 1.0]

    x = np.array([row(f"http://{t}") for t, _ in texts])
    y = np.array([v for _, v in texts], float)
    weights, pace = np.zeros(url_filter.BUCKETS + 1), np.zeros(url_filter.BUCKETS + 1)
    for _ in range(url_filter.STEPS):
        error = 1 / (1 + np.exp(-x @ weights)) - y
        pace = url_filter.MOMENTUM * pace - url_filter.RATE * x.T @ error / len(x)
        weights = weights + pace

    pages = read("pages", "page_id", "url")
    found = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, SF_DIR).collect()}
    assert len(found) == len(pages)
    for page_id, url in pages:
        host, path = host_and_path(url)
        fits = [(len(h + p), v, h + p) for v, h, p in FITTING if (host == h or host.endswith("." + h)) and path.startswith(p)]
        score = 1 / (1 + np.exp(-row(url) @ weights))
        _, verdict, rule = max(fits, default=(0, "block" if score >= 0.5 else "allow", None))
        got = found[page_id]
        assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict), url
        assert abs(got.score - score) < 1e-9


# --- op10: the contract's base patterns over every text


def luhn(figures):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(figures))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def figures(match):
    return re.sub("[^0-9]", "", match)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda s: 14 <= len(figures(s)) <= 19 and luhn(figures(s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(figures(s)) <= 15),
}


def test_base_spans_equal_a_plain_version(spark):
    kinds = list(BASE)
    documents = read("documents", "doc_id", "text")
    found = {r.doc_id: r for r in QUERIES["op10_personal_data"](spark, SF_DIR).collect()}
    assert len(found) == len(documents)
    for doc_id, text in documents:
        spans = []
        for kind, (pattern, right) in BASE.items():
            spans += [(m.start(), kinds.index(kind), m.end()) for m in re.finditer(pattern, text or "") if right(m.group())]
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        got = found[doc_id]
        counts = Counter(s.split(":")[0] for s in listed)
        assert [got[f"n_{kind}"] for kind in kinds] == [counts[kind] for kind in kinds], doc_id
        assert got.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), doc_id
        every = got.spans.split(",") if got.spans else []
        assert set(listed) <= set(every) and len(set(every)) == len(every)
        order = [(int(a), kinds.index(kind), int(b)) for kind, a, b in (s.split(":") for s in every)]
        assert order == sorted(order) and all(0 <= a < b <= len(text) for a, _, b in order)
