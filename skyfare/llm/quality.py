"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a row of statistics. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; ridge regression on them
is fitted from sums of products that every partition forms for itself. Scores
of labelled texts the regression has not seen are then fitted by a
non-decreasing function, which turns a score into the share of good texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfare.llm.stored import stored
from skyfare.llm.words import SPACE_WORD, find_words, mixed, ngrams, slices

FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "newline", "beyond_ascii", "mark", "bang", "bar", "symbol",
    "quote", "log_words", "mean_word", "word_spread", "distinct_words", "top_word", "same_as_last", "distinct_grams",
    "log_lines", "distinct_lines", "mean_line", "short_words", "symbol_words",
)

RANDOM_FEATURES = 384
RIDGE = 1e-3
# Labelled rows that the regression learns from at most: a share of all of them, by a hash of their ids.
MOST_LABELLED = 200_000
SCORE_BINS = 500
THRESHOLD = 0.3

Batches = Iterator[pa.RecordBatch]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_RANGES = {"lower": (97, 123), "upper": (65, 91), "digit": (48, 58), "beyond_ascii": (128, 256)}
_CHARS = {
    "space": " \t\r", "newline": "\n", "mark": ".,;:", "bang": "!?", "bar": "|", "symbol": "#$%&*+=<>@^_~{}[]\\/",
    "quote": "\"'`()-",
}
BYTE_CLASSES = {name: np.isin(np.arange(256), np.arange(a, b)) for name, (a, b) in _RANGES.items()}
BYTE_CLASSES |= {name: _class(chars) for name, chars in _CHARS.items()}
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[[10, 13]] = False


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0.0, np.cumsum(values, dtype=np.float64)][bounds])


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the number of distinct hashes, and how often the most frequent occurs."""
    texts = len(bounds) - 1
    of_text = np.repeat(np.arange(texts), np.diff(bounds))
    keys = mixed(hashes + of_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, of_text[first], counts)
    return np.bincount(of_text[first], minlength=texts), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; shares of nothing are 0."""
    size = np.diff(offsets)
    share = 1 / np.maximum(size, 1)
    column = {"log_bytes": np.log1p(size)}
    for name, table in BYTE_CLASSES.items():
        column[name] = _per_text(table[data], offsets) * share
    words = find_words(data, offsets, SPACE_WORD)
    n = np.diff(words.bounds)
    per_word = 1 / np.maximum(n, 1)
    length = words.ends - words.starts
    mean = _per_text(length, words.bounds) * per_word
    distinct, top = _distinct(words.hashes, words.bounds)
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.bounds[:-1][n > 0]] = False  # the word before is another text's
    grams, gram_bounds = ngrams(words, 5)
    distinct_grams, _ = _distinct(grams, gram_bounds)
    lines = find_words(data, offsets, NOT_NEWLINE)
    n_lines = np.diff(lines.bounds)
    distinct_lines, _ = _distinct(lines.hashes, lines.bounds)
    last = data[words.ends - 1]
    odd = BYTE_CLASSES["symbol"] | BYTE_CLASSES["bang"] | BYTE_CLASSES["bar"]
    column |= {
        "log_words": np.log1p(n),
        "mean_word": np.log1p(mean),
        "word_spread": np.sqrt(np.maximum(_per_text(length.astype(float) ** 2, words.bounds) * per_word - mean**2, 0)),
        "distinct_words": distinct * per_word,
        "top_word": top * per_word,
        "same_as_last": _per_text(same, words.bounds) * per_word,
        "distinct_grams": distinct_grams / np.maximum(np.diff(gram_bounds), 1),
        "log_lines": np.log1p(n_lines),
        "distinct_lines": distinct_lines / np.maximum(n_lines, 1),
        "mean_line": np.log1p(size / np.maximum(n_lines, 1)),
        "short_words": _per_text(length <= 3, words.bounds) * per_word,
        "symbol_words": _per_text(odd[last], words.bounds) * per_word,
    }
    column["word_spread"] = np.log1p(column["word_spread"])
    return np.column_stack([column[name] for name in FEATURES])


def _statistics(batches: Batches) -> Batches:
    for batch in batches:
        for rows, data, offsets in slices(batch, "text"):
            values = statistics(data, offsets)
            arrays = [pa.array(values[:, k], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *arrays], names=["doc_id", *FEATURES])


@dataclass
class Model:
    """Everything a score depends on."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    base: float
    steps: np.ndarray  # raw scores and
    values: np.ndarray  # the share of good texts there

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share; a thousandth of the raw score keeps the order inside a step."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.steps, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES])


def _products(model: Model) -> Callable[[Batches], Batches]:
    """Sums over a partition of z z', z y, z, y and 1, a row of the bordered matrix at a time."""

    def run(batches: Batches) -> Batches:
        total = np.zeros((len(model.phases) + 2,) * 2)
        for batch in batches:
            z = np.column_stack([model.features(_matrix(batch)), np.ones(len(batch)), batch.column("y").to_numpy()])
            total += z.T @ z
        if total.any():
            rows = [row.tobytes() for row in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows)], names=["row", "sums"])

    return run


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
    return pa.table({"row": pa.array(group.column("row")[:1]), "sums": pa.array([total.tobytes()], pa.binary())})


def _raw_bins(model: Model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            bins = np.clip(np.floor((model.raw(_matrix(batch)) + 0.5) * SCORE_BINS / 2), 0, SCORE_BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), batch.column("y")], names=["bin", "y"])

    return run


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours until their means rise: centres and means of the pools, for interpolation."""
    pools: list[list[float]] = []
    for place, s, k in zip(x.tolist(), total.tolist(), n.tolist(), strict=True):
        pools.append([place * k, s, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a, b = pools.pop(), pools.pop()
            pools.append([p + q for p, q in zip(a, b, strict=True)])
    return np.array([p / k for p, _, k in pools]), np.array([s / k for _, s, k in pools])


def fit(features: DataFrame, labelled: DataFrame, seed: int = 7, most: int = MOST_LABELLED) -> Model:
    """A model from rows (doc_id, y, part): parts 1 to 3 for the regression, part 4 for the calibration.

    The scale of the statistics comes from all documents. Where there are no
    labels, every score is 0.5; where only calibration labels are missing, the
    regression's own scores count.
    """
    spreads = [F.stddev_pop(name).alias(f"s_{name}") for name in FEATURES]
    row = features.agg(*[F.avg(name).alias(f"m_{name}") for name in FEATURES], *spreads).first()
    mean = np.array([row[f"m_{name}"] or 0.0 for name in FEATURES])
    spread = np.maximum([row[f"s_{name}"] or 0.0 for name in FEATURES], 1e-6)
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, np.sqrt(1 / len(FEATURES)), (len(FEATURES), RANDOM_FEATURES))
    phases = rng.uniform(0, 2 * np.pi, RANDOM_FEATURES)
    none = np.zeros(RANDOM_FEATURES)
    model = Model(mean, spread, directions, phases, none, 0.5, np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    n = labelled.count()
    share = min(1.0, most / max(n, 1))
    kept = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = stored(features.join(kept, "doc_id"), "labelled")
    sums = known.where("part < 4").drop("doc_id", "part").mapInArrow(_products(model), "row int, sums binary")
    rows = sums.groupBy("row").applyInArrow(_add_up, "row int, sums binary").collect()
    if not rows:
        return model
    total = np.array([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["row"])])
    n_rows, y_sum = total[-2, -2], total[-1, -2]
    z_sum, zy, zz = total[:-2, -2], total[:-2, -1], total[:-2, :-2]
    model.base = float(y_sum / n_rows)
    left = zz + RIDGE * n_rows * np.eye(len(zz))
    model.weights = np.linalg.solve(left, zy - model.base * z_sum)
    bins = known.where("part = 4").drop("doc_id", "part").mapInArrow(_raw_bins(model), "bin int, y double")
    counted = bins.groupBy("bin").agg(F.sum("y").alias("total"), F.count("*").alias("n")).orderBy("bin").collect()
    if counted:
        x = (np.array([r["bin"] for r in counted]) + 0.5) * 2 / SCORE_BINS - 0.5
        model.steps, model.values = isotonic(x, np.array([r["total"] for r in counted]), np.array([r["n"] for r in counted]))
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _scores(model: Model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            score = model.score(_matrix(batch)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _known(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, y, part) of the documents that labels are learnt from."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold() != 0))
    return known.groupBy("doc_id").agg(F.avg("y").alias("y")).withColumn("part", fold())


def _table(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The statistics of every document, written once for scales, fitting and scoring."""
    frame = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(frame.dtypes)['doc_id']}, " + ", ".join(f"{name} double" for name in FEATURES)
    return stored(frame.mapInArrow(_statistics, schema), "statistics")


def score_quality(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """One row for each document row: doc_id, held_out, score, predicted.

    ``score`` lies between 0 and 1; ``predicted`` is 1 from 0.3 on. Labels are
    learnt from documents with ``crc32(id) mod 5`` other than 0; ``held_out``
    marks the rest, and is false for rows without an id. A document's label is
    the mean of its label rows; NULL labels and labels without a document count
    for nothing. NULL and empty texts have statistics of 0 and are scored like
    any other. Repeated rows stay. Without labels every score is 0.5, an empty
    table gives an empty table, and other columns are not read.
    """
    features = _table(documents, doc_id, text)
    model = fit(features, _known(labels, doc_id, label))
    scored = features.mapInArrow(_scores(model), f"doc_id {dict(features.dtypes)['doc_id']}, score double")
    held_out = F.coalesce(fold() == 0, F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def _good(model: Model, text: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                yield rows.filter(pa.array(model.score(statistics(data, offsets)) >= THRESHOLD))

    return run


def keep_good(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The document rows that ``score_quality`` predicts to be good, with all their columns."""
    model = fit(_table(documents, doc_id, text), _known(labels, doc_id, label))
    return documents.mapInArrow(_good(model, text), documents.schema)
