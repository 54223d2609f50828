"""Quality scores from document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of
the text; normal equations summed by partition give ridge scores; isotonic regression
on rows left out of the fit turns those into probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.llm.common import blocks, gathered, materialize, string_buffers

FEATURES, GAMMA, RIDGE, SEED = 256, 0.04, 1.0, 5
#: One in so many training rows calibrates and isn't fitted.
CALIBRATE = 5
#: Ridge scores are counted on a grid of this many steps for the isotonic fit.
GRID = 2048
#: At most about this many labelled rows are fitted (a hash of doc_id picks them).
TRAIN_ROWS = 500_000
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence end, 7 other ASCII sign, 8 non-ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 47, 58, 59, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 7
_CLASS[[32, 9, 13]], _CLASS[10], _CLASS[[46, 63]] = 4, 5, 6
NAMES = [
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeats_last", "distinct_pairs", "upper", "digit", "space", "newline", "stop", "sign", "other_ascii",
    "all_upper_words", "signed_words", "no_letter_words", "short_words", "long_words", "distinct_lines", "line_words", "compressed", "commas", "exclamations", "pipes",
]


def statistics(text: bytes) -> list[float]:
    """The numbers in ``NAMES`` for one text; zeros for an empty one."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_CLASS[raw], minlength=9) / n
    words = text.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    size = [len(w) for w in words]
    upper = sum(map(bytes.isupper, words))
    plain = sum(map(bytes.isalpha, words))
    signed = sum(1 for w in counts if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",")) / max(1, len(counts))
    barren = sum(c for w, c in counts.items() if not any(x > 64 for x in w))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), sum(size) / m, len(counts) / m**0.9, max(counts.values(), default=0) / m, repeats / m, len(pairs) / m,
        share[2], share[3], share[4], share[5], share[6], share[7], share[0],
        upper / m, signed, barren / m, sum(s < 3 for s in size) / m, sum(s > 14 for s in size) / m, len(set(lines)) / len(lines), float(np.log1p(m / len(lines))),
        len(zlib.compress(text, 1)) / n, text.count(b",") / m, text.count(b"!") / m, text.count(b"|") / m,
    ]


def with_statistics(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row (``row``, a long, or 0) and ``x``, the statistics of each whole text (null: empty)."""

    def run(batches):
        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            for a, b in blocks(offsets):
                x = [statistics(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "row", "x"])

    mark = F.lit(0).cast("long") if row is None else row
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("row")).mapInArrow(run, "doc_id long, row long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, np.sqrt(2 * GAMMA), (len(NAMES), FEATURES))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + shift), z / len(NAMES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.grid, self.calibrated), 0, 1)


def isotonic(at: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean place, mean label) with labels that never fall."""
    pooled: list[list[float]] = []
    for x, p, c in zip(at, positive, count):
        pooled.append([x * c, p, c])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
    return np.array([x / c for x, _, c in pooled]), np.array([p / c for _, p, c in pooled])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"k": table.column("k")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """Sum of ``of(x, y)`` over all rows: within a partition, then over groups of partitions, then here."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)), batch.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "sums"])

    parts = rows.select("x", "y").mapInArrow(run, "k int, sums binary").groupBy("k").applyInArrow(_add, "k int, sums binary").collect()  # 32 at most
    return sum(np.frombuffer(r["sums"], np.float64) for r in parts) if parts else None


def train(rows: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Model from (doc_id, x, y), y 0 or 1. With no rows at all every score is 0.5; with one class, that class's."""
    d, size = len(NAMES), FEATURES + len(NAMES) + 1
    total = rows.count()
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7)), 11) / F.lit(float(1 << 53))
    rows = rows.where(place < min(1.0, limit / max(1, total)))
    fold = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(8)), F.lit(CALIBRATE))
    model = Model(np.zeros(d), np.ones(d), np.zeros(size), np.array([0.0]), np.array([0.5]))
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return model
    n = moments[0]
    model.mean = moments[1 : d + 1] / n
    model.scale = np.sqrt(np.maximum(moments[d + 1 :] / n - model.mean**2, 0))
    model.scale[model.scale < 1e-9] = 1.0

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows.where(fold != 0), normal)
    if sums is None:
        sums = _summed(rows, normal)
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + RIDGE * np.eye(size), sums[size * size :])

    def counted(x, y):
        at = np.clip(((model.raw(x) + 0.5) / 2 * GRID).astype(int), 0, GRID - 1)
        return np.concatenate([np.bincount(at, minlength=GRID), np.bincount(at, y, minlength=GRID)])

    tally = _summed(rows.where(fold == 0), counted)
    if tally is None:
        tally = _summed(rows, counted)
    seen = np.flatnonzero(tally[:GRID])
    model.grid, model.calibrated = isotonic((seen + 0.5) / GRID * 2 - 0.5, tally[GRID:][seen], tally[:GRID][seen])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                s = np.concatenate([model.score(x[i : i + 4096]) for i in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["doc_id", "row", "score"])

    return stats.mapInArrow(run, "doc_id long, row long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 likelier) for every row of ``docs``.

    Learns from ``labels`` (doc_id, quality) joined to ``docs``; labels that are null
    or neither 0 nor 1 teach nothing, a doc_id labelled twice teaches twice. The text
    alone decides a score: null and empty texts have the same one, repeated rows are
    scored each, and further columns are ignored. ``row``, a long expression over
    ``docs``, passes through as a column of that name.
    """
    stats = materialize(with_statistics(docs, row), "statistics")
    y = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = materialize(gathered(stats.join(y, "doc_id"), docs), "labelled")
    return score(stats, train(rows)).select("doc_id", *([] if row is None else ["row"]), "score")
