"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit one binary classifier over
hashed byte n-grams tells on which side a text lies. A text's language is the
codeword with the least loss over all bits (loss-weighted decoding, exponential
loss); the lead over the second best tells whether the answer is ambiguous.

The bit classifiers are naive Bayes: a bit's weight for an n-gram is the logarithm of
its mean rate in the languages of one side over that of the other. Counts for each
language are summed by partition, so training is one pass over the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.llm.common import blocks, string_buffers

#: Hash buckets of n-grams, and the n-gram sizes in bytes.
BUCKETS, SIZES = 1 << 13, (1, 2, 3)
#: At most about this many training documents of each language (a hash of doc_id picks them).
TRAIN_PER_LANGUAGE = 20_000
#: Of a column with more values than this, the most frequent are learned.
MAX_LANGUAGES = 2_000
#: Below this lead of the best score over the second an answer is ambiguous.
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[[91, 92, 93, 94, 95, 96, 123, 124, 125, 126, 127]] = 32


def ngram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row for each document: counts of hashed byte n-grams, all but letters read as a space."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    base = int(offsets[0])
    data = _FOLD[raw[base : int(offsets[-1])]]
    tables = []
    for size in SIZES:
        h = np.zeros(max(0, len(data) - size + 1), np.uint32)
        with np.errstate(over="ignore"):
            for j in range(size):
                h = (h + data[j : j + len(h)]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
        tables.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(19)).astype(np.int64))
    for i, (a, b) in enumerate(zip(offsets[:-1] - base, offsets[1:] - base)):
        for size, h in zip(SIZES, tables):
            if b - a >= size:
                out[i] += np.bincount(h[a : b - size + 1], minlength=BUCKETS)
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: exhaustive codes up to 6, else random ones, spread apart."""
    if languages <= 6:
        bits = range(1, 1 << max(0, languages - 1))
        rows = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in bits] for i in range(languages)]
        return np.array(rows, np.float64).reshape(languages, -1)
    rng, width = np.random.default_rng(11), max(15, int(np.ceil(10 * np.log2(languages))))
    best, apart = None, -1
    for _ in range(50):
        code = np.where(rng.random((languages, width)) < 0.5, 1.0, -1.0)
        code[0, np.abs(code.sum(0)) == languages] *= -1
        least = int(((width - code @ code.T) / 2 + np.eye(languages) * width).min())
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Loss of each codeword for each row of n-gram counts."""
        total = counts.sum(1, keepdims=True)
        # a text of n n-grams counts as about sqrt(n) independent ones; margins stay finite
        margins = np.clip((counts @ self.weights) / np.maximum(total, 1) * np.sqrt(np.minimum(total, 400)), -4, 4)
        return np.exp(-margins[:, None, :] * self.code[None]).sum(2) / max(1, self.code.shape[1])

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score, and its lead over the second."""
        loss = self.losses(counts)
        p = np.exp(-loss + loss.min(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top[:, -1], top[:, -1] - second


def train(rows: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Model from (doc_id, text, lang). Rows without text, or with a null lang, teach nothing.

    Of more than ``MAX_LANGUAGES`` values the most frequent are learned, of equally
    frequent ones those that sort first. A repeated row teaches each time.
    """
    rows = rows.where("lang is not null and text is not null and text <> ''").select(F.col("doc_id"), "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    place = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(3)), 11) / F.lit(float(1 << 53)))
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            offsets, raw = string_buffers(batch.column(0))
            label = [number[x] for x in batch.column(1).to_pylist()]
            for a, b in blocks(offsets):
                for a in range(a, b, 256):
                    z = min(b, a + 256)
                    counts = ngram_counts(raw, offsets[a : z + 1])
                    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
                    for i in set(label[a:z]):
                        sums[i] = sums.get(i, 0) + counts[[x == i for x in label[a:z]]].sum(0, dtype=np.float64)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([sums[i].tobytes() for i in names], pa.binary())], names=["lang", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    partial = rows.where(F.col("lang").isin(languages)).where(place < share[F.col("lang")]).select("text", "lang").mapInArrow(count, "lang int, sums binary")
    rates = np.zeros((len(languages), BUCKETS))
    for r in partial.groupBy("lang").applyInArrow(add, "lang int, sums binary").collect():  # one row for each language
        rates[r["lang"]] = np.frombuffer(r["sums"], np.float64)
    rates = (rates + 1e-6) / (rates + 1e-6).sum(1, keepdims=True)
    code = codewords(len(languages))
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log((plus.T @ rates) / plus.sum(0)[:, None] + 1e-7) - np.log((minus.T @ rates) / np.maximum(1, minus.sum(0))[:, None] + 1e-7) if code.shape[1] else np.zeros((0, BUCKETS))
    return Model(languages, code, np.ascontiguousarray(weights.T, np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, from ``text`` alone.

    A null text, one without letters, and every text of a model that learned no
    language get ``und`` with score 0. A model of one language answers with it. Equal
    scores go to the language that sorts first. Repeated rows are answered each.
    """

    def run(batches):
        for batch in batches:
            offsets, raw = string_buffers(batch.column(1))
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in batch.column(1).to_pylist()], bool)
            for a, b in blocks(offsets):
                for a in range(a, b, 256):
                    z = min(b, a + 256)
                    known = letters[a:z] & bool(model.languages)
                    best, score, lead = model.decode(ngram_counts(raw, offsets[a : z + 1])) if model.languages else (np.zeros(z - a, int), np.zeros(z - a), np.zeros(z - a))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0)[a:z], pa.array([model.languages[i] if k else "und" for i, k in zip(best, known)], pa.string()),
                            pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(~known | (lead < AMBIGUOUS)),
                        ],
                        names=["doc_id", "lang_pred", "score", "ambiguous"],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
