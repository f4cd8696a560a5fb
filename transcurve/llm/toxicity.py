"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

Features are the presence of hashed character n-grams of the folded text (lower case,
everything but letters and digits as a space): all whose log-count ratio between toxic
and clean documents is significant (``STRENGTH``). Each is scaled by that ratio; a logistic regression is fitted on the scaled
features. Fitting reads a bounded sample of labelled rows (``per_class``); scoring is
one pass over every whole text, in numpy.

Labels are learnt only from rows whose crc32 of the doc_id as text is not divisible by
five; a doc_id with contradictory labels and null labels teach nothing. Null text counts
as empty; an empty text scores by the intercept alone. A null doc_id is not held out.
Without labels of both classes every score is 0. Repeated rows get equal scores; extra
columns are ignored (``reject`` passes them on); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

#: Lengths of the n-grams, bits of the hash.
ORDERS, BITS = (4, 5, 6), 22
#: Standard errors by which an n-gram's log-count ratio must differ from 0 to be a feature; half the
#: strongest n-gram's, where few labels leave that one below twice as many.
STRENGTH = 4.0
#: Labelled documents of each class that the fit reads at most: clean, toxic.
PER_CLASS = (3000, 1500)
#: Smoothing of the counts, strength of the penalty, steps of the fit.
ALPHA, PENALTY, STEPS = 1.0, 1e-4, 300
#: Code points with a case or class that folding looks up; those beyond stand for themselves.
FOLDED = 0x3000
CHUNK_BYTES = 1 << 19


def _fold_table() -> np.ndarray:
    out = np.arange(FOLDED + 1, dtype=np.uint32)
    for i in range(FOLDED):
        low = chr(i).lower()
        out[i] = ord(low) if low.isalnum() and len(low) == 1 else 32
    return out


def _codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, each between two spaces, and where each text ends."""
    joined = (" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass")
    raw = np.frombuffer(joined, np.uint32)
    codes = table[np.minimum(raw, FOLDED)]
    if len(raw) and raw.max() >= FOLDED:
        far = raw >= FOLDED
        codes[far] = raw[far]
    return codes, np.cumsum([len(t) + 2 for t in texts])


def _grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Order and bucket of the n-gram that starts at each place, for each order."""
    h = codes.astype(np.uint64)
    done = 1
    for n in ORDERS:
        for k in range(done, n):
            h = h[: len(codes) - k] * np.uint64(0x100000001B3) + codes[k:]
        done = n
        yield n, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """Weight of each kept bucket (already times its log-count ratio) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        slot = np.zeros(1 << BITS, np.int32)
        slot[self.buckets] = np.arange(1, len(self.buckets) + 1)
        table, weights = _fold_table(), np.concatenate(([0.0], self.weights))

        def score(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros(0)
            codes, ends = _codes(texts, table)
            pairs = []
            for n, bucket in _grams(codes):
                found = slot[bucket]
                at = np.flatnonzero(found)
                doc = np.searchsorted(ends, at, "right")
                inside = at + n <= ends[doc]  # n-grams don't run on into the next text
                pairs.append(doc[inside] << 32 | found[at[inside]])
            pair = np.unique(np.concatenate(pairs))  # presence, not counts
            z = np.bincount(pair >> 32, weights[pair & 0xFFFFFFFF], len(texts)) + self.intercept
            return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

        return score


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """A model of labelled texts."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    table, docs = _fold_table(), []
    for t in texts:
        codes, _ = _codes([t], table)
        docs.append(np.unique(np.concatenate([b for _, b in _grams(codes)])))
    counts = [np.zeros(1 << BITS, np.int32) for _ in range(2)]
    for d, k in zip(docs, labels, strict=True):
        counts[int(k)][d] += 1
    a, b = (c[np.flatnonzero(counts[0] + counts[1] > 1)] + ALPHA for c in (counts[1], counts[0]))
    seen = np.flatnonzero(counts[0] + counts[1] > 1).astype(np.int32)
    ratio = np.log(a / (y.sum() + 2 * ALPHA)) - np.log(b / ((1 - y).sum() + 2 * ALPHA))
    strength = np.abs(ratio) / np.sqrt(1 / a + 1 / b)
    strong = strength >= min(STRENGTH, strength.max(initial=0.0) / 2)
    buckets, ratio = seen[strong], ratio[strong]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))
    cols = [c[c >= 0] for c in (slot[d] for d in docs)]
    col, row = np.concatenate(cols).astype(np.int64), np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    value, n, m = ratio[col], len(y), len(buckets)
    # rows to unit length for the fit's steps only: the largest row bounds the curvature
    bound = 0.25 * max(1.0, np.bincount(row, value**2, n).max()) + PENALTY
    w, u, bias, ubias, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(STEPS):  # accelerated gradient steps
        z = np.bincount(row, value * u[col], n) + ubias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        w2 = u - (np.bincount(col, value * g[row], m) + PENALTY * u) / bound
        b2 = ubias - g.sum() * 4
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ubias = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    return Model(buckets, w * ratio, float(bias))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class, chosen by a hash of their id.

    The intercept keeps the sample's class ratio: where toxic rows are rarer in the corpus
    than in the sample, that weighs a missed toxic document above a false alarm.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    )
    order = F.xxhash64("doc_id")
    sample = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n).select("doc_id", "toxic") for k, n in enumerate(per_class)]
    # at most sum(per_class) rows: small enough to broadcast at any scale
    chosen = F.broadcast(sample[0].unionByName(sample[1]).select(F.col("doc_id").alias("did"), "toxic"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("did"))
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    )
    model = fit([r.text or "" for r in rows], [r.toxic for r in rows])
    del rows
    common.give_back()
    return model


def _scored(model: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    score = model.scorer() if model else lambda texts: np.zeros(len(texts))
    for batch in batches:
        for part in common.chunks(batch, "text", CHUNK_BYTES):
            yield part, score([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _scored(model, batches):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        common.tidy(run), "doc_id long, held_out boolean, score double, predicted int"
    )


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model doesn't call toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _scored(model, batches):
            yield part.filter(pa.array(s < 0.5))

    return docs.mapInArrow(common.tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject(docs, train(docs, common.table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_toxicity": query}
ORACLES: dict[str, str] = {}
