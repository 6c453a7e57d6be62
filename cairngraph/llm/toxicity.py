"""Toxicity by a character n-gram linear classifier on naive Bayes features.

A text's features are the character 3- to 6-grams of its lower-cased words,
hashed, each counted once. A feature's value is its naive Bayes log-count
ratio, the log of its smoothed share in toxic texts over that in the others;
a logistic model with an L2 penalty is trained on these values. Features whose
ratio is within its own noise are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 20
GRAMS = (3, 4, 5, 6)


@dataclass(frozen=True)
class Model:
    """slot[h] is the position of hashed feature h in weight, or -1."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def _points(text: str) -> np.ndarray:
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """For each n-gram length, the hashed n-grams that hold no blank but at their ends."""
    c = _points(text or "")
    blank = c == 32
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h, inside = np.full(m, n, np.uint64), np.zeros(m, bool)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            if 0 < j < n - 1:
                inside |= blank[j : j + m]
        yield (h >> np.uint64(64 - BITS))[~inside].astype(np.int64)


def features(text: str | None, slot: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed features of a text, or their distinct slots where a table of slots is given."""
    found = [g if slot is None else (s := slot[g])[s >= 0] for g in gram_hashes(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            counts[label.as_py()][features(text.as_py())] += 1
    seen = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])], ["feature", "toxic", "other"])


def _select(slot: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = [features(t.as_py(), slot).astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["slots", "label"])

    return run


def _fit(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, values: np.ndarray, penalty: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias, by accelerated gradient descent.

    The rows' features lie end to end in flat; only they are held, so the cost
    follows the features that texts have and not all that there are.
    """
    row, n = np.repeat(np.arange(len(sizes)), sizes), max(1, len(sizes))
    forward = lambda w: np.bincount(row, (w[:-1] * values)[flat], len(sizes)) + w[-1]
    backward = lambda e: np.append(np.bincount(flat, e[row], len(values)) * values, e.sum())
    v = np.ones(len(values) + 1)
    for _ in range(8):  # largest curvature, by power iteration
        v = backward(forward(v))
        top = float(np.linalg.norm(v))
        v /= top or 1
    rate = 1 / (0.25 * top / n + penalty)
    decay = np.full(len(values) + 1, penalty)
    decay[-1] = 0
    w = ahead = np.zeros(len(values) + 1)
    for k in range(steps):
        error = 1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30))) - labels
        new = ahead - rate * (backward(error) / n + decay * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1] * values, float(w[-1])


def held_out_fold(doc_id: str = "doc_id"):
    """crc32 of the id's text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 8000, min_z: float = 3.5, penalty: float = 1e-3) -> Model:
    """Train on docs(doc_id, text) and labels(doc_id, label), one row per doc_id, label 0 or 1.

    At most ``sample_docs`` labels are used, those first in hashed id order, so
    that their ids can be sent to every task and no text is moved for the
    others. Of the 2^20 hashed features all are used whose log-count ratio is
    ``min_z`` standard errors or more. Without rows of both labels the model
    gives every text the smoothed share of toxic rows.
    """
    chosen = labels.where("doc_id is not null and label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    pick = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label")))
    share = {r.label: r.n for r in pick.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = share.get(1, 0), share.get(0, 0)
    slot = np.full(1 << BITS, -1, np.int32)
    if not (pos and neg):
        return Model(slot, np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else 0.0)
    p, q = F.col("toxic") + F.lit(1.0), F.col("other") + F.lit(1.0)
    ratio = F.log(p / (pos + 2.0)) - F.log(q / (neg + 2.0))
    counts = pick.mapInArrow(_count, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    z = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    best = counts.select("feature", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= min_z).select("feature", "ratio").toArrow().sort_by("feature")
    if not best.num_rows:
        return Model(slot, np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))))
    values = best["ratio"].to_numpy()
    slot[best["feature"].to_numpy()] = np.arange(len(values))
    got = pick.mapInArrow(_select(slot), "slots array<int>, label int").toArrow()
    rows = sorted(((label, np.asarray(slots.values)) for slots, label in zip(got["slots"], got["label"].to_pylist())), key=lambda r: (r[0], r[1].tobytes()))
    flat, sizes = np.concatenate([r for _, r in rows]).astype(np.int64), np.array([len(r) for _, r in rows])
    weight, bias = _fit(flat, sizes, np.array([label for label, _ in rows], float), values, penalty)
    return Model(slot, weight, bias)


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            sums = np.array([model.weight[features(t.as_py(), model.slot)].sum() + model.bias for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -50, 50))), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, score from 0 to 1 over the whole text.

    A null text scores as an empty one. Other columns of docs are not read.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scorer(model), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_docs: int = 8000) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    The model is trained on the labelled documents outside the held-out fold.
    A document with several labels counts with the highest. A null doc_id is
    scored, never trained on and not held out.
    """
    label = labels.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    out = score(docs, train(docs, label.where(held_out_fold() != 1), sample_docs))
    held = F.coalesce(held_out_fold() == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
