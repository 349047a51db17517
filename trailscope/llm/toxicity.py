"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between
(case folded). FTRL-proximal keeps a sum of gradients and of squared gradients per
coordinate: each coordinate has its own learning rate, and L1 leaves exactly zero
weight on coordinates without clear evidence, so the model sent to the tasks is a short list
of (bucket, weight), at most ``1 << BITS``.

Training reads at most ``train_rows`` labelled documents, chosen reproducibly by a hash of their id,
in one task, a few passes; everything else covers all rows. Results: a null or empty text
has no feature and scores the bias. Labels other than 0 and 1 and null labels are ignored; several labels of one
document count as the largest. Without any label every score is 0.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailscope.llm.common import sha_order, slices, spare_name, text_udf

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 16.0, 1.0
THRESHOLD = 0.3
MEMO_WORDS = 200_000
_WORDS = re.compile(r"\w+")
_PAIR, _SKIP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        h = self[word] = (zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)) or 1
        return h


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Buckets of the words, pairs and skip-pairs of one text, repeats included."""
    words = _WORDS.findall(text.lower()) if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    parts = [h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:]]
    all_h = np.concatenate(parts) * _MIX
    return (all_h >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class ToxicityModel:
    """Bias and the non-zero weights; ``buckets`` ascending."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    trained: bool = True

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> ToxicityModel:
    """Fit on (distinct buckets, label) rows. The bias is a coordinate without L1, on top of the labels' log odds."""
    size, base = (1 << BITS) + 1, 0.0
    if rows:
        ones = sum(label for _, label in rows)
        base = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, pull = z[at], np.full(len(at), l1)
        pull[-1] = 0.0  # the bias, always last
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for buckets, label in rows:
            at = np.append(buckets, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - label
            was = n[at]
            z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / alpha * w
            n[at] = was + g * g
    w = weights(np.arange(size))
    used = np.flatnonzero(w[:-1])
    return ToxicityModel(base + float(w[-1]), used, w[used].astype(np.float32), bool(rows))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from the labelled documents; only their ids and labels choose the sample."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(sha_order(F.col("id")), "id").limit(train_rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # at most train_rows narrow rows, so broadcasting them is bounded
    train = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")

    def extract(batches):
        import pyarrow as pa

        hashes = _Hashes()
        for part in slices(batches):
            found = [np.unique(features(t, hashes)).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(found, pa.binary())], ["id", "label", "raw"])

    def train_task(batches):
        import pyarrow as pa

        rows: dict[int, tuple[np.ndarray, int]] = {}
        for batch in slices(batches):
            for i, label, raw in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault((i, raw), (np.frombuffer(raw, np.int32), label))
        ordered = [rows[k] for k in sorted(rows, key=lambda k: (zlib.crc32(str(k[0]).encode()), k))]
        m = ftrl(ordered)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.buckets.astype(np.int32).tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.trained])], ["bias", "buckets", "weights", "trained"])

    extracted = train.select(F.col("id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(extract, "id long, label int, raw binary")
    # Rows that repeat an id and its features are one example: folded map-side before they meet in one task.
    extracted = extracted.groupBy("id", "raw").agg(F.max("label").alias("label")).select("id", "label", "raw")
    row = extracted.repartition(1).mapInArrow(train_task, "bias double, buckets binary, weights binary, trained boolean").first()  # one task: bounded by train_rows
    if row is None:
        return ToxicityModel(0.0, np.zeros(0, np.int32), np.zeros(0, np.float32), False)
    return ToxicityModel(row.bias, np.frombuffer(row.buckets, np.int32), np.frombuffer(row.weights, np.float32), row.trained)


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: probability of label 1, from the text alone."""

    def make():
        hashes, dense = _Hashes(), model.dense()

        def work(texts):
            scores = []
            for text in texts:
                at = features(text, hashes)
                at = at[dense[at] != 0]
                margin = model.bias + float(dense[np.unique(at)].sum())
                scores.append(float(1 / (1 + np.exp(-np.clip(margin, -35, 35)))) if model.trained else 0.0)
            return [scores]

        return work

    return df.withColumn(out, text_udf("score double", make)(df[text_col])["score"])


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with the input's columns."""
    name = spare_name(df.columns, "toxicity")
    return score_toxicity(df, model, text_col, name).where(F.col(name) < threshold).drop(name)
