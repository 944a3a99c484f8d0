"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal.

Features of a text are the 1- and 2-grams of its lower-cased words and of the
forms of its words (letter case, digits and symbols, or "as the word before").
Each of the four families is a unit vector of square-rooted frequencies, hashed
to ``2**bits`` places.  A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import rows_by_text, small_batches, text_bytes

FOLDS = 5
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
               for b in range(256))
_RUN = re.compile(rb"(\S)\1+")


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed n-grams (a place may stand twice)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    forms = _RUN.sub(rb"\1", text.translate(_CLASS)).split()
    forms[1:] = [b"=" if a == b else f for a, b, f in zip(words, words[1:], forms[1:])]
    place, value = [], []
    for seed, grams in enumerate((words, forms, zip(words, words[1:]), zip(forms, forms[1:]))):
        counts = Counter(grams)
        if not counts:
            continue
        keys = counts if seed < 2 else map(b" ".join, counts)
        place.append(np.fromiter((crc32(g, seed) for g in keys), np.int64, len(counts)))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        value.append(np.sqrt(n / n.sum()))
    return np.concatenate(place) & ((1 << bits) - 1), np.concatenate(value)


class Ftrl:
    """Follow-the-regularised-leader, proximal form, for logistic loss; the last place is the bias."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, place: np.ndarray, value: np.ndarray, label: int) -> None:
        place, back = np.unique(np.append(place, len(self.z) - 1), return_inverse=True)
        value = np.bincount(back, np.append(value, 1.0))
        w = self.weights(place)
        g = (sigmoid(w @ value) - label) * value
        n = self.n[place]
        self.z[place] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[place] += g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _fold():
    return F.expr(f"crc32(cast(doc_id as string)) % {FOLDS}")


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, epochs: int = 3, train_rows: int = 20_000,
          alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> np.ndarray:
    """Weights (``2**bits`` places and the bias) learnt from labelled rows outside fold 0.

    At most about ``train_rows`` labelled documents are used: those whose id
    hashes below the share that gives this number.  The bound makes the label
    side of the join small enough to broadcast and one task enough to train.
    A document with several labels takes the lowest; null labels and null ids
    are left out.  The rows reach the one training task sorted by epoch and
    hash and stream through it, so it holds the weights and one batch.  Without
    labelled rows all weights are 0 and every score is 0.5.
    """
    lab = (labels.filter("quality is not null and doc_id is not null")
           .select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(_fold() != 0)
           .groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .withColumn("place", F.xxhash64("doc_id")))
    share = min(1.0, train_rows / max(1, lab.count()))
    lab = lab.filter(F.expr(f"pmod(place, 1000000) < {int(share * 1_000_000)}"))
    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .join(F.broadcast(lab), "doc_id")
            .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
            .select("epoch", "place", "doc_id", "quality", "text"))

    def work(batches):
        model = Ftrl(bits, alpha, beta, l1, l2)
        for batch in small_batches(batches, "text"):
            for label, text in zip(batch.column(3).to_pylist(), text_bytes(batch.column(4))):
                model.learn(*features(text, bits), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())],
                                         names=["weights"])

    found = (rows.repartition(1).sortWithinPartitions("epoch", "place", "text")
             .mapInArrow(work, "weights binary").first())
    if found is None:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.frombuffer(found["weights"], "<f4")


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """``docs`` columns ``doc_id``, ``held_out``, ``score`` and ``predicted``, one row per input row.

    The score is 0 to 1, higher for likelier quality 1; null and empty texts get
    the bias alone.  A null doc_id counts as held out.  Every word of a text
    counts.  ``weights`` is broadcast; its size is fixed by the hash bits.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def work(batches):
        w = held.value.astype(np.float64)
        bits = (len(w) - 1).bit_length() - 1
        for batch in small_batches(batches, "text"):
            scores = []
            for text in text_bytes(batch.column(1)):
                place, value = features(text, bits)
                scores.append(float(sigmoid(w[place] @ value + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    return (base.mapInArrow(work, "doc_id long, score double")
            .select("doc_id", F.coalesce(_fold() == 0, F.lit(True)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose quality score is under ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def judge():
        w = held.value.astype(np.float64)
        bits = (len(w) - 1).bit_length() - 1

        def one(text: bytes) -> bool:
            place, value = features(text, bits)
            return bool(sigmoid(w[place] @ value + w[-1]) >= threshold)
        return lambda texts: [one(t) for t in text_bytes(texts)]

    return rows_by_text(docs, judge)
