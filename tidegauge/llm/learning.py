"""What the trained classifiers share: labelled samples, character inputs, an optimiser and calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import fold

#: Rows of a class that a training sample takes at most, and code points of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, parts: int, held_out: int) -> pd.DataFrame:
    """At most SAMPLE_ROWS labelled texts of each class as (text, y), in a fixed order.

    Only labels of ids outside the held-out fold are read. Ids are picked from
    the labels alone, smallest hash first, and are few enough to be broadcast
    to one scan of the documents; texts beyond SAMPLE_CHARS are not trained on,
    though all are scored. Repeated labels of an id count as the largest.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(column).cast("int").alias("y"))
    )
    picked = [
        tuple(r)
        for y in (0, 1)
        for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()
    ]
    ids = spark.createDataFrame(picked, "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]).toPandas()
    return found.sort_values(["doc_id", "text"], ignore_index=True)[["text", "y"]]


class CharGrams:
    """Buckets of the letter trigrams of words, each word between two marks."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all grams, end of each word's grams); a word of n bytes has n grams."""
        line = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        grams = (line[:-2] * np.uint32(961_748_927) ^ line[1:-1] * np.uint32(32_452_843) ^ line[2:] * np.uint32(7_368_787)) >> np.uint32(7)
        starts = np.cumsum(sizes + 2) - sizes - 2
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return (grams[at] % np.uint32(self.buckets)).astype(np.int64), ends


def segment_sums(rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows up to each end; no segment may be empty."""
    return np.add.reduceat(rows, np.concatenate([[0], ends[:-1]]), axis=0) if len(ends) else rows[:0]


def scatter(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by index."""
    return np.stack([np.bincount(index, weights=c, minlength=size) for c in rows.T], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with P(y = 1) close to sigmoid(a x + b), by Newton steps; a is kept positive.

    Few rows are soon told apart perfectly: a ridge and targets a little inside
    0 and 1 keep the slope from growing without bound.
    """
    y = np.where(y > 0.5, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    middle, spread = logits.mean(), logits.std() + 1e-9
    x = (logits - middle) / spread
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(abs(step).max(), 1e-12))  # far from the optimum Newton steps may overshoot
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    a = max(float(a), 1e-3)
    return a / spread, float(b - a * middle / spread)
