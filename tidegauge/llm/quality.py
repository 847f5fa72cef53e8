"""Quality by attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import fold, small_batches
from tidegauge.llm.learning import Adam, CharGrams, calibrate, labelled_sample, scatter, segment_sums, sigmoid

#: Words of a passage at most; lines end passages too.
PASSAGE = 48
#: Sizes: character input, passage encoding, attention, trigram buckets; counts taken of a word and of a passage.
CHAR_IN, ENCODED, ATTEND, GRAMS, WORD_COUNTS, PASSAGE_COUNTS = 16, 16, 8, 8192, 7, 4
#: Passes over the sample, more of them for a small one until LEAST_STEPS steps are made.
EPOCHS, LEAST_STEPS, BATCH, RATE = 5, 200, 64, 0.01
#: Documents are good from this score on.
CUT = 0.3
PARTS, HELD_OUT = 5, 0
REMEMBERED = 300_000


def passages_of(text: str | None) -> list[list[bytes]]:
    """Passages of a whole text: lines, cut after PASSAGE words; a text without words has one empty passage."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        out += [words[a : a + PASSAGE] for a in range(0, len(words), PASSAGE)]
    return out or [[]]


def word_counts(words: list[bytes]) -> np.ndarray:
    """Of each word: shares of capitals, digits, marks and bytes beyond ASCII, its length, all capitals, a bar alone."""
    line = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.float32)
    low = line | 32
    capital, digit, beyond = (line >= 65) & (line <= 90), (line >= 48) & (line <= 57), line >= 128
    mark = ~(((low >= 97) & (low <= 122)) | digit | beyond)
    sums = segment_sums(np.stack([capital, digit, mark, beyond], axis=1).astype(np.float32), np.cumsum(sizes).astype(np.int64))
    shares = sums / sizes[:, None]
    bar = np.array([w == b"|" for w in words], np.float32)
    return np.column_stack([shares, np.minimum(sizes, 40) / 10, (shares[:, 0] > 0.5).astype(np.float32), bar]).astype(np.float32)


class Bags:
    """Documents as bags of passages: words in order, the end of each passage and of each document."""

    def __init__(self, docs: list[list[list[bytes]]]):
        self.words = [w for d in docs for p in d for w in p]
        self.sizes = np.array([len(p) for d in docs for p in d], np.int64)
        self.bags = np.array([len(d) for d in docs], np.int64)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Of each passage: its length, the share of different words, and whether the document repeats it."""
        passage = np.repeat(np.arange(len(self.sizes)), self.sizes)
        pairs = np.unique(passage * (1 << 32) + rows)
        different = np.bincount(pairs >> 32, minlength=len(self.sizes))
        mixed = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        content = np.bincount(passage, weights=(mixed >> np.uint64(24)).astype(np.float64), minlength=len(self.sizes))
        doc = np.repeat(np.arange(len(self.bags)), self.bags)
        _, inverse, times = np.unique(np.stack([doc, content]), axis=1, return_inverse=True, return_counts=True)
        repeated = (times[inverse.ravel()] > 1) & (self.sizes > 0)
        share = different / np.maximum(self.sizes, 1)
        return np.column_stack([np.log1p(self.sizes) / 4, share, repeated, self.sizes == 0]).astype(np.float32)


class AttentionModel:
    """Every passage is encoded, gated attention weighs the passages of a document, and their weighted sum is scored."""

    def __init__(self, params: dict[str, np.ndarray], a: float = 1.0, b: float = 0.0):
        self.params, self.a, self.b = params, a, b
        self.grams = CharGrams(GRAMS)
        self.known: dict[bytes, int] = {}
        self.inputs = np.zeros((0, ENCODED), np.float32)

    @classmethod
    def fresh(cls, seed: int = 10) -> AttentionModel:
        random = np.random.default_rng(seed)
        normal = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls(
            {
                "chars": (0.3 * random.standard_normal((GRAMS, CHAR_IN))).astype(np.float32),
                "from_chars": normal(CHAR_IN, ENCODED),
                "from_words": normal(WORD_COUNTS, ENCODED),
                "from_passage": normal(PASSAGE_COUNTS, ENCODED),
                "bias": np.zeros(ENCODED, np.float32),
                "key": normal(ENCODED, ATTEND),
                "gate": normal(ENCODED, ATTEND),
                "focus": normal(ATTEND, 1)[:, 0],
                "out": normal(ENCODED, 1)[:, 0],
                "out_bias": np.zeros(1, np.float32),
            }
        )

    def embed(self, words: list[bytes]):
        grams, ends = self.grams(words)
        sizes = np.diff(ends, prepend=0)
        chars = segment_sums(self.params["chars"][grams], ends) / sizes[:, None].astype(np.float32)
        counts = word_counts(words) if words else np.zeros((0, WORD_COUNTS), np.float32)
        return chars @ self.params["from_chars"] + counts @ self.params["from_words"], (chars, counts, grams, sizes)

    def attend(self, inputs: np.ndarray, rows: np.ndarray, bags: Bags, extra: np.ndarray):
        """Logits of documents from the inputs of their words, and what the backward pass needs."""
        p = self.params
        full = bags.sizes > 0
        means = np.zeros((len(bags.sizes), ENCODED), np.float32)
        if len(rows):
            means[full] = segment_sums(inputs[rows], np.cumsum(bags.sizes[full])) / bags.sizes[full, None].astype(np.float32)
        h = np.tanh(means + extra @ p["from_passage"] + p["bias"])
        key, gate = np.tanh(h @ p["key"]), sigmoid(h @ p["gate"])
        e = (key * gate) @ p["focus"]
        ends = np.cumsum(bags.bags)
        starts = ends - bags.bags
        w = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), bags.bags))
        w /= np.repeat(np.add.reduceat(w, starts), bags.bags)
        pooled = segment_sums(w[:, None] * h, ends)
        return pooled @ p["out"] + p["out_bias"][0], (h, key, gate, w, pooled, ends)

    def train_step(self, bags: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        words = sorted(set(bags.words))
        index = {w: i for i, w in enumerate(words)}
        rows = np.array([index[w] for w in bags.words], np.int64)
        inputs, (chars, counts, grams, sizes) = self.embed(words)
        extra = bags.counts(rows)
        logit, (h, key, gate, w, pooled, ends) = self.attend(inputs, rows, bags, extra)
        d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grads = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = np.repeat(d_logit[:, None] * p["out"], bags.bags, axis=0)
        d_w = (d_pooled * h).sum(1)
        d_e = w * (d_w - np.repeat(np.add.reduceat(w * d_w, ends - bags.bags), bags.bags))
        grads["focus"] = (key * gate).T @ d_e
        d_key, d_gate = d_e[:, None] * p["focus"] * gate * (1 - key**2), d_e[:, None] * p["focus"] * key * gate * (1 - gate)
        grads |= {"key": h.T @ d_key, "gate": h.T @ d_gate}
        d_h = w[:, None] * d_pooled + d_key @ p["key"].T + d_gate @ p["gate"].T
        d_in = d_h * (1 - h * h)
        grads |= {"from_passage": extra.T @ d_in, "bias": d_in.sum(0)}
        share = d_in / np.maximum(bags.sizes, 1)[:, None]
        d_word = scatter(rows, np.repeat(share, bags.sizes, axis=0), len(words))
        grads |= {"from_chars": chars.T @ d_word, "from_words": counts.T @ d_word}
        d_chars = d_word @ p["from_chars"].T
        grads["chars"] = scatter(grams, np.repeat(d_chars / sizes[:, None], sizes, axis=0), GRAMS)
        return grads

    def forget(self) -> None:
        self.known, self.inputs = {}, self.inputs[:0]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        bags = Bags([passages_of(t) for t in texts])
        if len(self.known) > REMEMBERED:
            self.forget()
        found = list(map(self.known.get, bags.words))
        missing = [i for i, r in enumerate(found) if r is None]
        if missing:
            new = sorted({bags.words[i] for i in missing})
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.inputs = np.concatenate([self.inputs, self.embed(new)[0]])
            for i in missing:
                found[i] = self.known[bags.words[i]]
        rows = np.array(found, np.int64)
        return self.attend(self.inputs, rows, bags, bags.counts(rows))[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each whole text is good."""
        return sigmoid(self.a * self.logits(texts) + self.b) if texts else np.zeros(0)


def train(sample: pd.DataFrame, seed: int = 10) -> AttentionModel:
    """Fit a model on (text, y): a document's label is all that is known of its passages; every fifth document only calibrates."""
    random = np.random.default_rng(seed)
    model = AttentionModel.fresh(seed)
    y = sample["y"].to_numpy(np.float32)
    if len(set(y)) < 2:  # nothing to tell apart
        model.a, model.b = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    docs = [passages_of(t) for t in sample["text"]]
    learn = np.arange(len(docs)) % 5 > 0  # the rest only calibrates
    adam = Adam(model.params, RATE)
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // len(docs))
    for epoch in range(epochs):
        order = random.permutation(np.flatnonzero(learn))
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            adam.rate = RATE * (1 - 0.9 * (epoch + at / len(order)) / epochs)
            adam.update(model.train_step(Bags([docs[i] for i in mine]), y[mine]))
    model.forget()
    found = np.concatenate([model.logits(list(sample["text"][at : at + 256])) for at in range(0, len(sample), 256)])
    model.a, model.b = calibrate(found[~learn].astype(np.float64), y[~learn])
    model.forget()
    return model


def _scored(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores.astype(np.float64))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row's whole text.

    Null texts are scored as empty ones; rows that repeat each get a row, null
    ids are kept, an empty table gives no rows, further columns are ignored.
    """
    model = train(labelled_sample(docs, labels, "quality", PARTS, HELD_OUT))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double").select(
        "doc_id",
        (fold(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
