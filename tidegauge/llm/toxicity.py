"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import fold, lean, remembered, small_batches
from tidegauge.llm.learning import Adam, CharGrams, calibrate, labelled_sample, scatter, segment_sums, sigmoid

#: Words of a window and words from one window to the next.
WINDOW, STRIDE = 32, 16
#: Sizes: state of a direction, word input, character input, attention, words with a vector of their own, trigram buckets.
STATE, WORD_IN, CHAR_IN, ATTEND, VOCABULARY, GRAMS = 8, 8, 16, 8, 4096, 8192
#: Passes over the sample, more of them for a small one until LEAST_STEPS steps are made.
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 200, 256, 0.01
#: Windows of a clean document and of a toxic one in an epoch, and the clean ones taken because they seem most toxic so far.
CLEAN_WINDOWS, TOXIC_WINDOWS, HARD_WINDOWS = 4, 12, 4
#: Documents are toxic from this score on.
CUT = 0.7
PARTS, HELD_OUT = 3, 1
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Words whose inputs a task remembers; a full memory is emptied, scores stay the same.
REMEMBERED = 100_000
#: Texts that are cut to words at a time; what a worker holds for them follows from it.
TEXTS = 64


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case, as UTF-8; marks that are not ASCII count as letters."""
    return WORD.findall((text or "").lower().encode())


def window_starts(n: int) -> np.ndarray:
    """First word of every window over n words; the last window ends at the last word."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Network:
    """Weights, forward and backward passes; arrays are (time, window, feature)."""

    def __init__(self, vocabulary: dict[bytes, int], params: dict[str, np.ndarray], a: float = 1.0, b: float = 0.0):
        self.vocabulary, self.params, self.a, self.b = vocabulary, params, a, b
        self.grams = CharGrams(GRAMS)
        self.known: dict[bytes, int] = {}
        self.inputs = np.zeros((0, 6 * STATE), np.float32)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 3) -> Network:
        random = np.random.default_rng(seed)
        normal = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        width = WORD_IN + CHAR_IN
        params = {
            "words": (0.1 * random.standard_normal((VOCABULARY + 1, WORD_IN))).astype(np.float32),
            "chars": (0.3 * random.standard_normal((GRAMS, CHAR_IN))).astype(np.float32),
            "attend": normal(2 * STATE, ATTEND),
            "attend_bias": np.zeros(ATTEND, np.float32),
            "focus": normal(ATTEND, 1)[:, 0],
            "out": normal(2 * STATE, 1)[:, 0],
            "out_bias": np.zeros(1, np.float32),
        }
        for d in "fb":  # forward and backward in time
            params |= {f"x_{d}": normal(width, 3 * STATE), f"h_{d}": normal(STATE, 3 * STATE), f"bias_{d}": np.zeros(3 * STATE, np.float32)}
        return cls(vocabulary, params)

    def embed(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input of each word: its own vector, if it has one, beside the mean of its trigrams' vectors."""
        own = np.array([self.vocabulary.get(w, VOCABULARY) for w in words], np.int64)
        grams, ends = self.grams(words)
        sizes = np.diff(ends, prepend=0)[:, None].astype(np.float32)
        chars = segment_sums(self.params["chars"][grams], ends) / sizes
        x = np.concatenate([self.params["words"][own] * (own < VOCABULARY)[:, None], chars], axis=1)
        return x, (own, grams, sizes[:, 0].astype(np.int64))

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.params[f"x_{d}"] + self.params[f"bias_{d}"] for d in "fb"], axis=1)

    def direction(self, steps: np.ndarray, mask: np.ndarray | None, d: str, keep: bool = False):
        """States of one direction; steps come in the order of time and are (time, window, 3 STATE)."""
        u, h = self.params[f"h_{d}"], np.zeros((steps.shape[1], STATE), np.float32)
        states, tape = np.empty((*steps.shape[:2], STATE), np.float32), []
        order = range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1)
        for t in order:
            g = h @ u
            zr = sigmoid(steps[t, :, : 2 * STATE] + g[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(steps[t, :, 2 * STATE :] + r * g[:, 2 * STATE :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                tape.append((t, h, z, r, n, g[:, 2 * STATE :]))
            h = states[t] = new
        return states, tape

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        """Logit of each window from the attention-weighted mean of its states."""
        p = self.params
        keys = np.tanh(states @ p["attend"] + p["attend_bias"])
        e = keys @ p["focus"]
        if mask is not None:
            e = np.where(mask, e, -30.0)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbs->bs", w, states)
        return pooled @ p["out"] + p["out_bias"][0], keys, w, pooled

    def logits(self, steps: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        parts = [self.direction(steps[:, :, i * 3 * STATE : (i + 1) * 3 * STATE], mask, d)[0] for i, d in enumerate("fb")]
        return self.pool(np.concatenate(parts, axis=2), mask)[0]

    def train_step(self, words: list[bytes], windows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss; windows (time, window) index words."""
        p = self.params
        x, (own, grams, sizes) = self.embed(words)
        steps = self.project(x)[windows]
        runs = [self.direction(steps[:, :, i * 3 * STATE : (i + 1) * 3 * STATE], mask, d, keep=True) for i, d in enumerate("fb")]
        states = np.concatenate([r[0] for r in runs], axis=2)
        logit, keys, w, pooled = self.pool(states, mask)
        d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grads = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_w = np.einsum("bs,tbs->tb", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_keys = d_e[:, :, None] * p["focus"] * (1 - keys * keys)
        grads |= {"focus": np.einsum("tba,tb->a", keys, d_e), "attend_bias": d_keys.sum((0, 1))}
        grads["attend"] = np.einsum("tbs,tba->sa", states, d_keys, optimize=True)
        d_states = w[:, :, None] * d_pooled + d_keys @ p["attend"].T
        d_inputs = []
        for i, d in enumerate("fb"):
            u, back = p[f"h_{d}"], np.zeros((len(y), STATE), np.float32)
            d_u = np.zeros_like(u)
            d_steps = np.zeros((*windows.shape, 3 * STATE), np.float32)
            for t, h, z, r, n, g in reversed(runs[i][1]):
                back = back + d_states[t, :, i * STATE : (i + 1) * STATE]
                inside = np.where(mask[t][:, None], back, 0)
                d_n = inside * (1 - z) * (1 - n * n)
                d_z = inside * (h - n) * z * (1 - z)
                d_r = d_n * g * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_steps[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u += h.T @ d_g
                back = back - inside + inside * z + d_g @ u.T
            grads[f"h_{d}"] = d_u
            d_word = scatter(windows.ravel(), d_steps.reshape(-1, 3 * STATE), len(words))
            grads[f"x_{d}"], grads[f"bias_{d}"] = x.T @ d_word, d_word.sum(0)
            d_inputs.append(d_word @ p[f"x_{d}"].T)
        d_x = d_inputs[0] + d_inputs[1]
        grads["words"] = scatter(own, d_x[:, :WORD_IN], VOCABULARY + 1)
        grads["words"][VOCABULARY] = 0
        grads["chars"] = scatter(grams, np.repeat(d_x[:, WORD_IN:] / sizes[:, None], sizes, axis=0), GRAMS)
        return grads

    def rows_of(self, parts: Iterable[list[bytes]]) -> np.ndarray:
        """Row of each word in the table of inputs already multiplied by the weights, made for each word once."""
        if len(self.known) > REMEMBERED:
            self.known, self.inputs = {}, self.inputs[:0]
        found, new = [], {}
        for words in parts:
            rows = list(map(self.known.get, words))
            for i, r in enumerate(rows):
                if r is None:  # below zero until all new words are there
                    rows[i] = -1 - new.setdefault(words[i], len(new))
            found.append(np.array(rows, np.int64))
        out = np.concatenate(found)
        if new:
            order = sorted(new)
            places = np.empty(len(new), np.int64)
            places[[new[w] for w in order]] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(order, range(len(self.known), len(self.known) + len(new))))
            self.inputs = np.concatenate([self.inputs, self.project(self.embed(order)[0])])
            late = np.flatnonzero(out < 0)
            out[late] = places[-1 - out[late]]
        return out

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Logits of all overlapping windows of each whole text; a text without words has the logit of an empty window."""
        lengths: list[int] = []

        def parts() -> Iterator[list[bytes]]:
            for first in range(0, len(texts), TEXTS):
                lines = [words_of(t) for t in texts[first : first + TEXTS]]
                lengths.extend(map(len, lines))
                yield [w for line in lines for w in line]

        rows = self.rows_of(parts())
        firsts = np.cumsum([0, *lengths])
        starts = [window_starts(n) for n in lengths]
        counts = np.array([len(s) for s in starts])
        at = np.concatenate([first + s for first, s in zip(firsts, starts)])
        size = np.repeat(np.minimum(lengths, WINDOW), counts)
        out = np.empty(len(at), np.float32)
        for whole in (True, False):
            mine = np.flatnonzero((size == WINDOW) == whole)
            for part in np.split(mine, range(2048, len(mine), 2048)) if len(mine) else []:
                index = at[part] + np.arange(WINDOW)[:, None]
                mask = None if whole else np.arange(WINDOW)[:, None] < size[part]
                if not len(rows):
                    steps = np.zeros((WINDOW, len(part), 6 * STATE), np.float32)
                else:
                    steps = self.inputs[rows[np.minimum(index, len(rows) - 1)]]
                out[part] = self.logits(steps, mask)
        return np.split(out, np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each whole text is toxic, from its most toxic window."""
        most = np.array([x.max() for x in self.window_logits(texts)]) if texts else np.zeros(0)
        return sigmoid(self.a * most + self.b)


def train(sample: pd.DataFrame, seed: int = 3) -> Network:
    """Fit a network on (text, y).

    A toxic document says only that some of its windows are toxic: after the
    first epoch those that the network so far finds most toxic stand for it. Of
    a clean document the windows that seem most toxic are always among those
    trained on. Every fifth document is kept from that and calibrates the logits
    of whole documents.
    """
    random = np.random.default_rng(seed)
    lines, y = [words_of(t) for t in sample["text"]], sample["y"].to_numpy(np.float32)
    seen = Counter(w for line in lines for w in set(line))
    common = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:VOCABULARY]
    net = Network.fresh({w: i for i, w in enumerate(common)}, seed)
    if len(set(y)) < 2:  # nothing to tell apart
        net.a, net.b = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    learn = np.arange(len(lines)) % 5 > 0  # the rest only calibrates
    adam = Adam(net.params, RATE)
    rank: list[np.ndarray] | None = None
    steps = sum(TOXIC_WINDOWS if k else CLEAN_WINDOWS + HARD_WINDOWS for k in y[learn]) / BATCH
    epochs = max(EPOCHS, int(LEAST_STEPS / steps))
    for epoch in range(epochs):
        picked = []
        for i in np.flatnonzero(learn):
            line = lines[i]
            starts = window_starts(len(line))
            chosen = random.permutation(starts)[: TOXIC_WINDOWS if y[i] else CLEAN_WINDOWS]
            if rank is not None:
                top = starts[np.argsort(-rank[i], kind="stable")]
                chosen = top[: max(1, min(TOXIC_WINDOWS, len(starts)) // 2)] if y[i] else {*chosen, *top[:HARD_WINDOWS]}
            picked += [(i, s) for s in sorted(chosen)] if line else []
        order = random.permutation(len(picked))
        for at in range(0, len(order), BATCH):
            batch = [picked[j] for j in order[at : at + BATCH]]
            cut = [lines[i][s : s + WINDOW] for i, s in batch]
            words = sorted({w for c in cut for w in c})
            index = {w: k for k, w in enumerate(words)}
            windows = np.zeros((WINDOW, len(cut)), np.int64)
            mask = np.zeros(windows.shape, bool)
            for b, c in enumerate(cut):
                windows[: len(c), b] = [index[w] for w in c]
                mask[: len(c), b] = True
            adam.rate = RATE * (1 - 0.8 * (epoch + at / len(order)) / epochs)
            adam.update(net.train_step(words, windows, mask, y[[i for i, _ in batch]]))
        net.known, net.inputs = {}, net.inputs[:0]
        rank = [x for at in range(0, len(sample), 256) for x in net.window_logits(list(sample["text"][at : at + 256]))]
    most = np.array([x.max() for x in rank], np.float64)
    net.a, net.b = calibrate(most[~learn], y[~learn])
    net.known, net.inputs = {}, net.inputs[:0]
    return net


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity", dict)  # words are remembered by the task alone
        for b in batches:
            scores = net.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores.astype(np.float64))], names=["doc_id", "text_hash", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return train(labelled_sample(docs, labels, "toxic", PARTS, HELD_OUT))


def toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, text_hash, score) of each row's whole text.

    Null texts are scored as empty ones; rows that repeat each get a row, null
    ids are kept, an empty table gives no rows, further columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(lean(_scored(net)), "doc_id long, text_hash long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below CUT, with all their columns."""
    net = fit(docs, labels)
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity", dict)
        for b in batches:
            scores = net.scores(b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array(scores < CUT))

    return docs.mapInArrow(lean(clean), docs.schema)
