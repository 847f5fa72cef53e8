"""Shortest-pack-first packing of tokenised documents over the histogram of their lengths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import crc, lean, remembered, small_batches, stored

CAPACITY, END_ID = 2048, 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a worker remembers; a full memory is emptied, ids stay the same.
REMEMBERED = 1_000_000
#: Texts that are cut to words at a time; what a worker holds for them follows from it.
TEXTS = 128
#: Words of letters only are one piece for the merges.
PLAIN = re.compile(r"[a-zß-öø-ž]+")
#: A full stop or comma alone between a letter and white space is a piece of its own.
STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")


class WordIds:
    """Ids of whole texts by a tokenizer that never joins what ASCII white space parts.

    Each distinct word is given to the tokenizer once and its ids are
    remembered, as words repeat far more often than texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words: plain ones are encoded in one line and told apart by the ends of words."""
        texts = [w.decode() for w in words]
        easy = [t for t in texts if PLAIN.fullmatch(t)]
        got = np.array(self.tokenizer.encode(" ".join(easy), add_special_tokens=False).ids, np.uint32)
        bounds = np.flatnonzero(self.ends[got]) + 1
        if len(bounds) != len(easy):  # taken for plain, but cut otherwise by the tokenizer
            easy, got, bounds = [], got[:0], bounds[:0]
        plain = set(easy)
        rest = [t for t in texts if t not in plain]
        more = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        at = len(self.known)
        self.known.update(zip((t.encode() for t in easy + rest), range(at, at + len(texts))))
        sizes = np.concatenate([np.diff(bounds, prepend=0), [len(x) for x in more]]).astype(np.int64)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, got, np.array([i for x in more for i in x], np.uint32)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a text that spells a special token goes to the tokenizer whole."""
        if not texts:
            return []
        special = [i for i, t in enumerate(texts) if "<|" in t]
        lines = [[] if "<|" in t else STOP.sub(rb" \1", t.encode().lower()).split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [w for line in lines for w in line]
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            self.learn(sorted({words[i] for i in missing}))
            for i in missing:
                found[i] = self.known[words[i]]
        at = np.array(found, np.int64)
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.cumsum([len(line) for line in lines])[:-1]
        bounds = np.concatenate([[0], ends])[cuts]
        out = np.split(ids, bounds)
        for i in special:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def word_ids(path: str) -> WordIds:
    return remembered(f"packing by {path}", lambda: WordIds(path))


PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str):
    """Tokenise whole texts; each document gives pieces of CAPACITY ids and one of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for b in batches:
            out = []
            for first in range(0, b.num_rows, TEXTS):
                doc_ids, rows, texts = (c.to_pylist() for c in b.slice(first, TEXTS).columns)
                for doc_id, row, ids in zip(doc_ids, rows, encode([t or "" for t in texts])):
                    ids = np.append(ids, np.uint32(END_ID))
                    for at in range(0, len(ids), CAPACITY):
                        part = ids[at : at + CAPACITY]
                        out.append((doc_id, row, at, len(part), crc(part), len(ids)))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")]
            )

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of every row of documents, stored, so that their row numbers hold for all later steps."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(lean(_pieces(tokenizer)), PIECES), "pieces")


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a pack, number of such packs) for a histogram of lengths.

    Lengths are placed longest first, each into the packs that are filled
    least; packs of one pattern are counted, not listed. A length opens new
    packs only where not even those have room. Every length splits at most one
    pattern and opens at most one, so there are never more than two patterns
    for each length, whatever the counts are.
    """
    open_packs: dict[int, list[tuple[list[int], int]]] = {}
    done: list[tuple[list[int], int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            used = min(open_packs, default=capacity)
            if used + length > capacity:
                open_packs.setdefault(length, []).append(([length], left))
                break
            pattern, n = open_packs[used].pop()
            take = min(n, left)
            if n > take:
                open_packs[used].append((pattern, n - take))
            if not open_packs[used]:
                del open_packs[used]
            grown = (pattern + [length], take)
            if used + length == capacity:
                done.append(grown)
            else:
                open_packs.setdefault(used + length, []).append(grown)
            left -= take
    return done + [p for used in sorted(open_packs, reverse=True) for p in open_packs[used]]


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, in order of rank: (first rank, first sequence, offset) of each place in a pattern."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        sequence += n
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their rank among the rows of equal length, from 0.

    A length may hold a third of all rows, so each length is cut into as many
    groups as the root of the number of rows: groups are ranked each for
    themselves and get their first rank from the counts of those before them.
    """
    groups = isqrt(rows.count()) + 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("row", "start")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(firsts, ["length", "part"])
        .withColumn("rank", F.col("first") + F.col("inside"))
        .drop("part", "first", "inside")
    )


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and an end id; a null or empty text is the end
    id alone. Documents beyond the capacity are cut into full pieces, which are
    sequences of their own, and a rest. The histogram of lengths, at most one
    count per length up to the capacity, is all that the driver sees; its
    patterns are joined back to the pieces by their rank among pieces of equal
    length. Rows that repeat are packed each; an empty table gives no rows.
    """
    rows = pieces(docs, tokenizer)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(shortest_pack_first(counts, capacity))
    tables = {length: tuple(np.array(c, np.int64) for c in zip(*found)) for length, found in places.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                firsts, sequences, offsets = tables[int(size)]
                at = np.searchsorted(firsts, rank[mine], side="right") - 1
                sequence[mine] = sequences[at] + rank[mine] - firsts[at]
                offset[mine] = offsets[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in kept.split(", ")])

    kept = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    named = ranked(rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return named.mapInArrow(lean(placed), kept)
