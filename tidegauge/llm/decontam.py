"""Benchmark decontamination by spaced seeds: hashes that ignore fixed word positions, then verified overlaps."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import lean, membership, possible, small_batches, stored, words_hashed

#: Words of an overlap, and how many of them may differ: four fifths and more must agree.
SPAN, DIFFER = 13, 2
#: Positions of a span by block; a mask reads two blocks and ignores the other two.
BLOCKS = (range(0, 3), range(3, 6), range(6, 9), range(9, 13))
#: Two differing words spoil at most two of four blocks, so some mask reads only words that agree.
MASKS = tuple(combinations(range(len(BLOCKS)), 2))
WORD = re.compile(r"\w+")
SEED = 9
#: Code points whose words are hashed at a time; only a longer text alone is more.
CHUNK = 2 << 20
_RANDOM = np.random.default_rng(9)
FACTORS = _RANDOM.integers(1, 1 << 63, SPAN).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _RANDOM.integers(1, 1 << 63, len(MASKS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """Letters, digits and underscores in lower case: marks and case don't hide a passage."""
    return WORD.findall((text or "").lower())


@cache
def _word_marks(end: int) -> np.ndarray:
    """Which code points below ``end`` are part of words."""
    out = np.zeros(end, bool)
    for m in WORD.finditer("".join(map(chr, range(end)))):
        out[m.start() : m.end()] = True
    return out


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): a hash of each of ``words_of`` of the texts, one text after the other, and their number in each."""
    lines = [(t or "").lower() for t in texts]
    whole = "\n".join(lines)
    raw = whole.encode()
    plain = len(raw) == len(whole)
    points = np.frombuffer(raw, np.uint8) if plain else np.frombuffer(whole.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(np.diff(_word_marks(128 if plain else sys.maxunicode + 1)[points], prepend=False, append=False))
    starts, ends = ends[::2], ends[1::2]
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(line) + 1 for line in lines)])))
    if not plain:  # from code points to bytes
        width = np.ones(len(points) + 1, np.int64)
        for least in (0x80, 0x800, 0x10000):
            width[1:] += points >= least
        width[0] = 0
        place = np.cumsum(width)
        starts, ends = place[starts], place[ends]
    return words_hashed(raw, starts, ends - starts, SEED), sizes


def span_hashes(h: np.ndarray) -> np.ndarray:
    """(masks, positions) hashes of every span of words with these hashes under every mask."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros((len(MASKS), 0), np.uint64)
    blocks = []
    for block in BLOCKS:
        total = np.zeros(n, np.uint64)
        for j in block:
            total += h[j : j + n] * FACTORS[j]
        blocks.append(total)
    mixed = np.stack([(blocks[a] + blocks[b]) * salt for (a, b), salt in zip(MASKS, SALTS)])
    mixed ^= mixed >> np.uint64(29)
    return mixed


def seed_hashes(words: list[str]) -> np.ndarray:
    """(masks, positions) hashes of every span of the words under every mask."""
    raw = [w.encode() for w in words]
    sizes = np.array([len(w) for w in raw], np.int64)
    return span_hashes(words_hashed(b"".join(raw), np.cumsum(sizes) - sizes, sizes, SEED))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Neighbouring texts of at most CHUNK code points together, or one longer text, each time with the row of the first."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 1
        if i > first and held + size > CHUNK:
            yield first, texts[first:i]
            first, held = i, 0
        held += size
    if texts:
        yield first, texts[first:]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for item, text in zip(*(c.to_pylist() for c in b.columns)):
            for mask, row in enumerate(seed_hashes(words_of(text)).view(np.int64)):
                out += [(item, at, mask, h) for at, h in enumerate(row.tolist())]
        columns, types = list(zip(*out)) or [[]] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["item_id", "item_pos", "mask", "hash"])


REGION = "doc_id long, text_hash long, region long, start long, words array<string>, hits array<struct<pos:long,mask:int,hash:long>>"


def _regions(bits: np.ndarray):
    """Stretches of whole texts around seeds that the test set may hold, with the words a span can reach from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, texts = [], b.column(3).to_pylist()
            for first, group in _chunks(texts):
                h, sizes = hashed_words(group)
                ends, hashes = np.cumsum(sizes), span_hashes(h)
                mask, pos = np.nonzero(possible(bits, hashes.ravel()).reshape(hashes.shape))
                text_of = np.searchsorted(ends, pos, "right")
                inside = pos + SPAN <= ends[text_of]
                order = np.argsort(pos[inside], kind="stable")
                mask, pos, text_of = mask[inside][order], pos[inside][order], text_of[inside][order]
                for mine in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(text_of)) + 1) if len(pos) else []:
                    i = int(text_of[mine[0]])
                    doc_id, text_hash, row = (b.column(k)[first + i].as_py() for k in range(3))
                    words, at = words_of(group[i]), pos[mine] - (ends[i] - sizes[i])
                    for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(at) >= 2 * SPAN) + 1):
                        start, end = max(0, at[part[0]] - SPAN + 1), min(len(words), at[part[-1]] + 2 * SPAN - 1)
                        found = hashes[mask[mine[part]], pos[mine[part]]].view(np.int64)
                        hits = [{"pos": p, "mask": m, "hash": x} for p, m, x in zip(at[part].tolist(), mask[mine[part]].tolist(), found.tolist())]
                        out.append((doc_id, text_hash, row, int(start), words[start:end], hits))
            table = pa.Table.from_pylist(
                [dict(zip(("doc_id", "text_hash", "region", "start", "words", "hits"), r)) for r in out], schema=REGIONS
            )
            yield from table.to_batches()

    return run


REGIONS = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("region", pa.int64()), ("start", pa.int64())]
    + [("words", pa.list_(pa.string()))]
    + [("hits", pa.list_(pa.struct([("pos", pa.int64()), ("mask", pa.int32()), ("hash", pa.int64())])))]
)


def overlap(doc: list[str], item: list[str], shift: int) -> tuple[int, int, int]:
    """Best stretch of two word lists laid over each other: (first item word, words, agreeing words).

    ``item[i]`` lies on ``doc[i + shift]``. A stretch is a union of spans of
    which at least SPAN - DIFFER words agree; (0, 0, 0) if there is none.
    """
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.array([item[i] == doc[i + shift] for i in range(first, last)], np.int64)
    if len(same) < SPAN:
        return 0, 0, 0
    sums = np.convolve(same, np.ones(SPAN, np.int64), "valid")
    good = np.flatnonzero(sums >= SPAN - DIFFER)
    if not len(good):
        return 0, 0, 0
    runs = np.split(good, np.flatnonzero(np.diff(good) > SPAN) + 1)
    best = max(runs, key=lambda r: r[-1] - r[0])
    a, b = best[0], best[-1] + SPAN
    return int(first + a), int(b - a), int(same[a:b].sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, text_hash, item_id, text, words, shift, start in zip(*(c.to_pylist() for c in b.columns)):
            first, size, same = overlap(words, words_of(text), shift - start)
            if size:
                out.append((doc_id, text_hash, item_id, first, size, same, shift + first))
        columns = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=[c.split()[0] for c in VERIFIED.split(", ")])


VERIFIED = (
    "doc_id long, text_hash long, item_id long, item_start long, overlap_words long, same_words long, doc_start long"
)


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap, with their longest overlap.

    An overlap is a stretch of words, case and marks aside, in which every one
    of its spans of 13 words has at most two differing words. Each span of
    either side is hashed under six fixed masks; hashes of the whole documents
    pass a membership map of the test hashes, of fixed size, and are then
    joined with them. Every candidate pair is compared word by word around its
    hits.

    Columns: doc_id, text_hash, item_id, item_start, overlap_words, same_words,
    doc_start (words from 0). Documents and items with fewer than 13 words, null
    or empty texts and empty tables give no row. Rows that repeat give theirs
    once; null ids are kept. Further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tests = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    seeds = stored(tests.mapInArrow(lean(_items), "item_id long, item_pos long, mask int, hash long"), "seeds")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("region"),
        F.col("text").cast("string"),
    )
    regions = stored(rows.mapInArrow(lean(_regions(membership(seeds, "hash"))), REGION), "regions")
    hits = regions.select("region", "start", F.explode("hits").alias("h")).select("region", "start", "h.*")
    pairs = (
        hits.join(seeds, ["mask", "hash"])
        .select("region", "start", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .distinct()
    )
    placed = pairs.join(regions.drop("hits"), ["region", "start"]).join(tests, "item_id")
    found = placed.select("doc_id", "text_hash", "item_id", "text", "words", "shift", "start").mapInArrow(lean(_verify), VERIFIED)
    best = F.max_by(F.struct("item_start", "overlap_words", "same_words", "doc_start"), F.struct("overlap_words", "same_words", -F.col("doc_start"), -F.col("item_start")))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without an overlap with any item, as they are."""
    bad = contaminations(docs, items).select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")
