"""What the operators of this folder share: stored tables, text helpers and components."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidegauge.session import shared_dir

#: Documents per Arrow batch: whole texts are handed to Python, so few at a time.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Hand few documents at a time to Python, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it again: the lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of crc32 of the id as text; null ids count as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


#: Bits of a membership map, 2 MB whatever it is made from.
MAP_BITS = 1 << 24


def membership(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter with two probes over a long column, packed into MAP_BITS bits.

    Its size is fixed, so it may go to every task; with many hashes it lets
    more through, and the join behind it decides in any case.
    """
    h = F.col(column)
    probes = F.array(h.bitwiseAND(F.lit(MAP_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(MAP_BITS - 1)))
    slots = hashes.select(F.explode(probes).alias("slot"))
    parts = (
        slots.groupBy((F.col("slot") / 32768).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
        .collect()
    )
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def possible(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) the map may hold."""
    low = (hashes & np.uint64(MAP_BITS - 1)).astype(np.int64)
    out = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0
    at = np.flatnonzero(out)
    high = ((hashes[at] >> np.uint64(32)) & np.uint64(MAP_BITS - 1)).astype(np.int64)
    out[at] = (bits[high >> 3] >> (high & 7).astype(np.uint8)) & 1 > 0
    return out


T = TypeVar("T")
#: What the tasks of one operator remember in this worker.
_REMEMBERED: dict[str, object] = {}


def remembered(operator: str, make: Callable[[], T]) -> T:
    """What the tasks of an operator keep in this worker from one to the next.

    A worker outlives the stages of a pipeline, so the memory of any other
    operator is given up first and never adds up.
    """
    if operator not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[operator] = make()
    return _REMEMBERED[operator]  # type: ignore[return-value]


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker holds no freed memory.

    An executor keeps more workers than it has tasks at a time, and they take turns.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class _Places(dict):
    """Place of each word in a growing list of hashes."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed, self.hashes = seed, []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.hashes)
        self.hashes.append(xxh64_intdigest(word, self.seed))
        return place


class WordHashes:
    """XXH64 of words, remembered; a full memory is emptied."""

    def __init__(self, seed: int, most: int = 1_000_000):
        self.seed, self.most = seed, most
        self.places, self.table = _Places(seed), np.zeros(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.places) > self.most:
            self.places, self.table = _Places(self.seed), self.table[:0]
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if len(self.table) < len(self.places):
            self.table = np.concatenate([self.table, np.array(self.places.hashes[len(self.table) :], np.uint64)])
        return self.table[at]


#: Bytes of a word up to which many words are hashed together, eight bytes at a time; longer ones go one by one.
LONG_WORD = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
#: The first n of eight bytes, by n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_hashed(raw: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word, the words being ranges of ``raw``; it depends on the bytes of the word alone.

    Words of up to eight bytes and one size never agree.
    """
    eights = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    out = (sizes.astype(np.uint64) + np.uint64(seed << 32)) * _FACTORS[0]
    out ^= out >> np.uint64(29)
    at = np.arange(len(starts)) if not len(sizes) or sizes.max() <= LONG_WORD else np.flatnonzero(sizes <= LONG_WORD)
    long, place, left = np.flatnonzero(sizes > LONG_WORD), starts[at], sizes[at]
    while len(at):
        h = (out[at] ^ (eights[place] & _FIRST[np.minimum(left, 8)])) * _FACTORS[1]
        out[at] = h ^ (h >> np.uint64(32))
        more = np.flatnonzero(left > 8)
        at, place, left = at[more], place[more] + 8, left[more] - 8
    out *= _FACTORS[2]
    out ^= out >> np.uint64(29)
    for i in long.tolist():
        out[i] = xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]], seed)
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph whose edges are the rows (a, b), both long.

    Returns (node, root) with the smallest node of a component as its root;
    nodes without an edge are not in the result. Large-star and small-star
    steps take turns until the edges are stars: a number of rounds that grows
    with the logarithm of the graph. Each round only takes minima per node,
    pre-aggregated, and joins them back, so that a node of very many edges is
    no group of its own; the rounds end in stored tables.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
