"""Long repeated byte strings by bucket-pointer refinement over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tidegauge.llm.common import membership, possible, ragged, small_batches, stored

#: Bytes of a string that counts as repeated when it starts in two places.
LENGTH = 400
#: Numbers of neighbouring strings that one bucket speaks for, level by level; each divides the one before it.
SPANS = (289, 17, 1)
#: Bytes that all strings of a first bucket share: its q-gram.
GRAM = LENGTH + 1 - SPANS[0]
#: Bytes that are sampled at a time; only longer texts are cut, at multiples of it.
CHUNK = 2 << 20
FULL = (1 << 64) - 1

RUN = "id long, h long, lo long, hi long, at long, g long, c0 long, c1 long"
RUN_NAMES = [c.split()[0] for c in RUN.split(", ")]
ITEM = f"{RUN}, alone boolean"


def suffix_order(data: np.ndarray) -> np.ndarray:
    """A key for each byte: a hash of the 8 bytes from it above its position, so keys differ and ties go to the left."""
    grams = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)


def least_in(keys: np.ndarray, size: int) -> np.ndarray:
    """Smallest key of each ``size`` neighbours, by minima from both ends of blocks of that size."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % size, FULL, np.uint64)]).reshape(-1, size)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - size + 1], left[size - 1 : n])


def sampled(data: np.ndarray, starts: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last, suffix): runs of strings of LENGTH bytes that sample the same suffix.

    Each string samples the suffix with the smallest key among its first
    SPANS[0]. The choice depends on the string alone, so equal strings sample
    suffixes at the same offset; a text has about two samples in SPANS[0] bytes.
    Segments are given by their first byte and their number of strings.
    """
    least = least_in(suffix_order(data), SPANS[0])
    at = ragged(starts, strings)
    suffix = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = suffix[1:] != suffix[:-1]
    first = np.flatnonzero(new)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    return np.searchsorted(starts, lo, "right") - 1, lo, hi, suffix[first]


def _segments(sizes: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, start, end) that cover all strings of texts of these sizes, some CHUNK bytes each."""
    group, held = [], 0
    for row, n in enumerate(sizes):
        for start in range(0, n - LENGTH + 1, CHUNK):
            end = min(n, start + CHUNK + LENGTH - 1)
            if group and held + end - start > CHUNK:
                yield group
                group, held = [], 0
            group.append((row, start, end))
            held += end - start
    if group:
        yield group


def _digests(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run: its q-gram bucket ``g`` and its class (c0, c1), the digest of all bytes of its strings."""
    for b in batches:
        texts = b.column(2).to_pylist()
        for group in _segments([len(t) for t in texts]):
            raw = b"".join(texts[row][start:end] for row, start, end in group)
            row, start, end = np.array(group).T
            sizes = end - start
            firsts = np.cumsum(sizes) - sizes
            segment, lo, hi, at = sampled(np.frombuffer(raw, np.uint8), firsts, sizes - LENGTH + 1)
            g = np.array([xxh3_64_intdigest(raw[a : a + GRAM]) for a in at.tolist()], np.uint64).view(np.int64)
            c = _digests([xxh3_128_digest(raw[x : y + LENGTH], seed=a - x) for x, y, a in zip(lo.tolist(), hi.tolist(), at.tolist())])
            move, mine = (start - firsts)[segment], pa.array(row[segment])
            columns = [lo + move, hi + move, at + move, g, c[:, 0], c[:, 1]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(mine), b.column(1).take(mine), *map(pa.array, columns)], names=RUN_NAMES)


def _finer(before: int, span: int):
    """Cut runs of ``before`` strings at most into runs of ``span``, each in the bucket of its parent and of what lies farther out.

    All strings of a bucket share the bytes from its last string's start to its
    first one's end. A finer bucket is named by its parent's name, its offset
    and the bytes that are new on either side, which stand for the ranks of the
    suffixes at later offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, digests = [], []
            for i, (text, runs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for r in runs:
                    lo, hi, at = r["lo"], r["hi"], r["at"]
                    parent = (at - hi) // before
                    left, right = at - parent * before, at - (parent + 1) * before + LENGTH + 1
                    for k in range((at - hi) // span, (at - lo) // span + 1):
                        x, y = max(lo, at - (k + 1) * span + 1), min(hi, at - k * span)
                        new = text[at - k * span : left] + text[right : at - (k + 1) * span + LENGTH + 1]
                        g = xxh3_64_intdigest(new, (r["g"] + k * 0x9E3779B97F4A7C15) & FULL)
                        out.append((i, x, y, at, g if g < 1 << 63 else g - (1 << 64), r["alone"]))
                        digests.append(xxh3_128_digest(text[x : y + LENGTH], seed=at - x))
            if out:
                i, lo, hi, at, g, alone = zip(*out)
                c = _digests(digests)
                columns = [pa.array(x, pa.int64()) for x in (lo, hi, at, g)] + [pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(alone)]
                mine = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(mine), b.column(1).take(mine), *columns], names=[*RUN_NAMES, "alone"])

    return run


def _only_possible(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(possible(bits, b.column(1).to_numpy().view(np.uint64))))

    return run


def _measured(bits: np.ndarray):
    """Bytes and hash of each whole text; the text goes along only if something of it may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = possible(bits, b.column(2).to_numpy().view(np.uint64)).tolist()
            texts = [t or b"" for t in b.column(3).to_pylist()]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns, pa.array([t if m else None for t, m in zip(texts, maybe)], pa.binary())], names=MEASURED_NAMES)

    return run


MEASURED = "doc_id long, id long, h long, n_bytes long, whole_sha256 string, text binary"
MEASURED_NAMES = [c.split()[0] for c in MEASURED.split(", ")]
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
KEPT_NAMES = [c.split()[0] for c in KEPT.split(", ")]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, sha = b.column(1).to_pylist(), b.column(2).to_pylist()
        removed, spans = [0] * b.num_rows, [[] for _ in sizes]
        for i, (n, text, runs) in enumerate(zip(sizes, b.column(3).to_pylist(), b.column(4).to_pylist())):
            if runs:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, [r["lo"] for r in runs], 1)
                np.add.at(change, [r["hi"] + LENGTH for r in runs], -1)
                gone = np.cumsum(change)[:-1] > 0
                removed[i] = int(gone.sum())
                sha[i] = hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()
                spans[i] = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist()
        columns = [pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=KEPT_NAMES)


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, h, runs): what a text has, in one list; it is never longer than the text."""
    return rows.groupBy("id", "h").agg(F.collect_list(F.struct(*columns)).alias("runs"))


def _classes(rows: DataFrame, alone: Column) -> DataFrame:
    """A row for each class of a bucket: its number of runs, whether it is a single run not known to repeat, and one of its runs."""
    rep = F.min(F.struct("id", "h", "lo", "hi", "at")).alias("rep")
    return rows.groupBy("g", "c0", "c1").agg(F.count(F.lit(1)).alias("n"), F.count_if(alone).alias("_alone"), rep).withColumn(
        "alone", (F.col("n") == 1) & (F.col("_alone") == 1)
    )


def repeats(texts: DataFrame) -> DataFrame:
    """(id, h, lo, hi): strings of LENGTH bytes starting at lo to hi in the text (id, h) that also start elsewhere.

    ``texts`` has (id, h, text), id and h together naming a text.
    """
    runs = stored(texts.mapInArrow(_samples, RUN), "samples")
    # stored, so that the join deals both sides out anew and Spark can split a hot bucket
    shared = stored(runs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "shared-buckets")
    now, alone = stored(runs.join(shared, "g"), "shared-samples"), F.lit(True)
    found = None
    for before, span in zip((None, *SPANS), SPANS):
        if before is not None:
            listed = stored(_listed(reps, "lo", "hi", "at", "g", "alone"), "open-runs")
            bits = membership(listed.select("h"), "h")
            there = texts.mapInArrow(_only_possible(bits), "id long, h long, text binary")
            now = stored(there.join(listed, ["id", "h"]).select("id", "h", "text", "runs").mapInArrow(_finer(before, span), ITEM), "finer-runs")
            alone = F.col("alone")
        classes = stored(_classes(now, alone), "classes")
        known = now.where(alone).join(classes.where("n > 1").select("g", "c0", "c1"), ["g", "c0", "c1"]).select("id", "h", "lo", "hi")
        found = known if found is None else found.unionByName(known)
        # a bucket goes on where an unsettled class has others beside it, each by one run
        mixed = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.max("alone").alias("any"))
        mixed = stored(mixed.where((F.col("classes") > 1) & F.col("any")).select("g"), "mixed-buckets")
        reps = classes.join(mixed, "g").select("g", "rep.*", "alone")
    return found


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte, byte after the last) removed.

    A byte goes if it is covered by a string of LENGTH bytes that also starts
    anywhere else, in another document or the same one; strings may overlap and
    are judged on the input. Texts are UTF-8 bytes.

    Suffixes are sorted only where it matters. Each string samples one suffix
    by a rule that depends on the string alone; runs of neighbouring strings
    mostly sample the same. Samples are put in buckets by their first GRAM
    bytes. A bucket with one sample is final: nothing in it repeats. In the
    others, runs with the same bytes form classes; a class of several runs
    repeats whole. A run alone in its class, in a bucket with other classes, is
    refined: it is cut into shorter runs whose buckets are named by the old
    bucket and the bytes at later offsets, against one run of every class in
    it. So most runs leave after a level, and only strings at the ends of a
    repeated passage are ever looked at one by one. Names of buckets are 64-bit
    hashes, where a collision only costs work; equality of runs is that of
    128-bit digests of all their bytes.

    A passage of very many documents has one row per task and class in the
    aggregates, and its rows meet their class in joins that Spark can split.

    Null and empty texts, and those shorter than LENGTH, keep all bytes. Each
    row is a document of its own, also with a repeated or null id: two equal
    rows repeat each other. Further columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text, doc_id.isNull()).alias("h"), text.cast("binary").alias("text")
    )
    long = named.where(F.length("text") >= LENGTH).select("id", "h", "text")
    listed = stored(_listed(repeats(long), "lo", "hi"), "repeated-runs")
    measured = named.mapInArrow(_measured(membership(listed.select("h"), "h")), MEASURED)
    joined = measured.join(listed, ["id", "h"], "left")
    return joined.select("doc_id", "n_bytes", "whole_sha256", "text", "runs").mapInArrow(_kept, KEPT)
