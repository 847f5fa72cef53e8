"""Pairs of similar texts by exact Jaccard similarity of their word shingles, found by prefix filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidegauge.llm.common import WordHashes, components, lean, membership, possible, ragged, small_batches, stored

Batches = Iterator[pa.RecordBatch]

#: Words of a shingle; similarity from which on texts are near-duplicates, as a fraction of whole numbers.
SHINGLE, SIMILAR = 5, (4, 5)
SEED = 42
#: Documents that are sampled to find common shingles, and how many of these are kept. They only set the order of shingles.
SAMPLE_DOCS, COMMON = 16_384, 1 << 18
#: Members of a bucket up to which all its pairs are compared at once; larger ones are compared with one member first.
ALL_PAIRS = 16
#: Word hashes and digests that a task remembers; a full memory is emptied.
WORDS, TEXTS = 100_000, 200_000
#: Fewest and most bits of a sketch; between them a text gets about one bit for each shingle.
SKETCH_BITS = (256, 1 << 16)
#: Odd factors that mix the words of a shingle by place.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # the words of fingerprints


def _windows(w: np.ndarray) -> np.ndarray:
    """Hash of each shingle, in the order of the text, from the hashes of its words."""
    n, size = max(1, len(w) - SHINGLE + 1), min(SHINGLE, len(w))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out + w[k : k + n]) * FACTORS[k]
        out ^= out >> np.uint64(29)
    return out


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all shingles of a text; fewer words than SHINGLE are one shingle, none are none."""
    return np.unique(_windows(hashes(words))) if words else np.zeros(0, np.uint64)


def digest(words: list[bytes]) -> int:
    """A text as a signed number, whatever stands between its words."""
    return xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)


def prefix_size(n: int) -> int:
    """Shingles of a text of n, first in a common order, of which any similar text shares one in its own prefix."""
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return SIMILAR[1] * np.minimum(a, b) >= SIMILAR[0] * np.maximum(a, b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least SIMILAR."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return sum(SIMILAR) * both >= SIMILAR[0] * (len(a) + len(b))


def sketch(x: np.ndarray) -> bytes:
    """Parity of the number of shingles that fall on each bit; the number of bits is a power of two that follows the set."""
    size = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << max(0, len(x) - 1).bit_length()))
    counts = np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Whether sets of n and m shingles with sketches x and y can have a similarity of at least SIMILAR.

    Sketches differ in at most as many bits as the sets do in shingles. The
    longer one is folded to the length of the other, which keeps parities.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    differ = int(np.bitwise_count(a ^ b).sum())
    return (SIMILAR[1] - SIMILAR[0]) * (n + m) >= sum(SIMILAR) * differ


def _sampled(batches: Batches) -> Batches:
    """(word, h, n): shingles h and words h of texts, and how many times they stand there."""
    hashes = WordHashes(SEED, WORDS)
    for b in batches:
        texts = [hashes(words) for text in b.column(0).to_pylist() if (words := split(text))]
        for word, x in (False, [np.unique(_windows(w)) for w in texts]), (True, texts):
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *x]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([word] * len(h), pa.bool_()), pa.array(h.view(np.int64)), pa.array(n)], names=["word", "h", "n"])


class Order:
    """An order of all shingles, rare ones first, from what repeats in a sample of texts.

    Shingles that repeat there come last, by how often they do. All others go
    by how often their words do, so that those no sample holds twice, most of
    a large table, still have an order: what has rare words is rare itself.
    """

    def __init__(self, common: pa.Table, words: pa.Table):
        self.common, self.counts = self._sorted(common)
        self.words, times = self._sorted(words)
        self.weights = np.floor(8 * np.log2(np.maximum(1, times))).astype(np.int16)

    @staticmethod
    def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h = t.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        return h[order], t.column("n").to_numpy()[order].astype(np.int32)

    @staticmethod
    def _of(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Value of each x, 0 if it is none of the sorted keys."""
        if not len(keys):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, values[at], 0).astype(np.int64)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        """Distinct shingles of a text of these word hashes, in order."""
        x, first = np.unique(_windows(w), return_index=True)
        weight = self._of(self.words, self.weights, w)
        times = sum(weight[k : len(weight) - min(SHINGLE, len(w)) + 1 + k] for k in range(min(SHINGLE, len(w))))[first]
        return x[np.argsort((self._of(self.common, self.counts, x) << 20) + times, kind="stable")]


def sampled_order(docs: DataFrame) -> Order:
    """An order of shingles by those and by the words of a sample of texts."""
    parts = -(-max(1, docs.count()) // SAMPLE_DOCS)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).distinct()
    counts = some.mapInArrow(lean(_sampled), "word boolean, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts, "sampled-shingles")
    top = [counts.where(F.col("word") == word).orderBy(F.col("n").desc(), "h").limit(COMMON).select("h", "n").toArrow() for word in (False, True)]
    return Order(*top)


def _prefixes(ordered: Order) -> Callable[[Batches], Batches]:
    """(h, n, i, c) for each shingle of a text's prefix, rare ones first: n is the size of its set, i the place, c the digest."""

    def run(batches: Batches) -> Batches:
        hashes, seen = WordHashes(SEED, WORDS), set()
        for b in batches:
            out: list[np.ndarray] = []
            sizes: list[tuple[int, int, int]] = []
            for text in b.column(0).to_pylist():
                words = split(text)
                c = digest(words)
                if not words or c in seen:  # equal texts have equal fingerprints
                    continue
                if len(seen) > TEXTS:
                    seen.clear()
                seen.add(c)
                x = ordered(hashes(words))
                out.append(x[: prefix_size(len(x))])
                sizes.append((len(out[-1]), len(x), c))
            if out:
                times, n, c = np.array(sizes, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(out).view(np.int64)),
                        pa.array(np.repeat(n, times).astype(np.int32)),
                        pa.array(ragged(np.zeros(len(times), np.int64), times).astype(np.int32)),
                        pa.array(np.repeat(c, times)),
                    ],
                    names=["h", "n", "i", "c"],
                )

    return run


def _runs(batches: Batches) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by ``h``, in parts that never cut a run of equal h."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None and rest["h"][-1].as_py() == t["h"][-1].as_py():
            rest = pa.concat_tables([rest, t])
            continue
        h = t["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        whole = t.slice(0, cut) if rest is None else pa.concat_tables([rest, t.slice(0, cut)])
        rest = t.slice(cut)
        if whole.num_rows:
            yield {k: whole[k].to_numpy() for k in whole.column_names}
    if rest is not None:
        yield {k: rest[k].to_numpy() for k in rest.column_names}


def _first_pairs(all_pairs: int) -> Callable[[Batches], Batches]:
    """Rows (h, n, a, b): pairs (a, b) to compare, and with b null the members of buckets with pairs still to come."""
    names = ["h", "n", "a", "b"]

    def run(batches: Batches) -> Batches:
        for r in _runs(batches):
            h, n, c = r["h"], r["n"].astype(np.int64), r["c"]
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            h, n, c, left_over = h[new], n[new], c[new], (r["n"] - r["i"])[new]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[starts, len(h)])
            left, right, large = [], [], []
            for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                if m <= all_pairs:
                    i, j = np.triu_indices(m, 1)
                else:  # the first of each range of sizes with all in it, and neighbours
                    i, j, at = [np.arange(m - 1)], [np.arange(1, m)], 0
                    while at < m:
                        end = int(np.searchsorted(n[s : s + m], n[s + at] * SIMILAR[1] // SIMILAR[0], side="right"))
                        i.append(np.full(end - at - 1, at))
                        j.append(np.arange(at + 1, end))
                        at = end
                    i, j = np.concatenate(i), np.concatenate(j)
                    large.append(np.arange(s, s + m))
                fit = similar_sizes(n[s + i], n[s + j])
                if m <= all_pairs:  # where two texts share their first shingle, no more than the shorter rest can be shared
                    fit &= sum(SIMILAR) * np.minimum(left_over[s + i], left_over[s + j]) >= SIMILAR[0] * (n[s + i] + n[s + j])
                left.append(s + i[fit])
                right.append(s + j[fit])
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                a, b = np.minimum(c[i], c[j]), np.maximum(c[i], c[j])
                pairs = np.unique(np.stack([a, b], 1), axis=0)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)
            if large:
                k = np.concatenate(large)
                yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(n[k]), pa.array(c[k]), pa.nulls(len(k), pa.int64())], names=names)

    return run


def differences(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How sets differ from what over half of them hold: (set, element, place), elements of few differences first."""
    own, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    _, element, times = np.unique(flat, return_inverse=True, return_counts=True)
    central = 2 * times > len(sets)
    column = np.cumsum(central) - 1
    inside = central[element]
    lacks = np.ones((len(sets), int(central.sum())), bool)
    lacks[own[inside], column[element[inside]]] = False
    row, lacked = np.nonzero(lacks)
    own, element = np.r_[own[~inside], row], np.r_[element[~inside], np.flatnonzero(central)[lacked]]
    order = np.lexsort((element, np.where(central, len(sets) - times, times)[element], own))
    size = np.bincount(own, minlength=len(sets))
    return own[order], element[order], ragged(np.zeros(len(sets), np.int64), size)


def close_pairs(sets: list[np.ndarray], n: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
    """Positions (i, j) of pairs that link all similar sets of different roots, in parts.

    Sets x and y differ in as many elements as their differences from any
    common centre do. With d elements of difference and n of its own a set has
    the weight w = 9 d - n (for a similarity of 4/5): a pair is similar if 18
    times what its differences share is at least the sum of its weights. If that
    is 0 or less, both are similar to the set of least weight, and these stars
    link them. Any other similar pair shares an element of its differences, in
    prefixes that follow from its weights. What most texts of a bucket have in
    common is no part of a difference, so a large group of near copies, or of
    texts with a common line, has few pairs here and no pair is lost.
    """
    own, element, place = differences(sets)
    size = np.bincount(own, minlength=len(sets))
    w = sum(SIMILAR) * size - (SIMILAR[1] - SIMILAR[0]) * n
    star = int(np.argmin(w))
    near = w <= -w[star]
    linked = np.flatnonzero(near & (root != root[star]))
    yield np.stack([np.full(len(linked), star), linked], 1)
    # what a set shares at least with one outside the star, of no smaller weight; and one outside with any of no larger weight
    least = np.where(near, w - w[star] + 1, 2 * w), w + w[star]
    small, large = (place <= (size - np.maximum(1, -(-x // (2 * sum(SIMILAR)))))[own] for x in least)
    large &= ~near[own]
    by_element = np.argsort(element[small], kind="stable")
    held, other, rest = element[small][by_element], own[small][by_element], (size[own] - place)[small][by_element]
    first = np.searchsorted(held, element[large])
    many = np.searchsorted(held, element[large], side="right") - first
    mine, left = own[large], (size[own] - place)[large]
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + (1 << 20), side="right")))
        met = ragged(first[at:end], many[at:end])
        j, i = np.repeat(mine[at:end], many[at:end]), other[met]
        fit = (w[i] <= w[j]) & (root[i] != root[j]) & similar_sizes(n[i], n[j])
        # from the first element that two share on, no more than the shorter rest can be shared
        fit &= 2 * sum(SIMILAR) * np.minimum(np.repeat(left[at:end], many[at:end]), rest[met]) >= w[i] + w[j]
        yield np.unique(np.stack([i[fit], j[fit]], 1), axis=0)
        at = end


def _further_pairs(cut: str) -> Callable[[Batches], Batches]:
    """Pairs (a, b) that link all similar members of a bucket whose components differ so far; those of a star with its bucket h.

    Sets come cut to numbers of type ``cut``. Cut sets differ in no more
    elements than the whole ones, so no similar pair is lost but where a star
    links two that are not similar to it when whole: its bucket is named for that.
    """

    def run(batches: Batches) -> Batches:
        for r in _runs(batches):
            h, n, c, root = r["h"], r["n"], r["c"], r["root"]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
                if (root[s:e] == root[s]).all():
                    continue
                for k, pairs in enumerate(close_pairs([np.frombuffer(x, cut) for x in r["s"][s:e]], n[s:e], root[s:e])):
                    a, b = c[s:e][pairs[:, 0]], c[s:e][pairs[:, 1]]
                    bucket = pa.nulls(len(a), pa.int64()) if k else pa.array(np.full(len(a), h[s]))
                    yield pa.RecordBatch.from_arrays([bucket, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["h", "a", "b"])

    return run


def _wanted(bits: np.ndarray, batches: Batches) -> Iterator[list[tuple[int, str, list[bytes]]]]:
    """Digest, text and words of the texts whose digest the map ``bits`` may hold, each once as long as it is remembered."""
    seen: set[int] = set()
    for b in batches:
        out = []
        for text in b.column(0).to_pylist():
            words = split(text)
            c = digest(words)
            if words and c not in seen and possible(bits, np.array([c], np.int64).view(np.uint64))[0]:
                if len(seen) > TEXTS:
                    seen.clear()
                seen.add(c)
                out.append((c, text, words))
        yield out


def _sketches(bits: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        hashes = WordHashes(SEED, WORDS)
        for texts in _wanted(bits, batches):
            rows = [(c, len(x), sketch(x)) for c, _, words in texts for x in [shingles(words, hashes)]]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "bits"])

    return run


def _sets(bits: np.ndarray, name: Callable[[str], int]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        hashes = WordHashes(SEED, WORDS)
        for texts in _wanted(bits, batches):
            columns = [
                pa.array([c for c, _, _ in texts], pa.int64()),
                pa.array([name(t) for _, t, _ in texts], pa.int64()),
                pa.array([shingles(w, hashes).tobytes() for _, _, w in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "name", "s"])

    return run


def _cut_sets(bits: np.ndarray, cut: str) -> Callable[[Batches], Batches]:
    """Digest and set of the texts that ``bits`` may hold, each shingle by the first bytes of its hash."""

    def run(batches: Batches) -> Batches:
        hashes, shift = WordHashes(SEED, WORDS), np.uint64(64 - 8 * np.dtype(cut).itemsize)
        for texts in _wanted(bits, batches):
            sets = [np.unique((shingles(w, hashes) >> shift).astype(cut)).tobytes() for _, _, w in texts]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in texts], pa.int64()), pa.array(sets, pa.binary())], names=["c", "s"])

    return run


def _possible_pairs(batches: Batches) -> Batches:
    for b in batches:
        yes = [may_be_similar(*r) for r in zip(*(b.column(k).to_pylist() for k in range(2, 6)))]
        yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _compared(batches: Batches) -> Batches:
    for b in batches:
        yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "name_a", "name_b"]).filter(pa.array(yes, pa.bool_()))


def _either(pairs: DataFrame) -> np.ndarray:
    """Map of the digests in pairs (a, b)."""
    return membership(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "c")


def _verified(texts: DataFrame, pairs: DataFrame, name: Callable[[str], int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar, stored.

    Sketches meet first, some bytes for each text; only texts of pairs that
    their sketches allow are asked for their sets.
    """
    short = texts.mapInArrow(lean(_sketches(_either(pairs))), "c long, n long, bits binary").dropDuplicates(["c"])
    short = stored(short, "sketches")
    left = short.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    right = short.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")
    pairs = stored(met.mapInArrow(lean(_possible_pairs), "a long, b long"), "possible-pairs")
    sets = texts.mapInArrow(lean(_sets(_either(pairs), name)), "c long, name long, s binary").dropDuplicates(["c"])
    sets = stored(sets, "shingle-sets")
    left = sets.select(F.col("c").alias("a"), F.col("name").alias("name_a"), F.col("s").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("name").alias("name_b"), F.col("s").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "name_a", "name_b", "x", "y")
    return stored(both.mapInArrow(lean(_compared), "a long, b long, name_a long, name_b long"), "similar-pairs")


def _merged(rooted: DataFrame) -> DataFrame:
    """Rows (h, n, c, root) of buckets h, with buckets that hold mostly the same members made one, named by a root.

    The prefixes of a group of near copies meet in a bucket for each shingle
    that they share, and every bucket would be dealt the whole sets of all its
    members. A bucket joins the root that has the most rows over all buckets,
    of the roots in it; those that join one root become one wherever that at
    least halves the rows to deal out. No pair is lost, as a merged bucket
    holds all members of each of its buckets.
    """
    held = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
    rows = held.groupBy("root").agg(F.sum("m").alias("rows"))
    joined = held.join(rows, "root").groupBy("h").agg(F.max(F.struct("rows", "root")).alias("most"), F.sum("m").alias("m"))
    joined = stored(joined.select("h", F.col("most.root").alias("g"), "m"), "joined-buckets")
    named = rooted.join(joined.select("h", "g"), "h")
    once = stored(named.select("g", "n", "c", "root").distinct(), "merged-buckets")
    fewer = once.groupBy("g").agg(F.count(F.lit(1)).alias("k")).join(joined.groupBy("g").agg(F.sum("m").alias("m")), "g").where("m >= 2 * k").select("g")
    together = once.join(fewer, "g").withColumnRenamed("g", "h")
    return together.unionByName(named.join(fewer, "g", "left_anti").select("h", "n", "c", "root"))


def similar_links(docs: DataFrame, name: Callable[[str], int]) -> DataFrame:
    """Edges (a, b) that connect all texts linked by a shingle similarity of at least SIMILAR, each called by ``name``.

    In any common order of shingles, two similar texts share one of the first
    ``prefix_size`` of each: texts meet by these, and every pair that meets and
    whose sizes, places in the prefix and sketches allow the similarity is
    compared by its whole sets. Only pairs that are connected already are left
    out: large buckets are first compared with one member each and by
    neighbours, then buckets of mostly the same members are made one and members
    of different components meet by how they differ from what most of the
    bucket holds (``close_pairs``). Shingles that are common in a sample, or
    made of words that are, come last in the order, which keeps buckets small
    and loses nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    entries = texts.mapInArrow(lean(_prefixes(sampled_order(texts))), "h long, n int, i int, c long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # rows are small here
    met = stored(entries.repartition("h").sortWithinPartitions("h", "n", "c", "i").mapInArrow(lean(_first_pairs(ALL_PAIRS)), "h long, n long, a long, b long"), "shingle-buckets")
    small_batches(spark)
    pairs = stored(met.where("b is not null").select("a", "b").distinct(), "pairs")
    large = met.where("b is null").select("h", "n", F.col("a").alias("c"))
    links = _verified(texts, pairs, name)
    named = links.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    if large.isEmpty():
        return named
    roots = components(links)
    rooted = large.join(roots.withColumnRenamed("node", "c"), "c", "left").select("h", "n", "c", F.coalesce("root", "c").alias("root"))
    open_h = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    rooted = stored(_merged(stored(rooted.join(open_h, "h"), "open-members")), "open-buckets")
    for cut in ("<u4", "<u8"):
        members = membership(rooted.select("c").distinct(), "c")
        sets = stored(texts.mapInArrow(lean(_cut_sets(members, cut)), "c long, s binary").dropDuplicates(["c"]), "member-sets")
        held = rooted.join(sets, "c").select("h", "n", "c", "root", "s").repartition("h").sortWithinPartitions("h", "n", "c")
        met = stored(held.mapInArrow(lean(_further_pairs(cut)), "h long, a long, b long"), "met-pairs")
        more = _verified(texts, stored(met.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "further-pairs"), name)
        named = named.union(more.select("name_a", "name_b"))
        # a star that cut sets alone brought about: its bucket again, by whole sets
        again = met.where("h is not null").join(more, ["a", "b"], "left_anti").select("h").distinct()
        rooted = stored(rooted.join(again, "h"), "open-buckets")
        if rooted.isEmpty():
            break
    return named
