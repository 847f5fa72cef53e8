"""Repeated passages: a de Bruijn graph of word k-mers whose repeated paths are compacted by joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tidegauge.llm.common import membership, possible, ragged, small_batches, stored, words_hashed

#: Words of an edge of the graph (a window); its nodes are the first and the last EDGE - 1 of them.
EDGE = 13
#: Words of a minimiser: the smallest hash among the EDGE - SEED + 1 runs of SEED words in a window.
SEED = 5
#: One node in so many ends a path, by its hash alone, so that equal passages are cut alike.
ANCHOR = 8
WORD_SEED = 2
_RANDOM = np.random.default_rng(2)
NODE_FACTORS = _RANDOM.integers(1, 1 << 63, EDGE - 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SEED_FACTORS = _RANDOM.integers(1, 1 << 63, SEED).astype(np.uint64) * np.uint64(2) + np.uint64(1)
EDGE_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return (text or "").encode().split()


def runs_hashed(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash of each run of as many words as there are factors; words that differ in one place never agree."""
    n = max(0, len(hashes) - len(factors) + 1)
    out = np.zeros(n, np.uint64)
    for j, f in enumerate(factors):
        out += hashes[j : j + n] * f
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * EDGE_FACTOR
    return x ^ (x >> np.uint64(29))


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Minimiser of each window: equal windows have equal ones, and neighbours mostly share theirs."""
    x, width, want = mixed(runs_hashed(hashes, SEED_FACTORS)), 1, EDGE - SEED + 1
    if len(x) < want:
        return x[:0]
    while width < want:
        step = min(width, want - width)
        x, width = np.minimum(x[:-step], x[step:]), width + step
    return x


class Words:
    """The words of some texts one after the other, parted by one space in ``raw``, and the windows that lie inside one text."""

    def __init__(self, texts: list[str | None]):
        self.lines = [b" ".join(words_of(t)) for t in texts]
        self.raw = b" ".join(filter(None, self.lines))
        gaps = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == ord(" "))
        self.begins = np.concatenate([[0], gaps + 1]) if self.raw else gaps
        self.ends = np.append(gaps, len(self.raw)) if self.raw else gaps
        self.sizes = np.array([line.count(b" ") + 1 if line else 0 for line in self.lines], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.inside = self.row[: -EDGE + 1] == self.row[EDGE - 1 :]
        self.hashes = words_hashed(self.raw, self.begins, self.ends - self.begins, WORD_SEED)

    def joined(self, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Runs of at least one word, joined by one space."""
        return [self.raw[a:b] for a, b in zip(self.begins[starts].tolist(), self.ends[starts + sizes - 1].tolist())]

    def nodes(self) -> np.ndarray:
        return mixed(runs_hashed(self.hashes, NODE_FACTORS)).view(np.int64)


#: Pairs of a key and a document that a task settles among themselves before they are shuffled.
CHUNK = 2_000_000


def settled(keys: np.ndarray, docs: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs (key, document) with whether the key is known to be shared.

    Of the documents of a key here, all but the smallest are known to share it
    with a smaller one and need not meet the rest of the corpus: the smallest
    stands for them. With ``whole`` that the key is shared at all is what
    matters, so the smallest is also known, besides standing for the others. A
    key of very many documents thus has one open row for each chunk.
    """
    order = np.lexsort((docs, *keys.T[::-1]))
    keys, docs = keys[order], docs[order]
    same_key = (keys[1:] == keys[:-1]).all(1)
    new = np.ones(len(docs), bool)
    new[1:] = ~(same_key & (docs[1:] == docs[:-1]))
    keys, docs = keys[new], docs[new]
    known = np.zeros(len(docs), bool)
    known[1:] = (keys[1:] == keys[:-1]).all(1)
    if whole:
        also = np.flatnonzero(known[1:] & ~known[:-1])
        keys, docs = np.concatenate([keys, keys[also]]), np.concatenate([docs, docs[also]])
        known = np.concatenate([known, np.ones(len(also), bool)])
    return keys, docs, known


def _batch(keys: np.ndarray, docs: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    names = ["k0", "k1"][: keys.shape[1]]
    return pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys.T), pa.array(docs), pa.array(known)], names=[*names, "doc_id", "known"])


def in_chunks(pairs: Iterator[tuple[np.ndarray, np.ndarray]], width: int, whole: bool) -> Iterator[pa.RecordBatch]:
    held, n = [(np.zeros((0, width), np.int64), np.zeros(0, np.int64))], 0
    for keys, docs in pairs:
        held.append((keys.reshape(-1, width), docs))
        n += len(docs)
        if n >= CHUNK:
            yield _batch(*settled(*map(np.concatenate, zip(*held)), whole))
            held, n = held[:1], 0
    yield _batch(*settled(*map(np.concatenate, zip(*held)), whole))


def _shared(width: int, whole: bool):
    """Keys that documents share, from rows in order of key and document: a run is followed row by row, never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, first_doc, waiting = None, 0, False
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(width)], axis=1)
            docs, known = b.column(width).to_numpy(), b.column(width + 1).to_numpy(zero_copy_only=False)
            out = [(keys[known], docs[known])]
            keys, docs = keys[~known], docs[~known]
            if len(docs):
                new = np.ones(len(docs), bool)
                new[1:] = (keys[1:] != keys[:-1]).any(1)
                goes_on = last_key is not None and (keys[0] == last_key).all()
                number = np.cumsum(new) - 1
                firsts = docs[new]
                if goes_on:
                    firsts[0] = first_doc
                later = docs > firsts[number]
                out.append((keys[later], docs[later]))
                if whole:  # the first documents of runs that have others
                    more = np.zeros(len(firsts), bool)
                    more[number[later]] = True
                    if goes_on and more[0] and waiting:
                        out.append((last_key[None], np.array([first_doc])))
                    mine = more.copy()
                    mine[0] &= not goes_on
                    out.append((keys[new][mine], firsts[mine]))
                    waiting = not more[-1] and (waiting or not goes_on or len(firsts) > 1)
                last_key, first_doc = keys[-1], firsts[-1]
            keys, docs = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys.T), pa.array(docs)], names=[*["k0", "k1"][:width], "doc_id"])

    return run


def shared_keys(rows: DataFrame, width: int, whole: bool, name: str) -> DataFrame:
    """(doc_id, name): the list of keys that a document shares with a smaller one, or with ``whole`` with any other."""
    keys = ["k0", "k1"][:width]
    dealt = rows.repartition(F.when(F.col("known"), F.col("doc_id")).otherwise(F.col("k0"))).sortWithinPartitions(*keys, "doc_id")
    found = dealt.mapInArrow(_shared(width, whole), ", ".join(f"{k} long" for k in (*keys, "doc_id")))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct(*keys) if width > 1 else F.col("k0")).alias(name))


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for b in batches:
            words = Words(b.column(1).to_pylist())
            seeds = minimisers(words.hashes)[words.inside].view(np.int64)
            rows = words.row[: len(words.inside)][words.inside]
            new = np.ones(len(seeds), bool)  # neighbours mostly share theirs
            new[1:] = (seeds[1:] != seeds[:-1]) | (rows[1:] != rows[:-1])
            yield seeds[new], b.column(0).to_numpy()[rows[new]]

    yield from in_chunks(pairs(), 1, True)


FOUND = "doc_id long, n_words long, whole_sha256 string, text string, starts array<long>, sizes array<long>, a array<long>, b array<long>"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def rows_of_lists(lists: pa.ListArray) -> np.ndarray:
    """Row of each value of a list column."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), sizes)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of each document; the text goes along only where there are any.

    Whether a minimiser is shared is the same for all documents that have it.
    """
    for b in batches:
        words = Words(b.column(1).to_pylist())
        flags = np.unique(b.column(2).flatten().to_numpy()).view(np.uint64)
        shares = pc.is_valid(b.column(2)).to_numpy(zero_copy_only=False)  # rows without an id have no list
        inside = words.inside & shares[words.row[: len(words.inside)]]
        at = np.flatnonzero(np.isin(minimisers(words.hashes), flags) & inside) if len(flags) else np.zeros(0, np.int64)
        nodes = words.nodes().view(np.uint64) if len(at) else None
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = (np.diff(at) > 1) | (nodes[at[1:]] % np.uint64(ANCHOR) == 0)
        starts = at[new]
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        digests = list(map(xxh3_128_digest, words.joined(starts, sizes + EDGE - 1)))
        digests = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        rows = words.row[starts]
        counts = np.bincount(rows, minlength=b.num_rows)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in (starts - words.firsts[rows], sizes, digests[:, 0], digests[:, 1])]
        whole = [hashlib.sha256(line).hexdigest() for line in words.lines]
        text = pc.if_else(pa.array(counts > 0), b.column(1), pa.scalar(None, b.column(1).type))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.sizes), pa.array(whole), text, *lists], names=FOUND_NAMES)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for b in batches:
            a, c = (b.column(k).flatten().to_numpy() for k in (1, 2))
            yield np.stack([a, c], axis=1), b.column(0).to_numpy()[rows_of_lists(b.column(1))]

    yield from in_chunks(pairs(), 2, False)


def listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, second) of each pair in a list column."""
    pairs = lists.flatten()
    return rows_of_lists(lists), *(pairs.field(k).to_numpy() for k in (0, 1))


def held(rows: np.ndarray, first: np.ndarray, second: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which pairs are in the list of their row."""
    wanted, have = (rows, first, second), listed(lists)
    if not len(rows) or not len(have[0]):
        return np.zeros(len(rows), bool)

    def key(x: tuple[np.ndarray, ...]) -> np.ndarray:
        row, a, b = (c.astype(np.int64).view(np.uint64) for c in x)
        return (mixed(a + row * EDGE_FACTOR) + b) * EDGE_FACTOR

    keys = key(have)
    order = np.argsort(keys)
    want = key(wanted)
    at = order[np.minimum(np.searchsorted(keys, want, sorter=order), len(order) - 1)]
    out = np.logical_and.reduce([x == y[at] for x, y in zip(wanted, have)])
    unsure = np.flatnonzero((keys[at] == want) & ~out)
    if len(unsure):  # another pair has the same key
        known = set(zip(*(x.tolist() for x in have)))
        out[unsure] = [x in known for x in zip(*(c[unsure].tolist() for c in wanted))]
    return out


class Paths:
    """Paths of a batch of documents, by their columns starts, sizes, a, b and gone_paths."""

    def __init__(self, words: Words, starts: pa.ListArray, sizes: pa.ListArray, a: pa.ListArray, b: pa.ListArray, gone: pa.ListArray):
        self.row = rows_of_lists(starts)
        self.starts = words.firsts[self.row] + starts.flatten().to_numpy()
        self.sizes = sizes.flatten().to_numpy()
        self.gone = held(self.row, a.flatten().to_numpy(), b.flatten().to_numpy(), gone)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) of the windows of some paths."""
        return np.repeat(self.row[which], self.sizes[which]), ragged(self.starts[which], self.sizes[which])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for b in batches:
            words = Words(b.column(1).to_pylist())
            paths = Paths(words, *b.columns[2:])
            rows, at = paths.windows(~paths.gone)
            nodes = words.nodes()
            yield np.stack([nodes[at], nodes[at + 1]], axis=1), b.column(0).to_numpy()[rows]

    yield from in_chunks(pairs(), 2, False)


OPENED = "doc_id long, text string, starts array<long>, sizes array<long>, a array<long>, b array<long>"


def _in_map(bits: np.ndarray, yes: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, a hash, the map may hold, or all others; without that column."""
    for b in batches:
        mine = possible(bits, b.column(b.num_columns - 1).to_numpy().view(np.uint64)) == yes
        yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(mine))


def _with_gone(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_map(bits, True, batches)

    return run


def _edges_without_gone(bits: np.ndarray):
    """Edges of documents that have no path of a smaller document: they need not meet the paths that are gone."""
    none = pa.list_(pa.struct([("k0", pa.int64()), ("k1", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = _in_map(bits, False, batches)
        return _edges(pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, none)], names=[*b.schema.names, "gone_paths"]) for b in rest)

    return run


def _only_touched(bits: np.ndarray):
    """Found rows; the text and its paths go along only if something of it may be gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = pa.array(possible(bits, b.column(b.num_columns - 1).to_numpy().view(np.uint64)))
            lists = [pc.if_else(maybe, c, pa.scalar(None, c.type)) for c in b.columns[3:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=FOUND_NAMES)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # a text without paths was left out; only another row of its id can have lost words
        touched = pc.and_(pc.is_valid(b.column(3)), pc.or_(pc.is_valid(b.column(8)), pc.is_valid(b.column(9))))
        removed = np.zeros(b.num_rows, np.int64)
        sha, spans = b.column(2).to_pylist(), [[] for _ in range(b.num_rows)]
        part = b.filter(touched)
        words = Words(part.column(3).to_pylist())
        paths = Paths(words, *part.columns[4:9])
        rows, at = paths.windows(~paths.gone)
        nodes = words.nodes()
        windows = np.concatenate([at[held(rows, nodes[at], nodes[at + 1], part.column(9))], paths.windows(paths.gone)[1]])
        size = len(words.begins) + 1
        change = np.bincount(windows, minlength=size) - np.bincount(windows + EDGE, minlength=size)
        covered = np.cumsum(change)[:-1] > 0
        for i, first, n in zip(np.flatnonzero(touched.to_numpy(zero_copy_only=False)).tolist(), words.firsts.tolist(), words.sizes.tolist()):
            edges = np.flatnonzero(np.diff(covered[first : first + n], prepend=False, append=False))
            between = np.concatenate([[0], edges, [n]]).reshape(-1, 2)  # kept words
            between = between[between[:, 0] < between[:, 1]]
            removed[i] = n - np.diff(between).sum()
            sha[i] = hashlib.sha256(b" ".join(words.joined(first + between[:, 0], between[:, 1] - between[:, 0]))).hexdigest()
            spans[i] = edges.reshape(-1, 2).tolist()
        columns = [pa.array(removed), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=KEPT_NAMES)


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>"
KEPT_NAMES = [c.split()[0] for c in KEPT.split(", ")]


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and spans (first word, word after the last) removed.

    A word goes if a window of 13 words over it also starts in a document with
    a smaller doc_id. Windows whose minimiser occurs in one document only can't
    be repeated and never leave their document. The others are edges of the
    graph. Runs of them between anchor nodes are compacted into paths, which
    meet by a 128-bit digest of their words: a path that a smaller document
    also has goes whole. Only paths that occur here first are opened again, and
    their edges meet by both their nodes, which finds where paths branch or are
    entered midway. What was found returns to the words of a document by its
    id and the start of each path.

    Keys of minimisers, paths and edges are settled within tasks first, so that
    a passage of very many documents has one row for each task in the shuffle,
    and are then followed in sorted order, never gathered.

    A null id is smaller than none and compared with none: such rows keep all
    words. Null and empty texts have no words. Rows that repeat an id never
    take words from each other. Further columns are ignored; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seeds = texts.where("doc_id is not null").mapInArrow(_minimisers, "k0 long, doc_id long, known boolean")
    flags = shared_keys(seeds, 1, True, "flags")
    found = stored(texts.join(flags, "doc_id", "left").select("doc_id", "text", "flags").mapInArrow(_passages, FOUND), "passages")

    pair = "k0 long, k1 long, doc_id long, known boolean"
    opened = found.where("text is not null")
    paths = opened.select("doc_id", "a", "b").mapInArrow(_paths, pair)
    gone_paths = stored(shared_keys(paths, 2, False, "gone_paths"), "shared-paths")
    h = F.xxhash64("doc_id").alias("h")
    bits, rows = membership(gone_paths.select(h), "h"), opened.select("doc_id", "text", "starts", "sizes", "a", "b", h)
    with_gone = rows.mapInArrow(_with_gone(bits), OPENED).join(gone_paths, "doc_id", "left")
    edges = with_gone.mapInArrow(_edges, pair).unionByName(rows.mapInArrow(_edges_without_gone(bits), pair))
    gone_edges = stored(shared_keys(edges, 2, False, "gone_edges"), "shared-edges")
    both = gone_paths.join(gone_edges, "doc_id", "full")
    bits = membership(gone_paths.select(h).unionByName(gone_edges.select(h)), "h")
    cut = found.select(*found.columns, h).mapInArrow(_only_touched(bits), FOUND)
    return cut.join(both, "doc_id", "left").select(*found.columns, "gone_paths", "gone_edges").mapInArrow(_kept, KEPT)
