"""Ranked lexical search by scanning whole texts with an Aho-Corasick automaton of all item terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.common import ragged, small_batches, stored

TOP = 10
#: Weight of a document's length against the mean, in hundredths, and scales of the whole-number score.
B, TF_SCALE, W_SCALE = 90, 1_000_000_000, 1000
#: Places of terms in items that one automaton may hold; more items go in further blocks, each with a scan of its own.
BLOCK_TERMS = 400_000
#: Pairs of a document and an item that are added up at a time, and bytes of a text that are read at a time.
CELLS, PIECE = 1 << 22, 1 << 20
#: Sums of doubles below this are exact.
EXACT = 2**53

#: Bytes of a text, as terms see them: A-Z become small, what parts terms becomes a blank.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, term): the different terms of each row of items."""
    for b in batches:
        terms = [sorted(set(folded(t).split())) for t in b.column(1).to_pylist()]
        at = np.repeat(np.arange(b.num_rows), [len(x) for x in terms])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([x for t in terms for x in t], pa.binary())], names=["item_id", "term"])


class Automaton:
    """Terms between blanks, found in one pass over a text between blanks: a match is a whole term."""

    def __init__(self, terms: list[bytes]):
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            self.found.add_word(f" {term.decode('latin-1')} ", i)
        if terms:
            self.found.make_automaton()
        self.size = len(terms)

    def scan(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """(number of terms, places of item terms, their counts) in a folded text."""
        blank = np.frombuffer(b" " + text, np.uint8) == 32
        n = int(np.count_nonzero(blank[:-1] & ~blank[1:]))
        hits: list[int] = []
        start = 0
        while self.size and start < len(text):
            # a piece ends at a blank, so that it cuts no term
            end = len(text) if len(text) - start <= PIECE else text.find(b" ", start + PIECE)
            end = len(text) if end < 0 else end
            hits += [v for _, v in self.found.iter(f" {text[start:end].decode('latin-1')} ")]
            start = end
        places, counts = np.unique(np.array(hits, np.int64), return_counts=True)
        return n, places, counts


def _statistics(automaton: Broadcast):
    """One row per task: documents with a term, all their terms, and documents with each item term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton.value.scan
        documents = length = 0
        df = np.zeros(automaton.value.size, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                n, places, _ = scan(folded(text))
                documents, length = documents + (n > 0), length + n
                df[places] += 1
        some = np.flatnonzero(df)
        places, counts = np.concatenate([[-2, -1], some]), np.concatenate([[documents, length], df[some]])
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts)], names=["place", "n"])

    return run


class Items:
    """Which items (by position) hold which terms (by place), and the weights of the terms."""

    def __init__(self, items: np.ndarray, places: np.ndarray, weights: np.ndarray, count: int):
        order = np.lexsort((items, places))
        self.items, self.weights, self.count = items[order], weights, count
        self.first = np.searchsorted(places[order], np.arange(len(weights) + 1))
        # the most that an item can score: a term gives less than its weight times TF_SCALE / 1000
        most = np.bincount(items, weights=weights[places].astype(float), minlength=count).max(initial=0) * (TF_SCALE / 1000)
        self.exact = most < EXACT

    def scores(self, row: np.ndarray, place: np.ndarray, parts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of all pairs with a score, from the parts of terms in rows."""
        sizes = self.first[place + 1] - self.first[place]
        cell = np.repeat(row, sizes) * self.count + self.items[ragged(self.first[place], sizes)]
        value = np.repeat(parts, sizes)
        if self.exact:
            sums = np.bincount(cell, weights=value, minlength=rows * self.count).astype(np.int64)
        else:
            sums = np.zeros(rows * self.count, np.int64)
            np.add.at(sums, cell, value)
        some = np.flatnonzero(sums)
        return some // self.count, some % self.count, sums[some]


class Best:
    """The TOP documents of each item so far: smaller ids first among equal scores, null ids last."""

    def __init__(self, items: int):
        self.score = np.zeros((items, TOP), np.int64)
        self.doc = np.full((items, TOP), np.iinfo(np.int64).max)
        self.null = np.ones((items, TOP), bool)

    def take(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.score[item, TOP - 1]
        item, score, doc, null = item[good], score[good], doc[good], null[good]
        some = np.unique(item)
        item = np.concatenate([item, np.repeat(some, TOP)])
        score, doc, null = (np.concatenate([new, old[some].ravel()]) for new, old in ((score, self.score), (doc, self.doc), (null, self.null)))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < TOP
        at = item[kept], rank[kept]
        self.score[at], self.doc[at], self.null[at] = score[kept], doc[kept], null[kept]


def _search(automaton: Broadcast, items: Broadcast, documents: int, length: int):
    """The TOP documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, known = automaton.value.scan, items.value
        best = Best(known.count)
        step = max(1, CELLS // max(1, known.count))
        for b in batches:
            ids = b.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            for start in range(0, len(texts), step):
                rows, places, parts = [], [], []
                for i, text in enumerate(texts[start : start + step]):
                    n, place, tf = scan(folded(text))
                    if len(place):
                        m = 100 - B + B * n * documents // length
                        rows.append(np.full(len(place), i))
                        places.append(place)
                        parts.append(known.weights[place] * (TF_SCALE * tf // (1000 * tf + 8 * m)))
                if rows:
                    row, item, score = known.scores(*map(np.concatenate, (rows, places, parts)), min(step, len(texts)))
                    best.take(item, score, ids[start + row], nulls[start + row])
        item, rank = np.nonzero(best.score > 0)
        doc = pa.array(best.doc[item, rank], mask=best.null[item, rank])
        yield pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(best.score[item, rank])], names=["item", "doc_id", "score"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(W_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


def _blocks(terms: DataFrame) -> int:
    """Number of blocks, by a hash of the item, so that each holds at most BLOCK_TERMS places of terms or a single item."""
    blocks = 1
    while True:
        each = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        sizes = each.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if sizes.where((F.col("n") > BLOCK_TERMS) & (F.col("items") > 1)).isEmpty():
            return blocks
        blocks *= 4


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents (doc_id, text) of each item (item_id, text) with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z
    lowered. An item is its id: rows that repeat an id pool their terms, and
    null is an id like any other. No document is indexed. An automaton of all
    item terms, each guarded by blanks on both sides, goes to every task, and
    whole texts are run through it twice: first for the number of documents
    with each term, then for the scores, of which each task keeps the TOP of
    every item. Only these meet in a shuffle. An automaton holds at most
    BLOCK_TERMS places of terms in items (or one item); further items go in
    further blocks with scans of their own.

    Each row of documents is a document of its own, also where it repeats an
    id. Equal scores go by the smaller doc_id, null last. Null and empty texts
    have no terms: such a document is no result and not counted, such an item
    has no results. Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = stored(asked.mapInArrow(_item_terms, "item_id long, term binary").distinct(), "item-terms")
    found = None
    blocks = _blocks(terms)
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").toArrow()
        # the ids of the block by position, null first
        ids = mine["item_id"].combine_chunks()
        where = {x: i for i, x in enumerate(dict.fromkeys(ids.to_pylist()))}
        words = mine["term"].to_pylist()
        places = {t: i for i, t in enumerate(sorted(set(words)))}
        automaton = spark.sparkContext.broadcast(Automaton(list(places)))
        counts = texts.select("text").mapInArrow(_statistics(automaton), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        df = dict(counts.collect())  # a row for each term of the block
        documents, length = df.pop(-2, 0), df.pop(-1, 0)
        if not df:
            continue
        weights = np.array([weight(documents, df.get(k, 0)) for k in range(len(places))], np.int64)
        known = Items(np.array([where[x] for x in ids.to_pylist()]), np.array([places[t] for t in words]), weights, len(where))
        top = texts.mapInArrow(_search(automaton, spark.sparkContext.broadcast(known), documents, length), "item long, doc_id long, score long")
        names = spark.createDataFrame([(i, x) for x, i in where.items()], "item long, item_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        cut = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        part = cut.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
