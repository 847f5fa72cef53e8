"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidegauge.llm.common import components, lean, small_batches, stored
from tidegauge.llm.shingles import similar_links

BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 3
#: Distinct fingerprints that one bucket may hold; larger buckets are cut by further masks.
BUCKET = 512


def fingerprint(text: str | None) -> int:
    """Fingerprint of a whole text: a bit is 1 if it is set in over half the hashes of all its shingles."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # very long texts by parts
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row of documents."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def covering_masks(free: list[int], radius: int = RADIUS) -> list[list[int]]:
    """For each of 2^(radius+1) - 1 tables the positions of ``free`` that its mask keeps.

    Every position gets a nonzero vector of radius + 1 bits and table v keeps
    the positions whose vector has an odd product with v. Any ``radius``
    vectors leave some nonzero v orthogonal to all of them: that table keeps
    none of the positions in which a pair differs, and the pair collides there.
    """
    tables = (1 << (radius + 1)) - 1
    vector = {p: i * 7 % tables + 1 for i, p in enumerate(free)}
    return [[p for p in free if (vector[p] & v).bit_count() % 2] for v in range(1, tables + 1)]


def _signed(positions: list[int]) -> int:
    mask = sum(1 << p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def mask_levels() -> list[list[list[tuple[int, list[int]]]]]:
    """Masks by level and parent table: (bits fixed so far as a signed long, positions still free).

    A level's masks cut the positions its parent leaves free by the same
    construction, until the free positions allow at most BUCKET fingerprints.
    """
    levels = [[(0, list(range(BITS)))]]
    out = []
    while max(len(free) for _, free in levels[-1]) > BUCKET.bit_length() - 1:
        groups = []
        for _, free in levels[-1]:
            group = []
            for kept in covering_masks(free):
                left = [p for p in free if p not in set(kept)]
                group.append((_signed([p for p in range(BITS) if p not in set(left)]), left))
            groups.append(group)
        out.append(groups)
        levels.append([m for g in groups for m in g])
    return out


MASKS = mask_levels()


def _links(buckets: pd.Series) -> pd.Series:
    """For each bucket a spanning forest of the graph of its pairs within RADIUS."""

    def forest(bucket: np.ndarray) -> list[dict]:
        x = np.asarray(bucket, dtype=np.int64).view(np.uint64)
        left, out = np.ones(len(x), bool), []
        for seed in range(len(x)):
            todo = [seed] if left[seed] else []
            left[seed] = False
            while todo:
                i = todo.pop()
                near = np.flatnonzero(left & (np.bitwise_count(x ^ x[i]) <= RADIUS))
                left[near] = False
                out += [{"a": int(bucket[i]), "b": int(bucket[j])} for j in near]
                todo += near.tolist()
        return out

    return buckets.map(forest)


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """Rows (t, fp) of a level's parents laid into the tables of that level: (t, key, fp)."""
    width = len(MASKS[level][0])
    masks = F.array(*[F.array(*[F.lit(m) for m, _ in group]) for group in MASKS[level]])
    with_masks = rows.select("fp", "t", F.posexplode(F.element_at(masks, F.col("t") + 1)).alias("v", "mask"))
    return with_masks.select(
        (F.col("t") * width + F.col("v")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` linked by at most RADIUS differing bits.

    Only buckets of at most BUCKET fingerprints are compared, each into a
    spanning forest; the members of larger ones go to the next level, whose
    masks cut the bits that are still free. The last level can't hold more than
    BUCKET distinct fingerprints in a bucket, so no link is lost and no bucket
    is compared whole at its full size.
    """
    links = F.pandas_udf(_links, "array<struct<a:long,b:long>>")
    rows = prints.select("fp", F.lit(0).alias("t"))
    found = []
    for level in range(len(MASKS)):
        keyed = _keyed(rows, level)
        counts = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = keyed.join(counts, ["t", "key"])
        last = level + 1 == len(MASKS)
        small = (sized if last else sized.where(F.col("n") <= BUCKET)).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(small.select(F.explode(links("fps")).alias("e")).select("e.a", "e.b"))
        if last:
            break
        rows = stored(sized.where(F.col("n") > BUCKET).select("fp", "t"), "hot-buckets")
        if rows.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def signed_fingerprint(text: str | None) -> int:
    fp = fingerprint(text)
    return fp - (1 << 64) if fp >> 63 else fp


def near_duplicates(docs: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of fingerprints reach from each row.

    A null text has no words and the fingerprint zero, linked as any other.
    Rows may repeat; each keeps its own row. Null ids are never a smallest id:
    a component of null ids only has the component_id null. An empty table
    gives an empty result; further columns are ignored. Edges (a, b) of
    fingerprints in ``also`` link them as well.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = near_links(firsts) if also is None else near_links(firsts).unionByName(also)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id, with all its columns.

    Near-duplicates are texts whose fingerprints are linked, and all texts whose
    sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Null and empty texts have no words and are one group. Of rows that repeat an
    id and a text one stays; rows of one id with different texts all stay when
    one of them does. A null id names no document: such rows stay as they are.
    An empty table gives none.
    """
    keep = near_duplicates(docs, similar_links(docs, signed_fingerprint)).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
