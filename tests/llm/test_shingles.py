"""Near copies by shingle similarity, against plain comparison of all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_exact import frame, plain_print
from tidegauge.llm import common, shingles, simhash


def near_copies():
    """Texts of invented words, and copies of some with words changed here and there, so fingerprints drift apart."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    rows = []
    for k in range(12):
        base = [word() for _ in range(r.choice((4, 30, 90, 200)))]
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 30 if k == 3 else 4)):
            copy = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = word()
            rows.append(r.choice((" ", "  ", "\n")).join(copy))
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " "), (903, rows[0].upper())]


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("all_pairs", [16, 2])
def test_all_similar_texts_are_linked(spark, monkeypatch, all_pairs):
    monkeypatch.setattr(shingles, "ALL_PAIRS", all_pairs)
    rows = near_copies()
    sets = {i: plain_set(t) for i, t in rows}
    prints = {i: plain_print(t) for i, t in rows}
    edges, lost = [], 0
    for i, j in combinations(sets, 2):
        if sets[i] | sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            edges.append((i, j))
            lost += (prints[i] ^ prints[j]).bit_count() > simhash.RADIUS
        elif (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
            edges.append((i, j))
    assert lost > 20  # fingerprints alone don't link these
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    kept = simhash.keep_one(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i in root if root[i] == i}


def test_links_are_only_of_similar_texts(spark):
    rows = near_copies()
    name = {shingles.digest(shingles.split(t)): plain_set(t) for _, t in rows}
    links = shingles.similar_links(frame(spark, rows), lambda t: shingles.digest(shingles.split(t)))
    got = [(name[r.a], name[r.b]) for r in links.collect()]
    assert got and all(5 * len(a & b) >= 4 * len(a | b) for a, b in got)
    assert shingles.similar_links(frame(spark, []), lambda t: 0).collect() == []
    assert common.components(links).count() > 10


def test_sketches_never_rule_out_a_similar_pair():
    g = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(400):
        n = int(g.integers(1, 2_000))
        base = np.unique(g.integers(0, 1 << 63, n).astype(np.uint64))
        kept = base[g.random(len(base)) < g.choice([0.2, 0.85, 0.95])]
        other = np.unique(np.r_[kept, g.integers(0, 1 << 63, int(g.integers(0, 1 + n // 8))).astype(np.uint64)])
        may = shingles.may_be_similar(len(base), len(other), shingles.sketch(base), shingles.sketch(other))
        assert may or not shingles.similar(base, other)
        ruled_out += not may
    assert ruled_out > 50


def test_a_hot_shingle(spark):
    """Some thousand texts that share one short passage, with a similar pair among them, found and nothing else."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows = [(i, "one passage that all texts hold " + " ".join(word() for _ in range(12))) for i in range(3000)]
    rows.append((3000, rows[17][1] + " " + word()))
    kept = {x.doc_id for x in simhash.keep_one(frame(spark, rows)).collect()}
    prints = [plain_print(t) for _, t in rows]
    near = {j for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS}
    assert kept == set(range(3000)) - near


def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(2, a), (2, b), (2, b), (3, a)]
    assert sorted((x.doc_id, x.text) for x in simhash.keep_one(frame(spark, rows)).collect()) == [(2, a), (2, b)]


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with some words changed, most of them too far apart: all similar ones are linked by few pairs."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(600):
        copy = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 5, 6))):
            copy[r.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    counts, stored = {}, shingles.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(shingles, "stored", counted)
    digest = lambda t: shingles.digest(shingles.split(t))
    root = {digest(t): digest(t) for _, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in shingles.similar_links(frame(spark, rows), lambda t: shingles.digest(shingles.split(t))).collect():
        root[find(x.a)] = find(x.b)
    got = {x: find(x) for x in root}
    sets = {digest(t): plain_set(t) for _, t in rows}
    root = {x: x for x in root}
    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    want = {x: find(x) for x in root}
    both = {(got[x], want[x]) for x in root}
    assert len(both) == len(set(got.values())) == len(set(want.values())) > 1
    assert counts["further-pairs"] < 5 * len(rows)


def test_cut_sets_lose_no_link(spark, monkeypatch):
    """With all sets cut to two bits stars are of texts that are not similar: their buckets are compared by whole sets."""
    cut_sets = shingles._cut_sets

    def coarse(bits, cut):
        whole = cut_sets(bits, "<u8")

        def run(batches):
            for b in whole(batches):
                sets = [np.unique((np.frombuffer(x, np.uint64) >> np.uint64(62)).astype(cut)).tobytes() for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["c", "s"])

        return run if cut == "<u4" else whole

    monkeypatch.setattr(shingles, "_cut_sets", coarse)
    test_all_similar_texts_are_linked(spark, monkeypatch, 2)


def test_close_pairs_lose_no_link():
    g = np.random.default_rng(6)
    similar = 0
    for _ in range(150):
        centre, other = (np.unique(g.integers(0, 1 << 63, int(g.integers(3, 120))).astype(np.uint64)) for _ in range(2))
        sets = []
        for _ in range(int(g.integers(2, 40))):
            x = centre if g.random() < 0.8 else other
            x = x[g.random(len(x)) >= g.random() / 4]
            sets.append(np.unique(np.r_[x, g.integers(0, 1 << 63, int(g.integers(1, 2 + len(x) // 6))).astype(np.uint64), g.choice(other, 2)]))
        n, root = np.array([len(x) for x in sets]), np.arange(len(sets))
        root[g.random(len(sets)) < 0.2] = 0
        pairs = [(int(i), int(j)) for i, j in np.concatenate(list(shingles.close_pairs(sets, n, root)))]
        every = [(i, j) for i, j in combinations(range(len(sets)), 2) if shingles.similar(sets[i], sets[j])]
        parts = []
        for edges in ([p for p in pairs if shingles.similar(sets[p[0]], sets[p[1]])], every):
            part = root.copy()
            for _ in sets:
                for i, j in edges:
                    part[part == part[i]] = part[j]
            parts.append(part.tolist())
        assert len(set(zip(*parts))) == len(set(parts[0])) == len(set(parts[1]))
        similar += len(every)
    assert similar > 500


def digest_of(text):
    return shingles.digest(shingles.split(text))


def test_sets_of_a_group_are_dealt_out_few_times(spark, monkeypatch):
    """Near copies of some texts, most too far apart to be linked, share many buckets: their sets go to few of them."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(60):
            copy = list(base)
            for _ in range(r.choice((2, 3, 4, 5, 6))):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(60))) for i in range(50)]
    counts, stored = {}, shingles.stored

    def counted(df, name):
        out = stored(df, name)
        counts.setdefault(name, out.count())
        return out

    monkeypatch.setattr(shingles, "stored", counted)
    root = {digest_of(t): digest_of(t) for _, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in shingles.similar_links(frame(spark, rows), digest_of).collect():
        root[find(x.a)] = find(x.b)
    got = {x: find(x) for x in root}
    sets = {digest_of(t): plain_set(t) for _, t in rows}
    root = {x: x for x in root}
    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    want = {x: find(x) for x in root}
    assert len({(got[x], want[x]) for x in root}) == len(set(got.values())) == len(set(want.values())) > 53
    assert 0 < counts["member-sets"] <= counts["open-buckets"] <= 3 * counts["member-sets"]


@pytest.mark.parametrize("shared", [False, True])
def test_merged_buckets_hold_every_bucket(spark, shared):
    """Buckets of the same members become one; those that have little in common stay as they are."""
    r = random.Random(4)
    rows = []
    for h in range(40):
        members = r.sample(range(30), 20) if shared else [0, *range(30 + 20 * h, 50 + 20 * h)]
        rows += [(h, 10 + c, c, c // 2 * 2) for c in members]
    got = {}
    for x in shingles._merged(spark.createDataFrame(rows, "h long, n long, c long, root long")).collect():
        got.setdefault(x.h, []).append((x.n, x.c, x.root))
    buckets = {}
    for h, *x in rows:
        buckets.setdefault(h, set()).add(tuple(x))
    assert all(len(x) == len(set(x)) for x in got.values())
    assert all(any(b <= set(x) for x in got.values()) for b in buckets.values())
    dealt = sum(map(len, got.values()))
    assert dealt <= 60 if shared else dealt == len(rows) and len(got) == len(buckets)


def test_rare_words_come_first_in_the_order():
    hashes = common.WordHashes(shingles.SEED)
    table = lambda w, n: pa.table({"h": pa.array(hashes(w).view(np.int64)), "n": pa.array(n, pa.int64())})
    text = shingles.split("the of the of the of rare the of the of")
    line = shingles._windows(hashes(text[:5]))
    common_shingle = pa.table({"h": pa.array(line.view(np.int64)), "n": pa.array([9], pa.int64())})
    for known in (common_shingle, common_shingle.slice(0, 0)):
        ordered = shingles.Order(known, table([b"the", b"of"], [500, 400]))(hashes(text))
        assert sorted(ordered) == list(shingles.shingles(text, hashes))
        rare = set(shingles._windows(hashes(text))[2:7].tolist())
        assert set(ordered[:5].tolist()) == rare
        assert known.num_rows == 0 or ordered[-1] == line[0]
