"""Repeated byte strings against a plain version that looks at every string."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from tests.llm.test_exact import frame
from tidegauge.llm import suffixes
from tidegauge.llm.suffixes import LENGTH

SF = "/root/testdata/sf0.001"


def plain(texts, length=LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist()
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    return out


def compare(spark, rows):
    df = frame(spark, rows)
    got = suffixes.without_repeats(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    have = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.spans) for r in got), key=key)
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]))), key=key)
    assert have == want
    return have


def words(r, n):
    return "".join(r.choice("abcdefghijklmnop éß∑") for _ in range(n))


def test_passages_copies_and_edges(spark):
    r = random.Random(4)
    passage, other = words(r, 900), words(r, 3000)
    texts = [words(r, 50) + passage[r.randint(0, 300) :] + words(r, 60) for _ in range(30)]
    texts += [words(r, 100) + passage[k : k + 420] + words(r, 100) for k in range(0, 300, 23)]
    texts += [other, other, other[:1500] + "x" + other[1501:], other[700:], words(r, 500)]
    # just as long as a string, one byte less, in one text twice, overlapping itself
    exact = "q" + "".join(r.choice("rstuvw") for _ in range(LENGTH - 1))
    texts += [exact + "1" + words(r, 20), words(r, 30) + "2" + exact, exact[1:] + "3"]
    twice = "".join(r.choice("RSTUVW") for _ in range(450))
    texts += [twice + "#" + twice, "ab" * 900, "z" * 401, "z" * 400]
    texts += [None, "", "short", "short"]
    got = compare(spark, [(i * 7, t) for i, t in enumerate(texts)])
    assert sum(x[2] > 0 for x in got) > 40


def test_repeated_and_null_ids(spark):
    r = random.Random(5)
    a, b = words(r, 700), words(r, 700)
    # equal rows repeat each other; one id with other texts; null ids
    rows = [(1, a), (1, a), (2, b), (2, b[:450] + words(r, 300)), (None, words(r, 500)), (None, a[:500]), (None, None), (3, words(r, 600))]
    got = compare(spark, rows)
    assert [x[2] > 0 for x in got if x[0] == 3] == [False]


def test_one_long_text_is_cut(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 5000)
    r = random.Random(6)
    base = words(r, 12_000)
    compare(spark, [(1, base), (2, words(r, 40) + base[3000:9000]), (3, base[100:] + words(r, 9))])


def test_a_hot_bucket(spark):
    # thousands of texts share a passage, all with other surroundings
    r = random.Random(7)
    passage = words(r, 600)
    rows = [(i, f"{i:06d}" + words(r, 100) + passage + words(r, 100) + f"{i:06d}") for i in range(3000)]
    got = suffixes.without_repeats(frame(spark, rows)).collect()
    size = len(passage.encode())
    # neighbouring bytes of two texts may happen to agree, a few on either side
    assert all(size <= r.n_removed < size + 60 and r.n_spans == 1 for r in got)


def test_empty_table(spark):
    assert suffixes.without_repeats(frame(spark, [])).collect() == []


def test_query(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    want = {i: x[:4] for i, x in zip(d["doc_id"].tolist(), plain(d["text"].tolist()))}
    got = contract.queries()["op11_suffixes"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(x[1] for x in want.values()) > 1000


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=LENGTH, max_size=900), st.integers(0, 300))
def test_equal_strings_sample_the_same_suffix(data, at):
    """The sample of a string depends on its bytes alone, wherever it stands."""
    string = (data * 2)[:LENGTH]
    for left in (b"", b"left of it", data[:at]):
        raw = np.frombuffer(left + string + b"right of it", np.uint8)
        segment, lo, hi, suffix = suffixes.sampled(raw, np.array([0]), np.array([len(raw) - LENGTH + 1]))
        here = np.flatnonzero((lo <= len(left)) & (hi >= len(left)))
        assert len(here) == 1
        alone = suffixes.sampled(np.frombuffer(string, np.uint8), np.array([0]), np.array([1]))
        assert suffix[here[0]] - len(left) == alone[3][0]


@pytest.mark.parametrize("size", [1, 2, 7, 50])
def test_least_in(size):
    keys = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    assert suffixes.least_in(keys, size).tolist() == [keys[i : i + size].min() for i in range(50 - size + 1)]
