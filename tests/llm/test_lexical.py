"""Ranked search by automaton against a plain version, and the automaton's matches."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import check_oracle
from tests.llm.test_exact import frame, texts
from tidegauge.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(rows, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    pooled = {}
    for item, text in items:
        pooled.setdefault(item, set()).update(terms(text))
    for item, want in pooled.items():
        scores = []
        for i, c in docs:
            n = sum(c.values())
            score = 0
            for t in want & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, rows, items):
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as rank", "3 as doc_id")
    return sorted((tuple(r) for r in lexical.ranked(frame(spark, rows), asked).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3, t) for i, t in enumerate(texts(60))]
    # repeated ids, null ids, ties, scripts beyond ASCII
    return out + out[5:7] + [(None, "the of and"), (1000, "The OF and"), (999, "the of and"), (1001, "ÉTÉ été Été x,y"), (1002, "日本 日本 語")]


ITEMS = [(1, "the of AND"), (2, "été, xyz y"), (3, None), (4, ""), (5, "日本"), (6, "of of of"), (None, "which this"), (7, "absent"), (8, "to be"), (8, "his on at")]


def test_ranked(spark, rows):
    got = found(spark, rows, ITEMS)
    assert got == plain(rows, ITEMS)
    assert {r[0] for r in got} == {1, 2, 5, 6, None, 8}


def test_blocks_pieces_and_big_sums(spark, rows, monkeypatch):
    want = plain(rows, ITEMS)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
    monkeypatch.setattr(lexical, "PIECE", 40)
    monkeypatch.setattr(lexical, "CELLS", 5)
    monkeypatch.setattr(lexical, "EXACT", 10)
    assert found(spark, rows, ITEMS) == want


def test_empty_tables(spark, rows):
    assert found(spark, [], ITEMS) == []
    assert found(spark, rows, []) == []
    assert found(spark, rows, [(1, None)]) == []
    assert found(spark, [(1, None), (2, "")], ITEMS) == []


def test_sql(spark):
    verdict, n, _ = check_oracle.compare(spark, check_oracle.connect(SF), "op13_lexical", SF)
    assert verdict == "ok" and n > 0


@settings(max_examples=60, deadline=None)
@given(st.text("abAB é-_1", max_size=80), st.lists(st.text("abé1", min_size=1, max_size=3), max_size=6))
def test_automaton_counts_whole_terms(text, wanted):
    wanted = sorted({w.encode() for w in wanted})
    n, places, counts = lexical.Automaton(wanted).scan(lexical.folded(text))
    all_terms = Counter(t.encode() for t in terms(text))
    assert n == sum(all_terms.values())
    assert dict(zip(places.tolist(), counts.tolist())) == {i: all_terms[w] for i, w in enumerate(wanted) if all_terms[w]}


def test_best_keeps_ties_in_order():
    best = lexical.Best(1)
    for part in np.array_split(np.arange(40)[::-1], 7):
        best.take(np.zeros(len(part), np.int64), np.full(len(part), 5), part, np.zeros(len(part), bool))
    assert best.doc[0].tolist() == list(range(10))
