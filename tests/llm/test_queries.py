"""The registered queries over the given small tables, against SQL or a plain version."""

from __future__ import annotations

import re
import zlib

import pandas as pd
import pytest

import __spark_entry__ as contract
import check_oracle
from tests.llm.test_exact import check_sequences, plain_components, plain_overlap, plain_print, plain_spans, plain_substrings
from tidegauge.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return list(zip(d["doc_id"].tolist(), d["text"].tolist()))


def result(spark, name):
    return contract.queries()[name](spark, SF).collect()


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert all(sum(re.match(rf"op{n}_", x) is not None for x in names) == 1 for n in range(1, 14))


@pytest.mark.parametrize("name", ["op5_search", "op8_sharding"])
def test_sql(spark, name):
    verdict, n, _ = check_oracle.compare(spark, check_oracle.connect(SF), name, SF)
    assert verdict == "ok" and n > 0


def test_op2(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, "op2_substrings")}
    assert got == plain_substrings(rows)


def test_op4(spark, rows):
    got = result(spark, "op4_packing")
    check_sequences(got)
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in packing.word_ids(packing.TOKENIZER)([t for _, t in rows]))


def test_op6(spark, rows):
    for r in result(spark, "op6_pii"):
        spans = plain_spans(dict(rows)[r.doc_id])
        base = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == base
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))


def test_op7(spark, rows):
    prints = [plain_print(t) for _, t in rows]
    want = {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, "op7_simhash")} == want


def test_op9(spark, rows):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    short = [(i, t) for i, t in rows if len(t) < 3000]
    want = {(i, k) for i, t in short for k, x in zip(items["item_id"], items["text"]) if set(x.lower().split()) & set(t.lower().split()) and plain_overlap(t, x)}
    got = {(r.doc_id, r.item_id) for r in result(spark, "op9_decontamination")}
    assert {g for g in got if g[0] in dict(short)} == want


@pytest.mark.parametrize(("name", "parts", "rest"), [("op3_toxicity", 3, 1), ("op10_quality", 5, 0)])
def test_scores(spark, rows, name, parts, rest):
    got = result(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in got)


def test_op1(spark, rows):
    marked = {i for i, t in rows if re.search("(?:Released|Licensed|licensed) under", t)}
    assert {r.doc_id for r in result(spark, "op1_licenses") if r.confirmed} == marked


def test_pipeline(spark):
    got = result(spark, "pipeline")
    check_sequences(got)
    assert len({r.doc_id for r in got}) > 150
