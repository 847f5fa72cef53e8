"""Whitening against numpy in double precision, and the refinement on matrices with known eigenvectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from tidegauge.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, parts = np.linalg.eigh(y.T @ y / n)
    values, parts = values[::-1][:32], parts[:, ::-1][:, :32]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total)) for row in x]
    return y @ parts / np.sqrt(values), deviation, values / np.trace(y.T @ y / n)


def matches(got, ids, vectors):
    want, deviation, explained = plain(vectors)
    got = got.sort_values(["vec_id", "component"])
    k = got["component"].max()
    w = got["whitened"].to_numpy().reshape(-1, k)
    order = np.argsort(ids, kind="stable")
    want = want[order, :k]
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-6
    assert got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == [deviation[i] for i in order]
    assert np.abs(got["explained"].to_numpy().reshape(-1, k)[0] - explained[:k]).max() < 1e-9
    assert (got["n"] == len(ids)).all() and (got["identity_error"] < 1e-9).all()


def test_query(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = contract.queries()["op12_whitening"](spark, SF).toPandas()
    assert len(got) == 32 * len(e)
    matches(got, e["vec_id"].tolist(), e["embedding"].tolist())


def test_rows_that_cannot_be_fitted(spark):
    rng = np.random.default_rng(2)
    good = [(i, v) for i, v in enumerate(rng.normal(size=(40, 5)).tolist())]
    good += good[:3]  # rows that repeat are vectors each
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [math.nan] * 5), (94, [math.inf, 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as component", "2 as n", "'x' as whitened")
    got = whitening.whitened(df).toPandas()
    assert set(got["vec_id"]) == set(range(40)) and len(got) == 43 * 5
    ids = [i for i, _ in good]
    first = got.drop_duplicates(["vec_id", "component"])
    want, deviation, _ = plain([v for _, v in good])
    w = first.sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(-1, 5)
    assert np.abs(np.abs(w) - np.abs(want[:40])).max() < 1e-9
    assert first.groupby("vec_id")["deviation"].first().tolist() == [deviation[ids.index(i)] for i in range(40)]


def test_no_variance_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).count() == 0
    # one direction only, a null id, and entries far beyond any embedding
    rows = [(None, [0.0, 1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [5.0, 6.0, 7.0])]
    assert {(r.vec_id, r.component) for r in whitening.whitened(spark.createDataFrame(rows, schema)).collect()} == {(None, 1), (1, 1), (2, 1)}
    wide = whitening.whitened(spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], schema)).collect()
    assert wide and all(r.deviation is None for r in wide)


def basis(d, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(90, 1, 40),
        np.concatenate([np.full(5, 9.0), np.linspace(8, 1, 35)]),  # equal
        np.concatenate([9 - np.arange(6) * 1e-9, np.linspace(8, 1, 34)]),  # closer than float32 can tell
        50 - np.arange(40) * 1e-6,  # one cluster
        np.concatenate([np.linspace(5, 1, 10), np.zeros(30)]),
    ],
)
def test_refinement(values):
    q = basis(40)
    a = (q * values.astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    found, x = whitening.refined(a, start)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    assert np.abs(a @ x - x * found).max() < 1e-14
    assert np.abs(found - values).max() < 1e-14
    # eigenvectors are those of separate eigenvalues, to double precision, which float32 is far from
    gaps = np.abs(values[:, None] - values[None, :]) + np.eye(40)
    apart = gaps.min(axis=1) > 1e-10
    assert np.abs(1 - np.abs(np.einsum("ij,ij->j", q, x)))[apart].max(initial=0) < 1e-15
    assert np.abs(start.T.astype(float) @ start - np.eye(40)).max() > 1e-9


def test_covariance_is_exact_for_far_shifted_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (1000 + v).tolist()) for i, v in enumerate(rng.normal(size=(300, 4)) * 0.05)]
    fit, size = whitening.fit_list(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    n = len(x)
    want = [[sum((n * a[i] - total[i]) * (n * a[j] - total[j]) for a in x) / n**3 for j in range(4)] for i in range(4)]
    got = whitening.covariance(fit, size, n, total).astype(float)
    assert np.abs(got - np.array(want)).max() < 1e-14 * np.abs(want).max()
