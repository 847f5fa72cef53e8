"""Complete stream results: several batches, restarts and late samples against the batch operators."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_samples import brute_bursts
from tests.test_streaming import SCHEMA, T0, put, stream
from tidegauge.operators.samples import io_summary
from tidegauge.streaming import incremental as inc
from tidegauge.streaming import summaries as st


def one_file_each(spark, path):
    return st.read_sample_stream(spark, path + "/", spark.read.parquet(path).schema, 1)


def bursts_of(rows, start=T0):
    out = {}
    for r in rows:
        s, e = (int((t - start).total_seconds()) for t in (r.burst_start, r.burst_end))
        out.setdefault(r.label, []).append((s, e, r.n, r.peak_r))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("span", [2, 4096])
def test_bursts_over_batches_equal_brute_force(spark, tmp_path, span):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(900):
        t += rnd.choice([0, 1, 1, 2, 3, 4, 9])
        rows.append(("hot", t, float(rnd.randint(60, 99))))
    rows += [("flat", 2 * i, 70.0) for i in range(900)]  # one burst from the first to the last batch
    rows += [("x", rnd.randint(0, t), 80.0) for _ in range(60)] + [("once", 5, 90.0)]
    # batches by time, with disorder within the delay
    rows.sort(key=lambda r: r[1] + rnd.randint(0, 20))
    fold = inc.fold_bursts("label", span=span)
    run = None
    for k in range(0, len(rows), 450):
        put(spark, src, [(a, s, v, 0) for a, s, v in rows[k : k + 450]])
        run = inc.incremental(one_file_each(spark, src), fold, "t", delay="30 seconds", out=out)
    assert run.ledger(spark).count() == 0
    got = run.result(spark)
    assert bursts_of(got.collect()) == brute_bursts(rows, 3)
    assert got.agg(F.sum("n")).first()[0] == len(rows)
    # all but what may still grow has been settled: the open rows are few
    opened = spark.read.parquet(f"{out}/parts").where(f"batch = {run._marks(spark)[0]} and not settled")
    assert opened.count() < 80


def test_windows_are_complete_and_late_samples_are_kept(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [(a, s, s % 120, s % 70) for a in "ab" for s in range(0, 600, 2)])
    fold = inc.fold_io_summary("label")
    run = inc.incremental(stream(spark, src), fold, "t", out=out)

    def twin():
        rows = spark.read.parquet(src).withColumn("window_start", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
        return {tuple(r[c] for c in columns) for r in io_summary(rows, ["label", "window_start"], "ts", skip_first=False).collect()}

    columns = ["label", "window_start", "peak_r", "peak_w", "peak_rw", "total_r_gb", "total_w_gb", "active_avg_r", "active_avg_w", "active_n"]
    have = lambda **k: {tuple(r[c] for c in columns) for r in run.result(spark, **k).collect()}
    assert len(have()) == 2 * 10 and have() == twin()
    before = have()
    # new samples, one far behind, one without a time
    put(spark, src, [("a", s, 100, 0) for s in range(600, 700, 2)] + [("a", 5, 9999, 0)])
    spark.createDataFrame([("a", None, 1.0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run = inc.incremental(stream(spark, src), fold, "t", out=out)
    late = run.ledger(spark).collect()
    assert sorted(((r.ts and (r.ts - T0).seconds), r.r_mbs, r.batch) for r in late if r.ts) == [(5, 9999.0, 1)]
    assert [r.r_mbs for r in late if r.ts is None] == [1.0]
    now = have()
    assert before <= now and max(r[2] for r in now) < 9999
    untimed = {r for r in twin() if r[1] is not None}
    assert have(corrected=True) == untimed and max(r[2] for r in untimed) == 9999


def test_a_batch_that_failed_midway_counts_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [("a", s, 100, 0) for s in range(0, 300, 10)])
    fold = inc.fold_rate("label", slide="1 minute")
    run = inc.incremental(stream(spark, src), fold, "t", out=out)
    batch = spark.createDataFrame([("a", T0 + timedelta(seconds=s), 100.0, 0.0) for s in range(300, 360, 10)], SCHEMA)

    broken = inc.Incremental(inc.Fold(fold.partial, lambda rows, limit: 1 / 0, fold.result), batch.schema, out)
    with pytest.raises(ZeroDivisionError):
        broken._take(batch, 1)
    assert run.result(spark).agg(F.sum("n")).first()[0] == 30
    for _ in range(2):  # the same batch again, also after it was done
        run._take(batch, 1)
        assert run.result(spark).agg(F.sum("n")).first()[0] == 36
        assert run.result(spark).count() == 6


def test_no_batch_yet(spark, tmp_path):
    for fold in (inc.fold_rate("label"), inc.fold_io_summary("label"), inc.fold_bursts("label")):
        run = inc.Incremental(fold, spark.createDataFrame([], SCHEMA).schema, str(tmp_path / "none"))
        assert run.result(spark).count() == 0 and run.ledger(spark).count() == 0


def test_late_samples_do_not_join_bursts(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [("a", 0, 100, 0)])
    run = inc.incremental(stream(spark, src), inc.fold_bursts("label"), "t", out=str(tmp_path / "out"))
    with pytest.raises(ValueError):
        run.result(spark, corrected=True)
