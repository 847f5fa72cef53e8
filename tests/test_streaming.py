from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.operators.samples import bursts, io_summary
from tidegauge.streaming import summaries as st

T0 = datetime(2026, 5, 3, 10, 0, 0)
SCHEMA = "label string, ts timestamp, r_mbs double, w_mbs double"


def put(spark, path, rows, mode="append"):
    data = [(a, T0 + timedelta(seconds=s), float(r), float(w)) for a, s, r, w in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def stream(spark, path):
    return st.read_sample_stream(spark, path + "/", spark.read.parquet(path).schema)


def test_tumbling_summary_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [("a", s, s % 120, s % 70) for s in range(0, 600, 2)] + [("b", s, 10, 60) for s in range(0, 600, 2)])
    got = st.drain_to_table(st.stream_io_summary(stream(spark, src), "label"), "t", out)
    batch = io_summary(
        spark.read.parquet(src).withColumn("m", F.date_trunc("minute", "ts")), ["label", "m"], "ts", skip_first=False
    )
    want = {(r.label, r.m): r for r in batch.collect()}
    rows = got.collect()
    # the last windows stay open until the watermark has passed them
    assert len(rows) == 2 * 8
    for r in rows:
        w = want[(r.label, r.window_start)]
        assert (r.peak_r, r.peak_w, r.peak_rw, r.total_r_gb, r.active_avg_w, r.active_n) == (
            w.peak_r,
            w.peak_w,
            w.peak_rw,
            w.total_r_gb,
            w.active_avg_w,
            w.active_n,
        )


def test_bursts_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    times = [0, 2, 4, 20, 22, 60, 61, 64, 500]
    put(spark, src, [("a", s, 100 + s, 60) for s in times])
    got = st.drain_to_table(st.stream_bursts(stream(spark, src), "label"), "t", out).collect()
    want = bursts(spark.read.parquet(src), "label", "ts").collect()
    key = lambda r: (r.burst_start, r.burst_end, r.n, r.peak_r)
    assert sorted(map(key, got)) == sorted(map(key, want))[:-1]  # the newest one is still open


def test_a_restarted_run_goes_on_and_late_rows_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [("a", s, 100, 0) for s in range(0, 300, 10)])
    first = st.drain_to_table(st.stream_rate(stream(spark, src), "label", window="1 minute", slide="1 minute"), "t", out)
    seen = {r.window_start: r.n for r in first.collect()}
    assert seen == {T0 + timedelta(minutes=m): 6 for m in range(3)}
    # new rows, and one far behind the watermark
    put(spark, src, [("a", s, 100, 0) for s in range(300, 600, 10)] + [("a", 5, 9999, 0)])
    second = st.drain_to_table(st.stream_rate(stream(spark, src), "label", window="1 minute", slide="1 minute"), "t", out)
    rows = second.collect()
    assert {r.window_start: (r.n, r.mean_r) for r in rows} == {T0 + timedelta(minutes=m): (6, 100.0) for m in range(8)}
    assert len(rows) == 8


def test_sliding_windows_overlap(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [("a", s, s, 0) for s in range(0, 200, 2)])
    rows = st.drain_to_table(st.stream_rate(stream(spark, src), "label"), "t", out).collect()
    starts = sorted(r.window_start for r in rows)
    assert starts[1] - starts[0] == timedelta(seconds=10)
    full = next(r for r in rows if r.window_start == T0)
    assert full.n == 30 and full.mean_r == 29.0


def test_alerts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, [("a", 0, 100, 0), ("a", 2, 101, 0), ("a", 4, 101, 300), ("a", 6, 0, 201), ("z", 8, 9999, 9999)])
    limits = spark.createDataFrame([("a", 100.0, 200.0)], "label string, limit_r double, limit_w double")
    got = st.drain_to_table(st.stream_alerts(stream(spark, src), limits, "label"), "t", out)
    assert sorted(((r.ts - T0).seconds, r.alert) for r in got.collect()) == [
        (2, "read"),
        (4, "read and write"),
        (6, "write"),
    ]
