import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tidegauge.operators import samples, spread

T0 = datetime(2026, 5, 3, 10, 0, 0)
SCHEMA = "label string, device string, seq long, ts timestamp, r_mbs double, w_mbs double"


def series(spark, rows):
    return spark.createDataFrame([(a, d, s, T0 + timedelta(seconds=2 * s), r, w) for a, d, s, r, w in rows], SCHEMA)


def test_summary_by_hand(spark):
    df = series(
        spark,
        [
            ("a", "n", 0, 9999.0, 9999.0),  # since boot
            ("a", "n", 1, 50.0, 50.0),  # at the threshold: not active
            ("a", "n", 2, 60.0, 10.0),
            ("a", "n", 3, 0.0, 100.0),
            ("b", "n", 7, 80.0, 80.0),  # only the since-boot sample
        ],
    )
    got = {r.label: r for r in samples.io_summary(df, "label", "seq").collect()}
    a = got["a"]
    assert (a.peak_r, a.peak_w, a.peak_rw) == (60.0, 100.0, 100.0)  # peak of sums, not sum of peaks
    assert a.total_r_gb == 110 * 2 / 1024 and a.total_w_gb == 160 * 2 / 1024
    assert (a.active_avg_r, a.active_avg_w, a.active_n) == (30.0, 55.0, 2)
    b = got["b"]
    assert (b.peak_r, b.peak_w, b.peak_rw, b.total_r_gb, b.active_avg_r, b.active_n) == (0, 0, 0, 0, 0, 0)


def test_peaks_match_summary(spark):
    df = series(spark, [("a", "n", s, float(s % 7), float(s % 5)) for s in range(50)])
    peaks = samples.io_peaks(df, "label", "seq").first()
    full = samples.io_summary(df, "label", "seq").first()
    assert (peaks.peak_r, peaks.peak_w, peaks.peak_rw) == (full.peak_r, full.peak_w, full.peak_rw)


def test_one_row_per_log_is_dropped_even_with_two_devices(spark):
    df = series(
        spark,
        [("a", "nvme0n1", 0, 1.0, 1.0), ("a", "nvme0n1p1", 1, 2.0, 2.0), ("a", "nvme0n1", 2, 3.0, 3.0), ("a", "sda", 3, 4.0, 4.0)],
    )
    exact = samples.drop_since_boot(samples.on_device(df, "nvme0n1"), "label", "seq")
    assert [r.seq for r in exact.collect()] == [2]
    prefix = samples.drop_since_boot(samples.on_device(df, "nvme0n1", "prefix"), "label", "seq")
    assert sorted(r.seq for r in prefix.collect()) == [1, 2]


def test_first_row_of_null_group_and_composite_order(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 1, 1), ("x", 0, 5)], "label string, a int, b int")
    flags = spread.flag_first(df, "label", ["a", "b"])
    assert {(r.label, r.b): r.is_first for r in flags.collect()} == {(None, 2): False, (None, 1): True, ("x", 5): True}


def brute_bursts(rows, gap):
    out = {}
    for label in {r[0] for r in rows}:
        runs = []
        for _, t, v in sorted(r for r in rows if r[0] == label):
            if runs and t - runs[-1][-1][0] <= gap:
                runs[-1].append((t, v))
            else:
                runs.append([(t, v)])
        out[label] = [(r[0][0], r[-1][0], len(r), max(v for _, v in r)) for r in runs]
    return out


def test_bursts_against_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for label, n in (("hot", 3000), ("x", 200), ("y", 1)):
        t = 0
        for i in range(n):
            t += rnd.choice([0, 1, 1, 2, 3, 3, 4, 9, 40])
            rows.append((label, t, round(rnd.uniform(0, 99), 2)))
    rows += [("flat", 3 * i, 1.0) for i in range(500)]  # one run over many ranges
    df = spark.createDataFrame(
        [(a, T0 + timedelta(seconds=t), v, 1.0) for a, t, v in rows], "label string, ts timestamp, r_mbs double, w_mbs double"
    )
    want = brute_bursts(rows, 3)
    for span in (1, 4, 64, 4096):
        got = {}
        for r in samples.bursts(df, "label", "ts", gap_seconds=3, span=span).collect():
            s, e = (int((t - T0).total_seconds()) for t in (r.burst_start, r.burst_end))
            got.setdefault(r.label, []).append((s, e, r.n, r.peak_r))
        assert {k: sorted(v) for k, v in got.items()} == want, span


def test_burst_edges(spark):
    stamps = [0.0, 3.0, 6.000001, 7.5]  # a gap of exactly 3 s merges
    df = spark.createDataFrame(
        [("a", T0 + timedelta(seconds=s), 10.0, 20.0) for s in stamps], "label string, ts timestamp, r_mbs double, w_mbs double"
    )
    got = samples.bursts(df, "label", "ts").orderBy("burst_start").collect()
    assert [r.n for r in got] == [2, 2]
    assert got[0].burst_end == T0 + timedelta(seconds=3)  # last sample, not last sample + gap
    assert (got[0].mean_r, got[0].mean_w, got[0].peak_rw) == (10.0, 20.0, 30.0)


def test_burst_classes(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 1500.0), ("b", 700.0, 700.0), ("c", 1100.0, 0.0), ("d", 600.0, 50.0), ("e", 50.0, 50.0)],
        "label string, peak_r double, peak_w double",
    )
    got = {r.label: (r.direction, r.band) for r in samples.classify_burst(df).collect()}
    assert got == {
        "a": ("pure write", "checkpoint, cache hot"),
        "b": ("mixed", "checkpoint, cache cold"),
        "c": ("pure read", "restore, optimizer state"),
        "d": ("pure read", "model load or restore, shards"),
        "e": ("idle", None),
    }


def test_cache_regimes(spark):
    df = spark.createDataFrame([(16.0, 121.0), (128.0, 121.0), (512.0, 121.0), (1.0, 0.0)], "ws double, ram double")
    assert [r.regime for r in samples.cache_regime(df, "ws", "ram").collect()] == [
        "page cache",
        "readahead masked",
        "cold device",
        None,
    ]
    loads = spark.createDataFrame([(0.0, 16.0), (8.0, 16.0), (16.0, 16.0)], "read double, size double")
    assert [r.regime for r in samples.load_regime(loads, "read", "size").collect()] == ["page cache", "partial", "cold"]


def test_peak_memory_and_near_zero(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("b", None)], "label string, hwm_mib long")
    assert {r.label: r.peak_mib for r in samples.peak_memory(df, "label").collect()} == {"a": 5, "b": 0}
    io = spark.createDataFrame([("a", 0.2), ("a", 0.3), ("b", 9.0)], "label string, w_mbs double")
    got = {r.label: r.is_zero for r in samples.near_zero(io, "label", "w_mbs", 1.0).collect()}
    assert got == {"a": True, "b": False}


def test_hot_keys_keep_every_row(spark):
    """Two keys are above the hot limit; each row is joined exactly once."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
        ).alias("k"),
        F.col("id"),
    )
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))
    plain = {(r.id, r.k, r.first) for r in spread.attach(df, per_key, "k", "id", "rows").collect()}
    split = spread.attach(df, per_key, "k", "id", "rows", hot_rows=100)
    rows = [(r.id, r.k, r.first) for r in split.collect()]
    assert len(rows) == 5000 and set(rows) == plain
    assert all(f is not None for _, _, f in rows)


def test_hot_rows_are_spread_over_shuffle_partitions(spark):
    df = spark.range(8000).select(F.lit("hot").alias("k"), "id").unionByName(
        spark.range(40).select(F.col("id").cast("string").alias("k"), "id")
    )
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread.attach(df, per_key, "k", "id", "rows", hot_rows=1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_running_drops_over_ranges(spark):
    rnd = random.Random(3)
    rows = [("g", i, rnd.randrange(10)) for i in range(300)] + [("h", 5, 1)]
    df = spark.createDataFrame(rows, "g string, i long, v int")
    for span in (1, 16, 4096):
        got = {(r.g, r.i): r.c for r in spread.running_drops(df, "g", "i", "v", "c", span=span).collect()}
        drops = 0
        for k, (_, i, v) in enumerate(rows[:300]):
            drops += k > 0 and v < rows[k - 1][2]
            assert got[("g", i)] == drops
        assert got[("h", 5)] == 0


def test_interval_join_against_brute_force(spark):
    rnd = random.Random(5)
    points = [(rnd.choice("ab"), i, rnd.randrange(0, 5_000_000_000)) for i in range(400)]
    spans = [(rnd.choice("ab"), j, s := rnd.randrange(0, 5_000_000_000), s + rnd.randrange(-10, 900_000_000)) for j in range(30)]
    p = spark.createDataFrame(points, "k string, i int, at long")
    q = spark.createDataFrame(spans, "k string, j int, lo long, hi long")
    want = sorted((i, j) for k, i, t in points for g, j, lo, hi in spans if k == g and lo <= t <= hi)
    for bucket in (1, 60, 100000):
        got = spread.interval_join(p, q, "k", F.col("at"), F.col("lo"), F.col("hi"), bucket)
        assert sorted((r.i, r.j) for r in got.collect()) == want


def test_exactly_one_first_row(spark):
    rows = [("a", "d", 1, None, 1.0, 1.0), ("a", "d", 1, None, 1.0, 1.0), ("a", "d", 1, None, 2.0, 1.0), ("a", "d", None, None, 3.0, 1.0)]
    rows += [("b", "d", None, None, float(k), 0.0) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    left = samples.drop_since_boot(df, "label", "seq").collect()
    assert [sum(r.label == k for r in left) for k in "ab"] == [3, 3] and any(r.seq is None for r in left if r.label == "a")


def test_sums_keep_small_and_odd_figures(spark):
    rows = [("a", "d", i, None, 0.004, 0.0) for i in range(1001)] + [("b", "d", 0, None, float("nan"), 1.0), ("b", "d", 1, None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.label: r for r in samples.near_zero(df, "label", "r_mbs", 1.0).collect()}
    assert abs(got["a"].total - 4.004) < 1e-9 and not got["a"].is_zero and got["b"].total == 2.0
    rounded = {r.label: r for r in samples.near_zero(df, "label", "r_mbs", 1.0, decimals=2).collect()}
    assert rounded["b"].total == 2.0


def test_equal_first_rows_count_but_once(spark):
    first = ("a", "d", 0, None, 900.0, 100.25)
    rows = [first] * 3 + [("a", "d", i, None, 10.0, 60.5) for i in range(1, 4)] + [("b", "d", 0, None, 7.0, 8.0)] * 2 + [("c", "d", None, None, 5.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = samples.drop_since_boot(df, "label", "seq")
    for decimals in (None, 2):
        got = {r.label: r for r in samples.io_summary(df, "label", "seq", decimals=decimals).collect()}
        want = {r.label: r for r in samples.io_summary(kept, "label", "seq", skip_first=False, decimals=decimals).collect()}
        assert {k: got[k] for k in want} == want and set(got) - set(want) == {"c"}
        assert (got["a"].peak_rw, got["a"].active_n, got["b"].total_r_gb, got["c"].peak_r) == (1000.25, 5, 7 * 2 / 1024, 0.0)
    peaks = {r.label: r for r in samples.io_peaks(df, "label", "seq").collect()}
    assert (peaks["a"].peak_r, peaks["b"].peak_w, peaks["c"].peak_w) == (900.0, 8.0, 0.0)


def test_samples_are_not_shuffled_for_their_first_row(spark):
    df = series(spark, [("a", "n", s, float(s), 1.0) for s in range(50)])
    plan = executed_plan(samples.io_summary(df, "label", "seq"))
    assert "Window" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_an_interval_lies_on_few_nodes(spark):
    spans = [(0, 0), (-5, 17), (3, 3), (7, 8), (-64, 63), (1, 1023), (-1000, -1), (2**33 + 1, 2**33 + 525_600)]
    df = spark.createDataFrame(spans, "lo long, hi long")
    for r in df.select("lo", "hi", spread.time_nodes(F.col("lo"), F.col("hi")).alias("nodes")).collect():
        parts = sorted((n.node << n.level, (n.node + 1 << n.level) - 1) for n in r.nodes)
        assert parts[0][0] == r.lo and parts[-1][1] == r.hi
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) < 60


def test_intervals_of_years_beside_short_ones(spark):
    hour, year = 3_600_000_000, 365 * 86_400_000_000
    rnd = random.Random(9)
    points = [(rnd.choice(["a", "b", None]), i, rnd.randrange(-year, 2 * year)) for i in range(500)] + [("a", 999, None)]
    spans = [("a", 0, -year, year), ("b", 1, 0, 2 * year), ("a", 2, hour, hour), (None, 3, 0, year), ("b", 4, 5, 4), ("a", 5, None, 7)]
    spans += [(rnd.choice("ab"), 10 + j, s := rnd.randrange(-year, year), s + rnd.randrange(90 * 24) * hour) for j in range(20)]
    p = spark.createDataFrame(points, "k string, i int, at long")
    q = spark.createDataFrame(spans, "k string, j int, lo long, hi long")
    want = sorted((i, j) for k, i, t in points for g, j, lo, hi in spans if k and k == g and None not in (t, lo) and lo <= t <= hi)
    got = spread.interval_join(p, q, "k", F.col("at"), F.col("lo"), F.col("hi"), 60)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert spread.interval_join(p, q.limit(0), "k", F.col("at"), F.col("lo"), F.col("hi"), 60).count() == 0


def test_rows_and_summaries_of_ranges_read_one_shuffle(spark):
    df = series(spark, [("a", "n", s, float(s % 7), 1.0) for s in range(40)])
    for made in (spread.running_drops(df, "label", "seq", "r_mbs", "drops", 8), spread.carry_forward(df, "label", "seq", ["r_mbs"], 8)):
        plan = executed_plan(made)
        assert plan.count("Scan ExistingRDD") == 1 and "ReusedExchange" in plan


def test_carry_forward_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(g, i * 3 - 500, rnd.choice([None, None, None, i]), rnd.choice([None, "x", None, str(i)])) for g in "ab" for i in range(400)]
    rows += [("c", 5, None, None), ("a", 10_000_000, None, None)]
    df = spark.createDataFrame(rows, "g string, i long, v int, s string")
    want, last = {}, {}
    for g, i, v, s in sorted(rows, key=lambda r: r[:2]):
        a, b = last.get(g, (None, None))
        last[g] = (a if v is None else v, b if s is None else s)
        want[(g, i)] = last[g]
    for span in (1, 7, 4096):
        got = spread.carry_forward(df, "g", "i", ["v", "s"], span).collect()
        assert {(r.g, r.i): (r.v, r.s) for r in got} == want and len(got) == len(rows)
