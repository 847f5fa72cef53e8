import pytest
import random
from pyspark.sql import functions as F

from tidegauge.operators import audit, compare, costs, curves, intervals
from tidegauge.sources.dims import BATTERY, catalogue_df


def test_catalogue_order_and_missing(spark):
    rows = [("seq-read-1m", "READ", 11000.0), ("rand-rw-4k", "READ", 5.0), ("rand-rw-4k", "WRITE", 6.0), ("other", "READ", 1.0)]
    df = spark.createDataFrame(rows, "test string, op string, mb_per_s double")
    got = compare.catalogue_report(df, catalogue_df(spark), ["test", "op"], "mb_per_s").collect()
    assert [(r.description, r.mb_per_s) for r in got] == [
        ("1 MiB seq write", None),
        ("1 MiB seq read", 11000.0),
        ("64 KiB seq write", None),
        ("4 KiB random read", 5.0),
        ("4 KiB random write", 6.0),
    ]


def test_every_battery_gets_all_tests(spark):
    rows = [("1", None, "seq-read-1m", "READ", 11000.0), ("3", "host1", "seq-write-1m", "WRITE", 645.0)]
    df = spark.createDataFrame(rows, "pillar string, client string, test string, op string, mb_per_s double")
    got = compare.battery_report(df, BATTERY, ["pillar", "client"]).collect()
    assert len(got) == 10
    assert {(r.pillar, r.client, r.ord): r.mb_per_s for r in got if r.mb_per_s} == {
        ("1", None, 1): 11000.0,
        ("3", "host1", 0): 645.0,
    }


def test_zero_counts_in_pairs_but_not_in_the_cross_table(spark):
    rows = [
        ("3", "host1", "WRITE", 645.0),
        ("3", "host2", "WRITE", 0.0),
        ("3", "host1", "READ", 4447.0),
        ("3", "host2", "READ", 4440.0),
        ("1", None, "WRITE", 0.0),
        ("2", None, "READ", 2280.0),
    ]
    df = spark.createDataFrame(rows, "pillar string, client string, op string, mb_per_s double")
    pairs = compare.pair_clients(df.filter("pillar = '3'"), "op", "client", "mb_per_s", "host1", "host2")
    assert {r.op: r.total for r in pairs.collect()} == {"WRITE": 645.0, "READ": 8887.0}
    cross = {r.pillar: (r.write, r.read) for r in compare.cross_compare(df, "pillar", "op", "mb_per_s", {"3": 2}).collect()}
    assert cross == {"1": (0.0, None), "2": (None, 2280.0), "3": (None, 8887.0)}
    one = compare.pair_clients(df.filter("client = 'host1'"), "op", "client", "mb_per_s", "host1", "host2")
    assert {r.total for r in one.collect()} == {None}


def test_symmetry_of_published_clients(spark):
    df = spark.createDataFrame([("w", 645.0, 641.0), ("x", 100.0, 90.0)], "t string, value_a double, value_b double")
    assert {r.t: r.symmetric for r in compare.symmetry(df).collect()} == {"w": True, "x": False}


def test_write_ladder(spark):
    rows = [(1, 13400.0), (2, 11851.0), (3, 1974.0), (4, 600.0)]
    df = spark.createDataFrame(rows, "ord int, rate double")
    got = compare.ratio_ladder(df, "ord", "rate", []).orderBy("ord").collect()
    assert [round(r.gap_to_next, 2) if r.gap_to_next else None for r in got] == [1.13, 6.0, 3.29, None]
    assert round(got[0].total_gap, 1) == 22.3


def test_percent_of_level(spark):
    df = spark.createDataFrame([(1, 2200.0), (2, 490.0), (3, 65.0)], "ord int, v double")
    prev = compare.pct_of_level(df, "ord", "v", []).orderBy("ord").collect()
    first = compare.pct_of_level(df, "ord", "v", [], "first").orderBy("ord").collect()
    assert [r.pct_of_level for r in prev] == [None, 490 / 2200 * 100, 65 / 490 * 100]
    assert [r.pct_of_level for r in first] == [100.0, 490 / 2200 * 100, 65 / 2200 * 100]


def test_published_transports_and_lifts(spark):
    ab = spark.createDataFrame(
        [("seq-write-1m", "rdma", 1.36), ("seq-write-1m", "tcp", 1.55), ("seq-read-1m", "rdma", 13.6), ("seq-read-1m", "tcp", 2.74)],
        "test string, config string, v double",
    )
    got = {r.test: r.ratio for r in compare.ab_ratio(ab, "test", "config", "v", "rdma", "tcp").collect()}
    assert round(got["seq-read-1m"], 1) == 5.0 and round(got["seq-write-1m"], 2) == 0.88
    tuned = spark.createDataFrame([("w", "tuned", 2.2), ("w", "default", 0.44)], "test string, config string, v double")
    assert round(compare.lift(tuned, "test", "config", "v").first().lift, 6) == 5.0


def test_verdicts(spark):
    df = spark.createDataFrame([("a", 12.0), ("b", 12.7), ("c", 80.0)], "m string, v double")
    exp = spark.createDataFrame(
        [("a", 11.0, 11.0, 15.0), ("b", 11.0, 11.0, 15.0), ("c", 50.0, 80.0, 0.0), ("d", 1.0, None, 0.0)],
        "m string, lo double, hi double, tol_pct double",
    )
    checked = compare.check_expected(df, exp, "m", "v")
    assert {r.m: r.verdict for r in checked.collect()} == {"a": "ok", "b": "drift", "c": "ok", "d": "missing"}
    states = compare.triage(checked.withColumn("g", F.lit(1)), "g").first()
    assert (states.n, states.n_drift, states.state) == (4, 1, "drift")
    broken = compare.triage(checked.withColumn("g", F.lit(1)), "g", F.col("lo") > 5).first()
    assert broken.state == "investigate"


def test_bars(spark):
    df = spark.createDataFrame(
        [("a", 2.0, 2.0, None), ("b", 5.0, None, 5.0), ("c", 0.61, 0.4, 0.6), ("d", None, 1.0, None)],
        "t string, v double, lo double, hi double",
    )
    assert {r.t: r.passed for r in compare.pass_fail(df, "v", "lo", "hi").collect()} == {
        "a": True,
        "b": True,
        "c": False,
        "d": False,
    }


def test_constant_text(spark):
    rows = [("m", "2459.6220"), ("m", "2459.6220"), ("n", "2459.6220"), ("n", "2459.622"), ("o", None), ("o", "1")]
    df = spark.createDataFrame(rows, "model string, norm string")
    assert {r.model: (r.n, r.is_constant) for r in compare.constant_across(df, "model", "norm").collect()} == {
        "m": (2, True),
        "n": (2, False),
        "o": (2, False),
    }


def test_replicas(spark):
    rows = [("a", "h1", "s99"), ("a", "h2", "s99"), ("b", "h1", "s99"), ("b", "h2", "s49"), ("c", "h1", "MISSING"), ("c", "h2", "MISSING"), ("d", "h1", "x")]
    df = spark.createDataFrame(rows, "run string, host string, target string")
    assert {r.run: r.agree for r in compare.replica_agreement(df, "run", "host", "target").collect()} == {
        "a": True,
        "b": False,
        "c": False,
        "d": False,
    }


def test_cross_source(spark):
    a = spark.createDataFrame([("r", 11096.0), ("w", 8184.0)], "k string, iostat double")
    b = spark.createDataFrame([("r", 10512.0), ("w", 1974.0)], "k string, fio double")
    got = {r.k: (round(r.rel_diff, 3), r.agree) for r in compare.cross_source(a, b, "k", "iostat", "fio", 0.06).collect()}
    assert got == {"r": (0.056, True), "w": (3.146, False)}


def test_mixed_rate_adds_rounded_parts(spark):
    got = compare.mixed_rate(spark.createDataFrame([(2600.5, 1112.5)], "r double, w double"), "r", "w").first()
    assert got.total_mb == 3714 and got.mixed_text == "2601 R + 1113 W = 3714 MB/s"


def test_audit(spark):
    rows = [
        ("ok", {"numjobs": "16", "offset_increment": "128g", "size": "128g", "runtime": "180"}),
        ("shared", {"numjobs": "16", "size": "2048g", "runtime": "180"}),
        ("loops", {"numjobs": "2", "offset_increment": "64g", "size": "64g", "runtime": "180"}),
        ("over", {"numjobs": "2", "offset_increment": "128g", "size": "256g", "runtime": "1"}),
        ("single", {"size": "2048g", "runtime": "180"}),
    ]
    params = spark.createDataFrame(rows, "job string, params map<string,string>")
    rates = spark.createDataFrame(
        [("ok", 10512.0), ("shared", 32000.0), ("loops", 1500.0), ("over", 100.0), ("single", 1662.0)], "job string, mb_per_s double"
    )
    got = {
        r.job: (r.no_offset, r.wraps, r.overlap, r.above_link) for r in audit.audit_sweep(params, rates, 15750.0).collect()
    }
    assert got == {
        "ok": (False, False, False, False),
        "shared": (True, False, False, True),
        "loops": (False, True, False, False),
        "over": (False, False, True, False),
        "single": (False, False, False, False),
    }


def test_costs(spark):
    ev = spark.createDataFrame([("nfs", 21.0), ("nfs", 24.0), ("nfs", 23.0), ("rsync", 4.5)], "run string, secs double")
    sync = spark.createDataFrame([("rsync", 342.0)], "run string, sync double")
    got = {r.run: r.total_secs for r in costs.total_cost(ev, sync, "run", "secs", "sync").collect()}
    assert got == {"nfs": 68.0, "rsync": 346.5}
    be = costs.break_even(spark.createDataFrame([(342.0, 22.0, 4.5)], "s double, a double, b double"), "s", "a", "b").first()
    assert round(be.break_even, 1) == 19.5
    bw = costs.effective_bw(spark.createDataFrame([("r", 50000.0, 58.0)], "p string, mb double, s double"), "p", "mb", "s").first()
    assert round(bw.rate) == 862
    sh = costs.overhead_share(
        spark.createDataFrame([("c", 12.0, 100.0), ("c", 46.0, 100.0)], "p string, k double, w double"), "p", "k", "w"
    ).first()
    assert sh.share == 0.58


def test_footprint(spark):
    rows = [("file:/r/ck/step_24/model/a", 5), ("file:/r/ck/step_24/optim/b", 3), ("/r/ck/step_49/c", 1)]
    df = spark.createDataFrame(rows, "path string, length long")
    assert {r.dir: (r.bytes, r.files) for r in costs.footprint(df, 3).collect()} == {
        "r/ck/step_24": (8, 2),
        "r/ck/step_49": (1, 1),
    }


def test_elapsed_and_run_window(spark):
    df = spark.createDataFrame([("a", "launch", 100.0), ("a", "end", 150.0), ("a", "end", 442.0), ("b", "launch", 1.0)], "label string, kind string, ts_epoch double")
    got = {r.label: (r.secs, r.mins) for r in intervals.elapsed(df, "label").collect()}
    assert got == {"a": (342.0, 5.7), "b": (None, None)}


def test_curve_sums_threads_and_finds_the_knee(spark):
    rows = []
    for thread in range(16):
        for s in range(60):
            rows.append(("w16", thread, 1000 * s + thread, (700_000 if s < 30 else 115_000), 1))
            rows.append(("w16", thread, 1000 * s + thread, 10, 0))
    df = spark.createDataFrame(rows, "job string, thread int, t_ms long, bw_kib long, direction int")
    curve = curves.bw_curve(df, ["job", "direction"])
    at = {(r.direction, r.bin): r.total for r in curve.collect()}
    assert at[(1, 0)] == 16 * 700_000 and at[(1, 59)] == 16 * 115_000 and at[(0, 3)] == 160
    knee = {r.direction: r for r in curves.bw_knee(curve, ["job", "direction"]).collect()}
    # 5 s windows: below half once three of five seconds are slow
    assert knee[1].early == 16 * 700_000 and knee[1].knee_bin == 32
    assert knee[0].knee_bin is None
    points = curves.bw_points(df.limit(1)).first()
    assert points.secs == 0.0 and points.mib_s == 700_000 / 1024


def test_knee_over_ranges_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for job in "abc":
        level = 100.0
        for b in range(-30, 170):
            level *= rnd.choice([1, 1, 1, 0.99, 0.97])
            if rnd.random() > 0.04:  # a missing bin breaks every window over it
                rows.append((job, b, round(level + rnd.uniform(-9, 9), 2)))
    df = spark.createDataFrame(rows + [("short", 1, 5.0)], "job string, bin long, total double")
    for smooth, span in ((5, 5), (5, 8), (1, 3), (7, 4096)):
        want = {}
        for job in "abc":
            bins = {b: v for j, b, v in rows if j == job}
            full = {b: round(sum(bins[b - k] for k in range(smooth)), 6) / smooth for b in bins if all(b - k in bins for k in range(smooth))}
            early = full[min(full)]
            knee = min((b for b, v in full.items() if v < early * 0.5), default=None)
            want[job] = (early, knee, full.get(knee))
        for decimals in (None, 2):
            got = curves.bw_knee(df, "job", smooth, decimals=decimals, span=span).collect()
            assert {r.job: (r.early, r.knee_bin, r.knee_level) for r in got if r.job != "short"} == {k: tuple(x if x is None else pytest.approx(x) for x in v) for k, v in want.items()}
            assert smooth == 1 or "short" not in {r.job for r in got}
