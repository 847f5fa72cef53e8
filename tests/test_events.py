import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tidegauge.operators import events

T0 = datetime(2026, 5, 3, 10, 0, 0)


def test_a_line_can_have_several_kinds(spark):
    df = spark.createDataFrame(
        [(1, "step 250 | mem 35.5 GiB"), (2, "Loading checkpoint from x"), (3, "nothing"), (4, "step 1000 | x")], "n int, line string"
    )
    got = {(r.n, r.kind) for r in events.event_lines(df, "line").collect()}
    assert got == {
        (1, "step"),
        (1, "cold_restore"),
        (1, "restore_memory"),
        (2, "restore"),
        (2, "cold_restore"),
    }


def test_heads_and_tails(spark):
    df = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1)], "log string, n int")
    assert sorted(r.n for r in events.head_per(df, "log", "n", 3).filter("log = 'a'").collect()) == [0, 1, 2]
    assert sorted(r.n for r in events.tail_per(df, "log", "n", 3).filter("log = 'a'").collect()) == [37, 38, 39]
    assert events.head_per(df, "log", "n", 3).count() == 4


def test_head_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("log"), F.col("id").alias("n"))
    assert "WindowGroupLimit" in executed_plan(events.head_per(df, "log", "n", 30))


def test_large_heads_are_cut_in_slices(spark):
    df = spark.range(9000).select(F.lit("hot").alias("log"), F.col("id").alias("n"))
    got = sorted(r.n for r in events.head_per(df, "log", "n", 2500).collect())
    assert got == list(range(2500))


def test_kind_limits(spark):
    rows = [("a", i, "consolidation") for i in range(12)] + [("a", 100 + i, "bracket") for i in range(6)] + [("a", 500, "x")]
    df = spark.createDataFrame(rows, "log string, n int, kind string")
    got = events.head_per_kind(df, "log", "n", {"consolidation": 10, "step": 30, "bracket": 4})
    assert sorted(r.n for r in got.collect()) == list(range(10)) + [100, 101, 102, 103]


def test_plateau_is_last_five_distinct_and_text_sorted(spark):
    lines = ["mem 99 GiB", "mem 61.5 GiB | mem 9.5 GiB", "x", "mem 35.5 GiB", "mem 35.5 GiB", "mem 100.0 GiB"]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(lines)], "log string, n int, line string")
    found = events.extract_mem(df, "line")
    assert found.count() == 6  # every match of a line
    got = events.memory_plateau(found, "log", ["n", "mem_pos"], "mem").first()
    assert got.plateau == ["mem 100.0 GiB", "mem 35.5 GiB", "mem 61.5 GiB", "mem 9.5 GiB"]


def test_message_rows_for_logs_without_lines(spark):
    lines = spark.createDataFrame([("a", "step", "step 99")], "log string, kind string, line string")
    labels = spark.createDataFrame([("a",), ("b",)], "log string")
    got = events.message_rows(lines, labels, "log", "line", {"step": "(none)"})
    assert sorted((r.log, r.line) for r in got.collect()) == [("a", "step 99"), ("b", "(none)")]


def test_hot_and_cold_checkpoints(spark):
    # published consolidation times; the ratio is computed, not quoted
    df = spark.createDataFrame(
        [("c25", 49, 73.98), ("c25", 24, 12.99), ("c25", 74, 60.11), ("c25", 99, 46.66), ("c100", 99, 13.0)],
        "run string, step int, secs double",
    )
    got = {(r.run, r.step): r for r in events.hot_cold(df, "run", "step", "secs").collect()}
    assert got[("c25", 24)].regime == "hot" and got[("c25", 24)].ratio == 1.0
    assert got[("c25", 49)].regime == "cold" and round(got[("c25", 49)].ratio, 2) == 5.70
    assert got[("c100", 99)].regime == "hot"
    split = {(r.run, r.step): r for r in events.hot_cold(df, "run", "step", "secs", hot_rows=2).collect()}
    assert split == got
    stats = {r.regime: r for r in events.regime_stats(events.hot_cold(df, "run", "step", "secs"), "regime", "secs").collect()}
    assert stats["hot"].n == 2 and stats["cold"].mean_secs == (73.98 * 100 + 6011 + 4666) / 100 / 3


def test_slowdown_tail_over_range_borders(spark):
    tps = {s: (200.0 if 30 < s <= 45 or 10 < s <= 25 else 550.0) for s in range(60)}
    rows = [("r", s, v, s in (10, 30)) for s, v in tps.items()] + [("q", 1, 500.0, False)]
    df = spark.createDataFrame(rows, "run string, step int, tps double, ckpt boolean")
    for span in (15, 16, 64):
        got = {r.run: r for r in events.slowdown_tail(df, "run", "step", F.col("ckpt"), "tps", 15, span=span).collect()}
        r = got["r"]
        assert (r.tail_n, r.steady_n, r.tail_tps, r.steady_tps, r.slowdown) == (30, 30, 200.0, 550.0, 2.75)
        assert got["q"].tail_n == 0 and got["q"].tail_tps is None and got["q"].slowdown is None


def test_signposts(spark):
    rows = [("a", 0, "norm"), ("a", 5, "norm"), ("a", 89, "step 100"), ("a", 99, "step 100"), ("b", 3, "norm")]
    df = spark.createDataFrame([(r, T0 + timedelta(seconds=t), k) for r, t, k in rows], "run string, ts timestamp, kind string")
    got = events.signpost_interval(df, "run", "ts", F.col("kind") == "norm", F.col("kind") == "step 100")
    assert {r.run: r.secs for r in got.collect()} == {"a": 89.0, "b": None}


def test_signposts_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("abcdefgh"), rnd.randrange(-4000, 4000), rnd.choice(["norm", "step 100", "x", "x", None])) for _ in range(160)]
    rows += [("late", 10, "step 100"), ("late", 20, "norm"), ("both", 7, "norm"), ("both", 7, "step 100"), ("none", 1, "x"), (None, 1, "norm"), (None, 9000, "step 100")]
    df = spark.createDataFrame([(r, T0 + timedelta(seconds=t), k) for r, t, k in rows] + [("none", None, "norm")], "run string, ts timestamp, kind string")
    want = {}
    for run in {r[0] for r in rows}:
        first = min((t for r, t, k in rows if r == run and k == "norm"), default=None)
        ends = [t for r, t, k in rows if r == run and k == "step 100" and first is not None and t >= first]
        want[run] = (first, float(min(ends) - first) if ends else None)
    for span in (1, 100, 100_000):
        got = events.signpost_interval(df, "run", "ts", F.col("kind") == "norm", F.col("kind") == "step 100", span).collect()
        assert {r.run: (r.from_ts and (r.from_ts - T0).total_seconds(), r.secs) for r in got} == want


def test_signposts_take_one_scan(spark):
    df = spark.createDataFrame([("a", T0, "norm")], "run string, ts timestamp, kind string")
    plan = executed_plan(events.signpost_interval(df, "run", "ts", F.col("kind") == "norm", F.col("kind") == "step 100"))
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


def test_defaults(spark):
    df = spark.createDataFrame([("a", 5.0)], "t string, v double")
    dim = spark.createDataFrame([("a",), ("b",)], "t string")
    assert {r.t: r.v for r in events.with_default(df, dim, "t", {"v": 0.0}).collect()} == {"a": 5.0, "b": 0.0}
