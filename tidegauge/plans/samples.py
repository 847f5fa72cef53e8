"""Registered queries on sample series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.units import epoch_us, exact_sum
from tidegauge.operators import curves, samples
from tidegauge.operators.compare import source_agreement
from tidegauge.operators.events import head_per, signpost_interval, slowdown_tail
from tidegauge.operators.intervals import align_events, elapsed, samples_in_run
from tidegauge.plans.registry import load, registered


def io_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as device samples: one log per user, event type as device."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("label"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("device"),
        "ts",
        F.col("value").alias("r_mbs"),
        F.get_json_object("props", "$.k").try_cast("double").alias("w_mbs"),
    )


IO = """
io AS (
  SELECT user_id AS label, event_id AS seq, event_type AS device, ts, value AS r,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS w
  FROM events
)"""

NUMBERED = IO + """,
x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) > 1 AS kept FROM io)"""

SUMMARY = """
  greatest(coalesce(max(r) FILTER (WHERE kept), 0), 0) AS peak_r,
  greatest(coalesce(max(w) FILTER (WHERE kept), 0), 0) AS peak_w,
  greatest(coalesce(max(r + w) FILTER (WHERE kept), 0), 0) AS peak_rw,
  coalesce(CAST(sum(CAST(r AS DECIMAL(18,2))) FILTER (WHERE kept) AS DOUBLE), 0) * 2.0 / 1024 AS total_r_gb,
  coalesce(CAST(sum(CAST(w AS DECIMAL(18,2))) FILTER (WHERE kept) AS DOUBLE), 0) * 2.0 / 1024 AS total_w_gb,
  coalesce(CAST(sum(CAST(r AS DECIMAL(18,2))) FILTER (WHERE kept AND (r > 50 OR w > 50)) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE kept AND (r > 50 OR w > 50)), 0), 0) AS active_avg_r,
  coalesce(CAST(sum(CAST(w AS DECIMAL(18,2))) FILTER (WHERE kept AND (r > 50 OR w > 50)) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE kept AND (r > 50 OR w > 50)), 0), 0) AS active_avg_w,
  count(*) FILTER (WHERE kept AND (r > 50 OR w > 50)) AS active_n"""


@registered("io_summary", f"WITH {NUMBERED} SELECT label, {SUMMARY} FROM x GROUP BY label")
def io_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.io_summary(io_samples(spark, sf_dir), "label", "seq", decimals=2)


@registered(
    "io_summary_by_device",
    f"WITH {IO}, x AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq) > 1 AS kept FROM io)"
    f" SELECT device, {SUMMARY} FROM x GROUP BY device",
)
def io_summary_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.io_summary(io_samples(spark, sf_dir), "device", "seq", decimals=2)


@registered(
    "io_peaks",
    f"""WITH {NUMBERED}
SELECT label, coalesce(max(r), 0) AS peak_r, coalesce(max(w), 0) AS peak_w, coalesce(max(r + w), 0) AS peak_rw
FROM x GROUP BY label""".replace("max(r)", "max(r) FILTER (WHERE kept)")
    .replace("max(w)", "max(w) FILTER (WHERE kept)")
    .replace("max(r + w)", "max(r + w) FILTER (WHERE kept)"),
)
def io_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.io_peaks(io_samples(spark, sf_dir), "label", "seq")


@registered(
    "drop_since_boot",
    f"WITH {NUMBERED} SELECT label, seq, r AS r_mbs, w AS w_mbs FROM x WHERE kept",
)
def drop_since_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io_samples(spark, sf_dir).select("label", "seq", "r_mbs", "w_mbs")
    return samples.drop_since_boot(rows, "label", "seq")


@registered(
    "active_samples",
    f"WITH {IO} SELECT label, seq, device, r AS r_mbs, w AS w_mbs FROM io WHERE device = 'click' AND (r > 50 OR w > 50)",
)
def active_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.on_device(io_samples(spark, sf_dir).drop("ts"), "click")
    return samples.active_samples(rows, "r_mbs", "w_mbs", 50)


@registered(
    "device_prefix",
    f"WITH {IO} SELECT device, count(*) AS n, max(r) AS peak_r FROM io WHERE starts_with(device, 'p') OR"
    " starts_with(device, 'si') GROUP BY device",
)
def device_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io_samples(spark, sf_dir)
    both = samples.on_device(rows, "p", "prefix").unionByName(samples.on_device(rows, "si", "prefix"))
    return both.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.max("r_mbs").alias("peak_r"))


RUNS = IO + """,
act AS (SELECT * FROM io WHERE r > 50 OR w > 50),
o AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY label ORDER BY ts, seq) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END
    AS opens FROM act
),
g AS (
  SELECT *, sum(opens) OVER (PARTITION BY label ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS run FROM o
),
b AS (
  SELECT label, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n,
         CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_r,
         CAST(sum(CAST(w AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_w,
         max(r) AS peak_r, max(w) AS peak_w, max(r + w) AS peak_rw
  FROM g GROUP BY label, run
)"""


def hour_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = samples.active_samples(io_samples(spark, sf_dir), "r_mbs", "w_mbs", 50)
    return samples.bursts(active, "label", "ts", gap_seconds=3600, span=64, decimals=2)


@registered("bursts", f"WITH {RUNS} SELECT * FROM b")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_bursts(spark, sf_dir)


@registered(
    "classify_burst",
    f"""WITH {RUNS}, c AS (
  SELECT label, burst_start, peak_r, peak_w,
         CASE WHEN peak_r > 60 AND peak_w > 60 THEN 'mixed' WHEN peak_r > 60 THEN 'pure read'
              WHEN peak_w > 60 THEN 'pure write' ELSE 'idle' END AS direction FROM b)
SELECT *, CASE WHEN direction = 'pure read' AND peak_r BETWEEN 100 AND 200 THEN 'high read'
               WHEN direction = 'pure write' AND peak_w BETWEEN 90 AND 99 THEN 'high write'
               WHEN direction = 'mixed' AND peak_w BETWEEN 60 AND 80 THEN 'mid mixed' END AS band FROM c""",
)
def classify_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hour_bursts(spark, sf_dir).select("label", "burst_start", "peak_r", "peak_w")
    bands = (
        ("pure read", "peak_r", 100.0, 200.0, "high read"),
        ("pure write", "peak_w", 90.0, 99.0, "high write"),
        ("mixed", "peak_w", 60.0, 80.0, "mid mixed"),
    )
    return samples.classify_burst(rows, 60, bands=bands)


@registered(
    "align_events",
    f"""WITH {RUNS}
SELECT b.label, b.burst_start, e.seq
FROM b JOIN io e ON e.label = b.label AND e.device = 'error'
 AND e.ts BETWEEN b.burst_start - INTERVAL 120 SECOND AND b.burst_end + INTERVAL 120 SECOND""",
)
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = samples.on_device(io_samples(spark, sf_dir), "error").select("label", "seq", "ts")
    pairs = align_events(
        hour_bursts(spark, sf_dir).select("label", "burst_start", "burst_end"),
        events,
        "label",
        "ts",
        tolerance_seconds=120,
        bucket_seconds=3600,
    )
    return pairs.select("label", "burst_start", "seq")


def user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user: first signup to last purchase."""
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("label"))
        .agg(
            F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("run_start"),
            F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("run_end"),
        )
    )


IN_RUN = IO + """,
runs AS (
  SELECT label, min(ts) FILTER (WHERE device = 'signup') AS lo, max(ts) FILTER (WHERE device = 'purchase') AS hi
  FROM io GROUP BY label
),
inside AS (SELECT io.* FROM io JOIN runs ON io.label = runs.label AND io.ts BETWEEN runs.lo AND runs.hi)"""


def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_in_run(
        io_samples(spark, sf_dir), user_runs(spark, sf_dir), "label", "ts", "run_start", "run_end", 86400
    )


@registered("samples_in_run", f"WITH {IN_RUN} SELECT label, seq, r AS r_mbs FROM inside")
def in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_samples(spark, sf_dir).select("label", "seq", "r_mbs")


@registered(
    "near_zero",
    f"""WITH {IN_RUN}, s AS (
  SELECT label, CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE) AS total FROM inside GROUP BY label)
SELECT label, total, total < 2500 AS is_zero FROM s""",
)
def near_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.near_zero(run_samples(spark, sf_dir), "label", "r_mbs", 2500.0, decimals=2)


@registered(
    "elapsed",
    """WITH s AS (
  SELECT user_id AS label, min(epoch_us(ts) / 1e6) FILTER (WHERE event_type = 'signup') AS launch_at,
         max(epoch_us(ts) / 1e6) FILTER (WHERE event_type = 'purchase') AS end_at
  FROM events GROUP BY user_id)
SELECT *, end_at - launch_at AS secs, (end_at - launch_at) / 60 AS mins FROM s""",
)
def run_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "signup", "launch").when(F.col("event_type") == "purchase", "end")
    brackets = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("label"), kinds.alias("kind"), (epoch_us("ts") / F.lit(1e6)).alias("ts_epoch")
    )
    return elapsed(brackets, "label")


@registered(
    "signpost_interval",
    """WITH f AS (
  SELECT user_id AS run, min(ts) FILTER (WHERE event_type = 'signup') AS from_ts FROM events GROUP BY user_id),
s AS (SELECT run, from_ts, (SELECT min(ts) FROM events e WHERE e.user_id = f.run AND e.event_type = 'purchase'
    AND e.ts >= f.from_ts) AS to_ts FROM f)
SELECT *, (epoch_us(to_ts) - epoch_us(from_ts)) / 1e6 AS secs FROM s""",
)
def signposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumnRenamed("user_id", "run")
    kind = F.col("event_type")
    return signpost_interval(events, "run", "ts", kind == "signup", kind == "purchase")


@registered(
    "slowdown_tail",
    """WITH c AS (
  SELECT user_id AS run, value, event_id - max(CASE WHEN event_type = 'error' THEN event_id END) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events),
t AS (SELECT *, coalesce(since BETWEEN 1 AND 200, false) AS tail FROM c),
s AS (
  SELECT run, count(*) FILTER (WHERE tail) AS tail_n, count(*) FILTER (WHERE NOT tail) AS steady_n,
         CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE tail) AS DOUBLE) AS ts,
         CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE NOT tail) AS DOUBLE) AS ss FROM t GROUP BY run),
m AS (SELECT run, tail_n, steady_n, ts / nullif(tail_n, 0) AS tail_tps, ss / nullif(steady_n, 0) AS steady_tps FROM s)
SELECT *, steady_tps / nullif(tail_tps, 0) AS slowdown FROM m""",
)
def slowdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "event_type", "value")
    return slowdown_tail(events, "run", "event_id", F.col("event_type") == "error", "value", 200, span=1024, decimals=2)


@registered(
    "cache_regime",
    f"""WITH {IO}, q AS (SELECT seq, r / nullif(w, 0) AS ws_ratio FROM io)
SELECT seq, ws_ratio, CASE WHEN ws_ratio <= 1 THEN 'page cache' WHEN ws_ratio < 4 THEN 'readahead masked'
  WHEN ws_ratio IS NOT NULL THEN 'cold device' END AS regime FROM q""",
)
def cache_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io_samples(spark, sf_dir).select("seq", "r_mbs", "w_mbs")
    return samples.cache_regime(rows, "r_mbs", "w_mbs").select("seq", "ws_ratio", "regime")


@registered(
    "load_regime",
    f"""WITH {IO}, q AS (SELECT seq, w / nullif(r, 0) AS read_share FROM io)
SELECT seq, read_share, CASE WHEN read_share <= 0 THEN 'page cache' WHEN read_share < 0.95 THEN 'partial'
  WHEN read_share IS NOT NULL THEN 'cold' END AS regime FROM q""",
)
def load_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io_samples(spark, sf_dir).select("seq", "r_mbs", "w_mbs")
    return samples.load_regime(rows, "w_mbs", "r_mbs").select("seq", "read_share", "regime")


@registered(
    "peak_memory",
    "SELECT user_id AS label, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS peak_mib"
    " FROM events GROUP BY user_id",
)
def peak_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("label"), F.get_json_object("props", "$.k").try_cast("bigint").alias("hwm_mib")
    )
    return samples.peak_memory(rows, "label").select("label", F.col("peak_mib").cast("bigint").alias("peak_mib"))


CURVE = """
curve AS (
  SELECT event_type AS job, epoch_us(ts) // 3600000000 AS bin,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM events GROUP BY ALL
)"""


def hour_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("job"), F.floor(epoch_us("ts") / 1000).alias("t_ms"), "value"
    )
    return curves.bw_curve(rows, "job", "t_ms", "value", bin_s=3600, decimals=2)


@registered(
    "bw_head",
    """WITH p AS (
  SELECT event_type AS job, user_id % 4 AS thread, event_id, epoch_us(ts) // 1000 / 1000 AS secs,
    row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events)
SELECT job, thread, event_id, secs FROM p WHERE rn <= 10""",
)
def first_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First logged intervals of each thread of a job."""
    points = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("job"),
        (F.col("user_id") % 4).alias("thread"),
        "event_id",
        F.floor(epoch_us("ts") / 1000).alias("t_ms"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("bw_kib"),
    )
    first = head_per(points, ["job", "thread"], ["t_ms", "event_id"], 10)
    return curves.bw_points(first).select("job", "thread", "event_id", "secs")


@registered("bw_curve", f"WITH {CURVE} SELECT * FROM curve")
def bw_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_curve(spark, sf_dir)


@registered(
    "bw_knee",
    f"""WITH {CURVE}, m AS (
  SELECT job, bin, CAST(sum(CAST(total AS DECIMAL(18,2))) OVER w AS DOUBLE) / 5 AS smoothed, count(*) OVER w AS n
  FROM curve WINDOW w AS (PARTITION BY job ORDER BY bin RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
f AS (SELECT * FROM m WHERE n = 5),
e AS (SELECT job, arg_min(smoothed, bin) AS early FROM f GROUP BY job)
SELECT f.job, e.early, min(bin) FILTER (WHERE smoothed < e.early * 0.5) AS knee_bin,
       arg_min(smoothed, bin) FILTER (WHERE smoothed < e.early * 0.5) AS knee_level
FROM f JOIN e ON f.job = e.job GROUP BY f.job, e.early""",
)
def bw_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.bw_knee(hour_curve(spark, sf_dir), "job", smooth=5, frac=0.5, decimals=2)


@registered(
    "bw_points",
    "SELECT event_id, epoch_us(ts) // 1000 / 1000 AS secs, CAST(json_extract_string(props, '$.k') AS BIGINT) / 1024"
    " AS mib_s FROM events",
)
def bw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(
        "event_id",
        F.floor(epoch_us("ts") / 1000).alias("t_ms"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("bw_kib"),
    )
    return curves.bw_points(rows).select("event_id", "secs", "mib_s")


@registered(
    "cross_source",
    f"""WITH {IO}, s AS (
  SELECT label, CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE) AS a, CAST(sum(CAST(w AS DECIMAL(18,2))) AS DOUBLE) AS b
  FROM io GROUP BY label)
SELECT label, a, b, abs(a - b) / nullif(b, 0) AS rel_diff, abs(a - b) / nullif(b, 0) <= 0.05 AS agree FROM s""",
)
def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = io_samples(spark, sf_dir).groupBy("label").agg(exact_sum("r_mbs", 2).alias("a"), exact_sum("w_mbs", 2).alias("b"))
    return source_agreement(totals, "a", "b")
