"""Registered queries that run as streams over the stored samples, in batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.units import bin_of, epoch_us
from tidegauge.operators.samples import active_samples
from tidegauge.plans.registry import load, registered
from tidegauge.plans.samples import IO
from tidegauge.session import shared_dir
from tidegauge.streaming.incremental import Incremental, fold_bursts, fold_io_summary, fold_rate, incremental
from tidegauge.streaming.summaries import drain_to_table, read_sample_stream, stream_alerts

#: Files of a micro-batch, so that a long backlog is taken in bounded steps.
FILES = 256


def sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return _typed(read_sample_stream(spark, f"{sf_dir}/events.parquet", schema, FILES))


def _typed(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("label"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("device"),
        "ts",
        F.col("value").alias("r_mbs"),
        F.get_json_object("props", "$.k").try_cast("double").alias("w_mbs"),
    )


@registered(
    "stream_io_summary",
    f"""WITH {IO}, x AS (SELECT *, date_trunc('hour', ts) AS window_start, r > 50 OR w > 50 AS active FROM io)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, device, max(r) AS peak_r, max(w) AS peak_w,
  max(r + w) AS peak_rw, CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE) * 2.0 / 1024 AS total_r_gb,
  CAST(sum(CAST(w AS DECIMAL(18,2))) AS DOUBLE) * 2.0 / 1024 AS total_w_gb,
  coalesce(CAST(sum(CAST(r AS DECIMAL(18,2))) FILTER (WHERE active) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE active), 0), 0) AS active_avg_r,
  coalesce(CAST(sum(CAST(w AS DECIMAL(18,2))) FILTER (WHERE active) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE active), 0), 0) AS active_avg_w,
  count(*) FILTER (WHERE active) AS active_n
FROM x GROUP BY window_start, device""",
)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_io_summary("device", window="1 hour", decimals=2)
    # files come in any order here: what comes late still counts
    return incremental(sample_stream(spark, sf_dir), fold, "stream-summary", delay="1 hour").result(spark, corrected=True)


@registered(
    "stream_bursts",
    f"""WITH {IO}, act AS (SELECT * FROM io WHERE r > 50 OR w > 50),
o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY label ORDER BY ts, seq) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END
  AS opens FROM act),
g AS (SELECT *, sum(opens) OVER (PARTITION BY label ORDER BY ts, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT label, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n, max(r) AS peak_r, max(w) AS peak_w,
  max(r + w) AS peak_rw FROM g GROUP BY label, run""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = active_samples(sample_stream(spark, sf_dir), "r_mbs", "w_mbs", 50)
    run = incremental(active, fold_bursts("label", gap_seconds=7200, decimals=2), "stream-bursts", delay="1 hour")
    return run.result(spark).drop("mean_r", "mean_w")


@registered(
    "stream_rate",
    f"""WITH {IO}, s AS (
  SELECT io.*, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest([0, 1, 2]) AS window_start FROM io)
SELECT window_start, window_start + INTERVAL 3 HOUR AS window_end, device, count(*) AS n,
  CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_r,
  CAST(sum(CAST(w AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_w
FROM s GROUP BY window_start, device""",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_rate("device", window="3 hours", slide="1 hour", decimals=2)
    return incremental(sample_stream(spark, sf_dir), fold, "stream-rate", delay="1 hour").result(spark, corrected=True)


#: Days of samples in a delivery, and the last delivery.
DELIVERY_DAYS, DELIVERIES = 8, 3


def delivered(spark: SparkSession, sf_dir: str) -> Incremental:
    """The samples in a few deliveries, of which every fortieth sample misses its own and comes with the next."""
    events = load(spark, sf_dir, "events")
    first = events.agg(F.min(epoch_us("ts"))).first()[0] or 0
    due = bin_of(epoch_us("ts") - F.lit(first), DELIVERY_DAYS * 86_400_000_000)
    came = F.least(F.lit(DELIVERIES), due + F.when(F.col("event_id") % 40 == 7, 1).otherwise(0))
    folder = shared_dir(spark, "deliveries")
    stream, run = None, None
    for k in range(DELIVERIES + 1):
        events.where(came == k).write.mode("append").parquet(folder)
        stream = stream or _typed(read_sample_stream(spark, folder, events.schema))
        run = run or Incremental(fold_rate("device", window="3 hours", slide="3 hours", decimals=2), stream.schema, shared_dir(spark, "stream-late"), delay="1 hour")
        run.drain(stream)
    return run


DELIVERED = f"""{IO}, d AS (
  SELECT *, least({DELIVERIES}, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM io)) // {DELIVERY_DAYS * 86_400_000_000}
    + CASE WHEN seq % 40 = 7 THEN 1 ELSE 0 END) AS batch FROM io),
m AS (SELECT batch, max(ts) AS top FROM d GROUP BY batch),
l AS (SELECT *, coalesce(ts < (SELECT max(top) FROM m WHERE m.batch < d.batch) - INTERVAL 1 HOUR, false) AS late FROM d)"""


@registered("stream_late", f"WITH {DELIVERED} SELECT batch, label, seq, device, ts FROM l WHERE late")
def late_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, sf_dir).ledger(spark).select("batch", "label", "seq", "device", "ts")


@registered(
    "stream_late_effect",
    f"""WITH {DELIVERED}, s AS (SELECT *, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM l)
SELECT window_start, device, count(*) FILTER (WHERE NOT late) AS on_time_n, count(*) AS n,
  CAST(sum(CAST(r AS DECIMAL(18,2))) FILTER (WHERE NOT late) AS DOUBLE) / count(*) FILTER (WHERE NOT late) AS on_time_r,
  CAST(sum(CAST(r AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_r
FROM s GROUP BY window_start, device""",
)
def late_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What late samples change in each window."""
    run = delivered(spark, sf_dir)
    on_time = run.result(spark).select("window_start", "device", F.col("n").alias("on_time_n"), F.col("mean_r").alias("on_time_r"))
    whole = run.result(spark, corrected=True).select("window_start", "device", "n", "mean_r")
    joined = whole.join(on_time, ["window_start", "device"], "left")
    return joined.withColumn("on_time_n", F.coalesce("on_time_n", F.lit(0)))


@registered(
    "stream_alerts",
    f"""WITH {IO}, lim AS (SELECT p_size AS k, max(p_retailprice) / 10 AS limit_r, max(p_size) AS limit_w
  FROM part GROUP BY p_size),
j AS (SELECT seq, device, r, w, limit_r, limit_w FROM io JOIN lim ON lim.k = io.seq % 50 + 1)
SELECT seq, CASE WHEN r > limit_r AND w > limit_w THEN 'read and write' WHEN r > limit_r THEN 'read' ELSE 'write' END
  AS alert FROM j WHERE r > limit_r OR w > limit_w""",
)
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = load(spark, sf_dir, "part").groupBy(F.col("p_size").cast("bigint").alias("unit")).agg(
        (F.max("p_retailprice") / 10).alias("limit_r"), F.max("p_size").alias("limit_w")
    )
    rows = sample_stream(spark, sf_dir).withColumn("unit", F.col("seq") % 50 + 1)
    return drain_to_table(stream_alerts(rows, limits, "unit").select("seq", "alert"), "stream-alerts")
