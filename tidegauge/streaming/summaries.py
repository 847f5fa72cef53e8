"""Sample summaries on unbounded input.

The input is a stream of *typed* samples (see ``read_sample_stream``); the
since-boot block of a capture is dropped before samples are emitted, because
its place in a log is not known to a stream. Rows later than the watermark are
dropped, so the batch operators on the stored samples have the last word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.units import exact_sum
from tidegauge.operators.samples import is_active
from tidegauge.operators.spread import as_list
from tidegauge.session import shared_dir


def read_sample_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of typed samples as they arrive.

    A path is given as a pattern of itself, since a stream takes a single file
    only from a pattern; a folder is read the same way.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    path = path.rstrip("/")
    is_pattern = any(c in path for c in "*?[{")
    return reader.parquet(path if is_pattern else f"{path[:-1]}[{path[-1]}]")


def _timed(sdf: DataFrame, ts: str, watermark: str) -> DataFrame:
    # event time has to be a zoned timestamp
    return sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def _edges(window: Column) -> list[Column]:
    return [
        window["start"].cast("timestamp_ntz").alias("window_start"),
        window["end"].cast("timestamp_ntz").alias("window_end"),
    ]


def stream_io_summary(
    sdf: DataFrame,
    by: str | Sequence[str],
    ts: str = "ts",
    window: str = "1 minute",
    watermark: str = "1 minute",
    r: str = "r_mbs",
    w: str = "w_mbs",
    period: float = 2,
    threshold: float = 50,
    decimals: int | None = None,
) -> DataFrame:
    """Peak, volume and active average per tumbling window."""
    by = as_list(by)
    active = is_active(r, w, threshold)

    def summed(col: Column) -> Column:
        return F.coalesce(exact_sum(col, decimals), F.lit(0.0))

    sums = (
        _timed(sdf, ts, watermark)
        .groupBy(F.window(ts, window).alias("_window"), *by)
        .agg(
            F.max(r).alias("peak_r"),
            F.max(w).alias("peak_w"),
            F.max(F.col(r) + F.col(w)).alias("peak_rw"),
            summed(F.col(r)).alias("_sum_r"),
            summed(F.col(w)).alias("_sum_w"),
            summed(F.when(active, F.col(r))).alias("_act_r"),
            summed(F.when(active, F.col(w))).alias("_act_w"),
            F.count_if(active).alias("active_n"),
        )
    )
    return sums.select(
        *_edges(F.col("_window")),
        *by,
        "peak_r",
        "peak_w",
        "peak_rw",
        (F.col("_sum_r") * F.lit(float(period)) / 1024).alias("total_r_gb"),
        (F.col("_sum_w") * F.lit(float(period)) / 1024).alias("total_w_gb"),
        F.coalesce(F.try_divide("_act_r", "active_n"), F.lit(0.0)).alias("active_avg_r"),
        F.coalesce(F.try_divide("_act_w", "active_n"), F.lit(0.0)).alias("active_avg_w"),
        "active_n",
    )


def stream_bursts(
    sdf: DataFrame,
    by: str | Sequence[str],
    ts: str = "ts",
    gap: str = "3 seconds",
    watermark: str = "1 minute",
    r: str = "r_mbs",
    w: str = "w_mbs",
) -> DataFrame:
    """Bursts of active samples; filter the stream to active samples first."""
    by = as_list(by)
    return (
        _timed(sdf, ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("_session"), *by)
        .agg(
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.count(F.lit(1)).alias("n"),
            F.max(r).alias("peak_r"),
            F.max(w).alias("peak_w"),
            F.max(F.col(r) + F.col(w)).alias("peak_rw"),
        )
        .select(
            *by,
            F.col("_first").cast("timestamp_ntz").alias("burst_start"),
            F.col("_last").cast("timestamp_ntz").alias("burst_end"),
            "n",
            "peak_r",
            "peak_w",
            "peak_rw",
        )
    )


def stream_rate(
    sdf: DataFrame,
    by: str | Sequence[str],
    ts: str = "ts",
    window: str = "1 minute",
    slide: str = "10 seconds",
    watermark: str = "1 minute",
    r: str = "r_mbs",
    w: str = "w_mbs",
    decimals: int | None = None,
) -> DataFrame:
    """Mean rates over sliding windows."""
    by = as_list(by)
    return (
        _timed(sdf, ts, watermark)
        .groupBy(F.window(ts, window, slide).alias("_window"), *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            exact_sum(r, decimals).alias("_r"),
            exact_sum(w, decimals).alias("_w"),
        )
        .select(
            *_edges(F.col("_window")),
            *by,
            "n",
            (F.col("_r") / F.col("n")).alias("mean_r"),
            (F.col("_w") / F.col("n")).alias("mean_w"),
        )
    )


def stream_alerts(
    sdf: DataFrame,
    limits: DataFrame,
    on: str,
    r: str = "r_mbs",
    w: str = "w_mbs",
    limit_r: str = "limit_r",
    limit_w: str = "limit_w",
) -> DataFrame:
    """Samples strictly above the limits of their device.

    ``limits`` is a static table with one row per device; Spark broadcasts it
    when it is small and shuffles otherwise.
    """
    over_r = F.coalesce(F.col(r) > F.col(limit_r), F.lit(False))
    over_w = F.coalesce(F.col(w) > F.col(limit_w), F.lit(False))
    return (
        sdf.join(limits, on)
        .withColumn(
            "alert", F.when(over_r & over_w, "read and write").when(over_r, "read").when(over_w, "write")
        )
        .filter(F.col("alert").isNotNull())
    )


def drain_to_table(sdf: DataFrame, purpose: str, out: str | None = None) -> DataFrame:
    """Process what is available now into a parquet table and return the table.

    Output and progress lie in the shared folder, so a lost executor loses
    nothing. With ``out`` a restarted run goes on where it stopped; without it
    every call starts a table of its own.
    """
    spark = sdf.sparkSession
    root = out or shared_dir(spark, purpose)
    query = (
        sdf.writeStream.format("parquet")
        .option("path", f"{root}/table")
        .option("checkpointLocation", f"{root}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{root}/table")
