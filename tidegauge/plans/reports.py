"""End-to-end reports: from files to the published kinds of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import EVENT_LIMITS, EVENT_PATTERNS, MISSING_MESSAGES
from tidegauge.functions.units import bw_mbs, fmt_rate, iops, latency_us, pct_of, pct_text
from tidegauge.operators.compare import battery_report, cross_compare, join_spec, pair_clients
from tidegauge.operators.events import extract_mem, first_or_message, memory_plateau
from tidegauge.operators.samples import io_summary
from tidegauge.operators.spread import join_on
from tidegauge.sources.dims import BATTERY, spec_df, sweep_df


def sweep_report(results: DataFrame, spec: Mapping[str, float] | None = None) -> DataFrame:
    """Sweep table with percent of spec, one row per job of the sweep.

    ``results`` are rows of ``read_fio_json``. A job without result has null
    figures.
    """
    spark = results.sparkSession
    wide = results.groupBy("job").agg(
        *[
            F.max(F.when(F.col("op") == op, value)).alias(f"_{name}_{op}")
            for op in ("READ", "WRITE")
            for name, value in (("bw", bw_mbs("bw_bytes")), ("iops", iops("iops")), ("p99", latency_us("clat_ns")))
        ]
    )
    rows = join_on(sweep_df(spark), wide, "job")

    def side(name: str):
        return F.when(F.col("op") == "READ", F.col(f"_{name}_READ")).when(
            F.col("op") == "WRITE", F.col(f"_{name}_WRITE")
        )

    rows = rows.select(
        "ord",
        "job",
        "title",
        "kind",
        "spec_metric",
        F.when(F.col("kind") == "bw", side("bw")).when(F.col("kind") == "iops", side("iops")).alias("value"),
        F.when(F.col("kind") == "iops", side("p99")).alias("p99_us"),
        F.when(F.col("kind") == "mixed", F.col("_bw_READ")).alias("read_mb"),
        F.when(F.col("kind") == "mixed", F.col("_bw_WRITE")).alias("write_mb"),
    )
    rows = join_spec(rows, spec_df(spark, spec), "spec_metric")
    return rows.select(
        "ord",
        "job",
        "title",
        "kind",
        F.coalesce("value", F.col("read_mb") + F.col("write_mb")).alias("value"),
        "p99_us",
        "read_mb",
        "write_mb",
        pct_of("value", "spec").alias("pct_of_spec"),
    ).orderBy("ord")


def sweep_text(report: DataFrame) -> DataFrame:
    """Text cells of the sweep table: throughput, p99 latency, % of spec."""
    rate = (
        F.when(F.col("kind") == "bw", F.format_string("%d MB/s", "value"))
        .when(F.col("kind") == "iops", F.format_string("%d IOPS", "value"))
        .otherwise(F.format_string("%d R + %d W = %d MB/s", "read_mb", "write_mb", "value"))
    )
    floor = F.col("title").contains("latency floor")
    p99 = (
        F.when(F.col("p99_us").isNull(), "—")
        .when(floor, F.format_string("**%d µs**", "p99_us"))
        .otherwise(F.format_string("%d µs", "p99_us"))
    )
    return report.select("ord", "title", rate.alias("rate"), p99.alias("p99"), pct_text("pct_of_spec").alias("pct"))


def device_report(samples: DataFrame, threshold: float = 50, period: float = 2) -> DataFrame:
    """One summary row per log file; files of different folders may share a label."""
    each = io_summary(samples, ["path", "label"], "seq", threshold=threshold, period=period, decimals=2, once=True)
    return each.orderBy("label", "path")


def log_of(lines: DataFrame) -> list[str]:
    """Columns that name a log: its file beside the label, which files of different folders may share."""
    return [c for c in ("label", "path") if c in lines.columns]


def checkpoint_report(lines: DataFrame) -> DataFrame:
    """Event lines per log and kind with their limits, and message rows.

    ``lines`` are rows of ``read_training_log``.
    """
    kinds = {k: EVENT_PATTERNS[k] for k in EVENT_LIMITS}
    by = log_of(lines)
    rows = first_or_message(lines, by, "line_no", "raw", kinds, EVENT_LIMITS, MISSING_MESSAGES)
    return rows.orderBy(*by, "kind", "line_no")


def plateau_report(lines: DataFrame, n: int = 5) -> DataFrame:
    """Distinct memory figures of the last extracts of each log."""
    return memory_plateau(extract_mem(lines, "raw"), log_of(lines), ["line_no", "mem_pos"], "mem", n)


def battery_tables(results: DataFrame) -> DataFrame:
    """All batteries, every test in catalogue order with rate and text."""
    return battery_report(results, BATTERY, ["pillar", "client"]).withColumn("rate", fmt_rate("mb_per_s"))


def concurrent_table(results: DataFrame, pillar: str = "3", a: str = "host1", b: str = "host2") -> DataFrame:
    """Both clients of the concurrent battery and their sum, by test."""
    mine = results.filter(F.col("pillar") == pillar)
    return pair_clients(mine, ["test", "op"], "client", "mb_per_s", a, b)


def cross_table(
    results: DataFrame, test_ops: Mapping[str, str] = {"seq-write-1m": "WRITE", "seq-read-1m": "READ"}
) -> DataFrame:
    """Large sequential writes and reads of every battery; clients summed."""
    wanted = F.lit(False)
    for test, op in test_ops.items():
        wanted = wanted | ((F.col("test") == test) & (F.col("op") == op))
    return cross_compare(results.filter(wanted), "pillar", "op", "mb_per_s", {"3": 2}).orderBy("pillar")
