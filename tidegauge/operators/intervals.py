"""Run brackets: interval joins and elapsed time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.units import epoch_us
from tidegauge.operators.spread import as_list, interval_join


def samples_in_run(
    samples: DataFrame,
    runs: DataFrame,
    by: str | Sequence[str],
    ts: str,
    lo: str,
    hi: str,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Samples between launch and end of a run of the same label, both included."""
    return interval_join(samples, runs, by, epoch_us(ts), epoch_us(lo), epoch_us(hi), bucket_seconds)


def align_events(
    bursts: DataFrame,
    events: DataFrame,
    by: str | Sequence[str],
    ts: str,
    tolerance_seconds: float = 2,
    start: str = "burst_start",
    end: str = "burst_end",
    bucket_seconds: int = 60,
) -> DataFrame:
    """Log events next to the activity they fall into.

    Clocks of host and log can differ, so a burst is widened by the tolerance
    on both sides.
    """
    slack = int(tolerance_seconds * 1_000_000)
    return interval_join(
        events, bursts, by, epoch_us(ts), epoch_us(start) - slack, epoch_us(end) + slack, bucket_seconds
    )


def elapsed(
    brackets: DataFrame,
    by: str | Sequence[str],
    kind: str = "kind",
    at: str = "ts_epoch",
    launch: str = "launch",
    end: str = "end",
) -> DataFrame:
    """Last end minus first launch, in seconds and minutes."""
    return (
        brackets.groupBy(*as_list(by))
        .agg(
            F.min(F.when(F.col(kind) == launch, F.col(at))).alias("launch_at"),
            F.max(F.when(F.col(kind) == end, F.col(at))).alias("end_at"),
        )
        .withColumn("secs", F.col("end_at") - F.col("launch_at"))
        .withColumn("mins", F.col("secs") / 60)
    )
