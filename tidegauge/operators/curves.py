"""Bandwidth over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.units import bin_of, exact_sum, finite, of_units, whole_units
from tidegauge.operators.spread import as_list, join_on


def bw_points(df: DataFrame, t_ms: str = "t_ms", bw_kib: str = "bw_kib") -> DataFrame:
    """Seconds and MiB/s of each logged interval."""
    return df.withColumn("secs", F.col(t_ms) / 1000).withColumn("mib_s", F.col(bw_kib) / 1024)


def bw_curve(
    df: DataFrame,
    by: str | Sequence[str],
    t_ms: str = "t_ms",
    value: str = "bw_kib",
    bin_s: int = 1,
    decimals: int | None = None,
) -> DataFrame:
    """Sum over all threads of a job per time bin; put direction into ``by``."""
    return df.groupBy(*as_list(by), bin_of(t_ms, 1000 * bin_s).alias("bin")).agg(
        exact_sum(value, decimals).alias("total")
    )


def bw_knee(
    curve: DataFrame,
    by: str | Sequence[str],
    smooth: int = 5,
    frac: float = 0.5,
    decimals: int | None = None,
    span: int = 4096,
) -> DataFrame:
    """First bin whose smoothed rate is below ``frac`` of the early level.

    The rate is smoothed over ``smooth`` bins up to each bin. A curve is cut
    into ranges of ``span`` bins; the last ``smooth - 1`` bins of a range also
    go to the next one, so a window inside a range sees all it needs, and a long
    curve is not gathered in one task. The early level is the first full window;
    it is found in the same shuffle.
    """
    if smooth > span:
        raise ValueError("span must be at least smooth")
    by = as_list(by)
    value = finite("total") if decimals is None else whole_units("total", decimals).cast("decimal(38,0)")
    here = bin_of("bin", span)
    both = F.when(F.pmod("bin", F.lit(span)) > span - smooth, F.array(here, here + 1)).otherwise(F.array(here))
    laid = curve.select(*by, "bin", value.alias("_value"), F.explode(both).alias("_range")).repartition(*by, "_range")
    frame = Window.partitionBy(*by, "_range").orderBy("bin").rangeBetween(1 - smooth, 0)
    windows = (
        laid.withColumn("_sum", F.sum("_value").over(frame))
        .withColumn("_n", F.count(F.lit(1)).over(frame))
        .where((F.col("_n") == smooth) & (here == F.col("_range")))
        .select(*by, "bin", (of_units("_sum", decimals) / smooth).alias("smoothed"))
    )
    early = windows.groupBy(*by).agg(F.min_by("smoothed", "bin").alias("early"))
    found = join_on(windows, early, by)
    low = F.col("smoothed") < F.col("early") * frac
    return found.groupBy(*by).agg(
        F.max("early").alias("early"),
        F.min(F.when(low, F.col("bin"))).alias("knee_bin"),
        F.min_by("smoothed", F.when(low, F.col("bin"))).alias("knee_level"),
    )
