"""Device and memory sample series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.units import bin_of, epoch_us, exact_sum, finite, of_units, part_sum, whole_units
from tidegauge.operators.spread import as_list, flag_first, match_first


def on_device(df: DataFrame, device: str | None, match: str = "exact", col: str = "device") -> DataFrame:
    """Rows of one device; ``prefix`` also takes its partitions."""
    if device is None:
        return df
    if match == "exact":
        return df.filter(F.col(col) == device)
    if match == "prefix":
        return df.filter(F.col(col).startswith(device))
    raise ValueError(f"match must be exact or prefix, not {match}")


def is_active(r: str, w: str, threshold: float = 50) -> Column:
    """Either rate strictly above the threshold."""
    return (F.col(r) > threshold) | (F.col(w) > threshold)


def active_samples(df: DataFrame, r: str, w: str, threshold: float = 50) -> DataFrame:
    return df.filter(is_active(r, w, threshold))


def drop_since_boot(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """Without the first sample of each log, which averages since boot.

    Exactly one row per log goes, even if several devices were kept.
    """
    return flag_first(df, by, order, "_boot").filter(~F.col("_boot")).drop("_boot")


def _floor0(col: Column) -> Column:
    return F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0))


def _without_first(
    df: DataFrame, by: list[str], order: str | Sequence[str], rates: Sequence[str], skip_first: bool, once: bool = False
) -> tuple[DataFrame, Column, Column]:
    """Rows, whether a row is not its log's first, and how often that first row is there.

    Where the first row is there several times, all but one of them count.
    They are the same in all that is asked of them, so they are taken up by
    number once the log has been aggregated, and no row has to be told from its
    equals. Other columns are left out first.
    """
    if not skip_first:
        return df, F.lit(True), F.lit(0)
    first = F.col("_boot")
    few = df.select(*dict.fromkeys([*by, *as_list(order), *rates]))
    return match_first(few, by, order, "_boot", once), ~first, F.count_if(first)


def _peak(kept: Column, value: Column, again: Column) -> Column:
    """Greatest value of the kept rows, and of the first row where it is there again."""
    return _floor0(F.greatest(F.max(F.when(kept, value)), F.when(again > 1, F.max(F.when(~kept, value)))))


def io_summary(
    df: DataFrame,
    by: str | Sequence[str],
    order: str | Sequence[str],
    r: str = "r_mbs",
    w: str = "w_mbs",
    period: float = 2,
    threshold: float = 50,
    skip_first: bool = True,
    decimals: int | None = None,
    once: bool = False,
) -> DataFrame:
    """Peak, volume and active average per log, in one aggregation.

    A log with nothing but its since-boot sample reports zeros. Volume is the
    sum of rate x fixed period / 1024, whatever the true spacing. With ``once``
    samples that are parsed from text are parsed once, at the price of a shuffle.
    """
    by = as_list(by)
    rows, kept, firsts = _without_first(df, by, order, [r, w], skip_first, once)
    active = F.coalesce(is_active(r, w, threshold), F.lit(False))
    total = F.col(r) + F.col(w)

    def summed(cond: Column, col: str) -> Column:
        rest = F.coalesce(part_sum(F.when(kept & cond, F.col(col)), decimals), F.lit(0))
        if not skip_first:
            return rest
        # the first row is there n times, n - 1 of them count
        once = finite(col) if decimals is None else whole_units(col, decimals).cast("decimal(38,0)")
        again = F.max(F.when(~kept & cond, once)) * (firsts - 1)
        return rest + F.coalesce(F.when(firsts > 1, again), F.lit(0))

    sums = rows.groupBy(*by).agg(
        _peak(kept, F.col(r), firsts).alias("peak_r"),
        _peak(kept, F.col(w), firsts).alias("peak_w"),
        _peak(kept, total, firsts).alias("peak_rw"),
        summed(F.lit(True), r).alias("_sum_r"),
        summed(F.lit(True), w).alias("_sum_w"),
        summed(active, r).alias("_act_r"),
        summed(active, w).alias("_act_w"),
        (F.count_if(kept & active) + F.greatest(F.count_if(~kept & active) - 1, F.lit(0))).alias("active_n"),
    )

    def of(col: str) -> Column:
        return of_units(col, decimals)

    return sums.select(
        *by,
        "peak_r",
        "peak_w",
        "peak_rw",
        (of("_sum_r") * F.lit(float(period)) / 1024).alias("total_r_gb"),
        (of("_sum_w") * F.lit(float(period)) / 1024).alias("total_w_gb"),
        F.coalesce(F.try_divide(of("_act_r"), "active_n"), F.lit(0.0)).alias("active_avg_r"),
        F.coalesce(F.try_divide(of("_act_w"), "active_n"), F.lit(0.0)).alias("active_avg_w"),
        "active_n",
    )


def io_peaks(
    df: DataFrame,
    by: str | Sequence[str],
    order: str | Sequence[str],
    r: str = "r_mbs",
    w: str = "w_mbs",
    skip_first: bool = True,
) -> DataFrame:
    """Peak read, peak write and peak of the per-sample sum."""
    by = as_list(by)
    rows, kept, firsts = _without_first(df, by, order, [r, w], skip_first)
    return rows.groupBy(*by).agg(
        _peak(kept, F.col(r), firsts).alias("peak_r"),
        _peak(kept, F.col(w), firsts).alias("peak_w"),
        _peak(kept, F.col(r) + F.col(w), firsts).alias("peak_rw"),
    )


def peak_memory(df: DataFrame, by: str | Sequence[str], hwm: str = "hwm_mib") -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.greatest(F.coalesce(F.max(hwm), F.lit(0)), F.lit(0)).alias("peak_mib"))


PEAKS = ("peak_r", "peak_w", "peak_rw")


def burst_slots(
    df: DataFrame, by: str | Sequence[str], ts: str, r: str, w: str, gap_seconds: int, decimals: int | None = None
) -> DataFrame:
    """Samples added up per gap-wide slot of a log, as samples of one slot always belong together."""
    gap = gap_seconds * 1_000_000
    return (
        df.withColumn("_us", epoch_us(ts))
        .groupBy(*as_list(by), bin_of("_us", gap).alias("_slot"))
        .agg(
            F.min("_us").alias("_s"),
            F.max("_us").alias("_e"),
            F.count(F.lit(1)).alias("n"),
            part_sum(r, decimals).alias("_r"),
            part_sum(w, decimals).alias("_w"),
            F.max(r).alias("peak_r"),
            F.max(w).alias("peak_w"),
            F.max(F.col(r) + F.col(w)).alias("peak_rw"),
        )
    )


def merge_bursts() -> list[Column]:
    return [
        F.min("_s").alias("_s"),
        F.max("_e").alias("_e"),
        *[F.sum(c).alias(c) for c in ("n", "_r", "_w")],
        *[F.max(c).alias(c) for c in PEAKS],
    ]


def chain_slots(slots: DataFrame, by: str | Sequence[str], gap_seconds: int, span: int = 4096) -> DataFrame:
    """Slots no more than a gap apart as one row.

    Rows of a log must not overlap; each has a slot of its own, that of its end.
    Runs are found inside ranges of ``span`` slots: at most ``span`` rows. A run
    inside a range is done. Only the first and the last run of a range can go on
    in its neighbours; these, at most two rows per range, are chained along the
    log and aggregated once more.
    """
    by = as_list(by)

    def opens(w) -> Column:
        return F.coalesce(F.col("_s") - F.lag("_e").over(w) > gap_seconds * 1_000_000, F.lit(True)).cast("int")

    inside = Window.partitionBy(*by, "_range").orderBy("_slot")
    runs = (
        slots.withColumn("_range", bin_of("_slot", span))
        .withColumn("_open", opens(inside))
        .withColumn("_run", F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_runs", F.max("_run").over(Window.partitionBy(*by, "_range")))
        .groupBy(*by, "_range", "_runs", "_run")
        .agg(*merge_bursts())
    )
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    along = Window.partitionBy(*by).orderBy("_range", "_run")
    chained = (
        runs.filter(edge)
        .withColumn("_open", opens(along))
        .withColumn("_chain", F.sum("_open").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_chain")
        .agg(*merge_bursts())
        .drop("_chain")
    )
    return runs.filter(~edge).drop("_range", "_runs", "_run").unionByName(chained)


def burst_rows(runs: DataFrame, by: str | Sequence[str], kind: str, decimals: int | None = None) -> DataFrame:
    """Bursts with stamps of a type and means."""
    return runs.select(
        *as_list(by),
        F.timestamp_micros("_s").cast(kind).alias("burst_start"),
        F.timestamp_micros("_e").cast(kind).alias("burst_end"),
        "n",
        (of_units("_r", decimals) / F.col("n")).alias("mean_r"),
        (of_units("_w", decimals) / F.col("n")).alias("mean_w"),
        *PEAKS,
    )


def bursts(
    df: DataFrame,
    by: str | Sequence[str],
    ts: str,
    r: str = "r_mbs",
    w: str = "w_mbs",
    gap_seconds: int = 3,
    decimals: int | None = None,
    span: int = 4096,
) -> DataFrame:
    """Runs of samples no more than ``gap_seconds`` apart, as one row each."""
    runs = chain_slots(burst_slots(df, by, ts, r, w, gap_seconds, decimals), by, gap_seconds, span)
    return burst_rows(runs, by, df.schema[ts].dataType.simpleString(), decimals)


# Rate bands of the published burst signatures, MB/s.
BURST_BANDS = (
    ("pure write", "peak_w", 1000.0, 1700.0, "checkpoint, cache hot"),
    ("mixed", "peak_w", 600.0, 800.0, "checkpoint, cache cold"),
    ("pure read", "peak_r", 1019.0, 1153.0, "restore, optimizer state"),
    ("pure read", "peak_r", 583.0, 732.0, "model load or restore, shards"),
)


def classify_burst(
    df: DataFrame,
    threshold: float = 50,
    r: str = "peak_r",
    w: str = "peak_w",
    bands: Sequence[tuple[str, str, float, float, str]] = BURST_BANDS,
) -> DataFrame:
    """Direction of each burst by the rates above the threshold, and its band."""
    direction = (
        F.when((F.col(r) > threshold) & (F.col(w) > threshold), "mixed")
        .when(F.col(r) > threshold, "pure read")
        .when(F.col(w) > threshold, "pure write")
        .otherwise("idle")
    )
    out = df.withColumn("direction", direction)
    rates = {"peak_r": r, "peak_w": w}
    band = F.lit(None).cast("string")
    for kind, rate, lo, hi, name in reversed(list(bands)):
        band = F.when((F.col("direction") == kind) & F.col(rates[rate]).between(lo, hi), name).otherwise(band)
    return out.withColumn("band", band)


# Cache regimes by working set / RAM; measured at 0.13, 1.06, 4.2.
REGIME_BOUNDS = (1.0, 4.0)
REGIME_NAMES = ("page cache", "readahead masked", "cold device")


def cache_regime(
    df: DataFrame,
    working_set: str,
    ram: str,
    bounds: tuple[float, float] = REGIME_BOUNDS,
    names: tuple[str, str, str] = REGIME_NAMES,
) -> DataFrame:
    """Regime by working set / RAM: up to the first bound, below the second, above."""
    ratio = F.try_divide(F.col(working_set).cast("double"), F.col(ram).cast("double"))
    out = df.withColumn("ws_ratio", ratio)
    q = F.col("ws_ratio")
    return out.withColumn(
        "regime", F.when(q <= bounds[0], names[0]).when(q < bounds[1], names[1]).when(q.isNotNull(), names[2])
    )


def load_regime(df: DataFrame, bytes_read: str, size: str, full: float = 0.95, none: float = 0.0) -> DataFrame:
    """Regime of a load by the share of its bytes that the device delivered."""
    share = F.try_divide(F.col(bytes_read).cast("double"), F.col(size).cast("double"))
    out = df.withColumn("read_share", share)
    q = F.col("read_share")
    return out.withColumn(
        "regime", F.when(q <= none, "page cache").when(q < full, "partial").when(q.isNotNull(), "cold")
    )


def near_zero(df: DataFrame, by: str | Sequence[str], col: str, eps: float, decimals: int | None = None) -> DataFrame:
    """Whether a log's total stays below ``eps``."""
    sums = df.groupBy(*as_list(by)).agg(F.coalesce(exact_sum(col, decimals), F.lit(0.0)).alias("total"))
    return sums.withColumn("is_zero", F.col("total") < eps)
