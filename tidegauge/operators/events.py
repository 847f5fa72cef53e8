"""Training-log lines and checkpoint events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.text import EVENT_PATTERNS, MEM_PATTERN, event_fields, kinds_of, mem_extracts
from tidegauge.functions.units import bin_of, epoch_us, exact_sum
from tidegauge.operators.spread import as_list, attach, join_on, rank_cut


def event_lines(df: DataFrame, line: str, patterns: Mapping[str, str] = EVENT_PATTERNS) -> DataFrame:
    """One row per line and matching kind, in a single pass over the lines."""
    return df.withColumn("kind", F.explode(kinds_of(line, patterns)))


def head_per(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], n: int) -> DataFrame:
    return rank_cut(df, by, [F.col(c).asc() for c in as_list(order)], n, slice_by=as_list(order))


def tail_per(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], n: int) -> DataFrame:
    return rank_cut(df, by, [F.col(c).desc() for c in as_list(order)], n, slice_by=as_list(order))


def head_per_kind(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], limits: Mapping[str, int]) -> DataFrame:
    """First lines per log and kind, with a limit for each kind."""
    kinds = df.filter(F.col("kind").isin(*limits))
    cut = rank_cut(kinds, as_list(by) + ["kind"], [F.col(c).asc() for c in as_list(order)], max(limits.values()), "_rank", as_list(order))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return cut.filter(F.col("_rank") <= F.try_element_at(limit, F.col("kind"))).drop("_rank")


def extract_mem(df: DataFrame, line: str, pattern: str = MEM_PATTERN, out: str = "mem") -> DataFrame:
    """One row per match in a line; ``<out>_pos`` orders matches of one line."""
    return df.select("*", F.posexplode(mem_extracts(line, pattern)).alias(f"{out}_pos", out))


def memory_plateau(
    df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], text: str, n: int = 5
) -> DataFrame:
    """Distinct values of the last ``n`` extracts of each log, sorted as text."""
    last = tail_per(df.filter(F.col(text).isNotNull()), by, order, n)
    return last.groupBy(*as_list(by)).agg(F.array_sort(F.collect_set(text)).alias("plateau"))


def parse_events(df: DataFrame, line: str) -> DataFrame:
    return df.select("*", *[c.alias(k) for k, c in event_fields(line).items()])


def with_default(df: DataFrame, dim: DataFrame, on: str | Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Every row of ``dim``, with defaults for measures that have no row."""
    on = as_list(on)
    filled = join_on(dim, df, on)
    return filled.select(
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in filled.columns]
    )


def message_rows(lines: DataFrame, labels: DataFrame, label: str, line: str, messages: Mapping[str, str]) -> DataFrame:
    """The lines, and a message row for each (label, kind) without one.

    Labels and the kinds they have meet in one aggregation, a row per task,
    label and kind at most.
    """
    asked = labels.select(label, F.lit(None).cast("string").alias("kind"), F.lit(True).alias("_asked"))
    had = lines.select(label, F.when(F.col("kind").isin(*messages), F.col("kind")).alias("kind"), F.lit(False).alias("_asked"))
    each = asked.unionByName(had).groupBy(label).agg(F.max("_asked").alias("_asked"), F.collect_set("kind").alias("_kinds"))
    text = F.create_map(*[F.lit(x) for pair in messages.items() for x in pair])
    missing = each.where(F.col("_asked") & F.col(label).isNotNull()).select(
        label, F.explode(F.array_except(F.array(*map(F.lit, messages)), "_kinds")).alias("kind")
    )
    return lines.unionByName(missing.withColumn(line, F.try_element_at(text, F.col("kind"))), allowMissingColumns=True)


def first_or_message(
    lines: DataFrame,
    by: str | Sequence[str],
    order: str | Sequence[str],
    line: str,
    patterns: Mapping[str, str],
    limits: Mapping[str, int],
    messages: Mapping[str, str],
) -> DataFrame:
    """First lines of each log and kind, and a message row for each kind a log has no line of.

    Every line also counts as of the kind ``""``, whose first row stands for
    the log. What is missing then follows from the rows that are kept, a bounded
    number per log, so the text is read and matched once.
    """
    by, order = as_list(by), as_list(order)
    kinds = F.array_append(kinds_of(line, patterns), F.lit(""))
    tagged = lines.select(*by, *order, line, F.explode(kinds).alias("kind"))
    kept = head_per_kind(tagged, by, order, {**limits, "": 1})
    text = F.create_map(*[F.lit(x) for pair in messages.items() for x in pair])
    rows = kept.groupBy(*by).agg(F.collect_list(F.struct(*order, line, "kind")).alias("_rows"))
    none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order]
    missing = F.transform(
        F.array_except(F.array(*map(F.lit, messages)), F.transform("_rows", lambda r: r["kind"])),
        lambda k: F.struct(*none, F.try_element_at(text, k).alias(line), k.alias("kind")),
    )
    return rows.select(*by, F.inline(F.concat(F.filter("_rows", lambda r: r["kind"] != ""), missing)))


def hot_cold(
    df: DataFrame,
    run: str,
    step: str | Sequence[str],
    secs: str,
    hot_rows: int = 10_000_000,
) -> DataFrame:
    """First checkpoint of a run is hot, later ones cold; ratio to the first."""
    at = F.struct(*as_list(step))
    firsts = df.groupBy(run).agg(
        F.min(at).alias("_first_step"),
        F.min_by(secs, at).alias("_first_secs"),
        F.count(F.lit(1)).alias("_rows"),
    )
    both = attach(df, firsts, run, step, "_rows", hot_rows)
    return (
        both.withColumn("regime", F.when(at == F.col("_first_step"), "hot").otherwise("cold"))
        .withColumn("ratio", F.try_divide(F.col(secs).cast("double"), F.col("_first_secs").cast("double")))
        .drop("_first_step", "_first_secs")
    )


def regime_stats(df: DataFrame, by: str | Sequence[str], secs: str, decimals: int | None = None) -> DataFrame:
    """Mean, fastest and slowest time per regime."""
    return (
        df.groupBy(*as_list(by))
        .agg(
            F.count(secs).alias("n"),
            exact_sum(secs, decimals).alias("_sum"),
            F.min(secs).alias("min_secs"),
            F.max(secs).alias("max_secs"),
        )
        .withColumn("mean_secs", F.try_divide("_sum", "n"))
        .drop("_sum")
    )


def slowdown_tail(
    df: DataFrame,
    run: str,
    step: str,
    is_checkpoint: Column,
    tps: str,
    n_steps: int,
    decimals: int | None = None,
    span: int = 4096,
) -> DataFrame:
    """Throughput in the ``n_steps`` steps after a checkpoint against the rest.

    ``step`` is a whole number, unique per run. Runs are cut into ranges of
    ``span`` steps. A checkpoint reaches no further than the next range, so its
    row goes to both and every range is decided by itself.
    """
    if n_steps > span:
        raise ValueError("span must be at least n_steps")
    laid = (
        df.select(run, F.col(step).alias("_step"), is_checkpoint.alias("_is_ckpt"), F.col(tps).alias("_tps"))
        .withColumn("_here", bin_of("_step", span))
        .withColumn(
            "_range",
            F.explode(F.when(F.col("_is_ckpt"), F.array("_here", F.col("_here") + 1)).otherwise(F.array("_here"))),
        )
    )
    upto = Window.partitionBy(run, "_range").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_is_ckpt"), F.col("_step")), ignorenulls=True).over(upto)
    rows = laid.withColumn("_since", F.col("_step") - last).filter(F.col("_range") == F.col("_here"))
    tail = F.coalesce(F.col("_since").between(1, n_steps), F.lit(False))
    value = F.col("_tps")
    return (
        rows.withColumn("_tail", tail)
        .groupBy(run)
        .agg(
            F.count(F.when(F.col("_tail"), value)).alias("tail_n"),
            exact_sum(F.when(F.col("_tail"), value), decimals).alias("_tail_sum"),
            F.count(F.when(~F.col("_tail"), value)).alias("steady_n"),
            exact_sum(F.when(~F.col("_tail"), value), decimals).alias("_steady_sum"),
        )
        .withColumn("tail_tps", F.try_divide("_tail_sum", "tail_n"))
        .withColumn("steady_tps", F.try_divide("_steady_sum", "steady_n"))
        .withColumn("slowdown", F.try_divide("steady_tps", "tail_tps"))
        .drop("_tail_sum", "_steady_sum")
    )


def signpost_interval(
    df: DataFrame, run: str | Sequence[str], ts: str, start: Column, stop: Column, span_seconds: int = 3600
) -> DataFrame:
    """Seconds from the first ``start`` marker to the first ``stop`` marker at or after it.

    Markers of one time are one row. Time is cut into ranges, and each is summed
    up by its first start, its first stop, and its first stop at or after its
    own first start. Of these the interval follows for the whole run: it begins
    with the first of all starts and ends with that range's stop after it, or
    else with the first stop of a later range. A run without markers stays.
    """
    run = as_list(run)
    is_start, is_stop = F.coalesce(start, F.lit(False)), F.coalesce(stop, F.lit(False))
    at = F.when(is_start | is_stop, F.col(ts))
    marks = (
        df.select(*run, at.alias("_ts"), is_start.alias("_start"), is_stop.alias("_stop"))
        .groupBy(*run, bin_of(epoch_us("_ts"), span_seconds * 1_000_000).alias("_range"), "_ts")
        .agg(F.max("_start").alias("_start"), F.max("_stop").alias("_stop"))
    )
    first = F.min(F.when(F.col("_start"), F.col("_ts")))
    ranges = (
        marks.withColumn("_from", first.over(Window.partitionBy(*run, "_range")))
        .groupBy(*run, "_range")
        .agg(
            F.min("_from").alias("_from"),
            F.min(F.when(F.col("_stop"), F.col("_ts"))).alias("_first_stop"),
            F.min(F.when(F.col("_stop") & (F.col("_ts") >= F.col("_from")), F.col("_ts"))).alias("_stop_after"),
        )
    )
    start_at, stop_at = F.col("from_ts"), F.col("_first_stop")
    ends = F.least(
        F.min(F.when(F.col("_from") == start_at, F.col("_stop_after"))), F.min(F.when(stop_at >= start_at, stop_at))
    )
    return (
        ranges.withColumn("from_ts", F.min("_from").over(Window.partitionBy(*run)))
        .groupBy(*run)
        .agg(F.min("from_ts").alias("from_ts"), ends.alias("to_ts"))
        .withColumn("secs", (epoch_us("to_ts") - epoch_us("from_ts")) / F.lit(1e6))
    )
