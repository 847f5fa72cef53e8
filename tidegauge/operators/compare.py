"""Comparisons: catalogue, clients, configurations, levels, expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.units import fmt_rate, round_half_up
from tidegauge.operators.spread import as_list, attach, join_on


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all inputs by column name; a missing column is null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def catalogue_report(
    results: DataFrame,
    catalogue: DataFrame,
    on: str | Sequence[str],
    value: str,
    ord_col: str = "ord",
    order: str | None = None,
) -> DataFrame:
    """Every catalogue row in catalogue order; a test without result is null.

    Results are first brought to one row per test: the last by ``order``, or
    the greatest value.
    """
    on = as_list(on)
    best = F.max_by(value, order) if order else F.max(value)
    one = results.groupBy(*on).agg(best.alias(value))
    return join_on(catalogue, one, on).orderBy(ord_col)


def battery_report(
    results: DataFrame,
    entries: Sequence[tuple[str, str, str]],
    by: str | Sequence[str],
    value: str = "mb_per_s",
    test: str = "test",
    op: str = "op",
) -> DataFrame:
    """``catalogue_report`` for many batteries at once, one per ``by`` group.

    Results are aggregated once. What a battery has of the entries, one value
    each at most, is laid beside them, so the grid needs neither a second scan
    nor a join; a battery of which no entry is known still has its rows.
    """
    by = as_list(by)
    place = F.lit(None).cast("int")
    for i, (t, o, _) in enumerate(entries):
        place = F.when((F.col(test) == t) & (F.col(op) == o), i).otherwise(place)
    one = results.groupBy(*by, place.alias("_place")).agg(F.max(value).alias("_value"))
    known = F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "_value")))
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(t).alias(test), F.lit(o).alias(op), F.lit(d).alias("description"))
            for i, (t, o, d) in enumerate(entries)
        ]
    )
    grid = one.groupBy(*by).agg(F.map_from_entries(known).alias("_known")).select(*by, "_known", F.inline(rows))
    place_of = {}  # entries of one test and direction share a value
    for i, (t, o, _) in enumerate(entries):
        place_of[(t, o)] = i
    at = F.get(F.array(*[F.lit(place_of[(t, o)]) for t, o, _ in entries]), F.col("ord"))
    return grid.select(*by, "ord", test, op, "description", F.try_element_at("_known", at).alias(value)).orderBy(*by, "ord")


def pair_clients(
    df: DataFrame, key: str | Sequence[str], client: str, value: str, a: object, b: object
) -> DataFrame:
    """Both clients of a test side by side; the sum needs both, zero counts."""
    return (
        df.groupBy(*as_list(key))
        .agg(
            F.max(F.when(F.col(client) == a, F.col(value))).alias("value_a"),
            F.max(F.when(F.col(client) == b, F.col(value))).alias("value_b"),
        )
        .withColumn("total", F.col("value_a") + F.col("value_b"))
    )


def symmetry(pairs: DataFrame, tol: float = 0.05, a: str = "value_a", b: str = "value_b") -> DataFrame:
    """Relative difference of two clients; meant for writes, since reads of
    clients that drift apart differ by nature."""
    diff = F.try_divide(F.abs(F.col(a) - F.col(b)), F.greatest(a, b))
    return pairs.withColumn("rel_diff", diff).withColumn("symmetric", F.col("rel_diff") <= tol)


def cross_compare(
    df: DataFrame,
    config: str,
    op: str,
    value: str,
    summed: Mapping[object, int],
    ops: Mapping[str, object] = {"write": "WRITE", "read": "READ"},
) -> DataFrame:
    """One row per configuration, one column per operation.

    ``summed`` names configurations whose clients are added up and how many
    clients they need; there a zero rate counts as missing. The input has one
    row per (configuration, operation, client).
    """
    need = F.lit(1)
    for name, n in summed.items():
        need = F.when(F.col(config) == name, F.lit(n)).otherwise(need)

    def cell(code: object) -> Column:
        mine = F.when(F.col(op) == code, F.col(value))
        present = F.nullif(mine, F.lit(0).cast("double"))
        return F.struct(F.max(mine).alias("single"), F.count(present).alias("n"), F.sum(present).alias("total"))

    cells = df.groupBy(config).agg(*[cell(code).alias(f"_{name}") for name, code in ops.items()])
    return cells.select(
        config,
        *[
            F.when(need == 1, F.col(f"_{name}.single"))
            .when(F.col(f"_{name}.n") == need, F.col(f"_{name}.total"))
            .alias(name)
            for name in ops
        ],
    )


def join_spec(
    df: DataFrame,
    spec: DataFrame,
    on: str | Sequence[str],
    spread_by: str | Sequence[str] | None = None,
    hot_rows: int = 10_000_000,
) -> DataFrame:
    """Measure next to its denominator; ``spec`` has one row per key.

    A small ``spec`` is broadcast by Spark on its size. With ``spread_by``, hot
    keys of a larger one come by broadcast and the join stays even.
    """
    on = as_list(on)
    if spread_by is None:
        return join_on(df, spec, on)
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return attach(df, join_on(counts, spec, on), on, spread_by, "_rows", hot_rows)


def within(actual: Column, lo: Column, hi: Column, tol_pct: Column | None = None) -> Column:
    """Inside [lo, hi], each side widened by ``tol_pct``; an open side is null."""
    tol = F.coalesce(tol_pct, F.lit(0.0)) / 100 if tol_pct is not None else F.lit(0.0)
    above = lo.isNull() | (actual >= lo * (1 - tol))
    below = hi.isNull() | (actual <= hi * (1 + tol))
    return above & below


def verdict(actual: Column, lo: Column, hi: Column, tol_pct: Column) -> Column:
    return (
        F.when(actual.isNull(), "missing").when(within(actual, lo, hi, tol_pct), "ok").otherwise("drift")
    )


def check_expected(
    df: DataFrame,
    expected: DataFrame,
    on: str | Sequence[str],
    actual: str,
    lo: str = "lo",
    hi: str = "hi",
    tol_pct: str = "tol_pct",
) -> DataFrame:
    """Each expectation with the measured value and its verdict.

    Both sides have one row per key.
    """
    joined = join_on(expected, df, on)
    return joined.withColumn("verdict", verdict(F.col(actual), F.col(lo), F.col(hi), F.col(tol_pct)))


def triage(df: DataFrame, by: str | Sequence[str], shape_ok: Column | None = None) -> DataFrame:
    """Overall state: investigate a broken shape, drift on some metric, some metric missing, or ok."""
    broken = F.lit(False) if shape_ok is None else ~F.bool_and(shape_ok)
    drifted = F.count_if(F.col("verdict") == "drift")
    return df.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n"),
        drifted.alias("n_drift"),
        F.when(broken, "investigate").when(drifted > 0, "drift").when(F.count_if(F.col("verdict") == "missing") > 0, "missing").otherwise("ok").alias("state"),
    )


def pass_fail(df: DataFrame, actual: str, lo: str, hi: str, out: str = "passed") -> DataFrame:
    """Bars are inclusive; a null bar is open; a missing value fails."""
    return df.withColumn(out, F.coalesce(within(F.col(actual), F.col(lo), F.col(hi)), F.lit(False)))


def ab_ratio(
    df: DataFrame, key: str | Sequence[str], config: str, value: str, a: object, b: object, out: str = "ratio"
) -> DataFrame:
    """Two configurations of a test and a / b."""
    return (
        df.groupBy(*as_list(key))
        .agg(
            F.max(F.when(F.col(config) == a, F.col(value))).alias("value_a"),
            F.max(F.when(F.col(config) == b, F.col(value))).alias("value_b"),
        )
        .withColumn(out, F.try_divide("value_a", "value_b"))
    )


def lift(
    df: DataFrame, key: str | Sequence[str], config: str, value: str, tuned: object = "tuned", base: object = "default"
) -> DataFrame:
    """Tuned / default per workload."""
    return (
        ab_ratio(df, key, config, value, tuned, base, "lift")
        .withColumnRenamed("value_a", "tuned")
        .withColumnRenamed("value_b", "base")
    )


def ratio_ladder(df: DataFrame, order: str, value: str, by: str | Sequence[str]) -> DataFrame:
    """Gap of each level to the next, and of the first level to the last.

    A ladder is a list of summary levels, one row each.
    """
    w = Window.partitionBy(*as_list(by)).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(value)
    return df.withColumn("gap_to_next", F.try_divide(v, F.lead(v).over(w))).withColumn(
        "total_gap", F.try_divide(F.first(v).over(whole), F.last(v).over(whole))
    )


def pct_of_level(
    df: DataFrame, order: str, value: str, by: str | Sequence[str], base: str = "previous"
) -> DataFrame:
    """Percent of the level before, or of the first level."""
    w = Window.partitionBy(*as_list(by)).orderBy(order)
    v = F.col(value)
    if base == "previous":
        ref = F.lag(v).over(w)
    elif base == "first":
        ref = F.first(v).over(w)
    else:
        raise ValueError(f"base must be previous or first, not {base}")
    return df.withColumn("pct_of_level", F.try_divide(v, ref) * 100)


def _distinct_texts(df: DataFrame, key: Sequence[str], text: Column) -> DataFrame:
    """Rows per (key, text). Hash-aggregated, so repeated texts collapse in
    every task before the few that remain are compared."""
    return df.groupBy(*key, text.alias("_text")).agg(F.count(F.lit(1)).alias("_n"))


def constant_across(df: DataFrame, key: str | Sequence[str], col: str) -> DataFrame:
    """Whether all rows of a key carry the same non-missing text."""
    key = as_list(key)
    return (
        _distinct_texts(df, key, F.col(col).cast("string"))
        .groupBy(*key)
        .agg(
            F.sum("_n").alias("n"),
            F.max(F.col("_text").isNull()).alias("_gap"),
            F.min("_text").alias("low"),
            F.max("_text").alias("high"),
        )
        .withColumn("is_constant", ~F.col("_gap") & F.col("low").eqNullSafe(F.col("high")))
        .drop("_gap")
    )


def replica_agreement(
    df: DataFrame, key: str | Sequence[str], host: str, target: str, hosts: int = 2, missing: str = "MISSING"
) -> DataFrame:
    """Whether ``hosts`` different hosts resolve a key, all to the same target; a host may report more than once.

    ``n_targets`` counts the hosts that resolve it.
    """
    key = as_list(key)
    found = df.filter(F.col(host).isNotNull())
    return (
        _distinct_texts(found, [*key, host], F.nullif(F.col(target).cast("string"), F.lit(missing)))
        .groupBy(*key)
        .agg(
            F.count_distinct(F.when(F.col("_text").isNotNull(), F.col(host))).alias("n_targets"),
            F.min("_text").alias("low"),
            F.max("_text").alias("high"),
        )
        .withColumn("agree", (F.col("n_targets") == hosts) & F.coalesce(F.col("low") == F.col("high"), F.lit(False)))
    )


def source_agreement(df: DataFrame, a: str, b: str, tol: float = 0.05) -> DataFrame:
    """Relative difference of two columns with the same rate, and whether it is small."""
    return df.withColumn("rel_diff", F.try_divide(F.abs(F.col(a) - F.col(b)), F.col(b))).withColumn(
        "agree", F.col("rel_diff") <= tol
    )


def cross_source(
    df_a: DataFrame, df_b: DataFrame, key: str | Sequence[str], a: str, b: str, tol: float = 0.05
) -> DataFrame:
    """Two sources of the same rate; both have one row per key."""
    return source_agreement(join_on(df_a, df_b, key, "inner"), a, b, tol)


def mixed_rate(df: DataFrame, r: str, w: str) -> DataFrame:
    """Both rates rounded, and the sum of the rounded figures."""
    out = df.withColumn("read_mb", round_half_up(r)).withColumn("write_mb", round_half_up(w))
    out = out.withColumn("total_mb", F.col("read_mb") + F.col("write_mb"))
    return out.withColumn(
        "mixed_text", F.format_string("%d R + %d W = %d MB/s", "read_mb", "write_mb", "total_mb")
    )


def rate_texts(df: DataFrame, *cols: str) -> DataFrame:
    """Rate columns as text, ``-`` where missing."""
    return df.select(*[fmt_rate(c).alias(c) if c in cols else F.col(c) for c in df.columns])
