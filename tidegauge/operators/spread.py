"""Group-wise steps that never gather one key's rows in one task.

A log, host or test name can hold a large share of all rows. The helpers here
keep every task bounded: they aggregate before they shuffle, rank with a
per-task cut, or split a key's ordered rows into bounded ranges and pass only
one summary row per range on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.units import bin_of


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def same_keys(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool = False
) -> Column:
    """Equality of column pairs; null-safe equality is still an equi-join."""
    return reduce(
        lambda a, b: a & b,
        [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs],
    )


def join_on(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Equi-join that keeps the key columns of ``left``.

    Without ``null_safe`` a side that is already partitioned by the keys is not
    shuffled again.
    """
    on = as_list(on)
    renamed = right.select(
        *[F.col(c).alias(f"_on_{c}") for c in on],
        *[F.col(c) for c in right.columns if c not in on],
    )
    joined = left.join(renamed, same_keys(left, renamed, [(c, f"_on_{c}") for c in on], null_safe), how)
    return joined.drop(*[f"_on_{c}" for c in on])


def match_first(
    df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], out: str, once: bool = False
) -> DataFrame:
    """Mark the rows of each group that equal its first row, the one with the smallest ``order``.

    A null order comes last. Equal orders are told apart by a hash of the row's
    other columns, so all marked rows of a group are the same. The group
    minimum is a pre-aggregated pass over few columns. It is joined on group,
    order and hash, which spreads a hot group evenly where the minima are too
    many to be broadcast. With ``once`` rows are dealt out by a shuffle that both
    the minimum and the join read: for rows that cost more to make, as by
    parsing text, than to shuffle.
    """
    by, order = as_list(by), as_list(order)
    hashed = [f.name for f in df.schema if "map" not in f.dataType.simpleString()]
    keyed = df.withColumn("_tie", F.xxhash64(*hashed))
    parts = [c for o in order for c in (F.col(o).isNull().alias(f"_null_{o}"), F.col(o))]
    first = F.min(F.struct(*parts, "_tie")).alias("_first")
    if once:
        keyed = keyed.repartition(*by, "_tie")
        smallest = _same_columns(keyed, by, [first])
    else:
        smallest = keyed.groupBy(*by).agg(first)
    at = [*order, "_tie"]
    firsts = smallest.select(*by, *[F.col(f"_first.{c}").alias(c) for c in at], F.lit(True).alias("_hit"))
    joined = join_on(keyed, firsts, by + at, null_safe=True)
    return joined.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit")


def flag_first(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], out: str = "is_first") -> DataFrame:
    """Mark exactly one row of each group, the one with the smallest ``order``; of equal rows any one."""
    matched = match_first(df, by, order, "_same")
    same = Window.partitionBy(*as_list(by), *as_list(order), "_tie").orderBy(F.lit(1))
    return matched.withColumn(out, F.col("_same") & (F.row_number().over(same) == 1)).drop("_same", "_tie")


def rank_cut(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
    slice_by: Sequence[str] = (),
) -> DataFrame:
    """First ``n`` rows per group.

    Up to the window group limit Spark cuts every group to ``n`` rows in each
    task before the shuffle. Above it, rows are first cut inside slices of the
    group by a hash of ``slice_by``, ever fewer of them, so that no step gets
    more than eight times ``n`` rows of what the step before has kept.
    """
    by = as_list(by)
    name = rank or "_rank"
    spark = df.sparkSession
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        for slices in (512, 64, 8):
            sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*by, *slice_by), F.lit(slices)))
            w = Window.partitionBy(*by, "_slice").orderBy(*order)
            df = sliced.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r", "_slice")
    w = Window.partitionBy(*by).orderBy(*order)
    cut = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return cut if rank else cut.drop(name)


def _same_columns(dealt: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """One row per key, from the shuffle that also carries the rows.

    The hash makes both readers of the shuffle ask for the same columns; else
    Spark would prune them differently, and scan and shuffle the source twice.
    """
    hashed = [f.name for f in dealt.schema if "map" not in f.dataType.simpleString()]
    all_columns = F.max(F.xxhash64(*hashed)).alias("_all")
    return dealt.groupBy(*keys).agg(*columns, all_columns).where(F.col("_all").isNotNull()).drop("_all")


def running_drops(
    df: DataFrame, by: str | Sequence[str], order: str, value: str, out: str, span: int = 4096
) -> DataFrame:
    """How often ``value`` has dropped from one row to the next, up to each row.

    ``order`` is a whole number, unique per group, so a range of ``span`` order
    values holds at most ``span`` rows. Drops are counted inside ranges; one
    summary row per range carries the count on. ``by`` is never null.
    """
    by = as_list(by)
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    along = Window.partitionBy(*by).orderBy("_range")
    drop = F.coalesce((F.col(value) < F.lag(value).over(inside)).cast("bigint"), F.lit(0).cast("bigint"))
    dealt = df.withColumn("_range", bin_of(order, span)).repartition(*by, "_range")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_drop", drop).withColumn("_local", F.sum("_drop").over(upto)).drop("_drop")
    border = F.coalesce((F.col("_head") < F.lag("_tail").over(along)).cast("bigint"), F.lit(0).cast("bigint"))
    ends = [F.min_by(value, order).alias("_head"), F.max_by(value, order).alias("_tail"), F.max("_local").alias("_drops")]
    before = (
        _same_columns(local, [*by, "_range"], ends)
        .withColumn("_border", border)
        .withColumn(
            "_before",
            F.sum("_border").over(along.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(F.sum("_drops").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(*by, "_range", "_before")
    )
    counted = join_on(local, before, by + ["_range"], null_safe=True)
    return counted.withColumn(out, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def carry_forward(
    df: DataFrame, by: str | Sequence[str], order: str, carried: Sequence[str], span: int = 4096
) -> DataFrame:
    """Columns ``carried`` with the last value that is not null up to each row of its group.

    ``order`` is a whole number, unique per group, so a range of ``span`` order
    values holds at most ``span`` rows. Values are carried inside ranges. One
    row per range sums up what it ends with; these are carried along the group,
    so the rows of a group are never gathered. Both steps read one shuffle by
    group and range. ``by`` is never null.
    """
    by, carried = as_list(by), as_list(carried)
    dealt = df.withColumn("_range", bin_of(order, span)).repartition(*by, "_range")
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in carried]
    ends = _same_columns(dealt, [*by, "_range"], last)
    before = ends.select(*by, "_range", *[F.last(f"_end_{c}", ignorenulls=True).over(along).alias(f"_before_{c}") for c in carried])
    local = dealt.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in carried})
    joined = join_on(local, before, by + ["_range"], null_safe=True)
    whole = {c: F.coalesce(c, f"_before_{c}") for c in carried}
    return joined.withColumns(whole).drop("_range", *[f"_before_{c}" for c in carried])


def attach(
    df: DataFrame,
    per_key: DataFrame,
    on: str | Sequence[str],
    spread_by: str | Sequence[str],
    rows_col: str,
    hot_rows: int = 10_000_000,
) -> DataFrame:
    """Left join of a one-row-per-key table to a fact table with hot keys.

    ``rows_col`` of ``per_key`` is the number of fact rows of the key. Keys
    above ``hot_rows`` come by broadcast: there are at most (fact rows /
    hot_rows) of them. Their fact rows then have nothing to look for in the
    join of the other keys, and are spread over it by a hash of ``spread_by``.
    """
    on = as_list(on)
    payload = [c for c in per_key.columns if c not in on and c != rows_col]
    hot = per_key.filter(F.col(rows_col) > hot_rows).select(
        *on, F.struct(*payload).alias("_hot"), F.col(rows_col).alias("_hot_rows")
    )
    spread = F.pmod(F.xxhash64(*as_list(spread_by)), F.lit(1 << 20)) + 1
    tagged = join_on(df, F.broadcast(hot), on, null_safe=True).withColumn(
        "_spread", F.when(F.col("_hot_rows").isNotNull(), spread).otherwise(F.lit(0).cast("bigint"))
    )
    # always 0, but not a literal, so that it stays one of the join keys
    other = per_key.filter(F.col(rows_col) <= hot_rows).select(
        *on, F.struct(*payload).alias("_other"), F.least(F.col(rows_col), F.lit(0)).cast("bigint").alias("_spread")
    )
    joined = join_on(tagged, other, on + ["_spread"], null_safe=True)
    found = F.coalesce("_hot", "_other")
    return joined.select(*df.columns, *[found[c].alias(c) for c in payload])


def time_nodes(lo: Column, hi: Column) -> Column:
    """Nodes (level, node) of a binary tree over whole numbers that make up lo to hi, both included.

    A node stands for 2^level neighbours. Level by level, the node at either
    end is taken if it has no sibling in the interval: at most two per level,
    so their number grows with the logarithm of the length.
    """
    first, end = lo.cast("bigint"), hi.cast("bigint") + 1

    def at(level: Column) -> Column:
        a = -F.call_function("shiftright", -first, level)
        b = F.call_function("shiftright", end, level)
        return F.array(
            F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.struct(level.alias("level"), a.alias("node"))),
            F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), F.struct(level.alias("level"), (b - 1).alias("node"))),
        )

    levels = F.sequence(F.lit(0), F.log2((end - first).cast("double")).cast("int") + 1)
    return F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: str | Sequence[str],
    at_us: Column,
    lo_us: Column,
    hi_us: Column,
    bucket_seconds: int,
) -> DataFrame:
    """Points inside closed intervals of the same group.

    Spark has no range join. Time is cut into buckets, the leaves of a binary
    tree. An interval lies on the few nodes that make it up, whatever its
    length; a point looks up the node above it on each level that any interval
    uses. The nodes of an interval don't overlap, so no pair appears twice. The
    levels are a subquery of at most 64 numbers, found when the join runs. A
    node with very many points is an ordinary skewed key of an equi-join, which
    Spark splits. Columns of ``intervals`` must differ from those of ``points``
    except ``by``; rows without a group or a time match none.
    """
    by = as_list(by)
    width = bucket_seconds * 1_000_000
    nodes = (
        intervals.withColumn("_lo", lo_us)
        .withColumn("_hi", hi_us)
        .filter(F.col("_lo") <= F.col("_hi"))
        .select("*", F.inline(time_nodes(bin_of("_lo", width), bin_of("_hi", width))))
        .withColumnsRenamed({"level": "_level", "node": "_node"})
    )
    levels = nodes.agg(F.collect_set("_level")).scalar()
    left = points.withColumn("_at", at_us).withColumn("_level", F.explode(levels))
    left = left.withColumn("_node", F.call_function("shiftright", bin_of("_at", width), F.col("_level")))
    keys = by + ["_level", "_node"]
    right = nodes.select(*[F.col(c).alias(f"_on_{c}") for c in keys], *[c for c in nodes.columns if c not in keys])
    cond = same_keys(left, right, [(c, f"_on_{c}") for c in keys]) & F.col("_at").between(F.col("_lo"), F.col("_hi"))
    return left.join(right, cond).drop("_at", "_level", "_node", "_lo", "_hi", *[f"_on_{c}" for c in keys])
