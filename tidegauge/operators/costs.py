"""Footprint and time cost of checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.units import exact_sum
from tidegauge.operators.spread import as_list


def dir_of(path: str, depth: int):
    """First ``depth`` parts of a path or URL, without scheme."""
    parts = F.split(F.regexp_replace(F.col(path), r"^[A-Za-z0-9+.-]+:/*|^/+", ""), "/")
    return F.array_join(F.slice(parts, 1, depth), "/")


def footprint(entries: DataFrame, depth: int, path: str = "path", length: str = "length") -> DataFrame:
    """Bytes and files per directory (apparent size)."""
    return entries.groupBy(dir_of(path, depth).alias("dir")).agg(
        F.sum(F.col(length).cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def effective_bw(
    df: DataFrame, by: str | Sequence[str], size: str, secs: str, decimals: int | None = None
) -> DataFrame:
    """Bytes moved in a phase / seconds the phase took."""
    return (
        df.groupBy(*as_list(by))
        .agg(exact_sum(size, decimals).alias("size"), F.max(F.col(secs).cast("double")).alias("secs"))
        .withColumn("rate", F.try_divide("size", "secs"))
    )


def overhead_share(
    df: DataFrame, by: str | Sequence[str], ckpt: str, wall: str, decimals: int | None = None
) -> DataFrame:
    """Part of a run's wall clock spent in checkpoints."""
    return (
        df.groupBy(*as_list(by))
        .agg(exact_sum(ckpt, decimals).alias("ckpt_secs"), F.max(F.col(wall).cast("double")).alias("wall_secs"))
        .withColumn("share", F.try_divide("ckpt_secs", "wall_secs"))
    )


def total_cost(
    events: DataFrame,
    sync: DataFrame,
    by: str | Sequence[str],
    secs: str,
    sync_secs: str,
    decimals: int | None = None,
) -> DataFrame:
    """Checkpoint blocks plus the sync after the run; a run may lack either, which counts as 0."""
    by = as_list(by)
    blocks = events.groupBy(*by).agg(exact_sum(secs, decimals).alias("block_secs"))
    syncs = sync.groupBy(*by).agg(exact_sum(sync_secs, decimals).alias("sync_secs"))
    return (
        blocks.withColumn("sync_secs", F.lit(0.0))
        .unionByName(syncs.withColumn("block_secs", F.lit(0.0)))
        .groupBy(*by)
        .agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("block_secs", "sync_secs")])
        .withColumn("total_secs", F.col("block_secs") + F.col("sync_secs"))
    )


def break_even(df: DataFrame, sync: str, shared: str, local: str) -> DataFrame:
    """Checkpoints at which the extra cost of each equals one sync."""
    return df.withColumn("break_even", F.try_divide(F.col(sync), F.col(shared) - F.col(local)))
