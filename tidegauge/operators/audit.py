"""Audit of benchmark sweeps for figures that caches inflate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.units import size_bytes
from tidegauge.operators.spread import join_on


def audit_sweep(
    params: DataFrame,
    results: DataFrame,
    link_mb_s: float,
    job: str = "job",
    rate: str = "mb_per_s",
) -> DataFrame:
    """One flag per known mistake, for each job.

    ``no_offset``  several threads without ``offset_increment``
    ``wraps``      a thread's region is smaller than runtime x its rate
    ``overlap``    ``size`` is larger than ``offset_increment``
    ``above_link`` rate above what the link can carry
    """
    p = F.col("params")

    def param(name: str):
        return F.try_element_at(p, F.lit(name))

    jobs = join_on(params, results, job)
    jobs = (
        jobs.withColumn("_threads", F.coalesce(param("numjobs").try_cast("bigint"), F.lit(1).cast("bigint")))
        .withColumn("_offset", size_bytes(param("offset_increment")))
        .withColumn("_size", size_bytes(param("size")))
        .withColumn("_runtime", param("runtime").try_cast("double"))
        .withColumn("_region", F.coalesce("_offset", "_size"))
        .withColumn("_per_thread", F.col(rate) / F.col("_threads"))
    )
    return jobs.select(
        job,
        rate,
        ((F.col("_threads") > 1) & F.col("_offset").isNull()).alias("no_offset"),
        F.coalesce(
            F.col("_region") < F.col("_runtime") * F.col("_per_thread") * F.lit(1e6), F.lit(False)
        ).alias("wraps"),
        F.coalesce((F.col("_threads") > 1) & (F.col("_size") > F.col("_offset")), F.lit(False)).alias("overlap"),
        F.coalesce(F.col(rate) > link_mb_s, F.lit(False)).alias("above_link"),
    )
