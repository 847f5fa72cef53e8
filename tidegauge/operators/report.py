"""Report lines and durable tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


# Line formats of the per-log summary and of active samples.
SUMMARY_FORMAT = (
    "%-32s peakR=%7.1f peakW=%7.1f  totR=%6.2f GB totW=%6.2f GB  actAvgR=%7.1f actAvgW=%7.1f actN=%d"
)
SAMPLE_FORMAT = "%s | r=%8.2f MB/s  w=%8.2f MB/s"
SAMPLE_UTIL_FORMAT = "%s | r=%7.1f MB/s  w=%7.1f MB/s  %%util=%5.1f"


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _with_head(rows: DataFrame, head: Sequence[str]) -> DataFrame:
    """Head lines before the rows; ``_part`` keeps them apart in the order."""
    spark = rows.sparkSession
    first = spark.createDataFrame([(0, i, line) for i, line in enumerate(head)], "_part int, _pos int, line string")
    return first.unionByName(rows.withColumn("_part", F.lit(1)), allowMissingColumns=True)


def to_markdown(df: DataFrame, cols: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Lines of a markdown table, sorted; ``cols`` maps column to heading."""
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[_text(c) for c in cols]), F.lit(" |"))
    head = ["| " + " | ".join(cols.values()) + " |", "| " + " | ".join("---" for _ in cols) + " |"]
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, body.alias("line"))
    return _with_head(rows, head).orderBy("_part", "_pos", *[f"_k{i}" for i in range(len(order))]).select("line")


def _padded(col: Column, width: int) -> Column:
    """Left-aligned for positive width, right-aligned for negative; never cut."""
    size = abs(width)
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(size) - F.length(col), F.lit(0)))
    return F.concat(col, pad) if width > 0 else F.concat(pad, col)


def to_fixed_width(df: DataFrame, widths: Mapping[str, int], headings: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Lines of a padded table, sorted; a negative width aligns right."""
    body = F.concat_ws(" ", *[_padded(_text(c), w) for c, w in widths.items()])
    head_line = " ".join(
        headings[c].ljust(w) if w > 0 else headings[c].rjust(-w) for c, w in widths.items()
    )
    rule = "-" * (sum(abs(w) for w in widths.values()) + len(widths) - 1)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, body.alias("line"))
    return _with_head(rows, [head_line, rule]).orderBy(
        "_part", "_pos", *[f"_k{i}" for i in range(len(order))]
    ).select("line")


def summary_lines(summary: DataFrame, label: str = "label") -> DataFrame:
    """One line per log of an ``io_summary``, by label."""
    line = F.format_string(
        SUMMARY_FORMAT,
        F.col(label).cast("string"),
        "peak_r",
        "peak_w",
        "total_r_gb",
        "total_w_gb",
        "active_avg_r",
        "active_avg_w",
        "active_n",
    )
    return summary.select(F.col(label), line.alias("line")).orderBy(label).select("line")


def sample_lines(
    active: DataFrame,
    stamp: str = "stamp",
    r: str = "r_mbs",
    w: str = "w_mbs",
    util: str | None = None,
    order: Sequence[str] = ("label", "seq"),
) -> DataFrame:
    """One line per active sample, with %util where its column is given."""
    if util:
        line = F.format_string(SAMPLE_UTIL_FORMAT, stamp, r, w, util)
    else:
        line = F.format_string(SAMPLE_FORMAT, stamp, r, w)
    return active.select(*order, line.alias("line")).orderBy(*order).select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Report text; sorted partitions are written in order."""
    lines.select("line").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("phase",), mode: str = "append") -> None:
    """Typed rows as parquet, partitioned for later pruning.

    Rows are grouped by partition value and spread by AQE, so that a large
    value is not written by one task.
    """
    df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_run(df: DataFrame, path: str, run: str, partition_by: Sequence[str] = ("phase",)) -> None:
    """Rows of one run into a table of runs, once however often the run is repeated.

    A run has a folder of its own, which a repeated run replaces as a whole. The
    run counts when its mark has been written, last of all, so a table never
    shows half a run.
    """
    name = quote(run, safe="")
    table = df.drop("run")
    table.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/rows/run={name}")
    done = df.sparkSession.createDataFrame([(1,)], "done int")
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/done/run={name}")


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All finished runs of a table, with the ``run`` each row is of."""
    fields = [f for f in schema if f.name != "run"]
    rows = spark.read.schema(StructType([*fields, StructField("run", StringType())])).parquet(f"{path}/rows")
    done = spark.read.schema("done int, run string").parquet(f"{path}/done").select("run").distinct()
    return rows.join(done, "run", "left_semi").select(*[f.name for f in fields], "run")
