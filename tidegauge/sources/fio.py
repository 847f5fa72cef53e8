"""Benchmark results: JSON, text summaries, bandwidth logs, job files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.text import base_name, file_path, label_from_path
from tidegauge.functions.units import to_mb_per_s

_SIDE = T.StructType(
    [
        T.StructField("bw_bytes", T.LongType()),
        T.StructField("iops", T.DoubleType()),
        T.StructField(
            "clat_ns",
            T.StructType([T.StructField("percentile", T.MapType(T.StringType(), T.LongType()))]),
        ),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("fio version", T.StringType()),
        T.StructField(
            "jobs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("jobname", T.StringType()),
                        T.StructField("read", _SIDE),
                        T.StructField("write", _SIDE),
                    ]
                )
            ),
        ),
    ]
)

# Fixed value: bandwidth line of a text summary; groups 4 and 5 are decimal.
BW_LINE = r"^\s*(READ|WRITE):\s*bw=([\d.]+)([KkMG]i?B)/s\s*\(([\d.]+)([KkMG]B)/s\)"

BW_LOG_SCHEMA = "t_ms bigint, bw_kib bigint, direction int, block_size bigint, offset bigint"


def fio_rows(
    docs: DataFrame, job: str, jobs: str = "jobs", all_jobs: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document (or job in it) and direction.

    Only the first job counts, since grouped results have one; a document
    without jobs still gives its rows. Missing measures are 0. Columns ``keep``
    of the document stay.
    """
    if all_jobs:
        entries = docs.select(job, *keep, F.posexplode_outer(jobs).alias("job_no", "_job"))
    else:
        entries = docs.select(job, *keep, F.lit(0).alias("job_no"), F.get(jobs, F.lit(0)).alias("_job"))
    sides = F.array(
        *[F.struct(F.lit(op.upper()).alias("op"), F.col("_job")[op].alias("side")) for op in ("read", "write")]
    )
    rows = entries.select(job, *keep, "job_no", F.col("_job.jobname").alias("jobname"), F.inline(sides))
    return rows.select(
        F.col(job).alias("job"),
        *keep,
        "job_no",
        "jobname",
        "op",
        F.coalesce("side.bw_bytes", F.lit(0)).cast("bigint").alias("bw_bytes"),
        F.coalesce("side.iops", F.lit(0.0)).alias("iops"),
        F.col("side.clat_ns.percentile").alias("clat_ns"),
    )


def read_fio_json(spark: SparkSession, path: str, all_jobs: bool = False) -> DataFrame:
    """Result documents, one per file; an unreadable file fails the read."""
    docs = (
        spark.read.schema(RESULT_SCHEMA)
        .json(path, multiLine=True, mode="FAILFAST")
        .select("jobs", file_path().alias("path"))
        .withColumn("_name", label_from_path("path", suffix=".json"))
    )
    return fio_rows(docs, "_name", all_jobs=all_jobs, keep=["path"])


def parse_fio_lines(lines: DataFrame, path: str = "path", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Rate per file and operation from summary lines; the last line wins."""
    hit = lines.filter(F.col(line).rlike(BW_LINE)).select(
        path,
        line_no,
        F.regexp_extract(line, BW_LINE, 1).alias("op"),
        to_mb_per_s(
            F.regexp_extract(line, BW_LINE, 4).try_cast("double"), F.regexp_extract(line, BW_LINE, 5)
        ).alias("mb_per_s"),
    )
    return hit.groupBy(path, "op").agg(F.max_by("mb_per_s", line_no).alias("mb_per_s"))


# Fixed value: file name of a battery result: pillar, client if any, test.
BATTERY_NAME = r"^pillar([^-]+)-(?:(host[^-]*)-)?(.+)$"


def read_fio_text(spark: SparkSession, path: str) -> DataFrame:
    """Battery results of all files at once; a file without match has no row."""
    from tidegauge.sources.logs import read_lines

    rates = parse_fio_lines(read_lines(spark, path))
    name = label_from_path("path")
    return rates.select(
        "path",
        F.regexp_extract(name, BATTERY_NAME, 1).alias("pillar"),
        F.nullif(F.regexp_extract(name, BATTERY_NAME, 2), F.lit("")).alias("client"),
        F.regexp_extract(name, BATTERY_NAME, 3).alias("test"),
        "op",
        "mb_per_s",
    )


def read_bw_log(spark: SparkSession, path: str) -> DataFrame:
    """Per-interval bandwidth; job and thread come from ``<job>_bw.<n>.log``.

    The threads of a job lie in one folder: sum over (folder, job), as folders
    may hold files of equal names.
    """
    name = base_name("path")
    return (
        spark.read.schema(BW_LOG_SCHEMA)
        .csv(path, ignoreLeadingWhiteSpace=True)
        .withColumn("path", file_path())
        .select(
            "path",
            F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
            F.regexp_extract(name, r"^(.*)_bw\.\d+\.log$", 1).alias("job"),
            F.regexp_extract(name, r"_bw\.(\d+)\.log$", 1).try_cast("int").alias("thread"),
            "t_ms",
            "bw_kib",
            "direction",
        )
    )


def parse_job_files(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Parameters per job section; a job's own value replaces the global one.

    A job file is a short hand-written text, so it is read as one value.
    """
    clean = F.regexp_replace(F.col(text), r"(?m)^\s*[;#].*$|\r", "")
    sections = files.select(path, F.split(clean, r"(?m)^\s*\[").alias("_parts")).select(
        path,
        F.transform(
            F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))),
            lambda s: F.struct(
                F.trim(F.substring_index(s, "]", 1)).alias("name"),
                F.substring(s, F.locate("]", s) + 1, F.length(s)).alias("body"),
            ),
        ).alias("_sections"),
    )
    is_global = lambda s: F.lower(s["name"]) == "global"
    shared = F.array_join(F.transform(F.filter("_sections", is_global), lambda s: s["body"]), "\n")
    jobs = sections.select(
        path, shared.alias("_shared"), F.inline(F.filter("_sections", lambda s: ~is_global(s)))
    ).select(path, F.col("name").alias("job"), F.concat_ws("\n", "_shared", "body").alias("_body"))
    pairs = jobs.select(path, "job", F.posexplode(F.split("_body", "\n")).alias("_pos", "_line")).filter(
        F.trim("_line") != ""
    )
    key = F.trim(F.substring_index("_line", "=", 1))
    value = F.when(F.locate("=", F.col("_line")) > 0, F.trim(F.expr("substring(_line, locate('=', _line) + 1)")))
    return (
        pairs.groupBy(path, "job", key.alias("_key"))
        .agg(F.max_by(F.coalesce(value, F.lit("1")), "_pos").alias("_value"))
        .groupBy(path, "job")
        .agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("params"))
    )


def read_job_params(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", file_path().alias("path"))
    return parse_job_files(files).select(label_from_path("path", suffix=".fio").alias("file"), "job", "params")
