"""Line-oriented logs: training output, memory and process samples, brackets,
checkpoint files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.text import (
    base_name,
    event_fields,
    file_path,
    host_of,
    label_from_path,
    line_ts,
    phase_of,
)
from tidegauge.functions.units import scale
from tidegauge.operators.spread import running_drops
from tidegauge.session import shared_dir


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with path and an increasing ``line_no`` per file.

    Files stay splittable. Spark reads the splits of a file in offset order, so
    the row id of the scan grows along the file (it is an order, not a count).
    """
    return spark.read.text(path).select(
        file_path().alias("path"),
        F.monotonically_increasing_id().alias("line_no"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def _labels(name: Column) -> list[Column]:
    return [name.alias("label"), phase_of(name).alias("phase"), host_of(name).alias("host")]


def parse_training_lines(
    lines: DataFrame,
    path: str = "path",
    line_no: str = "line_no",
    line: str = "line",
    prefix: str = "training-",
    keep: Sequence[str] = (),
) -> DataFrame:
    return lines.select(
        *_labels(label_from_path(path, prefix)),
        *keep,
        line_no,
        F.col(line).alias("raw"),
        line_ts(line).alias("ts"),
        *[c.alias(k) for k, c in event_fields(line).items()],
    )


def read_training_log(spark: SparkSession, path: str, prefix: str = "training-") -> DataFrame:
    """Training-log lines with label, time and the numbers they carry."""
    return parse_training_lines(read_lines(spark, path), prefix=prefix, keep=["path"])


# Keys of a memory sample line.
MEM_KEYS = ("rss", "hwm", "used", "avail", "cache", "shared", "swap")


def parse_mem_lines(
    lines: DataFrame,
    path: str = "path",
    line_no: str = "line_no",
    line: str = "line",
    day: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Memory samples in MiB; ``keep`` may have the path, as files may share a label.

    Sample clocks have no date: the date comes from the file name and a day is
    added each time the clock steps back.
    """
    part = [F.substring(line, at, 2).try_cast("int") for at in (1, 4, 7)]  # HH:MM:SS
    if day is None:
        day = F.try_to_timestamp(F.regexp_extract(base_name(path), r"(\d{8})-\d{6}", 1), F.lit("yyyyMMdd"))
    rows = lines.filter(F.col(line).contains("hwm=")).select(
        F.col(path).alias("_path"),
        F.col(line_no).alias("seq"),
        (part[0] * 3600 + part[1] * 60 + part[2]).alias("_clock"),
        F.col(line).alias("_line"),
        *[c for c in keep if c != path],
        F.unix_seconds(day.cast("timestamp")).alias("_day"),
    )
    dated = running_drops(rows, "_path", "seq", "_clock", "_days")
    return dated.select(
        label_from_path("_path", "anon-rss-").alias("label"),
        *[F.col("_path").alias(c) if c == path else F.col(c) for c in keep],
        "seq",
        F.timestamp_seconds(F.col("_day") + F.col("_days") * 86400 + F.col("_clock")).alias("ts"),
        *[
            F.regexp_extract("_line", rf"\b{k}=(\d+)MiB", 1).try_cast("bigint").alias(f"{k}_mib") for k in MEM_KEYS
        ],
    )


def read_mem_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_mem_lines(read_lines(spark, path), keep=["path"])


def parse_proc_lines(
    lines: DataFrame, path: str = "path", line_no: str = "line_no", line: str = "line", keep: Sequence[str] = ()
) -> DataFrame:
    """Process-status samples; lines taken while no process ran have null sizes."""

    def mib(key: str) -> Column:
        return scale(F.regexp_extract(line, rf"\b{key}:\s*(\d+) kB", 1).try_cast("bigint"), "kb_to_mib")

    epoch = F.regexp_extract(line, r"\bts=(\d+)", 1).try_cast("bigint")
    return (
        lines.withColumn("_epoch", epoch)
        .filter(F.col("_epoch").isNotNull())
        .select(
            *_labels(label_from_path(path, "rss-")),
            *keep,
            F.col(line_no).alias("seq"),
            F.timestamp_seconds("_epoch").alias("ts"),
            mib("VmRSS").alias("rss_mib"),
            mib("VmHWM").alias("hwm_mib"),
            mib("VmSwap").alias("swap_mib"),
        )
    )


def read_proc_status(spark: SparkSession, path: str) -> DataFrame:
    return parse_proc_lines(read_lines(spark, path), keep=["path"])


def parse_bracket_lines(
    lines: DataFrame, path: str = "path", line_no: str = "line_no", line: str = "line", keep: Sequence[str] = ()
) -> DataFrame:
    """Launch and end stamps; the last line of an appended file counts."""
    stamp = F.trim(F.col(line)).try_cast("double")
    last = (
        lines.withColumn("_stamp", stamp)
        .filter(F.col("_stamp").isNotNull())
        .groupBy(path)
        .agg(F.max_by("_stamp", line_no).alias("ts_epoch"))
    )
    name = label_from_path(path, suffix=".ts")
    lead = r"^(?:(sync)-)?(launch|end)-(.+)$"
    trail = r"^(.+)-(launch|end)$"
    kind = F.coalesce(
        F.nullif(F.regexp_extract(name, lead, 2), F.lit("")), F.nullif(F.regexp_extract(name, trail, 2), F.lit(""))
    )
    label = F.coalesce(
        F.nullif(F.regexp_extract(name, lead, 3), F.lit("")), F.nullif(F.regexp_extract(name, trail, 1), F.lit(""))
    )
    scope = F.when(F.regexp_extract(name, lead, 1) == "sync", "sync").otherwise("run")
    return last.select(*keep, label.alias("label"), scope.alias("scope"), kind.alias("kind"), "ts_epoch")


def read_brackets(spark: SparkSession, path: str) -> DataFrame:
    return parse_bracket_lines(read_lines(spark, path), keep=["path"])


def read_file_entries(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and change time of files below a folder, as the driver lists them; no file is opened.

    For trees of very many files see ``scan_file_entries``.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


ENTRY = "path string, length long, modified timestamp, is_folder boolean"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder."""
    for b in batches:
        for folder in b.column(0).to_pylist():
            store, inner = fs.FileSystem.from_uri(quote(folder, safe="/:@"))
            scheme = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
            entries = [e for e in store.get_file_info(fs.FileSelector(inner)) if not e.base_name.startswith(("_", "."))]
            columns = [
                pa.array([scheme + e.path for e in entries], pa.string()),
                pa.array([e.size for e in entries], pa.int64()),
                pa.array([e.mtime for e in entries], pa.timestamp("us", "UTC")),
                pa.array([e.type == fs.FileType.Directory for e in entries], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENTRY.split(", ")])


def scan_file_entries(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and change time of files below a folder, listed by tasks.

    The tree is walked level by level: each folder of a level is listed in some
    task, and what was found is stored before the next level, so the driver
    holds no list and a lost executor costs one level at most. A folder is
    listed whole by one task. Names that begin with ``_`` or ``.`` are left out.
    The store has to be one that Arrow opens by its URI on the executors.
    """
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    root = re.sub(r"^file:/*", "file:///", root).rstrip("/")
    folders = spark.createDataFrame([(root,)], "path string")
    found = None
    while True:
        out = shared_dir(spark, "listing")
        tasks = spark.sparkContext.defaultParallelism
        folders.repartition(tasks, "path").mapInArrow(_list_folders, ENTRY).write.parquet(out)
        level = spark.read.schema(ENTRY).parquet(out)
        files = level.where(~F.col("is_folder")).drop("is_folder")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_folder").select("path")
        if folders.isEmpty():
            return found
