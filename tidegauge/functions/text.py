"""Log-line patterns, labels from file names, fields of event lines."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that select training-log and report lines.
EVENT_PATTERNS = {
    "consolidation": r"Done consolidating|saved.*checkpoint|Checkpoint.*saved",
    "step": r"step (98|99|100|198|199|200|248|249|250|255|260)\b",
    "bracket": r"=== (START|END)",
    "restore": r"Param L2 norm|Loading checkpoint|step 100 |step 101 ",
    "cold_restore": r"Loading checkpoint|using checkpoint value|step 250",
    "restore_memory": r"step 250.*mem [0-9.]+ GiB",
    "bandwidth": r"READ:|WRITE:",
    "fetch": r"Fetching 5 files: 100%",
}

# Lines kept per log for each kind in the per-log report.
EVENT_LIMITS = {"consolidation": 10, "step": 30, "bracket": 4}

# Fixed value: memory figure inside a step line.
MEM_PATTERN = r"mem [0-9.]+ GiB"

# Message rows for logs without a matching line.
MISSING_MESSAGES = {
    "consolidation": "(no consolidation lines matched)",
    "step": "(no step-boundary lines matched)",
    "bracket": "(no START/END markers)",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def kinds_of(line: Column | str, patterns: Mapping[str, str]) -> Column:
    """Array of every kind whose pattern is found in the line."""
    tags = [F.when(_c(line).rlike(p), F.lit(k)) for k, p in patterns.items()]
    return F.array_compact(F.array(*tags))


def mem_extracts(line: Column | str, pattern: str = MEM_PATTERN) -> Column:
    """Array of all matches in the line, in order."""
    return F.regexp_extract_all(_c(line), F.lit(f"({pattern})"), F.lit(1))


def file_path() -> Column:
    """Path of the file a row was read from, without the escapes of a URI."""
    return F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def label_from_path(path: Column | str, prefix: str = "", suffix: str = ".log", strip: bool = True) -> Column:
    """File name without ``suffix`` and, with ``strip``, without ``prefix``."""
    head = f"(?:{re.escape(prefix)})?" if strip and prefix else ""
    tail = f"(?:{re.escape(suffix)})?" if suffix else ""
    return F.regexp_extract(_c(path), f"^(?:.*/)?{head}([^/]*?){tail}$", 1)


def phase_of(label: Column | str) -> Column:
    """Part before the last dash; the whole label if it has no dash."""
    return F.regexp_replace(_c(label), r"-[^-]*$", "")


def host_of(label: Column | str) -> Column:
    """Part after the last dash; null if the label has no dash."""
    return F.nullif(F.regexp_extract(_c(label), r"^.*-([^-]+)$", 1), F.lit(""))


def number_after(line: Column | str, pattern: str, cast: str) -> Column:
    """Group 1 of ``pattern`` as a number; null without match or number."""
    return F.regexp_extract(_c(line), pattern, 1).try_cast(cast)


def event_fields(line: Column | str) -> dict[str, Column]:
    """Numbers carried by training-log lines."""
    return {
        "step": number_after(line, r"\bstep (\d+)\b", "int"),
        "tps": number_after(line, r"\btps ([0-9.]+)", "double"),
        "mem_gib": number_after(line, r"\bmem ([0-9.]+) GiB", "double"),
        "secs": number_after(line, r"\bin ([0-9.]+) secs", "double"),
        "l2_norm": F.nullif(F.regexp_extract(_c(line), r"Param L2 norm: ([0-9.]+)", 1), F.lit("")),
    }


def line_ts(line: Column | str) -> Column:
    """Time of a log line: leading ``yyyy-MM-dd HH:mm:ss``, or the ISO-8601
    stamp of a START / END marker."""
    c = _c(line)
    head = F.regexp_extract(c, r"^\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    mark = F.regexp_extract(c, r"=== (?:START|END) (\S+)", 1)
    return F.coalesce(head.try_cast("timestamp"), mark.try_cast("timestamp"))
