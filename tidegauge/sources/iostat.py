"""Device activity captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.text import file_path, host_of, label_from_path, phase_of
from tidegauge.operators.samples import on_device
from tidegauge.operators.spread import carry_forward
from tidegauge.sources.logs import read_lines

# Stamp line, and positions of read and write rate in a row.
STAMP_LINE = r"(?m)^([0-9][0-9]/.*)$"
HEADER_LINE = r"(?m)^(Device.*)$"
READ_FIELD = 3
WRITE_FIELD = 9

#: Lines of a capture that decide how it is read.
FIRST_LINES = 500

STAMP_FORMATS = ("MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yy hh:mm:ss a", "MM/dd/yy HH:mm:ss")


def parse_iostat_blocks(
    blocks: DataFrame,
    path: str = "path",
    block: str = "value",
    device: str | None = "nvme0n1",
    match: str = "exact",
    stamp_formats: Sequence[str] = STAMP_FORMATS,
    prefix: str = "iostat-",
    by_header: bool = True,
    record: Sequence[str] = (),
) -> DataFrame:
    """Typed samples from text that holds reports (stamp line, header, device rows), one or many per row.

    Text is cut at stamp lines, so every sample gets the stamp of its own
    report, whatever parts them. The rate columns are found by the names in the
    header, at the usual positions where the header lacks them. ``seq`` orders
    the samples of a log: by the ``record`` columns, which say where a text
    lies in its file, and the place in the text; the stamp only takes part
    where no ``record`` is given. ``path`` stays, as files may share a label.
    """
    text = F.replace(F.col(block), F.lit("\r"), F.lit(""))

    def words(line: Column) -> Column:
        return F.split(F.trim(line), r"\s+")

    def position(name: str, usual: int) -> Column:
        if not by_header:
            return F.lit(usual)
        at = F.array_position("_names", name).cast("int")
        return F.when(at > 0, at).otherwise(F.lit(usual))

    def wanted(line: Column) -> Column:
        line = F.ltrim(line)
        if device is not None:
            return line.startswith(device)
        return (line != "") & ~line.rlike(r"^[0-9][0-9]/") & ~line.startswith("Device") & ~line.startswith("Linux ")

    # what holds for a whole report is found before its rows are taken apart
    reports = blocks.select(
        F.col(path).alias("path"),
        *record,
        F.regexp_extract(text, HEADER_LINE, 1).alias("_header"),
        F.posexplode(F.split(text, r"(?m)(?=^[0-9][0-9]/)")).alias("_part", "_text"),
    ).select(
        "path",
        *record,
        "_part",
        F.trim(F.regexp_extract("_text", STAMP_LINE, 1)).alias("_stamp"),
        words(F.coalesce(F.nullif(F.regexp_extract("_text", HEADER_LINE, 1), F.lit("")), "_header")).alias("_names"),
        F.filter(
            F.transform(F.split("_text", "\n"), lambda line, i: F.struct(i.alias("_pos"), line.alias("_line"))),
            lambda x: wanted(x["_line"]),
        ).alias("_lines"),
    )
    stamped = F.coalesce(*[F.try_to_timestamp(F.col("_stamp"), F.lit(f)) for f in stamp_formats])
    rows = reports.where(F.size("_lines") > 0).select(
        "path",
        *record,
        "_part",
        F.nullif(F.col("_stamp"), F.lit("")).alias("stamp"),
        stamped.alias("ts"),
        position("rMB/s", READ_FIELD).alias("_r_at"),
        position("wMB/s", WRITE_FIELD).alias("_w_at"),
        F.inline("_lines"),
    )

    def field(at: Column) -> Column:
        return F.try_element_at(F.col("_fields"), at).try_cast("double")

    fields = rows.withColumn("_fields", words(F.col("_line"))).withColumn("label", label_from_path("path", prefix))
    samples = fields.select(
        "path",
        "label",
        phase_of("label").alias("phase"),
        host_of("label").alias("host"),
        F.get("_fields", F.lit(0)).alias("device"),
        "stamp",
        "ts",
        field(F.col("_r_at")).alias("r_mbs"),
        field(F.col("_w_at")).alias("w_mbs"),
        field(F.lit(-1)).alias("util_pct"),
        F.struct(*(record or ["ts"]), "_part", "_pos").alias("seq"),
    )
    return on_device(samples, device, match)


def parse_iostat_lines(
    lines: DataFrame,
    path: str = "path",
    line_no: str = "line_no",
    line: str = "line",
    device: str | None = "nvme0n1",
    match: str = "exact",
    stamp_formats: Sequence[str] = STAMP_FORMATS,
    prefix: str = "iostat-",
    by_header: bool = True,
    span: int = 4096,
) -> DataFrame:
    """Typed samples from single lines of captures, with their number in the file.

    A row takes stamp and columns from the last stamp line and the last header
    at or before it in its file, wherever splits part them. Only stamps, headers
    and rows of the device leave the scan. ``seq`` is the number of the line.
    """
    text = F.trim(F.regexp_replace(F.col(line), "\r", ""))
    is_stamp, is_header = text.rlike("^[0-9][0-9]/"), text.startswith("Device")
    row = text.startswith(device) if device is not None else (text != "") & ~text.startswith("Linux ")

    def position(name: str, usual: int) -> Column:
        at = F.array_position(F.split("_text", r"\s+"), name).cast("int")
        return F.when(at > 0, at).otherwise(F.lit(usual)) if by_header else F.lit(usual)

    kept = (
        lines.select(F.col(path).alias("path"), F.col(line_no).alias("seq"), text.alias("_text"), is_stamp.alias("_is_stamp"), is_header.alias("_is_header"))
        .where(F.col("_is_stamp") | F.col("_is_header") | row)
        .withColumn("_stamp", F.when(F.col("_is_stamp"), F.col("_text")))
        .withColumn(
            "_at", F.when(F.col("_is_header"), F.struct(position("rMB/s", READ_FIELD).alias("r"), position("wMB/s", WRITE_FIELD).alias("w")))
        )
    )
    rows = carry_forward(kept, "path", "seq", ["_stamp", "_at"], span).where(~F.col("_is_stamp") & ~F.col("_is_header"))

    def field(at: Column) -> Column:
        return F.try_element_at(F.col("_fields"), at).try_cast("double")

    samples = (
        rows.withColumn("_fields", F.split("_text", r"\s+"))
        .withColumn("label", label_from_path("path", prefix))
        .select(
            "path",
            "label",
            phase_of("label").alias("phase"),
            host_of("label").alias("host"),
            F.get("_fields", F.lit(0)).alias("device"),
            F.col("_stamp").alias("stamp"),
            F.coalesce(*[F.try_to_timestamp(F.col("_stamp"), F.lit(f)) for f in stamp_formats]).alias("ts"),
            field(F.coalesce(F.col("_at.r"), F.lit(READ_FIELD))).alias("r_mbs"),
            field(F.coalesce(F.col("_at.w"), F.lit(WRITE_FIELD))).alias("w_mbs"),
            field(F.lit(-1)).alias("util_pct"),
            "seq",
        )
    )
    return on_device(samples, device, match)


def read_iostat(
    spark: SparkSession,
    path: str,
    device: str | None = "nvme0n1",
    match: str = "exact",
    layout: str | None = None,
    **parse,
) -> DataFrame:
    """Samples of one log or of all logs a glob names, in the order of the file whatever their stamps.

    With ``layout="reports"`` records end at an empty line and are taken apart
    where they are read, without a shuffle; a log without such lines, as one
    with CRLF ends, is one record. ``layout="lines"`` reads any log line by
    line, in as many tasks as it has splits, and carries stamps and headers on.
    Without ``layout`` the first lines decide: reports where one of them is
    empty. Either layout gives the samples of any log; they differ in tasks, in
    the type of ``seq``, and in reports without a header of their own, which
    only ``lines`` gives the last header before them.
    """
    if layout is None:
        start = spark.read.option("lineSep", "\n").text(path).limit(FIRST_LINES).collect()
        layout = "lines" if start and all(r["value"] != "" for r in start) else "reports"
    if layout == "lines":
        return parse_iostat_lines(read_lines(spark, path), device=device, match=match, **parse)
    if layout != "reports":
        raise ValueError(f"layout must be reports or lines, not {layout}")
    blocks = (
        spark.read.option("lineSep", "\n\n")
        .text(path)
        .select(
            "value",
            file_path().alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("record"),
        )
    )
    return parse_iostat_blocks(blocks, device=device, match=match, record=["block", "record"], **parse)
