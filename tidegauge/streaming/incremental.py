"""Complete summaries of a stream by partial results that are merged batch by batch.

Each micro-batch is reduced to a few rows (a window of a device, a slot of a
log) and merged with the rows that were still open before it. Rows that no later
sample can change are settled; the others stay open for the next batch. A result
is what has been settled and what is still open, so it is complete at any time,
and after a finite stream it equals the batch operator's. Samples behind the
watermark are kept in a ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.units import bin_of, epoch_us, of_units, part_sum
from tidegauge.operators.samples import burst_rows, burst_slots, chain_slots, is_active, merge_bursts
from tidegauge.operators.spread import as_list
from tidegauge.session import shared_dir

SETTLED = "settled"


@dataclass(frozen=True)
class Fold:
    """How samples become rows that can be merged, and rows a result.

    ``partial`` makes rows of samples. ``settle`` merges rows, given the time in
    microseconds before which no sample can come any more, and says in a column
    SETTLED which of them are done. ``result`` makes the result of settled and
    open rows. ``corrected``, if a fold has it, also takes in rows of late samples.
    """

    partial: Callable[[DataFrame], DataFrame]
    settle: Callable[[DataFrame, Column], DataFrame]
    result: Callable[[DataFrame, DataFrame], DataFrame]
    corrected: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None


def _read(spark: SparkSession, schema: str | T.StructType, path: str) -> DataFrame | None:
    """A table, or none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Incremental:
    """A fold over a stream, kept below one folder of the shared storage.

    ``parts/batch=k`` has the rows of batch k, ``late/batch=k`` the samples that
    came behind the watermark or without a time, ``mark/batch=k`` the greatest
    time seen so far. The mark is written last and makes the batch count: a
    batch that failed midway leaves no trace in any result, and when it runs
    again it starts from the same rows and replaces its own folders.

    The watermark lies ``delay`` behind the greatest time of all earlier
    batches. Settled rows of all batches and the open ones of the last make the
    result, so nothing has to be closed by samples that come later.
    """

    def __init__(self, fold: Fold, schema: T.StructType, root: str, ts: str = "ts", delay: str = "1 minute"):
        self.fold, self.schema, self.root, self.ts, self.delay = fold, schema, root.rstrip("/"), ts, delay

    def drain(self, sdf: DataFrame) -> Incremental:
        """Take in what is available now; a further call goes on where this one stopped."""
        query = (
            sdf.writeStream.foreachBatch(self._take)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self

    def _marks(self, spark: SparkSession, before: int | None = None) -> tuple[int, int | None]:
        """The last batch that counts, and the greatest time up to it."""
        marks = _read(spark, "mark long, batch long", f"{self.root}/mark")
        if marks is None:
            return -1, None
        rows = marks if before is None else marks.where(F.col("batch") < before)
        last = rows.agg(F.max(F.struct("batch", "mark")).alias("last")).first()["last"]
        return (-1, None) if last is None else (last["batch"], last["mark"])

    def _rows(self, spark: SparkSession, batches: Column) -> DataFrame:
        empty = self.fold.partial(spark.createDataFrame([], self.schema))
        last, _ = self._marks(spark)
        if last < 0:
            return empty.withColumn(SETTLED, F.lit(False))
        kinds = T.StructType([T.StructField(f.name, f.dataType) for f in empty.schema])
        kinds = kinds.add(SETTLED, T.BooleanType()).add("batch", T.LongType())
        return spark.read.schema(kinds).parquet(f"{self.root}/parts").where(batches).drop("batch")

    def _limit(self, mark: int) -> Column:
        return epoch_us(F.timestamp_micros(F.lit(mark)) - F.expr(f"INTERVAL {self.delay}"))

    def _take(self, arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        last, mark = self._marks(spark, batch)
        arrived = arrived.persist()
        try:
            at = epoch_us(self.ts)
            late = at.isNull() if mark is None else at.isNull() | (at < self._limit(mark))
            newest, n_late = arrived.agg(F.max(at), F.count_if(late)).first()
            if n_late:
                arrived.where(late).write.mode("overwrite").parquet(f"{self.root}/late/batch={batch}")
            mark = newest if mark is None else mark if newest is None else max(mark, newest)
            rows = self.fold.partial(arrived.where(~late))
            if last >= 0:
                before = self._rows(spark, (F.col("batch") == last) & ~F.col(SETTLED)).drop(SETTLED)
                rows = rows.unionByName(before)
            settled = self.fold.settle(rows, self._limit(mark) if mark is not None else F.lit(0))
            settled.write.mode("overwrite").partitionBy(SETTLED).parquet(f"{self.root}/parts/batch={batch}")
            done = spark.createDataFrame([(mark,)], "mark long")
            done.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/mark/batch={batch}")
        finally:
            arrived.unpersist()

    def result(self, spark: SparkSession, corrected: bool = False) -> DataFrame:
        """Settled and open rows as one result; ``corrected`` also takes in the late samples."""
        last, _ = self._marks(spark)
        settled = self._rows(spark, (F.col("batch") <= last) & F.col(SETTLED)).where(SETTLED).drop(SETTLED)
        opened = self._rows(spark, (F.col("batch") == last) & ~F.col(SETTLED)).where(~F.col(SETTLED)).drop(SETTLED)
        if not corrected:
            return self.fold.result(settled, opened)
        if self.fold.corrected is None:
            raise ValueError("late samples can't be merged into this result")
        late = self.ledger(spark).drop("batch").where(F.col(self.ts).isNotNull())
        return self.fold.corrected(settled, opened, self.fold.partial(late))

    def ledger(self, spark: SparkSession) -> DataFrame:
        """All samples that came late or without a time, with the batch they came in."""
        last, _ = self._marks(spark)
        kinds = T.StructType([*self.schema, T.StructField("batch", T.LongType())])
        if last < 0:
            return spark.createDataFrame([], kinds)
        late = _read(spark, kinds, f"{self.root}/late")
        return spark.createDataFrame([], kinds) if late is None else late.where(F.col("batch") <= last)


def incremental(
    sdf: DataFrame, fold: Fold, purpose: str, ts: str = "ts", delay: str = "1 minute", out: str | None = None
) -> Incremental:
    """Take in what is available of a stream now; with ``out`` further calls go on there."""
    root = out or shared_dir(sdf.sparkSession, purpose)
    return Incremental(fold, sdf.schema, root, ts, delay).drain(sdf)


def _windowed(by: list[str], ts: str, window: str, slide: str | None, sums: list[Column]):
    def partial(df: DataFrame) -> DataFrame:
        w = F.window(F.col(ts).cast("timestamp"), window, slide)
        edges = [F.col(f"_window.{a}").cast("timestamp_ntz").alias(f"window_{a}") for a in ("start", "end")]
        return df.groupBy(w.alias("_window"), *by).agg(*sums).select(*edges, "*").drop("_window")

    return partial


def _windows(partial, by: list[str], merges: list[Column], finish: Callable[[DataFrame], DataFrame]) -> Fold:
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start", "window_end", *by).agg(*merges)

    return Fold(
        partial=partial,
        settle=lambda rows, limit: merged(rows).withColumn(SETTLED, epoch_us("window_end") <= limit),
        result=lambda settled, opened: finish(settled.unionByName(opened)),
        corrected=lambda settled, opened, late: finish(merged(settled.unionByName(opened).unionByName(late))),
    )


def fold_io_summary(
    by: str | Sequence[str],
    ts: str = "ts",
    window: str = "1 minute",
    r: str = "r_mbs",
    w: str = "w_mbs",
    period: float = 2,
    threshold: float = 50,
    decimals: int | None = None,
) -> Fold:
    """Peak, volume and active average per tumbling window."""
    by = as_list(by)
    active = is_active(r, w, threshold)
    peaks = {"peak_r": F.col(r), "peak_w": F.col(w), "peak_rw": F.col(r) + F.col(w)}
    sums = {"_sum_r": F.col(r), "_sum_w": F.col(w), "_act_r": F.when(active, F.col(r)), "_act_w": F.when(active, F.col(w))}
    partial = _windowed(
        by,
        ts,
        window,
        None,
        [
            *[F.max(c).alias(k) for k, c in peaks.items()],
            *[part_sum(c, decimals).alias(k) for k, c in sums.items()],
            F.count_if(active).alias("active_n"),
        ],
    )
    merges = [*[F.max(k).alias(k) for k in peaks], *[F.sum(k).alias(k) for k in (*sums, "active_n")]]

    def total(col: str) -> Column:
        return F.coalesce(of_units(col, decimals), F.lit(0.0))

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select(
            "window_start",
            "window_end",
            *by,
            *peaks,
            (total("_sum_r") * F.lit(float(period)) / 1024).alias("total_r_gb"),
            (total("_sum_w") * F.lit(float(period)) / 1024).alias("total_w_gb"),
            F.coalesce(F.try_divide(total("_act_r"), "active_n"), F.lit(0.0)).alias("active_avg_r"),
            F.coalesce(F.try_divide(total("_act_w"), "active_n"), F.lit(0.0)).alias("active_avg_w"),
            "active_n",
        )

    return _windows(partial, by, merges, finish)


def fold_rate(
    by: str | Sequence[str],
    ts: str = "ts",
    window: str = "1 minute",
    slide: str = "10 seconds",
    r: str = "r_mbs",
    w: str = "w_mbs",
    decimals: int | None = None,
) -> Fold:
    """Mean rates over sliding windows."""
    by = as_list(by)
    sums = [F.count(F.lit(1)).alias("n"), part_sum(r, decimals).alias("_r"), part_sum(w, decimals).alias("_w")]
    partial = _windowed(by, ts, window, slide, sums)

    def finish(rows: DataFrame) -> DataFrame:
        means = [(of_units(f"_{c}", decimals) / F.col("n")).alias(f"mean_{c}") for c in ("r", "w")]
        return rows.select("window_start", "window_end", *by, "n", *means)

    return _windows(partial, by, [F.sum(c).alias(c) for c in ("n", "_r", "_w")], finish)


def fold_bursts(
    by: str | Sequence[str],
    ts: str = "ts",
    gap_seconds: int = 3,
    r: str = "r_mbs",
    w: str = "w_mbs",
    decimals: int | None = None,
    span: int = 4096,
) -> Fold:
    """Bursts of active samples; filter the stream to active samples first.

    Samples are added up in gap-wide slots per batch, whatever the size of a
    log. Slots before the watermark are chained into runs; a run more than a gap
    before it is settled. What may still grow stays open: the slots from the
    watermark on, and a run that reaches up to it as one row.
    """
    by = as_list(by)
    gap = gap_seconds * 1_000_000

    def settle(rows: DataFrame, limit: Column) -> DataFrame:
        slots = rows.groupBy(*by, "_slot").agg(*merge_bursts())
        border = bin_of(limit, gap)
        runs = chain_slots(slots.where(F.col("_slot") < border), by, gap_seconds, span)
        before = runs.withColumn("_slot", bin_of("_e", gap)).withColumn(SETTLED, border * gap - F.col("_e") > gap)
        return before.unionByName(slots.where(F.col("_slot") >= border).withColumn(SETTLED, F.lit(False)))

    return Fold(
        partial=lambda df: burst_slots(df, by, ts, r, w, gap_seconds, decimals),
        settle=settle,
        result=lambda settled, opened: burst_rows(
            settled.drop("_slot").unionByName(chain_slots(opened, by, gap_seconds, span)), by, "timestamp_ntz", decimals
        ),
    )
