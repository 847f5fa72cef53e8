"""Small fixed tables: datasheet figures, test catalogue, expected values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Datasheet figures used as denominators.
SPEC = {
    "seqwrite_mbs": 13400.0,
    "seqread_mbs": 14800.0,
    "randread_iops": 2200000.0,
    "randwrite_iops": 2600000.0,
}

# Rows of the sweep report: job, title, kind, operation, spec key.
SWEEP = (
    ("01-seqwrite-1t", "seqwrite 1t 1MB", "bw", "WRITE", "seqwrite_mbs"),
    ("02-seqwrite-16t", "seqwrite 16t 1MB", "bw", "WRITE", "seqwrite_mbs"),
    ("03-seqread-1t", "seqread 1t 1MB", "bw", "READ", "seqread_mbs"),
    ("04-seqread-16t", "seqread 16t 1MB", "bw", "READ", "seqread_mbs"),
    ("05-randread-4k-qd64", "randread 4k QD64", "iops", "READ", "randread_iops"),
    ("06-randwrite-4k-qd64", "randwrite 4k QD64", "iops", "WRITE", "randwrite_iops"),
    ("07-randread-4k-qd1", "randread 4k QD1 (latency floor)", "iops", "READ", None),
    ("08-rw7030", "mixed 70/30 1MB 8t", "mixed", None, None),
)

# Tests of a battery in report order: name, operation, title.
BATTERY = (
    ("seq-write-1m", "WRITE", "1 MiB seq write"),
    ("seq-read-1m", "READ", "1 MiB seq read"),
    ("seq-write-64k", "WRITE", "64 KiB seq write"),
    ("rand-rw-4k", "READ", "4 KiB random read"),
    ("rand-rw-4k", "WRITE", "4 KiB random write"),
)

# Published expectations: scenario, metric, regime, low, high,
# tolerance in percent. Single figures have low = high.
EXPECTED = (
    ("sweep", "seqwrite-1t MB/s", "sustained", 1662.0, 1662.0, 10.0),
    ("sweep", "seqwrite-16t MB/s", "sustained", 1974.0, 1974.0, 10.0),
    ("sweep", "seqread-1t MB/s", "sustained", 5105.0, 5105.0, 10.0),
    ("sweep", "seqread-16t MB/s", "sustained", 10512.0, 10512.0, 10.0),
    ("sweep", "randread-qd64 IOPS", "sustained", 1624088.0, 1624088.0, 10.0),
    ("sweep", "randwrite-qd64 IOPS", "sustained", 481338.0, 481338.0, 10.0),
    ("sweep", "randread-qd1 IOPS", "sustained", 4852.0, 4852.0, 10.0),
    ("sweep", "mixed MB/s", "sustained", 3714.0, 3714.0, 10.0),
    ("full fine-tune c25", "consolidation secs", "step 24", 12.99, 12.99, 15.0),
    ("full fine-tune c25", "consolidation secs", "step 49", 73.98, 73.98, 15.0),
    ("full fine-tune c25", "consolidation secs", "step 74", 60.11, 60.11, 15.0),
    ("full fine-tune c25", "consolidation secs", "step 99", 46.66, 46.66, 15.0),
    ("full fine-tune c25", "consolidation ratio", "step 49 / step 24", 5.8, 6.3, 0.0),
    ("full fine-tune c25", "checkpoint bytes GB", "each", 62.0, 62.0, 15.0),
    ("full fine-tune c25", "wall clock mins", "total", 13.0, 13.0, 15.0),
    ("full fine-tune c25", "overhead percent", "total", 58.0, 58.0, 15.0),
    ("full fine-tune c25", "slowdown", "tail", 1.49, 1.49, 15.0),
    ("full fine-tune c25", "memory plateau GiB", "steady", 61.49, 61.49, 15.0),
    ("full fine-tune c100", "consolidation secs", "step 99", 13.0, 13.0, 15.0),
    ("full fine-tune c100", "wall clock mins", "total", 6.0, 6.0, 15.0),
    ("full fine-tune c100", "overhead percent", "total", 22.0, 22.0, 15.0),
    ("single-node", "consolidation secs", "hot", 11.0, 11.0, 15.0),
    ("single-node", "consolidation secs", "cold", 50.0, 80.0, 15.0),
    ("single-node", "memory plateau GiB", "steady", 61.5, 61.5, 15.0),
    ("single-node", "checkpoint block secs", "total", 120.0, 120.0, 15.0),
    ("two-node copy", "consolidation secs", "hot", 4.5, 4.5, 15.0),
    ("two-node copy", "consolidation secs", "cold", 4.8, 4.8, 15.0),
    ("two-node copy", "memory plateau GiB", "steady", 35.5, 35.5, 15.0),
    ("two-node copy", "checkpoint block secs", "total", 14.0, 14.0, 15.0),
    ("two-node copy", "sync secs", "clean", 342.0, 342.0, 15.0),
    ("two-node shared", "consolidation secs", "hot", 21.0, 21.0, 15.0),
    ("two-node shared", "consolidation secs", "cold", 24.0, 24.0, 15.0),
    ("two-node shared", "memory plateau GiB", "steady", 35.5, 35.5, 15.0),
    ("two-node shared", "checkpoint block secs", "total", 70.0, 70.0, 15.0),
    ("pillar 1", "seq-write-1m GB/s", "burst", 2.0, None, 0.0),
    ("pillar 1", "seq-write-1m GB/s", "sustained", 0.5, 0.8, 0.0),
    ("pillar 1", "seq-read-1m GB/s", "warm", 9.0, None, 0.0),
    ("pillar 1", "seq-write-64k GB/s", "tuned", 1.7, None, 0.0),
    ("pillar 1", "seq-write-64k GB/s", "verified", 1.8, None, 0.0),
    ("pillar 1", "rand-read-4k IOPS", "tuned", 150000.0, None, 0.0),
    ("pillar 1", "rand-write-4k IOPS", "tuned", 150000.0, None, 0.0),
    ("pillar 2", "seq-write-1m GB/s", "cross-node", 0.4, 0.6, 0.0),
    ("pillar 2", "seq-read-1m GB/s", "cross-node", 2.0, 2.5, 0.0),
    ("pillar 2", "seq-write-64k GB/s", "cross-node", 0.05, 0.08, 0.0),
    ("pillar 2", "rand-rw-4k MB/s", "cross-node", None, 5.0, 0.0),
    ("pillar 3", "seq-write-1m GB/s", "total", 1.2, None, 0.0),
    ("pillar 3", "seq-read-1m GB/s", "total", 8.5, None, 0.0),
    ("pillar 3", "seq-write-64k MiB/s", "total", 140.0, None, 0.0),
    ("pillar 3", "rand-rw-4k MB/s", "total", 4.0, None, 0.0),
)


def fixed(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table of fixed values as literal rows: Spark knows its size and can broadcast it."""

    def literal(v) -> str:
        if v is None:
            return "null"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

    columns = [c.split() for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in columns)
    return spark.sql(f"select {casts} from values {values} as t({', '.join(n for n, _ in columns)})")


def spec_df(spark: SparkSession, values: Mapping[str, float] | None = None) -> DataFrame:
    """Denominators by name; ``values`` replaces single figures."""
    rows = list({**SPEC, **(values or {})}.items())
    return fixed(spark, rows, "spec_metric string, spec double")


def sweep_df(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(SWEEP)]
    return fixed(spark, rows, "ord int, job string, title string, kind string, op string, spec_metric string")


def catalogue_df(spark: SparkSession, entries=BATTERY) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(entries)]
    return fixed(spark, rows, "ord int, test string, op string, description string")


def expected_df(spark: SparkSession, entries=EXPECTED) -> DataFrame:
    return fixed(
        spark, entries, "scenario string, metric string, regime string, lo double, hi double, tol_pct double"
    )
