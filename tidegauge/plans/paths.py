"""Registered queries that run a whole report, from raw text or rows to table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.text import EVENT_LIMITS, EVENT_PATTERNS, MEM_PATTERN, MISSING_MESSAGES
from tidegauge.plans import reports
from tidegauge.plans.logs import capture_blocks
from tidegauge.plans.registry import load, registered
from tidegauge.plans.samples import IO, NUMBERED, SUMMARY, io_samples
from tidegauge.sources.dims import BATTERY, SWEEP
from tidegauge.sources.iostat import parse_iostat_blocks
from tidegauge.sources.logs import parse_training_lines


@registered("device_report", f"WITH {NUMBERED} SELECT 'log-' || label AS label, {SUMMARY} FROM x GROUP BY label")
def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.device_report(parse_iostat_blocks(capture_blocks(spark, sf_dir))).drop("path")


# ---- sweep -----------------------------------------------------------------------

SWEEP_ROWS = ", ".join(
    f"({i}, '{job}', '{title}', '{kind}', "
    + ", ".join("NULL" if v is None else f"'{v}'" for v in (op, spec))
    + ")"
    for i, (job, title, kind, op, spec) in enumerate(SWEEP)
)


@registered(
    "sweep_report",
    f"""WITH s AS (SELECT * FROM (VALUES {SWEEP_ROWS}) AS s(ord, job, title, kind, op, metric)),
spec AS (SELECT * FROM (VALUES ('seqwrite_mbs', 60000.0::DOUBLE), ('seqread_mbs', 0.0), ('randread_iops', 2200000.0),
  ('randwrite_iops', 2600000.0)) AS p(metric, spec)),
m AS (
  SELECT l_partkey % 8 AS ord, l_linestatus AS side, max(CAST(round(l_orderkey * 1000000.0 / 1e6) AS BIGINT)) AS bw,
         max(CAST(round(l_extendedprice) AS BIGINT)) AS iops, max(CAST(round((l_suppkey * 1000 + 500) / 1000) AS BIGINT)) AS p99
  FROM lineitem GROUP BY 1, 2),
j AS (
  SELECT s.*, spec.spec, r.bw AS rbw, w.bw AS wbw, CASE op WHEN 'READ' THEN r.iops ELSE w.iops END AS io,
         CASE op WHEN 'READ' THEN r.p99 ELSE w.p99 END AS lat
  FROM s LEFT JOIN m r ON r.ord = s.ord AND r.side = 'O' LEFT JOIN m w ON w.ord = s.ord AND w.side = 'F'
  LEFT JOIN spec ON spec.metric = s.metric),
v AS (
  SELECT *, CASE kind WHEN 'iops' THEN io WHEN 'mixed' THEN rbw + wbw ELSE CASE op WHEN 'READ' THEN rbw ELSE wbw END END
    AS value FROM j)
SELECT ord, job, title, kind, value, CASE WHEN kind = 'iops' THEN lat END AS p99_us,
  CASE WHEN kind = 'mixed' THEN rbw END AS read_mb, CASE WHEN kind = 'mixed' THEN wbw END AS write_mb,
  CAST(trunc(value / nullif(spec, 0) * 100) AS BIGINT) AS pct_of_spec FROM v""",
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = F.array(*[F.lit(row[0]) for row in SWEEP])
    results = load(spark, sf_dir, "lineitem").select(
        F.get(jobs, (F.col("l_partkey") % 8).cast("int")).alias("job"),
        F.when(F.col("l_linestatus") == "O", "READ").otherwise("WRITE").alias("op"),
        (F.col("l_orderkey") * 1000000).alias("bw_bytes"),
        F.col("l_extendedprice").alias("iops"),
        F.create_map(F.lit("99.000000"), F.col("l_suppkey") * 1000 + 500).alias("clat_ns"),
    )
    return reports.sweep_report(results, {"seqwrite_mbs": 60000.0, "seqread_mbs": 0.0})


# ---- checkpoint events ---------------------------------------------------------------


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training log per user, one line per event."""
    kind = F.col("device")
    line = (
        F.when(kind == "error", F.format_string("Rank 0: Done consolidating. %d indices in %.2f secs.", "seq", "r_mbs"))
        .when(kind == "view", F.format_string("root | step %d | mem %d GiB", F.col("seq") % 300, F.col("w_mbs").cast("int")))
        .when((kind == "signup") & (F.col("label") % 2 == 0), F.lit("=== START now ==="))
        .otherwise(F.format_string("root | idle %d", "seq"))
    )
    path = F.concat(F.lit("/logs/training-run-"), F.col("label").cast("string"), F.lit(".log"))
    lines = io_samples(spark, sf_dir).select(path.alias("path"), F.col("seq").alias("line_no"), line.alias("line"))
    return parse_training_lines(lines)


RUN_LINES = IO + """,
raw AS (
  SELECT 'run-' || label AS label, seq AS line_no,
    CASE WHEN device = 'error' THEN printf('Rank 0: Done consolidating. %d indices in %.2f secs.', seq, r)
         WHEN device = 'view' THEN printf('root | step %d | mem %d GiB', seq % 300, CAST(w AS INTEGER))
         WHEN device = 'signup' AND label % 2 = 0 THEN '=== START now ==='
         ELSE 'root | idle ' || seq END AS raw
  FROM io
)"""


KIND_ROWS = " UNION ALL ".join(
    f"SELECT *, '{k}' AS kind, {n} AS n FROM raw WHERE regexp_matches(raw, '{EVENT_PATTERNS[k]}')" for k, n in EVENT_LIMITS.items()
)
MESSAGE_ROWS = ", ".join(f"('{k}', '{text}')" for k, text in MISSING_MESSAGES.items())


@registered(
    "checkpoint_report",
    rf"""WITH {RUN_LINES},
t AS ({KIND_ROWS}),
r AS (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY line_no) AS rn FROM t),
m AS (SELECT * FROM (VALUES {MESSAGE_ROWS}) AS m(kind, message)),
l AS (SELECT DISTINCT label FROM raw)
SELECT label, line_no, raw, kind FROM r WHERE rn <= n
UNION ALL SELECT l.label, NULL, m.message, m.kind FROM l CROSS JOIN m
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.label = l.label AND t.kind = m.kind)""",
)
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.checkpoint_report(run_lines(spark, sf_dir))


@registered(
    "plateau_report",
    rf"""WITH {RUN_LINES},
e AS (SELECT label, line_no, regexp_extract(raw, '{MEM_PATTERN}') AS mem FROM raw
  WHERE regexp_matches(raw, '{MEM_PATTERN}')),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY line_no DESC) AS rn FROM e),
d AS (SELECT DISTINCT label, mem FROM r WHERE rn <= 5)
SELECT label, string_agg(mem, ',' ORDER BY mem) AS plateau FROM d GROUP BY label""",
)
def plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.plateau_report(run_lines(spark, sf_dir))
    return found.withColumn("plateau", F.array_join("plateau", ","))


# ---- batteries -----------------------------------------------------------------------

TESTS = tuple(dict.fromkeys(test for test, _, _ in BATTERY))

TEST_LIST = ", ".join(f"'{t}'" for t in TESTS)

RATES = IO + f""",
rates AS (
  SELECT CAST(label % 3 + 1 AS VARCHAR) AS pillar,
    CASE WHEN label % 3 = 2 THEN CASE WHEN label % 2 = 0 THEN 'host1' ELSE 'host2' END END AS client,
    CASE WHEN label % 3 = 0 AND seq % 4 = 2 THEN 'other' ELSE [{TEST_LIST}][seq % 4 + 1] END AS test,
    CASE WHEN seq % 4 = 1 OR (seq % 4 = 3 AND seq % 8 > 3) THEN 'READ' ELSE 'WRITE' END AS op,
    max(floor(r) * 10) AS mb_per_s
  FROM io GROUP BY ALL
)"""


def battery_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three batteries; what the first has for one test is of a test no battery knows."""
    fourth = F.col("seq") % 4
    third = F.col("label") % 3
    read = (fourth == 1) | ((fourth == 3) & (F.col("seq") % 8 > 3))
    return (
        io_samples(spark, sf_dir)
        .groupBy(
            (third + 1).cast("string").alias("pillar"),
            F.when(third == 2, F.when(F.col("label") % 2 == 0, "host1").otherwise("host2")).alias("client"),
            F.when((third == 0) & (fourth == 2), "other")
            .otherwise(F.get(F.array(*[F.lit(t) for t in TESTS]), fourth.cast("int")))
            .alias("test"),
            F.when(read, "READ").otherwise("WRITE").alias("op"),
        )
        .agg(F.max(F.floor("r_mbs") * 10).cast("double").alias("mb_per_s"))
    )


BATTERY_ROWS = ", ".join(f"({i}, '{t}', '{o}', '{d}')" for i, (t, o, d) in enumerate(BATTERY))


@registered(
    "battery_tables",
    f"""WITH {RATES}, b AS (SELECT DISTINCT pillar, client FROM rates),
t AS (SELECT * FROM (VALUES {BATTERY_ROWS}) AS t(ord, test, op, description)),
j AS (SELECT b.pillar, b.client, t.*, rates.mb_per_s FROM b CROSS JOIN t LEFT JOIN rates ON rates.pillar = b.pillar
  AND rates.client IS NOT DISTINCT FROM b.client AND rates.test = t.test AND rates.op = t.op)
SELECT *, CASE WHEN mb_per_s IS NULL THEN '-' WHEN mb_per_s >= 1000 THEN printf('%.2f GB/s', mb_per_s / 1000)
  ELSE printf('%.0f MB/s', mb_per_s) END AS rate FROM j""",
)
def batteries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.battery_tables(battery_rates(spark, sf_dir))


@registered(
    "concurrent_table",
    f"""WITH {RATES}, p AS (SELECT test, op, max(mb_per_s) FILTER (WHERE client = 'host1') AS value_a,
  max(mb_per_s) FILTER (WHERE client = 'host2') AS value_b FROM rates WHERE pillar = '3' GROUP BY ALL)
SELECT *, value_a + value_b AS total FROM p""",
)
def concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.concurrent_table(battery_rates(spark, sf_dir))


@registered(
    "cross_table",
    f"""WITH {RATES}, k AS (SELECT pillar, op, max(mb_per_s) AS single, count(nullif(mb_per_s, 0)) AS n,
  sum(nullif(mb_per_s, 0)) AS total FROM rates
  WHERE (test = '{BATTERY[0][0]}' AND op = '{BATTERY[0][1]}') OR (test = '{BATTERY[1][0]}' AND op = '{BATTERY[1][1]}') GROUP BY pillar, op),
c AS (SELECT pillar, op, CASE WHEN pillar = '3' THEN CASE WHEN n = 2 THEN total END ELSE single END AS v FROM k)
SELECT pillar, max(v) FILTER (WHERE op = 'WRITE') AS write, max(v) FILTER (WHERE op = 'READ') AS read
FROM c GROUP BY pillar""",
)
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cross_table(battery_rates(spark, sf_dir))
