"""Registered queries that compare tests, clients, configurations and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.units import (
    exact_sum,
    fmt_rate,
    pct_of,
    pct_text,
    round_half_up,
    scale,
    to_mb_per_s,
)
from tidegauge.operators import compare, costs
from tidegauge.operators.audit import audit_sweep
from tidegauge.operators.events import with_default
from tidegauge.operators.report import read_runs, summary_lines, to_fixed_width, to_markdown, write_run
from tidegauge.plans.registry import load, registered
from tidegauge.plans.samples import IO, NUMBERED, SUMMARY, io_samples, io_summary
from tidegauge.session import shared_dir
from tidegauge.sources.dims import EXPECTED, expected_df, fixed
from tidegauge.sources.logs import scan_file_entries


# ---- units and text -------------------------------------------------------


@registered(
    "unit_scaling",
    """SELECT o_orderkey, o_totalprice / 1e6 AS mb, o_totalprice / 1000 AS us, o_totalprice / 1024 AS mib,
  o_orderkey // 1024 AS whole_mib, CAST(round(o_totalprice) AS BIGINT) AS rounded,
  o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1e-3 WHEN 'O' THEN 1e3 ELSE 1.0 END AS mb_per_s
FROM orders""",
)
def unit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("o_orderstatus") == "F", "kB").when(F.col("o_orderstatus") == "O", "GB").otherwise("blocks")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        scale("o_totalprice", "bytes_to_mb").alias("mb"),
        scale("o_totalprice", "ns_to_us").alias("us"),
        scale("o_totalprice", "kib_to_mib").alias("mib"),
        scale("o_orderkey", "kb_to_mib").alias("whole_mib"),
        round_half_up("o_totalprice").alias("rounded"),
        to_mb_per_s("o_totalprice", unit).alias("mb_per_s"),
    )


@registered(
    "rate_text",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
    ELSE CAST(floor(o_totalprice / 100) * 10 AS DOUBLE) END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v IS NULL THEN '-' WHEN v >= 1000 THEN printf('%.2f GB/s', v / 1000)
  ELSE printf('%.0f MB/s', v) END AS rate FROM v""",
)
def rate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderstatus") != "P", (F.floor(F.col("o_totalprice") / 100) * 10).cast("double"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", v.alias("rate"))
    return compare.rate_texts(rows, "rate")


@registered(
    "mixed_rate",
    """WITH s AS (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 7 AS r,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 3 AS w FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, CAST(round(r) AS BIGINT) AS read_mb, CAST(round(w) AS BIGINT) AS write_mb FROM s)
SELECT *, read_mb + write_mb AS total_mb,
  read_mb || ' R + ' || write_mb || ' W = ' || (read_mb + write_mb) || ' MB/s' AS mixed_text FROM m""",
)
def mixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (exact_sum("l_extendedprice", 2) / 7).alias("r"), (exact_sum("l_quantity", 2) / 3).alias("w")
    )
    return compare.mixed_rate(rows, "r", "w").drop("r", "w")


# ---- catalogue, spec, clients, configurations ------------------------------


@registered(
    "pct_of_spec",
    """WITH m AS (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY l_partkey),
p AS (SELECT l_partkey, CAST(round(top) AS BIGINT) AS actual,
             CASE WHEN p_size > 45 THEN 0 ELSE p_retailprice END AS spec FROM m JOIN part ON p_partkey = l_partkey)
SELECT l_partkey, actual, spec, CAST(trunc(actual / nullif(spec, 0) * 100) AS BIGINT) AS pct,
  coalesce(CAST(trunc(actual / nullif(spec, 0) * 100) AS BIGINT) || '%', '—') AS pct_text FROM p""",
)
def pct_of_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row per metric before the join, so no part is hot in it
    top = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        round_half_up(F.max("l_extendedprice")).alias("actual")
    )
    spec = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_size") > 45, 0.0).otherwise(F.col("p_retailprice")).alias("spec"),
    )
    rows = compare.join_spec(top, spec, "l_partkey").withColumn("pct", pct_of("actual", "spec"))
    return rows.withColumn("pct_text", pct_text("pct"))


@registered(
    "join_spec",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_retailprice AS spec,"
    " CAST(trunc(l_extendedprice / nullif(p_retailprice, 0) * 100) AS BIGINT) AS pct"
    " FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
)
def row_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    spec = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("spec")
    )
    joined = compare.join_spec(rows, spec, "l_partkey", spread_by=["l_orderkey", "l_linenumber"])
    return joined.withColumn("pct", pct_of("l_extendedprice", "spec"))


CLIENTS = """
c AS (
  SELECT l_suppkey, l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM lineitem GROUP BY ALL
),
p AS (
  SELECT l_suppkey, l_returnflag, max(v) FILTER (WHERE l_linestatus = 'O') AS value_a,
         max(v) FILTER (WHERE l_linestatus = 'F') AS value_b FROM c GROUP BY ALL
)"""


def client_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        exact_sum("l_extendedprice", 2).alias("v")
    )
    return compare.pair_clients(rates, ["l_suppkey", "l_returnflag"], "l_linestatus", "v", "O", "F")


@registered("pair_clients", f"WITH {CLIENTS} SELECT *, value_a + value_b AS total FROM p")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client_pairs(spark, sf_dir)


@registered(
    "symmetry",
    f"""WITH {CLIENTS}, d AS (SELECT *, value_a + value_b AS total,
  abs(value_a - value_b) / CASE WHEN value_a IS NULL OR value_b IS NULL THEN NULL
    ELSE greatest(value_a, value_b) END AS rel_diff FROM p)
SELECT *, rel_diff <= 0.05 AS symmetric FROM d""",
)
def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.symmetry(client_pairs(spark, sf_dir))


@registered(
    "cross_compare",
    """WITH c AS (
  SELECT config, op, client, CASE WHEN config = '1-URGENT' AND client = 1 AND op = 'F' THEN 0.0 ELSE v END AS v FROM (
    SELECT o_orderpriority AS config, o_orderstatus AS op, o_custkey % 2 AS client,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3)),
s AS (
  SELECT config, op, max(v) AS single, count(nullif(v, 0)) AS n, sum(nullif(v, 0)) AS total FROM c GROUP BY config, op),
r AS (
  SELECT config, op, CASE WHEN config IN ('1-URGENT', '2-HIGH') THEN CASE WHEN n = 2 THEN total END
                          ELSE single END AS v FROM s)
SELECT config, max(v) FILTER (WHERE op = 'O') AS write, max(v) FILTER (WHERE op = 'F') AS read FROM r GROUP BY config""",
)
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = F.col("o_custkey") % 2
    silent = (F.col("config") == "1-URGENT") & (F.col("client") == 1) & (F.col("op") == "F")
    rates = (
        load(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("op"), client.alias("client"))
        .agg(exact_sum("o_totalprice", 2).alias("v"))
        .withColumn("v", F.when(silent, 0.0).otherwise(F.col("v")))
    )
    return compare.cross_compare(
        rates, "config", "op", "v", {"1-URGENT": 2, "2-HIGH": 2}, {"write": "O", "read": "F"}
    )


@registered(
    "catalogue_report",
    """WITH s AS (SELECT s_nationkey - s_nationkey % 3 AS test, arg_max(s_acctbal, s_suppkey) AS s_acctbal FROM supplier GROUP BY ALL)
SELECT n_nationkey AS ord, n_name, s_acctbal FROM nation LEFT JOIN s ON test = n_nationkey""",
)
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_nationkey").alias("test"), "n_name"
    )
    # every supplier counts for the first of three nations; the others have no result
    found = load(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") - F.col("s_nationkey") % 3).alias("test"), "s_suppkey", "s_acctbal"
    )
    return compare.catalogue_report(found, nations, "test", "s_acctbal", order="s_suppkey").drop("test")


@registered(
    "battery_report",
    f"""WITH {IO}, t AS (SELECT * FROM (VALUES (0, 'view', 'READ', 'first'), (1, 'click', 'WRITE', 'second'),
  (2, 'click', 'READ', 'third'), (3, 'none', 'READ', 'fourth')) AS t(ord, test, op, description)),
r AS (SELECT label, device AS test, CASE WHEN w % 2 = 1 THEN 'READ' ELSE 'WRITE' END AS op, max(r) AS mb_per_s
  FROM io GROUP BY ALL),
l AS (SELECT DISTINCT label FROM io)
SELECT l.label, t.ord, t.test, t.op, t.description, r.mb_per_s
FROM l CROSS JOIN t LEFT JOIN r ON r.label = l.label AND r.test = t.test AND r.op = t.op""",
)
def battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = io_samples(spark, sf_dir).select(
        "label",
        F.col("device").alias("test"),
        F.when(F.col("w_mbs") % 2 == 1, "READ").otherwise("WRITE").alias("op"),
        F.col("r_mbs").alias("mb_per_s"),
    )
    entries = (
        ("view", "READ", "first"),
        ("click", "WRITE", "second"),
        ("click", "READ", "third"),
        ("none", "READ", "fourth"),
    )
    return compare.battery_report(results, entries, "label")


@registered(
    "with_default",
    """WITH s AS (SELECT s_nationkey - s_nationkey % 3 AS k, count(*) AS n, max(s_acctbal) AS top FROM supplier GROUP BY ALL)
SELECT n_nationkey, n_name, coalesce(n, 0) AS n, coalesce(top, 0) AS top FROM nation LEFT JOIN s ON k = n_nationkey""",
)
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = (
        load(spark, sf_dir, "supplier")
        .groupBy((F.col("s_nationkey") - F.col("s_nationkey") % 3).alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("s_acctbal").alias("top"))
    )
    dim = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return with_default(found, dim, "n_nationkey", {"n": 0, "top": 0.0})


@registered(
    "stack",
    "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL"
    " SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)
def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")
    )
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return compare.stack(a, b)


CONFIGS = """
c AS (
  SELECT l_suppkey, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM lineitem GROUP BY ALL
),
p AS (
  SELECT l_suppkey, max(v) FILTER (WHERE l_linestatus = 'O') AS a, max(v) FILTER (WHERE l_linestatus = 'F') AS b
  FROM c GROUP BY ALL
)"""


def config_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(
        exact_sum("l_extendedprice", 2).alias("v")
    )


@registered("lift", f"WITH {CONFIGS} SELECT l_suppkey, a AS tuned, b AS base, a / nullif(b, 0) AS lift FROM p")
def lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.lift(config_rates(spark, sf_dir), "l_suppkey", "l_linestatus", "v", "O", "F")


@registered(
    "ab_ratio",
    """WITH c AS (
  SELECT o_orderstatus AS test, o_orderpriority AS config,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM orders GROUP BY ALL),
p AS (SELECT test, max(v) FILTER (WHERE config = '1-URGENT') AS value_a,
             max(v) FILTER (WHERE config = '5-LOW') AS value_b FROM c GROUP BY ALL)
SELECT *, value_a / nullif(value_b, 0) AS ratio FROM p""",
)
def ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = load(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("test"), F.col("o_orderpriority").alias("config")
    ).agg((exact_sum("o_totalprice", 2) / F.count(F.lit(1))).alias("v"))
    return compare.ab_ratio(means, "test", "config", "v", "1-URGENT", "5-LOW")


LEVELS = """
levels AS (
  SELECT n_regionkey, n_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL
)"""


def nation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders are summed per customer before the join, so no customer is hot
    spent = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        exact_sum("o_totalprice", 2).alias("spent")
    )
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    by_nation = spent.join(customers, "c_custkey").groupBy("n_nationkey").agg(
        exact_sum("spent", 2).alias("total")
    )
    return by_nation.join(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")


@registered(
    "ratio_ladder",
    f"""WITH {LEVELS}
SELECT *, total / lead(total) OVER w AS gap_to_next,
  first_value(total) OVER w / last_value(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    AS total_gap
FROM levels WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
)
def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ratio_ladder(nation_levels(spark, sf_dir), "n_nationkey", "total", "n_regionkey")


@registered(
    "pct_of_level",
    f"""WITH {LEVELS}
SELECT *, total / lag(total) OVER w * 100 AS pct_of_previous, total / first_value(total) OVER w * 100 AS pct_of_first
FROM levels WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
)
def level_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = nation_levels(spark, sf_dir)
    once = compare.pct_of_level(levels, "n_nationkey", "total", "n_regionkey", "previous")
    once = once.withColumnRenamed("pct_of_level", "pct_of_previous")
    twice = compare.pct_of_level(once, "n_nationkey", "total", "n_regionkey", "first")
    return twice.withColumnRenamed("pct_of_level", "pct_of_first")


# ---- expectations and checks -----------------------------------------------

EXPECT = """
a AS (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS actual FROM lineitem
  GROUP BY l_orderkey
),
e AS (
  SELECT o_orderkey, o_orderpriority, o_totalprice * 0.5 AS lo,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice * 1.5 END AS hi, 15.0::DOUBLE AS tol_pct FROM orders
),
v AS (
  SELECT o_orderkey, o_orderpriority, lo, hi, tol_pct, actual,
    CASE WHEN actual IS NULL THEN 'missing'
         WHEN actual >= lo * (1 - tol_pct / 100) AND (hi IS NULL OR actual <= hi * (1 + tol_pct / 100)) THEN 'ok'
         ELSE 'drift' END AS verdict
  FROM e LEFT JOIN a ON l_orderkey = o_orderkey
)"""


def order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        exact_sum("l_extendedprice", 2).alias("actual")
    )
    price = F.col("o_totalprice")
    expected = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        (price * 0.5).alias("lo"),
        F.when(F.col("o_orderstatus") != "P", price * 1.5).alias("hi"),
        F.lit(15.0).alias("tol_pct"),
    )
    return compare.check_expected(actual, expected, "o_orderkey", "actual")


@registered("check_expected", f"WITH {EXPECT} SELECT * FROM v")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_verdicts(spark, sf_dir)


@registered(
    "triage",
    f"""WITH {EXPECT}
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE verdict = 'drift') AS n_drift,
  CASE WHEN NOT bool_and(lo < 220000) THEN 'investigate'
       WHEN count(*) FILTER (WHERE verdict = 'drift') > 0 THEN 'drift'
       WHEN count(*) FILTER (WHERE verdict = 'missing') > 0 THEN 'missing' ELSE 'ok' END AS state
FROM v GROUP BY o_orderpriority""",
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.triage(order_verdicts(spark, sf_dir), "o_orderpriority", F.col("lo") < 220000)


@registered(
    "pass_fail",
    """WITH m AS (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem GROUP BY l_partkey),
b AS (SELECT p_partkey, top, p_retailprice * 80 AS lo, CASE WHEN p_size < 25 THEN p_retailprice * 100 END AS hi
  FROM part LEFT JOIN m ON l_partkey = p_partkey)
SELECT *, coalesce(top >= lo AND (hi IS NULL OR top <= hi), false) AS passed FROM b""",
)
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("top")
    )
    price = F.col("p_retailprice")
    wanted = load(spark, sf_dir, "part").select(
        "p_partkey", (price * 80).alias("lo"), F.when(F.col("p_size") < 25, price * 100).alias("hi")
    )
    joined = wanted.join(top, "p_partkey", "left").select("p_partkey", "top", "lo", "hi")
    return compare.pass_fail(joined, "top", "lo", "hi")


@registered(
    "constant_across",
    """SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS low, max(l_returnflag) AS high,
  count(l_returnflag) = count(*) AND min(l_returnflag) = max(l_returnflag) AS is_constant
FROM lineitem GROUP BY l_orderkey""",
)
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.constant_across(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@registered(
    "replica_agreement",
    """WITH t AS (
  SELECT doc_id, 'labels' AS host, CASE quality WHEN 1 THEN 'long' ELSE 'short' END AS target FROM labels
  UNION ALL SELECT doc_id, 'documents', CASE WHEN n_chars > 400 THEN 'long' ELSE 'short' END FROM documents
    WHERE doc_id % 7 = 0 AND lang <> 'de' -- hosts that report twice
  UNION ALL SELECT doc_id, 'documents', CASE WHEN lang = 'de' THEN 'MISSING' WHEN n_chars > 400 THEN 'long'
    ELSE 'short' END FROM documents),
g AS (SELECT doc_id, count(DISTINCT host) FILTER (WHERE target <> 'MISSING') AS n_targets,
  min(nullif(target, 'MISSING')) AS low, max(nullif(target, 'MISSING')) AS high FROM t GROUP BY doc_id)
SELECT *, n_targets = 2 AND coalesce(low = high, false) AS agree FROM g""",
)
def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") > 400, "long").otherwise("short")
    views = compare.stack(
        load(spark, sf_dir, "labels").select(
            "doc_id",
            F.lit("labels").alias("host"),
            F.when(F.col("quality") == 1, "long").otherwise("short").alias("target"),
        ),
        load(spark, sf_dir, "documents").select(
            "doc_id",
            F.lit("documents").alias("host"),
            F.when(F.col("lang") == "de", "MISSING").otherwise(size).alias("target"),
        ),
        # hosts that report twice
        load(spark, sf_dir, "documents")
        .where((F.col("doc_id") % 7 == 0) & (F.col("lang") != "de"))
        .select("doc_id", F.lit("documents").alias("host"), size.alias("target")),
    )
    return compare.replica_agreement(views, "doc_id", "host", "target")


@registered(
    "audit_sweep",
    """WITH r AS (SELECT l_partkey, max(l_extendedprice) AS mb_per_s FROM lineitem GROUP BY l_partkey),
p AS (SELECT p_partkey, p_size % 4 + 1 AS threads,
             CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size * 100)::BIGINT * 1073741824 END AS off,
             (p_size * 100 + p_partkey % 2)::BIGINT * 1073741824 AS size FROM part)
SELECT p_partkey AS job, mb_per_s, threads > 1 AND off IS NULL AS no_offset,
  coalesce(coalesce(off, size) < 180 * (mb_per_s / threads) * 1e6, false) AS wraps,
  coalesce(threads > 1 AND size > off, false) AS overlap, coalesce(mb_per_s > 80000, false) AS above_link
FROM p LEFT JOIN r ON l_partkey = p_partkey""",
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("job")).agg(
        F.max("l_extendedprice").alias("mb_per_s")
    )
    size = F.col("p_size") * 100
    params = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("job"),
        F.create_map(
            F.lit("numjobs"),
            (F.col("p_size") % 4 + 1).cast("string"),
            F.lit("offset_increment"),
            F.when(F.col("p_size") % 3 != 0, F.concat(size.cast("string"), F.lit("g"))),
            F.lit("size"),
            F.concat((size + F.col("p_partkey") % 2).cast("string"), F.lit("g")),
            F.lit("runtime"),
            F.lit("180"),
        ).alias("params"),
    )
    return audit_sweep(params, rates, 80000.0)


# ---- costs -------------------------------------------------------------------


@registered(
    "footprint",
    """SELECT split_part(regexp_replace(url, '^[A-Za-z0-9+.-]+:/*|^/+', ''), '/', 1) AS dir,
  CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) AS files FROM pages GROUP BY ALL""",
)
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").alias("length")
    )
    return costs.footprint(files, 1)


@registered(
    "effective_bw",
    """WITH s AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS size,
  max(l_quantity) AS secs FROM lineitem GROUP BY l_suppkey)
SELECT *, size / nullif(secs, 0) AS rate FROM s""",
)
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.effective_bw(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity", decimals=2)


@registered(
    "effective_net_bw",
    """WITH s AS (SELECT l_suppkey,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS size,
  max(l_quantity) AS secs FROM lineitem GROUP BY l_suppkey)
SELECT *, size / nullif(secs, 0) AS rate FROM s""",
)
def effective_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with four decimals: none of them is lost."""
    net = load(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_quantity"
    )
    return costs.effective_bw(net, "l_suppkey", "net", "l_quantity", decimals=4)


@registered(
    "overhead_share",
    """WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS ckpt_secs,
  max(l_extendedprice) AS wall_secs FROM lineitem GROUP BY l_orderkey)
SELECT *, ckpt_secs / nullif(wall_secs, 0) AS share FROM s""",
)
def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.overhead_share(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", decimals=2)


@registered(
    "total_cost",
    """WITH b AS (SELECT l_orderkey AS run, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS block_secs
  FROM lineitem GROUP BY l_orderkey),
s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE -o_orderkey END AS run,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sync_secs FROM orders GROUP BY ALL)
SELECT run, coalesce(block_secs, 0) AS block_secs, coalesce(sync_secs, 0) AS sync_secs,
  coalesce(block_secs, 0) + coalesce(sync_secs, 0) AS total_secs
FROM b FULL JOIN s USING (run)""",
)
def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").alias("secs"))
    # the other orders stand for runs that have a sync and no block
    run = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    sync = load(spark, sf_dir, "orders").select(run.alias("run"), F.col("o_totalprice").alias("sync"))
    return costs.total_cost(blocks, sync, "run", "secs", "sync", decimals=2)


@registered(
    "break_even",
    f"""WITH {CONFIGS}
SELECT l_suppkey, s_acctbal AS sync_secs, a AS shared_secs, b AS local_secs, s_acctbal / nullif(a - b, 0) AS break_even
FROM p JOIN supplier ON s_suppkey = l_suppkey""",
)
def even(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = compare.ab_ratio(config_rates(spark, sf_dir), "l_suppkey", "l_linestatus", "v", "O", "F")
    sync = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("sync_secs")
    )
    rows = both.select("l_suppkey", F.col("value_a").alias("shared_secs"), F.col("value_b").alias("local_secs")).join(
        sync, "l_suppkey"
    )
    return costs.break_even(rows, "sync_secs", "shared_secs", "local_secs")


# ---- report text and stored tables --------------------------------------------


def brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.max("p_size").alias("top")
    )


@registered(
    "markdown_table",
    """SELECT '| Brand | Parts | Largest |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL
SELECT '| ' || p_brand || ' | ' || count(*) || ' | ' || max(p_size) || ' |' FROM part GROUP BY p_brand""",
)
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = {"p_brand": "Brand", "n": "Parts", "top": "Largest"}
    return to_markdown(brand_counts(spark, sf_dir), heads, ["p_brand"])


@registered(
    "fixed_width_table",
    """SELECT 'Brand        Parts  Largest' AS line UNION ALL SELECT '---------------------------' UNION ALL
SELECT rpad(p_brand, 10, ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 7, ' ') || ' '
  || lpad(CAST(max(p_size) AS VARCHAR), 8, ' ') FROM part GROUP BY p_brand""",
)
def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = {"p_brand": "Brand", "n": "Parts", "top": "Largest"}
    return to_fixed_width(brand_counts(spark, sf_dir), {"p_brand": 10, "n": -7, "top": -8}, heads, ["p_brand"])


def _fixed(col: str, width: int, digits: int) -> str:
    """SQL text of a double the way Spark prints it: its shortest decimal form
    rounded half up."""
    exact = f"CAST(CAST({col} AS VARCHAR) AS DECIMAL(38,18))"
    return f"lpad(CAST(CAST(round({exact}, {digits}) AS DECIMAL(38,{digits})) AS VARCHAR), {width}, ' ')"


@registered(
    "summary_lines",
    f"""WITH {NUMBERED}, s AS (SELECT label, {SUMMARY} FROM x GROUP BY label)
SELECT rpad(CAST(label AS VARCHAR), 32, ' ') || ' peakR=' || {_fixed("peak_r", 7, 1)}
  || ' peakW=' || {_fixed("peak_w", 7, 1)} || '  totR=' || {_fixed("total_r_gb", 6, 2)}
  || ' GB totW=' || {_fixed("total_w_gb", 6, 2)} || ' GB  actAvgR=' || {_fixed("active_avg_r", 7, 1)}
  || ' actAvgW=' || {_fixed("active_avg_w", 7, 1)} || ' actN=' || active_n AS line FROM s""",
)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_lines(io_summary(spark, sf_dir))


@registered(
    "stored_samples",
    f"WITH {IO} SELECT 'run 1' AS run, device, label, seq, ts, r AS r_mbs, w AS w_mbs FROM io",
)
def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is stored twice is there once, with all partitions."""
    out = shared_dir(spark, "samples")
    samples = io_samples(spark, sf_dir)
    for _ in range(2):
        write_run(samples, out, "run 1", ["device"])
    return read_runs(spark, out, samples.schema)


def _literal(v: str | float | None) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


EXPECTED_ROWS = ", ".join(f"({i}, {', '.join(map(_literal, r))})" for i, r in enumerate(EXPECTED))
#: Measures that are taken: one for each expectation and some that none asks for.
MEASURED = len(EXPECTED) + 7


@registered(
    "expected_values",
    f"""WITH e AS (SELECT * FROM (VALUES {EXPECTED_ROWS}) AS t(ord, scenario, metric, regime, lo, hi, tol_pct)),
q AS (SELECT l_orderkey % {MEASURED} AS ord, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 25.5 AS ratio
  FROM lineitem GROUP BY ALL),
m AS (SELECT e.ord, coalesce(lo, hi) * ratio * (0.8::DOUBLE + 0.2::DOUBLE * (e.ord % 3)) AS actual FROM e JOIN q ON q.ord = e.ord
  WHERE e.ord % 11 <> 5)
SELECT scenario, metric, regime, lo, hi, tol_pct, actual, CASE WHEN actual IS NULL THEN 'missing'
  WHEN (lo IS NULL OR actual >= lo * (1 - tol_pct / 100)) AND (hi IS NULL OR actual <= hi * (1 + tol_pct / 100)) THEN 'ok'
  ELSE 'drift' END AS verdict FROM e LEFT JOIN m ON m.ord = e.ord""",
)
def expected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published expectations against measures that a table gives them; some are not measured at all."""
    ratio = (
        load(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % MEASURED).alias("ord"))
        .agg((exact_sum("l_quantity", 2) / F.count(F.lit(1)) / F.lit(25.5)).alias("ratio"))
    )
    names = fixed(
        spark,
        [(i, s, m, r if i % 11 != 5 else "not measured", lo if lo is not None else hi) for i, (s, m, r, lo, hi, _) in enumerate(EXPECTED)],
        "ord bigint, scenario string, metric string, regime string, base double",
    )
    actual = F.col("base") * F.col("ratio") * (F.lit(0.8) + F.lit(0.2) * (F.col("ord") % 3))
    measures = ratio.join(names, "ord").select("scenario", "metric", "regime", actual.alias("actual"))
    return compare.check_expected(measures, expected_df(spark), ["scenario", "metric", "regime"], "actual")


@registered(
    "file_footprint",
    """SELECT 'site=' || page_id % 7 || '/kind=' || (CASE WHEN length(html) > 1000 THEN 'long' ELSE 'short' END) AS dir,
  sum(strlen(html) + 1)::BIGINT AS bytes FROM pages GROUP BY ALL""",
)
def file_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per directory of files that were written from a table."""
    out = shared_dir(spark, "footprint")
    kind = F.when(F.length("html") > 1000, "long").otherwise("short")
    pages = load(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("site"), kind.alias("kind"), "html")
    pages.write.partitionBy("site", "kind").text(out)
    entries = scan_file_entries(spark, out)
    inside = F.substring_index("path", f"{out.rsplit('/', 1)[1]}/", -1)
    return costs.footprint(entries.withColumn("path", inside), 2).select("dir", "bytes")
