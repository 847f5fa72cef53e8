from pyspark.sql import functions as F

from tidegauge.functions import text, units


def test_rounding_is_half_away_from_zero(one):
    assert one(units.round_half_up(F.lit(2.5))) == 3
    assert one(units.round_half_up(F.lit(-2.5))) == -3
    assert one(units.round_half_up(F.lit(2.4999))) == 2


def test_bandwidth_rounds_after_scaling_and_missing_is_zero(one):
    assert one(units.bw_mbs(F.lit(1_974_500_000))) == 1975
    assert one(units.bw_mbs(F.lit(None).cast("bigint"))) == 0
    assert one(units.iops(F.lit(None).cast("double"))) == 0


def test_percent_is_cut_off_and_uses_the_rounded_figure(one):
    assert one(units.pct_of(F.lit(1974), F.lit(13400))) == 14
    assert one(units.pct_of(F.lit(10512), F.lit(14800))) == 71
    assert one(units.pct_of(F.lit(5), F.lit(0))) is None
    assert one(units.pct_text(units.pct_of(F.lit(5), F.lit(0)))) == "—"
    assert one(units.pct_text(units.pct_of(F.lit(5105), F.lit(14800)))) == "34%"


def test_percentile_lookup(one):
    table = F.create_map(F.lit("99.000000"), F.lit(457499))
    assert one(units.latency_us(table)) == 457
    assert one(units.percentile_of(table, "50.000000")) is None
    assert one(units.latency_us(table, "50.000000")) == 0


def test_units_of_summary_lines(one):
    assert one(units.to_mb_per_s(F.lit(1477.0), F.lit("kB"))) == 1477 * 1e-3
    assert one(units.to_mb_per_s(F.lit(2.5), F.lit("GB"))) == 2500.0
    assert one(units.to_mb_per_s(F.lit(7.0), F.lit("blocks"))) == 7.0


def test_kib_is_divided_as_whole_number(one):
    assert one(units.scale(F.lit(2047), "kb_to_mib")) == 1
    assert one(units.scale(F.lit(2047), "kib_to_mib")) == 2047 / 1024


def test_rate_text(one):
    assert one(units.fmt_rate(F.lit(None).cast("double"))) == "-"
    assert one(units.fmt_rate(F.lit(0.0))) == "0 MB/s"
    assert one(units.fmt_rate(F.lit(999.0))) == "999 MB/s"
    assert one(units.fmt_rate(F.lit(1000.0))) == "1.00 GB/s"


def test_sizes(one):
    assert one(units.size_bytes(F.lit("128g"))) == 128 * 1024**3
    assert one(units.size_bytes(F.lit("4k"))) == 4096
    assert one(units.size_bytes(F.lit("1M"))) == 1024**2
    assert one(units.size_bytes(F.lit("512"))) == 512
    assert one(units.size_bytes(F.lit("big"))) is None


def test_bins_go_down_below_zero(one):
    assert one(units.bin_of(F.lit(-1), 10)) == -1
    assert one(units.bin_of(F.lit(-10), 10)) == -1
    assert one(units.bin_of(F.lit(19), 10)) == 1


def test_exact_sum(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,), (-7.25,)], "v double")
    assert df.agg(units.exact_sum("v").alias("s")).first()["s"] == -6.95
    assert df.filter("v > 99").agg(units.exact_sum("v").alias("s")).first()["s"] is None
    # far beyond what one bigint of hundredths holds
    big = spark.range(2000).select(F.lit(9.0e13).alias("v"))
    assert big.agg(units.exact_sum("v").alias("s")).first()["s"] == 1.8e17


def test_labels(one):
    path = F.lit("/x/logs/iostat-cold-restore-host1.log")
    label = text.label_from_path(path, "iostat-")
    assert one(label) == "cold-restore-host1"
    assert one(text.phase_of(label)) == "cold-restore"
    assert one(text.host_of(label)) == "host1"
    assert one(text.label_from_path(path, "iostat-", strip=False)) == "iostat-cold-restore-host1"
    assert one(text.host_of(F.lit("c25"))) is None
    assert one(text.phase_of(F.lit("c25"))) == "c25"


def test_step_pattern_needs_a_word_end(one):
    p = text.EVENT_PATTERNS["step"]
    assert one(F.lit("root | step 100 | loss").rlike(p))
    assert not one(F.lit("root | step 1000 | loss").rlike(p))


def test_line_times(one):
    assert str(one(text.line_ts(F.lit("2026-05-01 10:20:30,123 | INFO")).cast("string"))) == "2026-05-01 10:20:30"
    assert str(one(text.line_ts(F.lit("=== START 2026-05-01T10:20:30+02:00 ===")).cast("string"))) == "2026-05-01 08:20:30"
    assert one(text.line_ts(F.lit("no time"))) is None
