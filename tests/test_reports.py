import json

import pytest

from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tests.test_sources import capture, device_row
from tidegauge.operators import report
from tidegauge.plans import reports
from tidegauge.sources import fio, iostat, logs


def doc(**sides):
    return json.dumps({"jobs": [dict(jobname="j", **sides)]})


def test_sweep_from_files(spark, write):
    bw = lambda mb: {"bw_bytes": mb * 1_000_000}
    lat = lambda n, us: {"iops": float(n), "clat_ns": {"percentile": {"99.000000": us * 1000}}}
    root = write(
        {
            "01-seqwrite-1t.json": doc(write=bw(1662)),
            "02-seqwrite-16t.json": doc(write=bw(1974)),
            "03-seqread-1t.json": doc(read=bw(5105)),
            "04-seqread-16t.json": doc(read=bw(10512)),
            "05-randread-4k-qd64.json": doc(read=lat(1624088, 399)),
            "06-randwrite-4k-qd64.json": doc(write=lat(481338, 1729)),
            "07-randread-4k-qd1.json": doc(read=lat(4852, 457)),
            "08-rw7030.json": doc(read=bw(2601), write=bw(1113)),
        }
    )
    table = reports.sweep_report(fio.read_fio_json(spark, f"{root}/*.json"))
    got = [(r.value, r.p99_us, r.pct_of_spec) for r in table.collect()]
    assert got == [
        (1662, None, 12),
        (1974, None, 14),
        (5105, None, 34),
        (10512, None, 71),
        (1624088, 399, 73),
        (481338, 1729, 18),
        (4852, 457, None),
        (3714, None, None),
    ]
    heads = {"title": "Job", "rate": "Throughput / IOPS", "p99": "p99 lat", "pct": "% of spec"}
    lines = [r.line for r in report.to_markdown(reports.sweep_text(table), heads, ["ord"]).collect()]
    assert lines[0] == "| Job | Throughput / IOPS | p99 lat | % of spec |"
    assert lines[3] == "| seqwrite 16t 1MB | 1974 MB/s | — | 14% |"
    assert lines[8] == "| randread 4k QD1 (latency floor) | 4852 IOPS | **457 µs** | — |"
    assert lines[9] == "| mixed 70/30 1MB 8t | 2601 R + 1113 W = 3714 MB/s | — | — |"


def test_device_report_from_files(spark, write):
    stamp = "05/03/2026 10:00:{:02}"
    root = write(
        {
            "iostat-b-host1.log": capture(
                (stamp.format(0), [device_row("nvme0n1", 9999, 9999)]),
                (stamp.format(2), [device_row("nvme0n1", 100.5, 0)]),
                (stamp.format(4), [device_row("nvme0n1", 0, 1700)]),
            ),
            "iostat-a-host2.log": capture((stamp.format(0), [device_row("nvme0n1", 1, 1)])),
        }
    )
    samples = iostat.read_iostat(spark, f"{root}/iostat-*.log")
    rows = reports.device_report(samples).collect()
    assert [r.label for r in rows] == ["a-host2", "b-host1"]
    assert (rows[1].peak_r, rows[1].peak_w, rows[1].peak_rw, rows[1].active_n) == (100.5, 1700.0, 1700.0, 2)
    assert rows[1].total_w_gb == 3400 / 1024
    lines = [r.line for r in report.summary_lines(reports.device_report(samples)).collect()]
    assert lines[0].startswith("a-host2  ") and lines[0].endswith("actN=0")
    assert "peakR=  100.5 peakW= 1700.0  totR=  0.20 GB totW=  3.32 GB" in lines[1]
    active = samples.filter("r_mbs > 50 or w_mbs > 50").filter("label = 'b-host1'")
    text = [r.line for r in report.sample_lines(active, util="util_pct").collect()]
    assert text[1] == "05/03/2026 10:00:02 | r=  100.5 MB/s  w=    0.0 MB/s  %util=  1.0"


def test_checkpoint_report_from_files(spark, write):
    body = "=== START x ===\n" + "".join(f"step {s} | mem 35.5 GiB\n" for s in (97, 98, 99, 100, 1000))
    body += "".join(f"Done consolidating {i}\n" for i in range(12))
    root = write({"training-m-host1.log": body, "training-n-host2.log": "quiet\n"})
    lines = logs.read_training_log(spark, f"{root}/training-*.log")
    rows = reports.checkpoint_report(lines).collect()
    got = {}
    for r in rows:
        got.setdefault((r.label, r.kind), []).append(r.raw)
    assert got[("m-host1", "consolidation")] == [f"Done consolidating {i}" for i in range(10)]
    assert [x.split(" |")[0] for x in got[("m-host1", "step")]] == ["step 98", "step 99", "step 100"]
    assert got[("m-host1", "bracket")] == ["=== START x ==="]
    assert {k[1] for k in got if k[0] == "n-host2"} == {"consolidation", "step", "bracket"}
    assert all(v[0].startswith("(no ") for k, v in got.items() if k[0] == "n-host2")
    assert reports.plateau_report(lines).collect()[0].plateau == ["mem 35.5 GiB"]


def test_battery_tables_from_files(spark, write):
    def out(op, mb):
        return f"  {op}: bw=1MiB/s ({mb}MB/s), x\n"

    root = write(
        {
            "pillar1-seq-write-1m.log": out("WRITE", 2200),
            "pillar1-seq-read-1m.log": out("READ", 11000),
            "pillar2-seq-read-1m.log": out("READ", 2280),
            "pillar3-host1-seq-write-1m.log": out("WRITE", 645),
            "pillar3-host2-seq-write-1m.log": out("WRITE", 641),
            "pillar3-host1-seq-read-1m.log": out("READ", 4447),
        }
    )
    results = fio.read_fio_text(spark, f"{root}/pillar*.log")
    first = [r.rate for r in reports.battery_tables(results).filter("pillar = '1'").collect()]
    assert first == ["2.20 GB/s", "11.00 GB/s", "-", "-", "-"]
    both = {r.test: r.total for r in reports.concurrent_table(results).collect()}
    assert both == {"seq-write-1m": 1286.0, "seq-read-1m": None}
    cross = {r.pillar: (r.write, r.read) for r in reports.cross_table(results).collect()}
    assert cross == {"1": (2200.0, 11000.0), "2": (None, 2280.0), "3": (1286.0, None)}


def test_fixed_width(spark):
    df = spark.createDataFrame([(1, "a test", "2 MB/s"), (0, "a much longer test name", "-")], "ord int, t string, r string")
    lines = [r.line for r in report.to_fixed_width(df, {"t": 10, "r": -8}, {"t": "Test", "r": "Result"}, ["ord"]).collect()]
    assert lines == ["Test         Result", "-------------------", "a much longer test name        -", "a test       2 MB/s"]


def test_tables_are_partitioned_and_pruned(spark, tmp_path):
    df = spark.range(100).select(F.when(F.col("id") < 10, "cold").otherwise("hot").alias("phase"), "id")
    report.write_table(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).filter("phase = 'cold'")
    assert back.count() == 10
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["phase=cold", "phase=hot"]
    report.write_lines(df.select(F.col("id").cast("string").alias("line")).orderBy("line"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 100


STAMPS = {
    "iso": [f"2026-05-{d:02d}T10:00:00" for d in (1, 2, 3)],
    "day first": [f"{d}/05/2026 10:00:00" for d in (13, 14, 15)],
    "month first, out of order": ["05/03/2026 10:00:02", "05/03/2026 10:00:00", "05/03/2026 10:00:04"],
    "none": ["", "", ""],
}


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("between", ["", "blank"])
@pytest.mark.parametrize("stamps", STAMPS)
def test_device_report_whatever_the_stamps(spark, write, stamps, between, ends):
    """Exactly the first row of each file goes; equal names in two folders and blanks in names stay apart."""
    row = "nvme0n1 1.0 {} 0 0 0 0 2.0 {} 0 0 0 0 0.5 1.0"

    def log(*rates):
        parts = []
        for stamp, (r, w) in zip(STAMPS[stamps], rates):
            parts += [stamp, row.format(r, w), *([""] if between else [])]
        return ends.join(x for x in parts if x or between) + ends

    root = write({"d 3/iostat-train-h1.log": log((5000, 1), (100, 403), (60, 0)), "d4/iostat-train-h1.log": log((9000, 9), (70, 8), (70, 8))})
    got = reports.device_report(iostat.read_iostat(spark, f"{root}/*/iostat-*.log")).collect()
    found = {r.path.split("/")[-2]: (r.label, r.peak_r, r.peak_w, r.active_n, r.total_r_gb) for r in got}
    assert found == {"d 3": ("train-h1", 100.0, 403.0, 2, 160 * 2 / 1024), "d4": ("train-h1", 70.0, 8.0, 2, 140 * 2 / 1024)}


def test_every_sample_has_the_stamp_of_its_report(spark, write):
    text = "\r\n".join(f"05/03/2026 10:00:0{i}\r\nnvme0n1 1 {i} 0 0 0 0 2 {i} 0 0 0 0 0 1" for i in range(4))
    rows = iostat.read_iostat(spark, f"{write({'iostat-a.log': text})}/iostat-a.log").orderBy("seq").collect()
    assert [(r.stamp[-1], r.r_mbs) for r in rows] == [(str(i), float(i)) for i in range(4)]


def test_logs_of_equal_names_stay_apart(spark, write):
    root = write({f"d{k}/training-a-h1.log": f"Done consolidating {k}\nmem {k}.5 GiB\n" for k in (1, 2)})
    lines = logs.read_training_log(spark, f"{root}/*/training-*.log")
    rows = reports.checkpoint_report(lines).collect()
    assert sorted(r.raw for r in rows if r.kind == "consolidation") == ["Done consolidating 1", "Done consolidating 2"]
    assert sum(r.kind == "bracket" for r in rows) == 2
    assert sorted(r.plateau for r in reports.plateau_report(lines).collect()) == [["mem 1.5 GiB"], ["mem 2.5 GiB"]]


def test_checkpoint_report_reads_its_lines_once(spark, write):
    root = write({"training-a-h1.log": "Done consolidating\n"})
    report_df = reports.checkpoint_report(logs.read_training_log(spark, f"{root}/training-*.log"))
    plan = executed_plan(report_df)
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 1, plan


def test_captures_are_parsed_once(spark, write):
    row = "nvme0n1 1 {} 0 0 0 0 0 {} 0 0 0 0 1"
    text = "\n\n".join(f"05/03/2026 11:00:{s:02}\n" + row.format(v, v / 2) for s, v in [(0, 900), (1, 60), (2, 80), (3, 80)])
    root = write({"iostat-a-h1.log": text, "iostat-b-h1.log": text[: text.index("\n\n")]})
    report = reports.device_report(iostat.read_iostat(spark, f"{root}/iostat-*.log"))
    plan = executed_plan(report)
    assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan
    assert [(r.label, r.peak_r, r.peak_rw, r.active_n) for r in report.collect()] == [("a-h1", 80.0, 120.0, 3), ("b-h1", 0.0, 0.0, 0)]
