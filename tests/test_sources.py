import json
import zipfile
from datetime import datetime

import pytest
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidegauge.functions.units import bw_mbs, latency_us
from tidegauge.operators import curves, report
from tidegauge.operators.samples import peak_memory
from tidegauge.session import ship_package
from tidegauge.sources import dims, fio, iostat, logs


def side(bw=None, iops=None, p99=None):
    out = {}
    if bw is not None:
        out["bw_bytes"] = bw
    if iops is not None:
        out["iops"] = iops
    if p99 is not None:
        out["clat_ns"] = {"percentile": {"50.000000": 1, "99.000000": p99}}
    return out


def test_fio_json(spark, write):
    root = write(
        {
            "a.json": json.dumps(
                {
                    "fio version": "fio-3",
                    "jobs": [
                        {"jobname": "a", "read": side(1_500_000, 10.5, 2500), "write": side(7)},
                        {"jobname": "b", "read": side(9_000_000)},
                    ],
                },
                indent=2,
            ),
            "b.json": json.dumps({"jobs": [{"jobname": "x", "read": {"bw_bytes": None, "iops": 3}}]}),
            "c.json": json.dumps({"jobs": []}),
        }
    )
    rows = fio.read_fio_json(spark, f"{root}/*.json")
    got = {
        (r.job, r.op): (r.bw, r.p99, r.iops)
        for r in rows.select("job", "op", "iops", bw_mbs("bw_bytes").alias("bw"), latency_us("clat_ns").alias("p99")).collect()
    }
    assert got[("a", "READ")] == (2, 3, 10.5)  # halves go up, first job only
    assert got[("a", "WRITE")] == (0, 0, 0.0)
    assert got[("b", "READ")] == (0, 0, 3.0)  # null and missing count as 0
    assert got[("b", "WRITE")] == (0, 0, 0.0)
    assert got[("c", "READ")] == (0, 0, 0.0)
    every = fio.read_fio_json(spark, f"{root}/a.json", all_jobs=True)
    assert sorted((r.job_no, r.op, r.bw_bytes) for r in every.collect()) == [
        (0, "READ", 1500000),
        (0, "WRITE", 7),
        (1, "READ", 9000000),
        (1, "WRITE", 0),
    ]


def test_missing_files_fail(spark, tmp_path):
    with pytest.raises(AnalysisException):
        fio.read_fio_json(spark, f"{tmp_path}/none.json").collect()
    with pytest.raises(AnalysisException):
        iostat.read_iostat(spark, f"{tmp_path}/iostat-*.log").collect()


def test_fio_text(spark, write):
    root = write(
        {
            "pillar1-seq-write-1m.log": "x\n  WRITE: bw=100MiB/s (105MB/s), io=1\n  WRITE: bw=2100MiB/s (2.2GB/s), io=1\n",
            "pillar1-rand-rw-4k.log": "   READ: bw=1442KiB/s (1477kB/s), a\r\n  WRITE: bw=0KiB/s (0kB/s), a\r\n",
            "pillar3-host1-seq-read-1m.log": b"\xff\xfe junk\n   READ: bw=2264MiB/s (2374MB/s), run\n",
            "pillar3-host2-seq-read-1m.log": "   READ: bw=12B/s (12B/s), run\n  TRIM: bw=1MiB/s (1MB/s)\n",
        }
    )
    got = {
        (r.pillar, r.client, r.test, r.op): r.mb_per_s for r in fio.read_fio_text(spark, f"{root}/pillar*.log").collect()
    }
    assert got == {
        ("1", None, "seq-write-1m", "WRITE"): 2200.0,  # last line wins
        ("1", None, "rand-rw-4k", "READ"): 1477 * 1e-3,
        ("1", None, "rand-rw-4k", "WRITE"): 0.0,
        ("3", "host1", "seq-read-1m", "READ"): 2374.0,  # plain B/s gives no row
    }


def test_bw_log(spark, write):
    root = write({"02-seqwrite-16t_bw.0.log": "1000, 2048, 1, 0, 0\n2001, 1024, 1, 0, 0\n", "j_bw.12.log": "5, 6, 0, 0\n"})
    got = sorted(tuple(r) for r in fio.read_bw_log(spark, f"{root}/*_bw.*.log").drop("path", "folder").collect())
    assert got == [("02-seqwrite-16t", 0, 1000, 2048, 1), ("02-seqwrite-16t", 0, 2001, 1024, 1), ("j", 12, 5, 6, 0)]


HEADER = "Device r/s rMB/s rrqm/s %rrqm r_await rareq-sz w/s wMB/s wrqm/s %wrqm w_await wareq-sz aqu-sz %util"


def device_row(name, r, w, util=1.0):
    return f"{name}  1.0 {r} 0 0 0 0 2.0 {w} 0 0 0 0 0.5 {util}"


def capture(*reports, tail=""):
    blocks = ["Linux 6.17 (h) \t05/03/2026 \t_aarch64_\t(20 CPU)"]
    for stamp, rows in reports:
        blocks.append("\n".join([stamp, HEADER, *rows]))
    return "\n\n".join(blocks) + "\n\n" + tail


def test_iostat(spark, write):
    root = write(
        {
            "iostat-single-host1.log": capture(
                ("05/03/2026 11:59:58 AM", [device_row("nvme0n1", 5, 6), device_row("nvme0n1p1", 1, 1)]),
                ("05/03/2026 12:00:00 PM", [device_row("nvme0n1", 70.25, 6, 99.5), device_row("sda", 9, 9)]),
                ("05/03/2026 12:00:02 PM", [device_row("nvme0n1", "bad", 8)]),
                tail="05/03/2026 12:00:04 PM\nnvme0n1 1.0",
            ),
            "iostat-c25.log": capture(("05/03/2026 13:00:00", [device_row("nvme0n1", 1, 2)])),
        }
    )
    rows = iostat.read_iostat(spark, f"{root}/iostat-*.log").orderBy("label", "seq").collect()
    assert [(r.label, r.phase, r.host, r.r_mbs, r.w_mbs, r.util_pct) for r in rows] == [
        ("c25", "c25", None, 1.0, 2.0, 1.0),
        ("single-host1", "single", "host1", 5.0, 6.0, 1.0),
        ("single-host1", "single", "host1", 70.25, 6.0, 99.5),
        ("single-host1", "single", "host1", None, 8.0, 1.0),
        ("single-host1", "single", "host1", None, None, 1.0),
    ]
    assert rows[1].ts == datetime(2026, 5, 3, 11, 59, 58) and rows[2].ts == datetime(2026, 5, 3, 12, 0, 0)
    assert rows[0].ts == datetime(2026, 5, 3, 13, 0, 0)
    assert rows[1].stamp == "05/03/2026 11:59:58 AM"
    prefix = iostat.read_iostat(spark, f"{root}/iostat-single-host1.log", match="prefix")
    assert prefix.count() == 5  # the partition too


def test_iostat_columns_by_name_or_position(spark):
    old = "05/03/2026 13:00:00\nDevice rrqm/s wrqm/s r/s w/s rMB/s wMB/s %util\nnvme0n1 1 2 3 4 55 66 7"
    bare = "05/03/2026 13:00:00\nnvme0n1 1 22 33 4 5 6 7 88 99 10"
    blocks = spark.createDataFrame([("iostat-a.log", old), ("iostat-b.log", bare)], "path string, value string")
    got = {r.label: (r.r_mbs, r.w_mbs) for r in iostat.parse_iostat_blocks(blocks).collect()}
    assert got == {"a": (55.0, 66.0), "b": (22.0, 88.0)}


def test_large_capture_splits_between_reports(spark, write):
    reports = [(f"05/03/2026 {h:02}:{m:02}:{s:02}", [device_row("nvme0n1", h * 3600 + m * 60 + s, 1)])
               for h in range(3) for m in range(60) for s in range(0, 60, 10)]
    root = write({"iostat-big-host1.log": capture(*reports)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = iostat.read_iostat(spark, f"{root}/iostat-big-host1.log")
        assert df.rdd.getNumPartitions() > 3
        got = [r.r_mbs for r in df.orderBy("seq").collect()]
        assert got == [float(i * 10) for i in range(1080)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("end", "part"), [("\r\n", "\r\n"), ("\n", ""), ("\n", "\n")])
def test_captures_of_any_line_end_are_read_by_splits(spark, write, end, part):
    """CRLF, or no blank line at all: stamps and the one header are carried over splits and ranges."""
    header = "Device r/s wMB/s rrqm/s %rrqm r_await rareq-sz w/s rMB/s wrqm/s %wrqm w_await wareq-sz %util"
    stamps = [f"05/03/2026 {h:02}:{m:02}:{s:02}" for h in range(2) for m in range(60) for s in range(0, 60, 10)]
    text = "Linux 6.1 (h1)" + end + header + end
    for i, stamp in enumerate(stamps):
        rows = "".join(f"{d} 1 {i * 10 + k} 2 3 4 5 6 {i}.5 7 8 9 10 11{end}" for k, d in enumerate(["nvme0n1", "nvme0n1p1", "nvme0n1", "sda"]))
        text += stamp + end + rows + part
    root = write({"x/iostat-big-host1.log": text, "y/iostat-big-host1.log": "nvme0n1 1 5 0 0 0 0 0 6 0\n" + text[:900]})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        assert logs.read_lines(spark, f"{root}/x/iostat-big-host1.log").rdd.getNumPartitions() > 10
        got = iostat.read_iostat(spark, f"{root}/*/iostat-*.log", layout="lines", span=64).orderBy("path", "seq").collect()
        unasked = iostat.read_iostat(spark, f"{root}/x/iostat-*.log")
        assert dict(unasked.dtypes)["seq"].startswith("struct") == (part == "\n")  # records only where there are some
        mine = [r for r in got if "/x/" in r.path]
        assert [(r.stamp, r.w_mbs, r.r_mbs) for r in mine] == [(s, float(i * 10 + k), i + 0.5) for i, s in enumerate(stamps) for k in (0, 2)]
        assert {(r.label, r.phase, r.host) for r in got} == {("big-host1", "big", "host1")} and mine[3].ts == datetime(2026, 5, 3, 0, 0, 10)
        first = next(r for r in got if "/y/" in r.path)
        assert (first.stamp, first.ts, first.r_mbs, first.w_mbs) == (None, None, 5.0, 6.0)
        if part == "\n":  # where records can be told apart both layouts agree
            both = [iostat.read_iostat(spark, f"{root}/x/iostat-*.log", match="prefix", layout=x).orderBy("seq") for x in ("lines", "reports")]
            a, b = ([tuple(r)[:-1] for r in df.collect()] for df in both)
            assert [r[:5] + r[5:7] for r in a] == [r[:5] + r[5:7] for r in b] and len(a) == 3 * len(stamps)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_follow_the_file_over_splits(spark, write):
    root = write({"training-a-h1.log": "".join(f"line {i}\n" for i in range(5000))})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = logs.read_lines(spark, f"{root}/training-a-h1.log")
        assert df.rdd.getNumPartitions() > 3
        assert [r.line for r in df.orderBy("line_no").collect()] == [f"line {i}" for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


TRAIN = """=== START 2026-05-01T10:00:00+00:00 ===
2026-05-01 10:00:05 | INFO | root | Param L2 norm: 2459.6220
Loading checkpoint from /opt/x/epoch_0_step_99
2026-05-01 10:01:34 | INFO | root | step 100 | loss 0.1 | tps 226.5 | mem 35.5 GiB
2026-05-01 10:01:40 | Rank 0: Done consolidating. Processed 5 unique indices in 12.36 secs.
=== END 2026-05-01T10:05:00+00:00 ===
"""


def test_training_log(spark, write):
    root = write({"training-restore-host1.log": TRAIN})
    rows = logs.read_training_log(spark, f"{root}/training-*.log").orderBy("line_no").collect()
    assert {(r.label, r.phase, r.host) for r in rows} == {("restore-host1", "restore", "host1")}
    assert (rows[3].step, rows[3].tps, rows[3].mem_gib) == (100, 226.5, 35.5)
    assert rows[4].secs == 12.36 and rows[4].step is None
    assert rows[1].l2_norm == "2459.6220" and rows[2].l2_norm is None
    assert rows[0].ts == datetime(2026, 5, 1, 10) and rows[5].ts == datetime(2026, 5, 1, 10, 5)


def test_memory_log_over_midnight(spark, write):
    line = "{} rss=1MiB hwm={}MiB used=3MiB avail=4MiB cache=5MiB shared=6MiB swap=7MiB\n"
    root = write(
        {
            "anon-rss-20260501-235900.log": "=== armed ===\n"
            + line.format("23:59:55", 10)
            + line.format("00:00:00", 47000)
            + line.format("00:00:05", 30)
            + line.format("23:59:00", 30)
            + line.format("00:10:00", 30)
        }
    )
    rows = logs.read_mem_log(spark, f"{root}/anon-rss-*.log").orderBy("seq").collect()
    assert [r.ts.strftime("%d %H:%M:%S") for r in rows] == [
        "01 23:59:55",
        "02 00:00:00",
        "02 00:00:05",
        "02 23:59:00",
        "03 00:10:00",
    ]
    assert [r.hwm_mib for r in rows] == [10, 47000, 30, 30, 30]
    assert rows[0].swap_mib == 7 and rows[0].label == "20260501-235900"


def test_process_status(spark, write):
    root = write(
        {
            "rss-single-host1.log": "no finetune.py found ts=1700000000\n"
            "State:\tS (sleeping) VmHWM:\t 4097 kB VmRSS:\t 2047 kB VmSwap:\t 0 kB  ts=1700000002\n"
        }
    )
    rows = logs.read_proc_status(spark, f"{root}/rss-*.log").orderBy("seq").collect()
    assert [(r.rss_mib, r.hwm_mib, r.swap_mib) for r in rows] == [(None, None, None), (1, 4, 0)]
    assert rows[1].ts == datetime(2023, 11, 14, 22, 13, 22) and rows[1].host == "host1"


def test_brackets(spark, write):
    root = write(
        {
            "launch-multi-host1.ts": "100.25\n",
            "end-multi-host1.ts": "150.5\n160.75\n",
            "sync-launch-multi-host1.ts": "200\n",
            "sync-end-multi-host1.ts": "542\n",
            "pillar3-host1-launch.ts": "1\n",
            "pillar3-host1-end.ts": "9\n",
        }
    )
    got = {(r.label, r.scope, r.kind): r.ts_epoch for r in logs.read_brackets(spark, f"{root}/*.ts").collect()}
    assert got == {
        ("multi-host1", "run", "launch"): 100.25,
        ("multi-host1", "run", "end"): 160.75,
        ("multi-host1", "sync", "launch"): 200.0,
        ("multi-host1", "sync", "end"): 542.0,
        ("pillar3-host1", "run", "launch"): 1.0,
        ("pillar3-host1", "run", "end"): 9.0,
    }


def test_job_files(spark, write):
    root = write(
        {
            "02-w.fio": "; note\n[global]\nioengine=libaio\ntime_based\nsize=2048g\n\n[w-16t]\nrw=write\n# x\nsize = 128g\n",
            "two.fio": "[global]\nbs=1M\n[a]\nrw=read\n[b]\nbs=4k\n",
        }
    )
    got = {(r.file, r.job): r.params for r in fio.read_job_params(spark, f"{root}/*.fio").collect()}
    assert got == {
        ("02-w", "w-16t"): {"ioengine": "libaio", "time_based": "1", "size": "128g", "rw": "write"},
        ("two", "a"): {"bs": "1M", "rw": "read"},
        ("two", "b"): {"bs": "4k"},
    }


def test_file_entries(spark, write):
    root = write({"ckpt/step_24/model/a": "12345", "ckpt/step_24/optim/b": "123", "ckpt/step_49/c": "1"})
    df = logs.read_file_entries(spark, f"{root}/ckpt")
    assert sorted((r.path.rsplit("ckpt/")[1], r.length) for r in df.collect()) == [
        ("step_24/model/a", 5),
        ("step_24/optim/b", 3),
        ("step_49/c", 1),
    ]
    assert df.columns == ["path", "length", "modified"]


def test_files_are_listed_by_tasks(spark, write):
    root = write({"c k/step_24/model/a b": "12345", "c k/step_24/optim/b": "123", "c k/d": "1", "c k/_SUCCESS": "", "c k/.x.crc": "1", "c k/é/f+g": ""})
    want = {(r.path.rsplit("c k/")[1], r.length) for r in logs.read_file_entries(spark, f"{root}/c k").collect()}
    for path in (f"{root}/c k", f"file://{root}/c k/"):
        df = logs.scan_file_entries(spark, path)
        got = df.collect()
        assert {(r.path.rsplit("c k/")[1], r.length) for r in got} == {*want, ("é/f+g", 0)} and len(got) == 4
        assert df.columns == ["path", "length", "modified"] and all(r.modified.year > 2000 for r in got)
    with pytest.raises(Exception, match="(?i)no such|not exist|non-existent|cannot get"):
        logs.scan_file_entries(spark, f"{root}/none").collect()


def test_dimensions(spark):
    assert {r.spec_metric: r.spec for r in dims.spec_df(spark, {"seqread_mbs": 7000.0}).collect()} == {
        "seqwrite_mbs": 13400.0,
        "seqread_mbs": 7000.0,
        "randread_iops": 2200000.0,
        "randwrite_iops": 2600000.0,
    }
    assert [r.test for r in dims.catalogue_df(spark).orderBy("ord").collect()].count("rand-rw-4k") == 2
    assert dims.expected_df(spark).filter(F.col("lo").isNull() & F.col("hi").isNull()).count() == 0


def test_files_of_equal_names_stay_apart(spark, write):
    """Two folders with the same file name, a blank and a plus in it."""
    mem = "10:00:0{k} rss=1MiB hwm={h}MiB used=3MiB avail=4MiB cache=5MiB shared=6MiB swap=0MiB\n"
    root = write(
        {
            f"{d} dir/{name}": text
            for d, v in (("a", 10), ("b", 20))
            for name, text in {
                "my+job 1_bw.1.log": f"1000, {v}, 0, 0, 0\n",
                "my+job 1_bw.2.log": f"1000, {v}, 0, 0, 0\n",
                "anon-rss-20260503-100000.log": mem.format(k=1, h=v) + mem.format(k=2, h=v + 1),
                "rss-my run-h1.log": f"VmHWM: {v * 1024} kB VmRSS: 1024 kB VmSwap: 0 kB  ts=17\n",
                "launch-my run.ts": f"{v}.5\n",
                "my job.json": json.dumps({"jobs": [{"read": {"bw_bytes": v}}]}),
                "pillar1-seq-read-1m.log": f"   READ: bw=1MiB/s ({v}MB/s)\n",
            }.items()
        }
    )
    bw = fio.read_bw_log(spark, f"{root}/*/*_bw.*.log")
    curve = curves.bw_curve(bw, ["folder", "job"]).collect()
    assert sorted((r.folder.rsplit("/", 1)[1], r.job, r.total) for r in curve) == [("a dir", "my+job 1", 20.0), ("b dir", "my+job 1", 40.0)]
    folder = lambda r: r.path.rsplit("/", 2)[1]
    peaks = peak_memory(logs.read_mem_log(spark, f"{root}/*/anon-rss-*.log"), ["path", "label"]).collect()
    assert sorted((folder(r), r.label, r.peak_mib) for r in peaks) == [("a dir", "20260503-100000", 11), ("b dir", "20260503-100000", 21)]
    proc = logs.read_proc_status(spark, f"{root}/*/rss-*.log").collect()
    assert sorted((folder(r), r.label, r.rss_mib, r.hwm_mib) for r in proc) == [("a dir", "my run-h1", 1.0, 10.0), ("b dir", "my run-h1", 1.0, 20.0)]
    brackets = logs.read_brackets(spark, f"{root}/*/*.ts").collect()
    assert sorted((folder(r), r.label, r.kind, r.ts_epoch) for r in brackets) == [("a dir", "my run", "launch", 10.5), ("b dir", "my run", "launch", 20.5)]
    results = fio.read_fio_json(spark, f"{root}/*/*.json").where("op = 'READ'").collect()
    assert sorted((folder(r), r.job, r.bw_bytes) for r in results) == [("a dir", "my job", 10), ("b dir", "my job", 20)]
    rates = fio.read_fio_text(spark, f"{root}/*/pillar*.log").collect()
    assert sorted((folder(r), r.pillar, r.test, r.mb_per_s) for r in rates) == [("a dir", "1", "seq-read-1m", 10.0), ("b dir", "1", "seq-read-1m", 20.0)]


def test_a_repeated_run_adds_nothing_and_half_a_run_is_not_shown(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "phase string, v int")
    path = str(tmp_path / "runs")
    for _ in range(2):
        report.write_run(rows, path, "2026-05 / first")
    report.write_run(rows.limit(1), path, "007")
    # written, but never marked as done
    rows.write.partitionBy("phase").parquet(f"{path}/rows/run=broken")
    got = report.read_runs(spark, path, rows.schema)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "007"), ("a", 1, "2026-05 / first"), ("a", 1, "2026-05 / first"), ("b", 2, "2026-05 / first")]


def test_the_package_is_shipped_whole(spark):
    """Tasks find every module in the archive that the session serves."""
    ship_package(spark)
    archive = SparkFiles.get("tidegauge.zip")
    with zipfile.ZipFile(archive) as z:
        names = set(z.namelist())
    assert {"tidegauge/__init__.py", "tidegauge/sources/logs.py", "tidegauge/operators/spread.py"} <= names
    assert spark.range(3).mapInArrow(lambda batches: batches, "id long").count() == 3
