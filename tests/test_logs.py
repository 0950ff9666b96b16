import os
import shutil

from tidemark.operators import logs

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


def _lines(spark, tmp, *files):
    for name, text in files:
        with open(os.path.join(tmp, name), "w") as fh:
            fh.write(text)
    return logs.read_log_lines(spark, tmp)


def test_gc_report_golden(spark, tmpdir_path):
    shutil.copy(os.path.join(HERE, "jstat_gc.log"), tmpdir_path)
    out = logs.gc_report(logs.read_log_lines(spark, tmpdir_path))
    got = [r.line for r in out.filter("line is not null").orderBy("line_no").collect()]
    want = open(os.path.join(HERE, "jstat_gc.expected")).read().splitlines()
    assert got == want


def test_a_long_log_is_read_by_many_tasks(spark, tmpdir_path):
    """Ranges of 300 bytes: the same lines, numbers and report."""
    shutil.copy(os.path.join(HERE, "jstat_gc.log"), tmpdir_path)
    text = open(os.path.join(HERE, "jstat_gc.log")).read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = logs.read_log_lines(spark, tmpdir_path)
        assert lines.select("block").distinct().count() > 4
        assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == \
            [(k, x) for k, x in enumerate(text.split("\n")) if x.strip()]
        out = logs.gc_report(lines).filter("line is not null").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line for r in out] == open(os.path.join(HERE, "jstat_gc.expected")).read().splitlines()


def test_gc_report_repeat_reset_and_notes(spark, tmpdir_path):
    hdr = open(os.path.join(HERE, "jstat_gc.log")).read().splitlines()[:4]
    row = hdr[3]
    # same count again (dropped), a context line, then a counter reset that is
    # suppressed until the old maximum is exceeded
    reset = row.replace("   188   13.722", "     5    0.100").replace("13.722\n", "0.100")
    parts = reset.split()
    parts[-1] = "0.100"
    reset = "  ".join(parts)
    higher = row.replace("   188   13.722", "   200   14.000")
    parts = higher.split()
    parts[-1] = "14.000"
    parts[0] = "90.2"
    higher = "  ".join(parts)
    text = "\n".join(hdr + [row, "# restarted", reset, higher]) + "\n"
    out = logs.gc_report(_lines(spark, tmpdir_path, ("a.log", text)))
    rows = out.orderBy("line_no").collect()
    counts = [r.ygc for r in rows if r.line is not None]
    assert counts == [0, 49, 188, 200]
    assert [r.note for r in rows if r.note is not None] == ["# restarted"]


def test_run_log_summary(spark, tmpdir_path):
    s_log = "\n".join([
        "'ROWTIME','RPS','BOUNDS','TIMEOUTS','CUMULATIVE_ROWS','ROWTIME_LOW','ROWTIME_HIGH','TestSecs'",
        "'2031-05-02 07:10:01.0','3','0','0','3 | 00:00:00.0 | 00:00:00.0','0'",
        "'2031-05-02 07:10:02.0','1200','0','0','1203 | 00:00:00.004 | 00:01:10.250','0'",
        "'2031-05-02 07:10:03.0','87000','0','0','88203 | 00:01:10.260 | 00:09:30.125','1'",
        "3 rows selected (4.25 seconds)",
    ])
    f_log = "\n".join([
        "| +I | 2031-06-09 18:00:11.000 |                 1500 |        2031-01-01 00:00:07.100 |           0 |",
        "| +I | 2031-06-09 18:00:12.000 |                92000 |        2031-01-01 00:02:40.900 |           1 |",
        "Peak RAM usage (VmHWM)",
        "TaskManager  2.125 Gb",
        "JobManager  0.375 Gb",
    ])
    out = logs.run_log_summary(_lines(spark, tmpdir_path, ("s.log", s_log), ("f.log", f_log)))
    got = {os.path.basename(r.file): r for r in out.collect()}
    s, f = got["s.log"], got["f.log"]
    assert (s.seconds, s.rows, s.peak_rps, s.wall_secs) == (3, 88203, 87000, 4.25)
    assert (f.seconds, f.rows, f.peak_rps, f.peak_mem_gb) == (2, 93500, 92000, 2.125)


def test_benchmark_ratio(spark):
    rows = [("projection_view", "F", 154000.0, 2.0), ("projection_view", "S", 881000.0, 1.9),
            ("agg_view", "F", 44000.0, 9.0), ("agg_view", "S", 452000.0, 1.6)]
    df = spark.createDataFrame(rows, "view string, system string, rps double, cores double")
    got = {r.view: r for r in logs.benchmark_ratio(df, "F", "S").collect()}
    assert got["projection_view"].rps_ratio == 5.7
    assert got["agg_view"].rps_ratio == 10.3
    assert got["agg_view"].rps_per_core_ratio == round((452000 / 1.6) / (44000 / 9.0), 1)
