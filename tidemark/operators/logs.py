"""Reports over run telemetry: GC counter logs, run logs, benchmark tables.

Each report reads many log files with Spark; work is split by file (a log belongs
to one process run, and its lines are ordered within it) and by byte range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GIB_KIB = 1024 * 1024      # jstat capacities are KiB; reports show GiB

# fixed values: jstat -gc -t field positions (1-based) used by the report
GC_FIELDS = {"time": 1, "s0c": 2, "s1c": 3, "s0u": 4, "s1u": 5, "ec": 6, "eu": 7, "oc": 8,
             "ou": 9, "ygc": 14, "ygct": 15, "fgc": 16, "fgct": 17, "gct": 18}

# fixed value: the report's header
GC_HEADER = "Timestamp,HeapUsedGib,HeapCurrentGib,YGC,YGCT,FGC,FGCT,GCT,DeltaGC%,GC%"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line) for every line with text under ``path``.

    A file is read in byte ranges by as many tasks as its size asks for.  ``block`` is
    where a line's range begins; lines are numbered in their range in the order they
    are read, and go on from the lines of the ranges before (one row per range)."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                      F.col("_metadata.file_block_start").alias("block"),
                                      F.monotonically_increasing_id().alias("_read"), F.col("value").alias("line"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("_read"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy("file", "block").agg(F.count("*").alias("_n")) \
        .select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    out = df.withColumn("_place", place).join(start, ["file", "block"])
    return out.select("file", "block", (F.col("_start") + F.col("_place") - 1).alias("line_no"), "line") \
              .filter(F.length(F.trim("line")) > 0)


def _carried(rows: DataFrame, value, fold) -> DataFrame:
    """Per (file, block): ``fold`` of ``value`` over all earlier blocks of the file."""
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(value.alias("_v"))
    return per.select("_file", "_block", fold("_v").over(earlier).alias("_before"))


def _with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.join(carry, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")), "left") \
        .drop("_file", "_block")


def gc_report(lines: DataFrame) -> DataFrame:
    """GC summary of ``jstat -gc -t`` logs, one row per sample in which the
    collection count rose above every earlier sample of the file.

    Input: (file, block, line_no, line).  A file's running maximum and last kept sample
    are found per block of the file and carried from block to block, so a long log is
    not one task's.  Output per kept sample: the whole-second
    time, heap used / current in GiB, collection counts and times, the share
    of time spent collecting since the previous kept sample (``delta_gc_pct``)
    and since the start (``gc_pct``), and ``line``: the CSV text of the row.
    ``#`` context lines pass through as ``note`` rows."""
    fields = F.split(F.trim("line"), r"\s+")
    x = lines.withColumn("_f", fields).withColumn("_first", F.col("_f")[0])
    notes = x.filter(F.col("_first") == "#").select("file", "line_no",
                                                   F.col("line").alias("line"))
    data = x.filter((F.col("_first") != "#") & (F.col("_first") != "Timestamp"))
    num = {k: F.col("_f")[i - 1].cast("double") for k, i in GC_FIELDS.items()}
    data = data.select("file", "block", "line_no",
                       F.floor(num["time"]).cast("bigint").alias("timestamp"),
                       ((num["s0u"] + num["s1u"] + num["eu"] + num["ou"]) / GIB_KIB)
                       .alias("heap_used_gib"),
                       ((num["s0c"] + num["s1c"] + num["ec"] + num["oc"]) / GIB_KIB)
                       .alias("heap_current_gib"),
                       num["ygc"].cast("bigint").alias("ygc"), num["ygct"].alias("ygct"),
                       num["fgc"].cast("bigint").alias("fgc"), num["fgct"].alias("fgct"),
                       num["gct"].alias("gct"))
    gc = F.col("ygc") + F.col("fgc")
    order = Window.partitionBy("file", "block").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the last emitted count is the maximum count of all earlier samples
    data = _with_carry(data, _carried(data, F.max(gc), F.max))
    kept = data.withColumn("_prev_max", F.coalesce(F.greatest(F.max(gc).over(before), "_before"), F.lit(-1))) \
               .filter(gc > F.col("_prev_max")).drop("_before")
    # the sample kept before: of the same block, or the last of the blocks before
    kept = _with_carry(kept, _carried(kept, F.max_by(F.struct("gct", "timestamp"), "line_no"),
                                      lambda c: F.last(c, ignorenulls=True)))
    last = F.coalesce(F.lag(F.struct("gct", "timestamp")).over(order), F.col("_before"))
    last_gct = F.coalesce(last["gct"], F.lit(0.0))
    last_time = F.coalesce(last["timestamp"], F.lit(0))
    dt = F.col("timestamp") - last_time
    kept = kept.withColumn("delta_gc_pct", F.when(dt == 0, F.lit(0.0))
                           .otherwise((F.col("gct") - last_gct) * 100 / dt)) \
               .withColumn("gc_pct", F.when(F.col("timestamp") == 0, F.lit(0.0))
                           .otherwise(F.col("gct") * 100 / F.col("timestamp")))
    text = F.format_string("%d,%.3f,%.3f,%d,%.2f,%d,%.2f,%.2f,%6.3f%%,%6.3f%%",
                           "timestamp", "heap_used_gib", "heap_current_gib", "ygc", "ygct",
                           "fgc", "fgct", "gct", "delta_gc_pct", "gc_pct")
    rows = kept.select("file", "line_no", "timestamp", "heap_used_gib", "heap_current_gib",
                       "ygc", "ygct", "fgc", "fgct", "gct", "delta_gc_pct", "gc_pct",
                       text.alias("line"), F.lit(None).cast("string").alias("note"))
    return rows.unionByName(notes.select("file", "line_no",
                                         F.col("line").alias("note")),
                            allowMissingColumns=True)


# --- run logs ---------------------------------------------------------------

# one per-second meter row of each engine's client output, and the memory
# lines of the harness (formats of the upstream run logs)
_RATE_S = (r"^'([0-9-]+ [0-9:.]+)','(\d+)','\d+','\d+','(\d+) \| ([0-9:.]*) \| ([0-9:.]*)',"
           r"'(-?\d+)'")
_RATE_F = r"^\|\s*\+I\s*\|\s*([0-9-]+ [0-9:.]+)\s*\|\s*(\d+)\s*\|\s*([0-9-]+ [0-9:.]+)\s*\|"
_PEAK = r"^(\w+)\s+([0-9.]+) Gb\s*$"
_WALL = r"rows selected \(([0-9.]+) seconds\)"


def run_log_summary(lines: DataFrame) -> DataFrame:
    """Per run log: metered seconds, rows, mean and peak rows per second, peak
    memory (GiB, largest process) and the client's wall time if printed."""
    s_rps = F.regexp_extract("line", _RATE_S, 2)
    f_rps = F.regexp_extract("line", _RATE_F, 2)
    rps = F.when(s_rps != "", s_rps).when(f_rps != "", f_rps).cast("bigint")
    peak = F.when(F.regexp_extract("line", _PEAK, 2) != "",
                  F.regexp_extract("line", _PEAK, 2)).cast("double")
    wall = F.when(F.regexp_extract("line", _WALL, 1) != "",
                  F.regexp_extract("line", _WALL, 1)).cast("double")
    x = lines.select("file", rps.alias("rps"), peak.alias("peak"), wall.alias("wall"))
    return x.groupBy("file").agg(
        F.count("rps").alias("seconds"),
        F.coalesce(F.sum("rps"), F.lit(0)).alias("rows"),
        F.round(F.avg("rps"), 1).alias("mean_rps"),
        F.max("rps").alias("peak_rps"),
        F.max("peak").alias("peak_mem_gb"),
        F.max("wall").alias("wall_secs"))


# --- benchmark comparison ------------------------------------------------------

def benchmark_ratio(results: DataFrame, base: str, other: str) -> DataFrame:
    """Per view: rows/s, cores and rows/s per core of two systems, and the
    ratios ``other / base`` of both.

    Input columns: view, system, rps, cores."""
    per = results.withColumn("rps_per_core", F.col("rps") / F.col("cores"))
    piv = per.groupBy("view").pivot("system", [base, other]).agg(
        F.first("rps").alias("rps"), F.first("cores").alias("cores"),
        F.first("rps_per_core").alias("rps_per_core"))
    b, o = f"`{base}_rps`", f"`{other}_rps`"
    return piv.select(
        "view",
        F.col(b).alias("base_rps"), F.col(o).alias("other_rps"),
        F.col(f"`{base}_rps_per_core`").alias("base_rps_per_core"),
        F.col(f"`{other}_rps_per_core`").alias("other_rps_per_core"),
        F.round(F.col(o) / F.col(b), 1).alias("rps_ratio"),
        F.round(F.col(f"`{other}_rps_per_core`") / F.col(f"`{base}_rps_per_core`"), 1)
        .alias("rps_per_core_ratio"))
