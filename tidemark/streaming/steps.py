"""Streams as a row of batch steps over carried tables.

A window over a stream needs rows from before the micro-batch, which ``OVER``
cannot reach and for which state operators keep one entry per row.  Here each
micro-batch is a step (``foreachBatch``): its rows are appended to a log, the
watermark moves from ``lo`` to ``hi``, and the view is an ordinary batch plan that
returns the rows whose time lies in ``[lo, hi)``, reading from the logs as far back
as its frames reach.  Catalyst plans it, Spark's shuffles spread and spill it, and
a hot key is split as in batch.  What was put together once (a joined row, the
partials of a closed minute) is appended to a log of its own and read, not made
again.

* The watermark is the newest event time of each input less ``delay``, the least of
  all inputs.  With ``idle``, an input that is silent is taken to be at most that
  much (in event time) behind the newest row of all, so it cannot hold the others.
* A row behind the watermark of the steps before it, or without a time, is late: it
  goes to the side output ``<out>_late`` and to nothing else.  Kept and late rows
  together are the input.
* Logs, outputs and commit records are Parquet and text folders named by batch id.
  A step that is run again overwrites its own folders, and a step whose commit
  record exists is not run again: every row comes out once.  Folders that no frame
  can reach any more are removed one step later; many small ones are merged.
* ``finish`` is the end of a bounded input: a last step up to the newest row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.frames import micros
from ..session import prepare

#: folders of a log that are read side by side before they are merged
MERGE = 64


@dataclass(frozen=True)
class View:
    """A view as steps: ``step`` gets a :class:`Slice` and returns the rows that are
    final; ``reach`` tells how far before ``lo`` it reads each input (micros)."""

    step: Callable[["Slice"], DataFrame]
    reach: dict[str, int] = field(default_factory=dict)


class Slice:
    """What a step sees: rows of inputs and carried tables by time, in microseconds."""

    def __init__(self, job: "Steps", batch: int, lo: int, hi: int, last: bool):
        self.job, self.batch, self.lo, self.hi, self.last = job, batch, lo, hi, last
        self.spark = job.spark

    def rows(self, name: str, since: int, before: int) -> DataFrame:
        return self.job.read(name, since, before)

    def fresh(self, name: str) -> DataFrame:
        return self.rows(name, self.lo, self.hi)

    def floor(self, width: int) -> tuple[int, int]:
        """``[lo, hi)`` in whole units of ``width``; the last step takes the open one."""
        up = -(-self.hi // width) if self.last else self.hi // width
        return self.lo // width * width, up * width

    def known(self, name: str) -> bool:
        return name in self.job.state["schemas"]

    def keep(self, name: str, df: DataFrame, time: Column, reach: int) -> None:
        """Append rows to the carried table ``name``; later steps read them up to
        ``reach`` before their ``lo``."""
        self.job.append(name, df, time, reach, self.batch)

    def replace(self, name: str, df: DataFrame) -> None:
        """Put ``df`` in place of the small carried table ``name``."""
        self.job.replace(name, df, self.batch)

    def table(self, name: str) -> DataFrame | None:
        return self.job.read(name, None, None) if self.known(name) else None


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def _numbered(base: str, batch: int) -> str:
    return f"{base.rstrip('/')}/batch={batch:012d}"


class Steps:
    """Runs a view's steps; its whole state is the last commit record."""

    def __init__(self, spark: SparkSession, view: View, inputs: dict[str, tuple[T.StructType, str]],
                 out: str, work: str, delay="30 seconds", idle=None):
        self.spark, self.view, self.out, self.work = prepare(spark), view, out.rstrip("/"), work.rstrip("/")
        self.names, self.schemas = list(inputs), {n: s for n, (s, _) in inputs.items()}
        self.times = {n: t for n, (_, t) in inputs.items()}
        self.delay, self.idle = micros(delay), None if idle is None else micros(idle)
        self.state = self._load() or {"batch": -1, "hi": None, "last": False, "newest": {}, "live": {}, "schemas": {},
                                      "reach": {}, "dead": []}

    # -- input

    def tagged(self, inputs: dict[str, DataFrame]) -> DataFrame:
        """All inputs as one DataFrame: the number of the input, the time, the row."""
        def one(k: int, name: str) -> DataFrame:
            df = inputs[name]
            return df.select(F.lit(k).alias("_src"), F.unix_micros(F.col(self.times[name]).cast("timestamp")).alias("_us"), *[
                F.struct(*df.columns).alias(f"_{n}") if n == name else F.lit(None).cast(self.schemas[n]).alias(f"_{n}")
                for n in self.names])
        return reduce(DataFrame.unionByName, [one(k, n) for k, n in enumerate(self.names)])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.state["batch"]:
            return  # committed before the query was stopped
        if self.state["last"]:
            raise ValueError("the stream was finished and takes no more rows")
        lo = self.state["hi"]
        late = F.col("_us").isNull() | (F.lit(False) if lo is None else F.col("_us") < lo)
        x, seen = batch.withColumn("_late", late), Observation()
        kept = ~F.col("_late")
        figures = [F.count_if("_late").alias("late")]
        for k, n in enumerate(self.names):
            ours = F.when(kept & (F.col("_src") == k), F.col("_us"))
            figures += [F.min(ours).alias(f"min_{n}"), F.max(ours).alias(f"max_{n}")]
        folder = _numbered(self.work + "/input", batch_id)
        x.observe(seen, *figures).write.mode("overwrite").parquet(folder)
        found = seen.get
        for n in self.names:
            if found[f"max_{n}"] is not None:
                self.state["live"].setdefault(n, []).append([folder, found[f"min_{n}"], found[f"max_{n}"]])
                self.state["newest"][n] = max(found[f"max_{n}"], self.state["newest"].get(n, found[f"max_{n}"]))
        if found["late"]:
            self._write_late(folder, batch_id)
        self._step(batch_id, self._watermark(), False)

    def finish(self) -> None:
        """The input has ended: a last step gives out all that is held."""
        if not self.state["last"]:
            newest = self.state["newest"].values()
            self._step(self.state["batch"] + 1, max(newest) + 1 if newest else 0, True)

    def _watermark(self) -> int | None:
        newest = self.state["newest"]
        if not newest or self.idle is None and len(newest) < len(self.names):
            return self.state["hi"]
        top = max(newest.values())
        at = [newest.get(n, top - self.idle if self.idle is not None else None) for n in self.names]
        if self.idle is not None:
            at = [max(t, top - self.idle) for t in at]
        mark = min(at) - self.delay
        return mark if self.state["hi"] is None else max(mark, self.state["hi"])

    def _write_late(self, folder: str, batch_id: int) -> None:
        x = self.spark.read.schema(self._staged_schema()).parquet(folder).where("_late")
        for k, n in enumerate(self.names):
            x.where(F.col("_src") == k).select(f"_{n}.*").write.mode("overwrite") \
                .parquet(_numbered(f"{self.out}_late/{n}", batch_id))

    # -- steps

    def _step(self, batch: int, hi: int | None, last: bool) -> None:
        state = self.state
        lo = state["hi"]
        if lo is None and hi is not None:
            # all rows so far are final or held: the first step begins with the oldest
            lo = min([f[1] for n in self.names for f in state["live"].get(n, [])], default=hi)
            lo = min(lo, hi)
        if hi is not None and (hi > lo or last):
            done = self.view.step(Slice(self, batch, lo, hi, last))
            if done is not None:
                done.write.mode("overwrite").parquet(_numbered(self.out, batch))
            state["hi"] = hi
        state["batch"], state["last"] = batch, last
        dead, state["dead"] = state["dead"], []
        if state["hi"] is not None:
            for n in list(state["live"]):
                self._prune(n, batch)
        self._commit()
        held = {f[0] for live in state["live"].values() for f in live}
        for path in set(dead) - held:
            remove(self.spark, path)

    def _reach(self, name: str) -> int:
        return self.view.reach.get(name, 0) if name in self.names else self.state["reach"][name]

    def _prune(self, name: str, batch: int) -> None:
        if self._reach(name) is None:
            return
        live, since = self.state["live"][name], self.state["hi"] - self._reach(name)
        keep = [f for f in live if f[2] >= since]
        if len(keep) > MERGE:
            path, seen = _numbered(f"{self.work}/merged-{name}", batch), Observation()
            self._raw(name, keep).where(F.col("_us") >= since) \
                .observe(seen, F.min("_us").alias("lo"), F.max("_us").alias("hi")).write.mode("overwrite").parquet(path)
            found = seen.get
            keep = [[path, found["lo"], found["hi"]]] if found["hi"] is not None else []
        still = {f[0] for n, x in self.state["live"].items() if n != name for f in x} | {f[0] for f in keep}
        self.state["dead"] += [f[0] for f in live if f[0] not in still]
        self.state["live"][name] = keep

    # -- logs

    def _staged_schema(self) -> T.StructType:
        out = T.StructType().add("_src", T.IntegerType()).add("_us", T.LongType())
        for n in self.names:
            out = out.add(f"_{n}", self.schemas[n])
        return out.add("_late", T.BooleanType())

    def _raw(self, name: str, folders: list) -> DataFrame:
        read = self.spark.read.schema(
            self._staged_schema() if name in self.names else T.StructType.fromJson(json.loads(self.state["schemas"][name])))
        x = read.parquet(*[f[0] for f in folders])
        return x.where(~F.col("_late") & (F.col("_src") == self.names.index(name))) if name in self.names else x

    def read(self, name: str, since: int | None, before: int | None) -> DataFrame:
        live = self.state["live"].get(name, [])
        if since is not None:
            live = [f for f in live if f[2] >= since and f[1] < before]
        if not live:
            own = self.schemas[name] if name in self.names else T.StructType(
                [f for f in T.StructType.fromJson(json.loads(self.state["schemas"][name])) if f.name != "_us"])
            return self.spark.createDataFrame([], own)
        x = self._raw(name, live)
        if since is not None:
            x = x.where((F.col("_us") >= since) & (F.col("_us") < before))
        return x.select(f"_{name}.*") if name in self.names else x.drop("_us")

    def append(self, name: str, df: DataFrame, time: Column, reach: int, batch: int) -> None:
        path, seen = _numbered(f"{self.work}/{name}", batch), Observation()
        x = df.withColumn("_us", time)
        x.observe(seen, F.min("_us").alias("lo"), F.max("_us").alias("hi")).write.mode("overwrite").parquet(path)
        found = seen.get
        self.state["schemas"][name], self.state["reach"][name] = x.schema.json(), reach
        if found["hi"] is not None:
            self.state["live"].setdefault(name, []).append([path, found["lo"], found["hi"]])

    def replace(self, name: str, df: DataFrame, batch: int) -> None:
        path = _numbered(f"{self.work}/{name}", batch)
        x = df.withColumn("_us", F.lit(0).cast("long"))
        x.write.mode("overwrite").parquet(path)
        self.state["dead"] += [f[0] for f in self.state["live"].get(name, [])]
        self.state["live"][name] = [[path, 0, 0]]
        self.state["schemas"][name], self.state["reach"][name] = x.schema.json(), None

    # -- commit records

    def _commit(self) -> None:
        # the record of the step before stays until this one is whole
        base, batch = self.work + "/commits", self.state["batch"]
        write_whole(self.spark, f"{base}/{batch:012d}.json", json.dumps(self.state))
        if batch >= 2:
            remove(self.spark, f"{base}/{batch - 2:012d}.json")

    def _load(self) -> dict | None:
        base = self.work + "/commits"
        if not exists(self.spark, base):
            return None
        records = [json.loads(r.value) for r in self.spark.read.option("pathGlobFilter", "*.json").text(base).collect()]  # two at most
        return max(records, key=lambda r: r["batch"], default=None)


Inputs = dict[str, tuple[DataFrame, str]]


def start(spark: SparkSession, view: View, inputs: Inputs, out: str, work: str, *, delay="30 seconds", idle=None,
          trigger: dict | None = None) -> tuple[StreamingQuery, Steps]:
    """Start ``view`` over streaming ``inputs`` (name -> DataFrame and its time column).
    ``work`` holds logs, commit records and the checkpoint; a restart over it goes on."""
    job = Steps(spark, view, {n: (df.schema, t) for n, (df, t) in inputs.items()}, out, work, delay, idle)
    rows = job.tagged({n: df for n, (df, _) in inputs.items()})
    query = (rows.writeStream.foreachBatch(job).option("checkpointLocation", job.work + "/checkpoint")
             .trigger(**(trigger or {"availableNow": True})).start())
    return query, job


def run(spark: SparkSession, view: View, inputs: Inputs, out: str, work: str, **options) -> DataFrame:
    """A bounded run: all input there is, then the last step; the output as a table."""
    query, job = start(spark, view, inputs, out, work, **options)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    job.finish()
    return output(spark, out)


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def late(spark: SparkSession, out: str, name: str, schema: T.StructType) -> DataFrame:
    """The late rows of input ``name``."""
    path = f"{out.rstrip('/')}_late/{name}"
    return spark.read.parquet(path).drop("batch") if exists(spark, path) else spark.createDataFrame([], schema)
