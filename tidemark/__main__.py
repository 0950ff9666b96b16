"""Command line: run a named view over flows/sessions record folders, generate
records, or summarise GC logs.

  python -m tidemark run VIEW --flows DIR [--sessions DIR] [--out DIR] [--stream [--work DIR]]
  python -m tidemark generate --minutes N --out DIR [--lateness-secs S]
  python -m tidemark gc-report PATH
"""

from __future__ import annotations

import argparse
import json
import os
import time
import uuid

from pyspark.sql import functions as F


def _spark(args):
    from .session import build_session
    return build_session(args.master, args.partitions)


def cmd_run(args):
    from .plans.views import BATCH, STREAM, stream_inputs
    from .session import scratch_path
    from .sources import csv
    from .streaming import steps
    spark = _spark(args)
    opts = {"pattern": args.pattern, "sep": args.sep}
    t0 = time.perf_counter()
    if not args.stream:
        f = csv.read_flows(spark, args.flows, **opts)
        s = csv.read_sessions(spark, args.sessions, **opts) if args.sessions else None
        df = BATCH[args.view](f, s)
        if args.out:
            df.write.mode("overwrite").option("header", "true").csv(args.out)
        else:
            df.write.format("noop").mode("overwrite").save()
    else:
        f = csv.read_flows(spark, args.flows, stream=True, max_files_per_trigger=args.files, **opts)
        s = csv.read_sessions(spark, args.sessions, stream=True, max_files_per_trigger=args.files, **opts) \
            if args.sessions else None
        work = args.work or scratch_path(spark, f"run-{uuid.uuid4().hex}")
        df = steps.run(spark, STREAM[args.view], stream_inputs(args.view, f, s), work + "/out", work + "/work",
                       delay=args.delay, idle=args.idle)
        if args.out:
            df.write.mode("overwrite").option("header", "true").csv(args.out)
    secs = time.perf_counter() - t0
    n_in = csv.read_flows(spark, args.flows, **opts).count()
    print(json.dumps({"view": args.view, "mode": "stream" if args.stream else "batch",
                      "input_rows": n_in, "seconds": round(secs, 3),
                      "rows_per_sec": round(n_in / secs) if secs else None}))


def cmd_generate(args):
    from .sources import generator
    from .sources.sinks import write_rotated
    spark = _spark(args)
    secs = args.minutes * 60
    write_rotated(generator.gen_flows(spark, secs, lateness_secs=args.lateness_secs,
                                      seed=args.seed), os.path.join(args.out, "flows"),
                  args.records_per_file)
    write_rotated(generator.gen_sessions(spark, secs, lateness_secs=args.lateness_secs,
                                         seed=args.seed), os.path.join(args.out, "sessions"),
                  args.records_per_file)


def cmd_gc_report(args):
    from .operators import logs
    spark = _spark(args)
    out = logs.gc_report(logs.read_log_lines(spark, args.path))
    print(logs.GC_HEADER)
    for r in out.orderBy("file", "line_no").select(F.coalesce("line", "note")).toLocalIterator():
        print(r[0])


def main(argv=None):
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--master", default=None)
    p.add_argument("--partitions", type=int, default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("view")
    r.add_argument("--flows", required=True)
    r.add_argument("--sessions")
    r.add_argument("--out")
    r.add_argument("--stream", action="store_true")
    r.add_argument("--files", type=int, default=None, help="files per micro-batch")
    r.add_argument("--work", default=None, help="state of a stream; a run over it goes on where one stopped")
    r.add_argument("--delay", default="30 seconds", help="how late rows may be")
    r.add_argument("--idle", default=None, help="how far a silent input may hold back the other")
    r.add_argument("--pattern", default=None)
    r.add_argument("--sep", default=",")
    r.set_defaults(fn=cmd_run)
    g = sub.add_parser("generate")
    g.add_argument("--minutes", type=int, default=60)
    g.add_argument("--out", required=True)
    g.add_argument("--lateness-secs", type=float, default=0)
    g.add_argument("--records-per-file", type=int, default=1_000_000)
    g.add_argument("--seed", type=int, default=42)
    g.set_defaults(fn=cmd_generate)
    c = sub.add_parser("gc-report")
    c.add_argument("path")
    c.set_defaults(fn=cmd_gc_report)
    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main()
