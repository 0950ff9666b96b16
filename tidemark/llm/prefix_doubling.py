"""Substring dedup by distributed prefix doubling.

A byte is removed if a ``LENGTH``-byte string that also starts in a document of
smaller id covers it.  Positions are named by longer and longer prefixes, in two
fixed rounds; Spark deals the names to buckets, a task sorts those of its bucket, and
a position is followed only while its prefix is not yet unique and not yet long enough:

1. ``SEED``-byte prefixes.  Any two equal windows of LENGTH bytes hold the same
   smallest seed hash, so one position stands for a whole run of windows that
   share it (a segment).  A seed that a single document holds is unique: its
   windows are settled, they are not repeated.
2. Segments, up to 2 * LENGTH - SEED bytes.  A segment that a smaller document
   holds too is removed as a whole.  If all segments of a seed are equal, the
   smallest document's is settled as well.
3. LENGTH-byte windows of the segments that are still open, named by the pair of
   their halves' names: dealt and sorted again, a window that a smaller document holds is
   removed.

The smallest holder of a window is never removed in step 2 by a smaller one, so
it takes part in step 3 and the smallest ids found there are the true ones.

Names travel in packed arrays, dealt to buckets by hash.  Tasks first combine
their own: of equal names only the smallest document's goes on, and a seed with
several segments in one task goes to step 3 at once behind a single marker, so
a passage that a third of all documents holds costs a bucket one entry for each
task.  Text is not shuffled for naming.

Defined results: null and empty texts have 0 bytes; texts shorter than LENGTH
lose nothing; rows that share a doc_id do not remove each other's bytes; rows
without an id lose and remove nothing; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .groups import runs
from .staging import staged

LENGTH = 50
SEED = 24
#: names that a task holds before it combines and sends them
FLUSH = 1 << 20
#: buckets for each shuffle partition, to even out their hashing
SPREAD = 4
#: stands for the documents of a seed with several segments in one task
MARK = np.iinfo(np.int64).min
REPLY = "bucket int, packed binary, docs binary, doc long, gone binary, open binary"
EMPTY = np.zeros(0, np.uint64)


def segments(data: np.ndarray, offs: np.ndarray, sums: np.ndarray):
    """(seed, name, first window, last window, document) of every run of windows
    that share their smallest seed."""
    least = grams.sliding_min(grams.byte_gram_hashes(data, SEED), LENGTH - SEED + 1)
    n = np.diff(offs)
    has = np.flatnonzero(n >= LENGTH)
    if not len(has):
        none = np.zeros(0, np.int64)
        return EMPTY, EMPTY, none, none, none
    lo, hi = offs[has], offs[has] + n[has] - LENGTH
    valid = np.zeros(len(least) + 1, np.int8)
    valid[lo] += 1
    valid[hi + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begins[lo] = True
    first = np.flatnonzero(begins)
    doc = np.searchsorted(offs, first, "right") - 1
    last = np.empty_like(first)
    last[:-1] = first[1:] - 1
    last[-1] = hi[-1]
    last = np.minimum(last, offs[doc] + n[doc] - LENGTH)
    return least[first], grams.span_hashes(sums, first, last + LENGTH), first, last, doc


def halves(sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mid = LENGTH // 2
    return grams.span_hashes(sums, at, at + mid), grams.span_hashes(sums, at + mid, at + LENGTH)


def one_name(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return grams.mix(x * np.uint64(grams.STEP) + y)


def spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, stop], and the range each comes from."""
    n = stops - starts + 1
    which = np.repeat(np.arange(len(n)), n)
    return starts[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), which


def _ordered(x, y, doc):
    """Distinct (x, y, doc), sorted."""
    order = np.lexsort((doc, y, x))
    x, y, doc = x[order], y[order], doc[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (doc[1:] != doc[:-1])
    return x[keep], y[keep], doc[keep]


def _heads(*keys):
    """Where a new key begins in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _by_doc(doc: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(doc, kind="stable")
    doc, names = doc[order], names[order]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else []
    for lo, hi in zip(cut, [*cut[1:], len(doc)]):
        yield int(doc[lo]), names[lo:hi]


def _replies(gone: tuple, still: tuple, buckets: int) -> pa.RecordBatch:
    """Rows for documents: names whose bytes go, names that stay open."""
    rows: dict[int, list] = {}
    for k, (doc, names) in enumerate((gone, still)):
        for d, found in _by_doc(doc, names):
            rows.setdefault(d, [b"", b""])[k] = found.tobytes()
    return _rows([d % buckets for d in rows], [None] * len(rows), [None] * len(rows), list(rows),
                 [r[0] for r in rows.values()], [r[1] for r in rows.values()])


def _rows(bucket, packed, docs, doc, gone, still) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(packed, pa.binary()), pa.array(docs, pa.binary()),
         pa.array(doc, pa.int64()), pa.array(gone, pa.binary()), pa.array(still, pa.binary())],
        ["bucket", "packed", "docs", "doc", "gone", "open"])


def _packed(x, y, doc, buckets: int) -> pa.RecordBatch:
    """Names dealt to buckets; documents as numbers into a small table."""
    to = (x % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    x, y, doc, to = x[order], y[order], doc[order], to[order]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
    bucket, packed, docs = [], [], []
    for lo, hi in zip(cut, [*cut[1:], len(to)]):
        ids, number = np.unique(doc[lo:hi], return_inverse=True)
        bucket.append(int(to[lo]))
        packed.append(x[lo:hi].tobytes() + y[lo:hi].tobytes() + number.astype(np.uint32).tobytes())
        docs.append(ids.astype(np.int64).tobytes())
    none = [None] * len(bucket)
    return _rows(bucket, packed, docs, none, none, none)


def _unpacked(packed: bytes, docs: bytes):
    n = len(packed) // 20
    x, y = (np.frombuffer(packed, np.uint64, n, 8 * n * k) for k in (0, 1))
    return x, y, np.frombuffer(docs, np.int64)[np.frombuffer(packed, np.uint32, n, 16 * n)]


def _combine_segments(seed, name, doc, buckets: int) -> Iterator[pa.RecordBatch]:
    seed, name, doc = _ordered(seed, name, doc)
    head = _heads(seed, name)
    gone = (doc[~head], name[~head])
    seed, name, doc = seed[head], name[head], doc[head]
    # seeds with several segments in several documents of this task go to the windows at once
    number = np.cumsum(_heads(seed)) - 1
    count = np.bincount(number)
    start = np.flatnonzero(_heads(seed))
    several = (count > 1) & (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)) if len(start) else count > 1
    at_once = several[number]
    yield _replies(gone, (doc[at_once], name[at_once]), buckets)
    marks = seed[at_once & _heads(seed)]
    yield _packed(np.concatenate([seed[~at_once], marks]), np.concatenate([name[~at_once], np.zeros(len(marks), np.uint64)]),
                  np.concatenate([doc[~at_once], np.full(len(marks), MARK)]), buckets)


def _combine_windows(x, y, doc, buckets: int) -> Iterator[pa.RecordBatch]:
    x, y, doc = _ordered(x, y, doc)
    head = _heads(x, y)
    yield _replies((doc[~head], one_name(x[~head], y[~head])), (doc[:0], EMPTY), buckets)
    yield _packed(x[head], y[head], doc[head], buckets)


def _collected(parts: Iterator[tuple], combine, buckets: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= FLUSH:
            yield from combine(*map(np.concatenate, zip(*held)), buckets)
            held, size = [], 0
    if held:
        yield from combine(*map(np.concatenate, zip(*held)), buckets)


def _name_segments(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for part, data, offs in grams.slices(batch):
                    seed, name, _, _, doc = segments(data, offs, grams.prefix_sums(data, False))
                    yield seed, name, part.column("doc_id").to_numpy()[doc]
        yield from _collected(parts(), _combine_segments, buckets)
    return run


def _name_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                lists = batch.column("open")
                at = 0
                for part, data, offs in grams.slices(batch):
                    sums = grams.prefix_sums(data, False)
                    _, name, first, last, doc = segments(data, offs, sums)
                    still = _member(name, doc, lists.slice(at, len(part)))
                    windows, which = spread(first[still], last[still])
                    yield (*halves(sums, windows), part.column("doc_id").to_numpy()[doc[still][which]])
                    at += len(part)
        yield from _collected(parts(), _combine_windows, buckets)
    return run


def _member(name: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each name is in its document's packed lists."""
    out = np.zeros(len(name), bool)
    cut = np.searchsorted(doc, np.arange(len(lists) + 1))
    for d, packed in enumerate(lists.to_pylist()):
        if packed and cut[d] < cut[d + 1]:
            out[cut[d]:cut[d + 1]] = np.isin(name[cut[d]:cut[d + 1]], np.frombuffer(b"".join(packed), np.uint64))
    return out


def _judge(kind: str, buckets: int):
    """Sorts the names of a bucket and answers the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ("bucket",)):
            g = g.combine_chunks()
            answered = g.filter(pc.is_valid(g["doc"]))
            yield from answered.to_batches()
            parts = [_unpacked(p, d) for p, d in zip(g["packed"].to_pylist(), g["docs"].to_pylist()) if p]
            if not parts:
                continue
            x, y, doc = _ordered(*map(np.concatenate, zip(*parts)))
            head = _heads(x, y)
            if kind == "windows":
                yield _replies((doc[~head], one_name(x[~head], y[~head])), (doc[:0], EMPTY), buckets)
                continue
            gone = (doc[~head & (doc != MARK)], y[~head & (doc != MARK)])
            x, y, doc = x[head], y[head], doc[head]
            start = np.flatnonzero(_heads(x))
            number = np.cumsum(_heads(x)) - 1
            several = (np.bincount(number) > 1) & (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))
            still = several[number] & (doc != MARK)
            yield _replies(gone, (doc[still], y[still]), buckets)
    return run


def _answers(named: DataFrame, kind: str, parts: int) -> DataFrame:
    """``(doc, gone, open)``: packed names for each document."""
    buckets = parts * SPREAD
    judged = named.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(kind, buckets), REPLY)
    return judged.where((F.length("gone") > 0) | (F.length("open") > 0)).select("doc", "gone", "open")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes of the named segments and windows."""
    for batch in batches:
        at = 0
        for part, data, offs in grams.slices(batch):
            gone = np.zeros(len(data) + 1, np.int64)
            if any(batch.column("gone").slice(at, len(part)).to_pylist()) or any(batch.column("windows").slice(at, len(part)).to_pylist()):
                sums = grams.prefix_sums(data, False)
                _, name, first, last, doc = segments(data, offs, sums)
                whole = _member(name, doc, batch.column("gone").slice(at, len(part)))
                np.add.at(gone, first[whole], 1)
                np.add.at(gone, last[whole] + LENGTH, -1)
                still = _member(name, doc, batch.column("open").slice(at, len(part))) & ~whole
                windows, which = spread(first[still], last[still])
                hit = windows[_member(one_name(*halves(sums, windows)), doc[still][which], batch.column("windows").slice(at, len(part)))]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + LENGTH, -1)
            mask = np.cumsum(gone[:-1]) > 0
            n, removed, spans, kept, texts = [], [], [], [], []
            for lo, hi in zip(offs[:-1], offs[1:]):
                m = mask[lo:hi]
                rest = data[lo:hi][~m].tobytes()
                n.append(int(hi - lo))
                removed.append(int(m.sum()))
                spans.append(int((m[1:] & ~m[:-1]).sum() + (m[0] if hi > lo else 0)))
                kept.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            at += len(part)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per row;
    ``kept`` holds the remaining bytes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = base.where("doc_id IS NOT NULL").mapInArrow(_name_segments(parts * SPREAD), REPLY)
    first = staged(_answers(named, "segments", parts), "segments")
    still = first.where(F.length("open") > 0).groupBy("doc").agg(F.collect_list("open").alias("open"))
    texts = base.join(still, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "open")
    second = staged(_answers(texts.mapInArrow(_name_windows(parts * SPREAD), REPLY), "windows", parts), "windows")
    told = first.select("doc", "gone", "open", F.lit(None).cast("binary").alias("windows")).unionByName(
        second.select("doc", F.lit(None).cast("binary").alias("gone"), F.lit(None).cast("binary").alias("open"), F.col("gone").alias("windows")))
    told = told.groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in ("gone", "open", "windows")])
    cut = base.join(told, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "gone", "open", "windows")
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).drop("kept")
