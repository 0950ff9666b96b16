"""Importance resampling of documents towards a target distribution.

Features are runs of 1 to ``longest`` words, hashed into ``buckets`` buckets.  The
gain of a bucket, the log ratio of its smoothed shares in the target and in the
corpus, is one entry of an array of fixed length, and a document's weight is the
sum of the entries of its features.  Gumbel noise drawn from a hash of its id is
added, and the documents of highest score are drawn, which samples without
replacement in proportion to the weights.

Corpus counts come from all texts; a task adds its own up before the shuffle, so at
most ``buckets`` rows leave it.  The scores are staged.  A quantile sketch brackets
the lowest score drawn; exact counts of rows outside confirm the bracket or widen
it, and only the rows of the bracket are sorted to find the cutoff.  The drawn rows
are then numbered by ranges of the order.

Defined results: null and empty texts have no features, weight 0, and are never
drawn; texts of any length are read whole; rows that share an id share their noise,
are judged one by one and numbered in any order among equals; rows without an id
take the noise of an empty id and come after all others of their score; with an
empty target all gains follow from the corpus alone, and an empty table gives an
empty one.  Only doc_id and text are read; other columns can be carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import grams, ranking
from .staging import staged

BUCKETS = 10_000
LONGEST = 1
#: documents of fewer words are not drawn
LEAST_WORDS = 20
#: percent of the others that are drawn
SHARE = 10
SEED = 2024
#: noise and gains are whole thousandths
UNIT = 1000
#: words of more bytes are hashed one by one
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc_states(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states (before the last inversion) after the bytes of each span."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    s, n, c = starts[order], size[order], state[order]
    short = int(np.searchsorted(-n, -LONG_WORD, "left"))
    for k in range(short):
        span = data[s[k]:s[k] + n[k]].tobytes()
        c[k] = zlib.crc32(span, int(c[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(n[short]) if short < len(n) else 0):
        upto = int(np.searchsorted(-n, -j, "left"))
        part = c[short:upto]
        c[short:upto] = CRC[(part ^ data[s[short:upto] + j]) & 0xFF] ^ (part >> 8)
    out = np.empty_like(c)
    out[order] = c
    return out


def buckets_of(data: np.ndarray, offs: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, number of its document) of a slice of texts."""
    starts, ends, first = grams.word_spans(data, offs, grams.ALNUM)
    low = grams.LOWER[data]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    word = np.arange(len(starts))
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    found, docs = [], []
    for run in range(longest):
        if run:
            keep = (word + run < len(starts)) & (doc[np.minimum(word + run, len(doc) - 1)] == doc[word])
            word, state = word[keep], state[keep]
            state = CRC[(state ^ np.uint32(32)) & 0xFF] ^ (state >> 8)
        if not len(word):
            break
        state = crc_states(state, low, starts[word + run], ends[word + run])
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        docs.append(doc[word])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(docs)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: one array of ``buckets`` counts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offs in grams.slices(batch):
                total += np.bincount(buckets_of(data, offs, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    size = len(corpus)
    all_s, all_t = float(corpus.sum()) + size, float(target.sum()) + size
    return np.array([math.floor(UNIT * math.log(((t + 1.0) * all_s) / ((s + 1.0) * all_t)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray, longest: int, schema_names: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                bucket, doc = buckets_of(data, offs, longest, len(gain))
                weight = np.zeros(len(part), np.int64)
                np.add.at(weight, doc, gain[bucket])
                words = np.diff(grams.word_spans(data, offs, grams.ALNUM)[2]) if longest > 1 else None
                n = np.bincount(doc, minlength=len(part)).astype(np.int64)
                new = {"n_features": n, "weight": weight, "_words": n if words is None else words}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[c], pa.int64()) if c in new else part.column(c) for c in schema_names], schema_names)
    return task


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
           seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_features, weight, _words, score)`` and the columns ``carry``."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in carry if c != "text"])
    kept = [f for f in rows.schema if f.name != "text" or "text" in carry]
    schema = StructType([StructField(f.name, f.dataType) for f in kept]
                        + [StructField(c, LongType()) for c in ("n_features", "weight", "_words")])
    x = rows.mapInArrow(_weigh(gain, longest, schema.names), schema)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return x.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS,
             longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
             carry: tuple[str, ...] = (), accuracy: int = ranking.ACCURACY) -> DataFrame:
    """Every document's ``(doc_id, n_features, weight, score, rank)`` and the columns
    ``carry``; ``rank`` is null where it is not drawn."""
    x = scored(docs, target, longest, buckets, seed, carry)
    x = staged(x.withColumn("_n", F.monotonically_increasing_id()), "scored")
    able = x.where(F.col("_words") >= least_words)
    rows = able.count()
    take = share * rows // 100
    if not take:
        return x.withColumn("rank", F.lit(None).cast("long")).drop("_words", "_n")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_n")]
    low, high, above = ranking.bracket(able, take, rows, accuracy=accuracy)
    within = able.where(F.col("score").between(low, high)).select("score", "doc_id", "_n")
    last = ranking.numbered(within, order, within.count(), "place").where(F.col("place") == take - above).first()
    drawn = (F.col("_words") >= least_words) & (
        (F.col("score") > last.score) | (F.col("score") == last.score) & _not_after(last))
    ranked = ranking.numbered(x.where(drawn), order, take)
    rest = x.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.col("rank").cast("long")).unionByName(rest).drop("_words", "_n")


def _not_after(last):
    """Of the cutoff's score: rows up to the cutoff in the order of id and row."""
    if last.doc_id is None:
        return F.col("doc_id").isNotNull() | (F.col("_n") <= last._n)
    before = (F.col("doc_id") < last.doc_id) | (F.col("doc_id") == last.doc_id) & (F.col("_n") <= last._n)
    return F.coalesce(before, F.lit(False))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents drawn, in full, best first numbered in ``rank``."""
    return resample(docs, target, carry=("text",), **how).where("rank IS NOT NULL")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a word in SQL: the table by its rule, then one step for each byte
ORACLE = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda c: list_reduce(range(8),
    lambda a, i: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c)) AS t),
words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM {documents}
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM {benchmark}),
crcs AS (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), tab),
counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM words JOIN crcs USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g
  FROM counts, totals),
weights AS (
  SELECT d.doc_id, count(c.w) AS n_features, coalesce(sum(g), 0)::BIGINT AS weight
  FROM {documents} d LEFT JOIN words ON side = 0 AND id = d.doc_id LEFT JOIN crcs c USING (w) LEFT JOIN gain USING (bucket)
  GROUP BY d.doc_id),
scores AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM weights),
places AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100 AS take
  FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= take THEN place END AS rank FROM places
"""
