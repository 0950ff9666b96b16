"""Line dedup with content-defined chunks of lines.  DataFrame functions only.

Each line is hashed, a rolling hash covers each line and the one before it,
and a chunk ends where the rolling hash is a local minimum.  A boundary
depends on four neighbouring lines alone, so text inserted elsewhere does not
shift it, and two boundaries are at least two lines apart.  Chunks of two or
more lines whose hash occurs more than once are compared by their bytes; all
occurrences but the first, by (doc_id, chunk number), are removed.

A chunk that holds the edge of a repeated passage also holds lines beside it and
so repeats nowhere, and a passage of one line is never a chunk of its own.  With
``passages`` (the registered query and the pipeline), runs of whole lines with
over ``PASSAGE_WORDS`` words go as well, wherever they lie between chunks: for
each line that has words, the shortest such run that starts there and the
shortest that ends there are compared by their SHA-256, and the lines of all
occurrences but the first, by (doc_id, hash of the text, line number), are
removed, unless an occurrence overlaps the first.  A repeated run of lines of over
PASSAGE_WORDS words is the union of such shortest runs inside it, but for lines
without words between them, so only such lines stay of it.
Each line that is removed has an equal earlier one, so one of each stays.
Passages that repeat within lines of other words are not lines and stay.

Defined results: a null text has no lines and stays null, an empty one has one
empty line; for chunks, rows that share a doc_id are judged alike (a chunk that is
first under that id stays in each of them), for passages those that share doc_id and
text; rows without a doc_id keep their text;
a text of any length is cut whole, in time that grows with its lines (runs of lines
are hashed once for each line that starts or ends one); an empty table gives an empty
result.  Columns other than doc_id and text are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import nested, row_columns, staged

#: shorter runs of lines are removed as chunks only
PASSAGE_WORDS = 50

def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row explode: the optimiser merges plain
    projections, and would then evaluate an array again for every element of a
    lambda that refers to it."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_held")
    return df.select("*", one).select(*df.columns, *[F.col(f"_held.{k}").alias(k) for k in columns])


def _chunked(df: DataFrame) -> DataFrame:
    """Adds ``_chunks``, an array of (no, start, n_lines, body) per row."""
    def at(a, i):
        return F.get(F.col(a), i)
    df = _held(df, _lines=F.split("text", "\n", -1))
    df = _held(df, _rolling=F.transform("_lines", lambda x, i: F.xxhash64(at("_lines", i - 1), x)))
    # line numbers from 0 that end a chunk: local minima of the rolling hash, and the last line
    columns = df.columns[:-1]
    df = _held(df, _ends=F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == F.size("_lines") - 1) | (
        (i >= 1) & (at("_rolling", i) < at("_rolling", i - 1)) & (at("_rolling", i) <= at("_rolling", i + 1)))))

    def chunk(e, k):
        start = F.when(k == 0, 0).otherwise(at("_ends", k - 1) + 1)
        return F.struct(k.alias("no"), start.alias("start"), (e - start + 1).alias("n_lines"),
                        F.array_join(F.slice("_lines", start + 1, e - start + 1), "\n").alias("body"))
    return _held(df.select(*columns, "_ends"), _chunks=F.transform("_ends", chunk))


def _numbered(nos: str) -> Column:
    """The chunks of the given numbers (a chunk's number is its place)."""
    return F.filter(F.transform(nos, lambda k: F.get(F.col("_chunks"), k)), lambda c: c.isNotNull())


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, nos)``: chunk numbers to remove from each document.

    Hashes alone find the chunks that may be repeated; only the texts of
    documents that hold one are shuffled, and only such chunks are compared.
    """
    lines = docs.select("doc_id", "text").where(F.col("text").contains("\n") & F.col("doc_id").isNotNull())
    chunks = _chunked(lines).select("doc_id", F.filter("_chunks", lambda c: c["n_lines"] >= 2).alias("c"))
    keys = staged(chunks.select("doc_id", F.explode(F.transform("c", lambda c: F.struct(
        c["no"].alias("no"), F.xxhash64(c["body"]).alias("h")))).alias("k")).select("doc_id", "k.no", "k.h"), "chunk-hashes")
    # staged, so that the join that follows may split a hash that very many documents hold
    again = staged(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    asked = staged(keys.join(again, "h").groupBy("doc_id").agg(F.collect_set("no").alias("asked")), "asked")
    texts = lines.join(asked.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "asked")
    texts = _chunked(texts).select("doc_id", F.explode(_numbered("asked")).alias("c"))
    texts = staged(texts.select("doc_id", "c.no", "c.body", F.xxhash64("c.body").alias("h")), "chunks")
    # the bytes themselves are the key: equal hashes of different chunks stay apart
    first = staged(texts.groupBy("h", "body").agg(F.min(F.struct("doc_id", "no")).alias("first"),
                                                  F.count("*").alias("n")).where("n > 1").drop("n"), "first-chunks")
    later = texts.join(first, ["h", "body"]).where(F.struct("doc_id", "no") > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("no").alias("nos"))


def _passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, start, end, digest)`` of the shortest runs of lines
    that have over PASSAGE_WORDS words, from each line on and up to each line."""
    def at(a, i):
        return F.get(F.col(a), i)
    df = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    df = _held(df, _lines=F.split("text", "\n", -1))
    # the line of each word, and the numbers of the words that lines start with
    df = _held(df, _of=F.flatten(F.transform("_lines", lambda x, i: F.array_repeat(i, F.regexp_count(x, F.lit(r"\S+"))))))
    df = df.where(F.size("_of") > PASSAGE_WORDS)
    df = _held(df, _first=F.filter(F.sequence(F.lit(0), F.size("_of") - 1), lambda p: (p == 0) | (at("_of", p - 1) != at("_of", p))))

    def run(start, end):
        return start.cast("long") * 2**32 + end
    ahead = F.transform("_first", lambda p: run(at("_of", p), at("_of", p + PASSAGE_WORDS)))
    # a word's number less one is the last word of the line before
    back = F.transform(F.concat(F.slice("_first", 2, F.size("_first")), F.array(F.size("_of"))),
                       lambda p: run(at("_of", p - 1 - PASSAGE_WORDS), at("_of", p - 1)))
    df = _held(df, _runs=F.array_distinct(F.filter(F.concat(ahead, back), lambda r: r.isNotNull())))
    df = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "_lines", F.explode("_runs").alias("r")) \
        .withColumns({"start": F.shiftright("r", 32).cast("int"), "end": F.col("r").bitwiseAND(2**32 - 1).cast("int")})
    body = F.array_join(F.slice("_lines", F.col("start") + 1, F.col("end") - F.col("start") + 1), "\n")
    return df.select("doc_id", "text_hash", "start", "end", F.unhex(F.sha2(body, 256)).alias("digest"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, runs)``: the (text_hash, start, end) of lines to remove from the
    texts of each document."""
    keys = staged(_passages(docs), "passages")
    # staged, so that the join that follows may split a passage that very many documents hold
    first = staged(keys.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("first"),
                                              F.count("*").alias("n")).where("n > 1").drop("n"), "first-passages")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = keys.join(first, "digest").where(~same | (F.col("start") > F.col("first.end")))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("text_hash", "start", "end")).alias("runs"))


COUNTS = ("n_lines", "n_chunks", "removed_chunks", "removed_lines")


def dedup_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``_row`` (the other columns of ``docs``), ``doc_id``, ``text`` without the
    repeated chunks and, if asked, passages, and COUNTS; ``removed_lines`` are
    those of both."""
    none = F.array().cast("array<int>")
    nos = repeated_chunks(docs).toDF("_id", "_nos")
    out = nested(docs, "doc_id", "text", apart=("text",)).join(nos, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    if passages:
        # by doc_id alone, as the join before, so that texts are shuffled once
        runs = repeated_passages(docs).toDF("_id", "_runs")
        out = _held(out.join(runs, F.col("doc_id") == F.col("_id"), "left").drop("_id"), _hash=F.xxhash64("text"))
        own = F.filter("_runs", lambda r: r["text_hash"] == F.col("_hash"))
        out = out.withColumn("_gone", F.flatten(F.transform(own, lambda r: F.sequence(r["start"], r["end"])))).drop("_runs", "_hash")
    else:
        out = out.withColumn("_gone", none)
    out = _chunked(out)
    out = out.withColumn("_nos", F.coalesce("_nos", none))
    out = _held(out, _split=F.split("text", "\n", -1), _removed=_numbered("_nos"))
    gone = F.flatten(F.transform("_removed", lambda c: F.sequence(c["start"], c["start"] + c["n_lines"] - 1)))
    every = F.sequence(F.lit(0), F.size("_split") - 1)
    out = _held(out, _kept=F.array_except(every, F.concat(F.coalesce("_gone", none), gone)))
    counts = (F.size("_split"), F.size("_chunks"), F.size("_removed"), F.size("_split") - F.size("_kept"))
    text = F.array_join(F.transform("_kept", lambda i: F.get(F.col("_split"), i)), "\n")
    return out.select("_row", "doc_id", F.when(F.size("_split") > F.size("_kept"), text).otherwise(F.col("text")).alias("text"),
                      *[F.when(F.col("text").isNull(), 0).otherwise(c).cast("long").alias(k) for k, c in zip(COUNTS, counts)])


def with_deduped_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that remains; ``n_chars``, where it is a column,
    follows the texts that lost lines."""
    out = dedup_lines(docs, passages=True)
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("_row.n_chars")) \
            .cast(docs.schema["n_chars"].dataType)
    rest = dict(zip([c for c in docs.columns if c not in columns], row_columns(docs, *columns)))
    return out.select(*[(columns | rest)[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, passages: bool = False) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"), passages)
    return out.select("doc_id", *COUNTS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
                      F.col("text").alias("kept_text"))
