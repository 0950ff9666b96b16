"""Ranked lexical search with per-term geometric blocking.

The corpus is cut into shards of documents.  In a shard, each term of the queries
has a posting list; its documents are clustered by similarity (the nearest of
evenly spaced members, in a random projection of their weighted terms) into blocks,
and a block stores a summary: for each term the largest impact any of its documents
has.  A query goes through its terms from the rarest on.  The summary's product
with the query bounds the score of every document of a block from above, so a block
is skipped only when that bound is below the score of the ``k``-th document found so
far; what is not skipped is scored exactly.  A document is due under its rarest
query term, so bounds leave out the terms before, and a query ends when the largest
impacts of all terms left cannot reach its ``k``-th score.  Lists that no query
reaches are not clustered.

Documents are read once for each block of queries (bounded by their bytes) and
reduced to the counts of query terms, which are staged.  No posting list is
shuffled, so a term that every document holds is no hot key; a task returns at most
``k`` rows for each query.

Terms are told apart by 64-bit hashes.  Defined results: null and empty texts hold
no term, are not counted and never found; null and empty queries find nothing;
texts of any length are read whole; rows that share an id, documents or queries,
are ranked one by one; rows without an id come after all others of their score; an
empty table gives no rows.  Only the ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .staging import staged

TOP = 20
#: documents in a block of a posting list
BLOCK = 64
#: documents of a shard, and cells of its table of impacts
SHARD, CELLS = 4096, 1 << 24
#: bytes of query texts that are searched in one pass
QUERY_BYTES = 256 << 10
DIMENSIONS = 16
NO_ID = np.iinfo(np.int64).max


class Queries:
    """Terms of a block of queries: ``terms`` are the distinct ones, sorted, and query
    j holds those numbered ``held[j]``, ``times[j]`` times each."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        data, offs = grams.text_bytes(pa.array([r[1] or "" for r in rows], pa.large_string()))
        starts, ends, first = grams.word_spans(data, offs, grams.ALNUM)
        words = grams.span_hashes(grams.prefix_sums(data, True), starts, ends)
        self.terms, at = np.unique(words, return_inverse=True)
        self.held, self.times = [], []
        for lo, hi in zip(first[:-1], first[1:]):
            t, n = np.unique(at[lo:hi], return_counts=True)
            self.held.append(t)
            self.times.append(n.astype(np.float64))
        with_term: list[list] = [[] for _ in self.terms]
        for t in self.held:
            for x in t.tolist():
                with_term[x].append(t)
        #: for each term, the terms of all queries that hold it
        self.beside = [np.unique(np.concatenate(x)) for x in with_term]


def _count_terms(terms: np.ndarray):
    """Documents as ``(doc_id, n, terms, counts)``; only terms of queries are kept."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                starts, ends, first = grams.word_spans(data, offs, grams.ALNUM)
                words = grams.span_hashes(grams.prefix_sums(data, True), starts, ends)
                at = np.minimum(np.searchsorted(terms, words), max(len(terms) - 1, 0))
                ours = terms[at] == words if len(terms) else np.zeros(len(words), bool)
                doc = np.repeat(np.arange(len(part)), np.diff(first))[ours]
                key, n = np.unique(doc * len(terms) + at[ours], return_counts=True)
                cut = np.searchsorted(key, np.arange(len(part) + 1) * len(terms))
                t, n = (key % max(len(terms), 1)).astype(np.int32), n.astype(np.int32)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()),
                     pa.array([t[a:b].tobytes() for a, b in spans], pa.binary()),
                     pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], ["doc_id", "n", "terms", "counts"])
    return task


def _document_counts(n_terms: int):
    """Documents that hold each term, added up in the task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            df += np.bincount(held, minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])
    return task


class Shard:
    """Posting lists of some documents, clustered when a query first needs them."""

    def __init__(self, queries: Queries, weights: np.ndarray, docs: np.ndarray, impacts: tuple, block: int = BLOCK):
        self.docs, self.block, self.queries = docs, block, queries
        doc, term, impact = impacts
        # whole numbers of at most 10**6, exact in 32-bit floats
        self.impact = np.zeros((len(weights), len(docs)), np.float32)
        self.impact[term, doc] = impact
        order = np.lexsort((doc, term))
        self.list = doc[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.most = self.impact.max(axis=1).astype(np.float64)
        signs = np.random.default_rng(0).choice(np.float32([-1, 1]), (len(weights), DIMENSIONS))
        near = self.impact.T @ (signs * weights[:, None].astype(np.float32))
        self.near = near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
        self.blocks: dict[int, tuple] = {}

    def blocked(self, term: int) -> tuple:
        """(documents by block, where blocks begin, their summaries)."""
        if term not in self.blocks:
            docs = self.list[self.first[term]:self.first[term + 1]]
            starts = np.zeros(1, np.int64)
            if len(docs) > self.block:
                seeds = docs[::self.block]
                cluster = np.argmax(self.near[docs] @ self.near[seeds].T, axis=1)
                order = np.argsort(cluster, kind="stable")
                docs, cluster = docs[order], cluster[order]
                # a cluster of many documents is several blocks
                begin = np.searchsorted(cluster, cluster)
                place = np.arange(len(docs)) - begin
                starts = np.flatnonzero(place % (2 * self.block) == 0)
            beside = self.queries.beside[term]
            summary = np.maximum.reduceat(self.impact[np.ix_(beside, docs)], starts, axis=1)
            self.blocks[term] = docs, starts, summary
        return self.blocks[term]


class Best:
    """The best documents of a query so far, equal scores by id."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids = np.zeros(0, np.float64), np.zeros(0, np.int64)
        self.least = 0.0

    def skips(self, bound: float) -> bool:
        return bound < self.least or bound <= 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.least) & (scores > 0)
        s, i = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((i, -s))[:self.top]
        self.scores, self.ids = s[order], i[order]
        if len(order) == self.top:
            self.least = float(self.scores[-1])


def search_shard(shard: Shard, terms: np.ndarray, values: np.ndarray, best: Best, seen: np.ndarray) -> int:
    """Add the documents of a shard to the ``best`` of a query, whose ``terms`` come
    rarest first and are worth ``values``.  Returns the number of blocks skipped."""
    rest = np.cumsum((values * shard.most[terms])[::-1])[::-1]
    marked, skipped = [], 0
    for j, term in enumerate(terms.tolist()):
        if best.skips(rest[j]):
            break
        if shard.first[term] == shard.first[term + 1]:
            continue
        docs, starts, summary = shard.blocked(term)
        at = np.searchsorted(shard.queries.beside[term], terms[j:])
        bounds = values[j:] @ summary[at].astype(np.float64)
        ends = np.append(starts[1:], len(docs))
        order = np.argsort(-bounds, kind="stable")
        lo, step = 0, 4
        while lo < len(order) and not best.skips(bounds[order[lo]]):
            these = order[lo:lo + step]
            these = these[(bounds[these] >= best.least) & (bounds[these] > 0)]
            members = np.concatenate([docs[starts[b]:ends[b]] for b in these.tolist()])
            members = members[~seen[members]]
            if len(members):
                seen[members] = True
                marked.append(members)
                best.add(values @ shard.impact[np.ix_(terms, members)].astype(np.float64), shard.docs[members])
            lo, step = lo + step, step * 2
        skipped += max(len(order) - lo, 0)
    for m in marked:
        seen[m] = False
    return skipped


def _search(queries: Queries, weights: np.ndarray, n_docs: int, n_words: int, top: int, block: int, first: int):
    """Search all shards of a task, one after another, for all queries."""
    size = int(max(64, min(SHARD, CELLS // max(len(weights), 1))))
    plans = []
    for held, times in zip(queries.held, queries.times):
        order = np.argsort(-weights[held], kind="stable")
        order = order[weights[held[order]] > 0]
        plans.append((held[order], (times * weights[held])[order]))

    def one(batches: list[pa.RecordBatch], best: list[Best]) -> None:
        t = pa.Table.from_batches(batches)
        ids = t.column("doc_id").fill_null(int(NO_ID)).to_numpy()
        terms = [np.frombuffer(x, np.int32) for x in t.column("terms").to_pylist()]
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in terms])
        term = np.concatenate(terms)
        tf = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int32).astype(np.int64)
        m = 75 + (25 * t.column("n").to_numpy() * n_docs) // n_words
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        shard = Shard(queries, weights, ids, (doc, term, impact), block)
        seen = np.zeros(len(ids), bool)
        for (terms, values), b in zip(plans, best):
            if len(terms):
                search_shard(shard, terms, values, b, seen)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries.ids]
        held, n = [], 0
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.slice(lo, size)
                if n and n + len(part) > size:
                    one(held, best)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            one(held, best)
        found = [(first + j, queries.ids[j], None if i == NO_ID else i, int(s))
                 for j, b in enumerate(best) for s, i in zip(b.scores.tolist(), b.ids.tolist())]
        if found:
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, ["_query", "item_id", "doc_id", "score"])
    return task


def _query_blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Queries in blocks of about ``size`` bytes, one at a time."""
    rows = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // size) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        found = [tuple(r) for r in rows.where(block == b).collect()]
        if found:
            yield found


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK,
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, first = [], 0
    for found in _query_blocks(items, query_bytes):
        queries = Queries(found)
        counted = staged(rows.mapInArrow(_count_terms(queries.terms), "doc_id long, n long, terms binary, counts binary")
                         .where("n > 0"), "terms")
        n_docs, n_words = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(queries.terms), np.int64)
        per_term = counted.mapInArrow(_document_counts(len(df)), "term long, df long").groupBy("term").agg(F.sum("df"))
        for term, n in per_term.collect():  # terms of this block of queries
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * n + 1))) for n in df.tolist()], np.float64)
        out.append(staged(counted.where(F.octet_length("terms") > 0).mapInArrow(
            _search(queries, weights, n_docs, n_words, top, block, first),
            "_query long, item_id long, doc_id long, score long"), "found"))
        first += len(found)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return reduce(DataFrame.unionByName, out).withColumn("rank", place).where(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {documents}),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {benchmark}) GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS all_n, sum(n)::BIGINT AS all_l FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(all_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_n) // all_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
