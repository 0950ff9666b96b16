"""Benchmark decontamination with suffix arrays over the training documents.

Every task cuts its documents into shards of bounded size and builds a suffix
array of each: word positions sorted by the words that follow, up to the window
length.  Every test suffix is binary-searched in every shard.  Positions whose
first words begin no test suffix can never be found, so they are left out of
the array before it is sorted.  A test item of fewer words than the window is
one window.  Nothing is shuffled: a document's windows lie in its own shard.

The test set is cut into blocks of at most ``BLOCK_BYTES`` of text, by their
measured size; each block is sent to the tasks and the documents pass through
the blocks one after another.

Defined results: null and empty texts have no words and are clean; null test
texts give no window, and items without an id mark words but are not listed;
rows are judged one by one, so repeated rows repeat their result; an empty
test set leaves every document clean.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import grams

WINDOW = 13
HEAD = 4
BLOCK_BYTES = 4 << 20
#: a document is contaminated if 1 / SHARE of its words or more are hit
SHARE = 20

MATCH = "array<struct<word:int,item_id:long,item_word:int,n_words:int>>"


class TestSuffixes:
    """Distinct windows of a block of test items, keyed by their leading words."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.window = window
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, offs = grams.text_bytes(texts)
        starts, ends, first = grams.word_spans(data, offs, grams.ALNUM)
        words = grams.span_hashes(grams.prefix_sums(data, True), starts, ends)
        seen: dict[bytes, int] = {}
        keys, sizes, places = [], [], []
        for d, (item, _) in enumerate(items):
            lo, hi = int(first[d]), int(first[d + 1])
            size = min(window, hi - lo)
            for i in range(lo, hi - size + 1 if size else lo):
                w = words[i:i + size]
                k = seen.setdefault(w.tobytes(), len(seen))
                if k == len(keys):
                    row = np.zeros(window, np.uint64)
                    row[:size] = w
                    keys.append(row)
                    sizes.append(size)
                    places.append([])
                places[k].append((item, i - lo))
        self.sizes = np.array(sizes, np.int64)
        self.rows = np.array(keys, np.uint64).reshape(-1, window)
        self.places = places
        self.items = [sorted({i for i, _ in p if i is not None}) for p in places]
        self.heads = {}
        for h in range(1, HEAD + 1):
            these = self.sizes >= HEAD if h == HEAD else self.sizes == h
            if these.any():
                self.heads[h] = np.unique(np.concatenate([grams.ngram_hashes(r[:h], h) for r in self.rows[these]]))


def _sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of word hashes as byte strings that sort word by word."""
    width = rows.shape[1] * 8
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{width}").ravel()


class Shard:
    """Suffix array of the word positions of some documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, self.first = grams.word_spans(data, offs, grams.ALNUM)
        self.words = grams.span_hashes(grams.prefix_sums(data, True), starts, ends)
        self.stop = np.repeat(self.first[1:], np.diff(self.first))

    def find(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """(position, test window) of every occurrence of every test window."""
        found = np.zeros(len(self.words), bool)
        for h, heads in tests.heads.items():
            g = grams.ngram_hashes(self.words, h)
            if len(g):
                at = np.minimum(np.searchsorted(heads, g), len(heads) - 1)
                found[:len(g)] |= heads[at] == g
        at = np.flatnonzero(found)
        if not len(at):
            return at, at
        take = at[:, None] + np.arange(tests.window)
        rows = np.where(take < self.stop[at][:, None], self.words[np.minimum(take, len(self.words) - 1)], 0)
        keys = _sortable(rows)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        low = np.searchsorted(keys, _sortable(tests.rows), "left")
        above = np.where(np.arange(tests.window) < tests.sizes[:, None], tests.rows, np.uint64(2**64 - 1))
        high = np.searchsorted(keys, _sortable(above), "right")
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at[order[low[which] + step]], which

    def hits(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + sizes, -1)
        return np.cumsum(cover[:-1]) > 0


def longest(at: np.ndarray, which: np.ndarray, tests: TestSuffixes, base: int) -> list[dict]:
    """Maximal verbatim matches: windows that follow each other in document and
    item are one match."""
    rows = sorted((item, a - i, a, i, int(tests.sizes[w])) for a, w in zip(at.tolist(), which.tolist())
                  for item, i in tests.places[w] if item is not None)
    out: list[dict] = []
    last = None
    for item, shift, a, i, n in rows:
        if last == (item, shift, a - 1):
            out[-1]["n_words"] += 1
        else:
            out.append({"word": a - base, "item_id": item, "item_word": i, "n_words": n})
        last = (item, shift, a)
    return out


def _pass(tests: TestSuffixes, locations: bool, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                shard = Shard(data, offs)
                at, which = shard.find(tests)
                hit = shard.hits(at, tests.sizes[which])
                doc = np.searchsorted(shard.first, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                at, which, doc = at[order], which[order], doc[order]
                lo = np.searchsorted(doc, np.arange(len(part)))
                hi = np.searchsorted(doc, np.arange(len(part)), "right")
                bits, items, matches = [], [], []
                olds = zip(part.column("bits").to_pylist(), part.column("items").to_pylist(),
                           part.column("matches").to_pylist())
                for d, (b, it, ma) in enumerate(olds):
                    a, w = at[lo[d]:hi[d]], which[lo[d]:hi[d]]
                    if len(a):
                        now = np.packbits(hit[shard.first[d]:shard.first[d + 1]])
                        b = (now | np.frombuffer(b, np.uint8)).tobytes() if b else now.tobytes()
                        it = sorted({*(it or []), *(i for k in np.unique(w).tolist() for i in tests.items[k])})
                        if locations:
                            ma = (ma or []) + longest(a, w, tests, int(shard.first[d]))
                    bits.append(b)
                    items.append(it or [])
                    matches.append(ma or [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(np.diff(shard.first), pa.int64()),
                     pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.int64())),
                     pa.array(matches, part.schema.field("matches").type),
                     *[part.column(c) for c in carry]], schema=part.schema)
    return run


def test_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[TestSuffixes]:
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [TestSuffixes([tuple(r) for r in rows.where(block == b).collect()]) for b in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, locations: bool = True,
                  block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, matches, contaminated)`` per document, and
    the columns ``carry`` of its own row.  ``matches`` holds the longest verbatim
    matches and their places."""
    others = tuple(c for c in carry if c != "text")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"),
                     F.lit(None).cast("binary").alias("bits"), F.array().cast("array<long>").alias("items"),
                     F.array().cast(MATCH).alias("matches"), *others)
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema])
    for tests in test_blocks(benchmark, block_bytes):
        df = df.mapInArrow(_pass(tests, locations, others), schema)
    # words hit: one bits of the packed hit map, counted through its hex digits
    digits = F.coalesce(F.hex("bits"), F.lit(""))
    ones = sum((F.length(digits) - F.length(F.translate(digits, x, ""))) * n
               for n, x in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")))
    df = df.select("doc_id", "n_words", ones.cast("long").alias("n_hit"), "items", "matches", *carry)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns, and the longest matches as ``word:item_id:item_word:n_words``,
    in order and comma-joined."""
    found = contamination(docs, benchmark)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    listed = F.transform(F.array_sort("matches"), lambda m: F.concat_ws(":", m["word"], m["item_id"], m["item_word"], m["n_words"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), "contaminated",
                        F.array_join(listed, ",").alias("matches"))
