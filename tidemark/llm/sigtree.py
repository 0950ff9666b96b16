"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct five-word shingles.  Two
documents link when their sets' Jaccard similarity is 0.75 or more.  Documents
with equal sets are one from the start.

Candidates meet in groups: documents that share one of their ``SKETCH``
smallest shingle hashes.  Of the SKETCH smallest hashes of a linked pair's union
each is shared with probability 0.75 or more, so a pair misses all groups with
probability 0.25^SKETCH, 5e-20, far below that of a collision of the hashes
themselves; sets of fewer hashes are compared whole.

Inside a group a signature tree finds the links: leaves are documents ordered
by size, inner nodes hold the OR of the token bitmaps below them, their size
range and the least number of set bits.  A dual traversal descends pairs of
nodes and drops those whose largest possible overlap is below what the
threshold asks for, or which are one component already.  Surviving pairs are
checked on the sets themselves, unless earlier links joined them.

Groups come in three rounds, with connected components in between: the two
smallest hashes of each document, then all groups of at most ``BLOCK`` documents
that still hold more than one component, then those of the prefix join below.
Groups of more than ``BLOCK`` documents are dealt with in blocks in the first round,
for the links inside blocks alone.

In the third round no sketch hash that more than ``BLOCK`` documents hold is a
key.  Documents that hold ``SURE`` of those are joined by the exact prefix instead:
each orders its shingles by how many of these documents hold them (those that few
hold by hash; counted in the tasks first, the commonest ``RANKED`` told apart), and takes the first quarter of its set plus one as keys.  A linked
pair has a key in common, and one that is in the first seventh plus one of its
smaller set (``index``).  So a shingle that many share is a key only of documents
that hold little else, and those mostly link.  Groups of such a key are parted by
size range; what is outside the part's main component, and is or meets an ``index``
key, visits all its blocks.

Defined results: null, empty and blank texts have no shingles and link with
nothing (also rows without an id); rows that share a doc_id each have the component
of their own text; repeated rows repeat their result; an empty table gives an empty result.  Only
doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .graph import components
from .groups import Forest, runs
from .staging import nested, staged, unnested

WORDS = 5
#: links need PART * intersection >= OF * union
PART, OF = 100, 75
SKETCH = 32
BLOCK = 512
FANOUT = 8
#: a linked pair shares this many sketch hashes, but for 8e-15 of the pairs at the
#: threshold; two sets of 400 shingles hold a collision of hashes as often
SURE = 4
#: shingles that fewer of the documents hold count as equally rare, as do all but this
#: many of the commonest: what the tasks look counts up in is bounded, and any one order
#: of all shingles gives exact prefixes
COMMON, RANKED = 8, 1 << 20
#: shingles counted at once in a task, and documents of one hot hash dealt to a task
COUNTED, DEALT = 1 << 21, 8192
PAIRS_AT_ONCE = 1 << 14


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                sets = grams.shingle_sets(data, offs, words)
                n = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    d1 = [int(grams.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    d2 = [int(np.bitwise_xor.reduce(grams.mix(s * np.uint64(grams.STEP)), initial=np.uint64(0)).view(np.int64)) for s in sets]
                small = [s[:SKETCH].view(np.int64) for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in small])))
                flat = np.concatenate([*small, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    ["doc_id", "n", "d1", "d2", "sketch"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in grams.slices(batch):
                sets = [s.view(np.int64) for s in grams.shingle_sets(data, offs, words)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate([*sets, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("comp"), part.column("deal"),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    ["doc", "comp", "deal", "set"])
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle, of those that more than one at hand holds."""
    held: list[np.ndarray] = []

    def counted():
        token, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(token[c > 1]), pa.array(c[c > 1])], ["token", "c"])

    for batch in batches:
        held.append(batch.column("set").flatten().to_numpy())
        if sum(map(len, held)) >= COUNTED:
            yield counted()
    if held:
        yield counted()


def _prefixes(tokens: np.ndarray, counts: np.ndarray):
    """The first shingles of each set, those of the smallest count first (``tokens``
    ascend; others count as 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, comps = batch.column("doc").to_numpy(), batch.column("comp").to_numpy()
            ends = batch.column("set").offsets.to_numpy()
            flat = batch.column("set").values.to_numpy()
            count = np.zeros(len(flat), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                count = np.where(tokens[at] == flat, counts[at], 0)
            picked, number, index = [], [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                n = hi - lo
                # n - ceil(share * n) + 1, where share is what a set must have in common
                # with one that is larger, or not smaller
                probe = n - (OF * n + PART - 1) // PART + 1 if n else 0
                first = n - (2 * OF * n + PART + OF - 1) // (PART + OF) + 1
                picked.append(flat[lo:hi][np.lexsort((flat[lo:hi], count[lo:hi]))[:probe]])
                number.append(len(picked[-1]))
                index.append(np.arange(number[-1]) < first)
            if not sum(number):
                continue
            size = np.repeat(np.diff(ends).astype(np.int32), number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(picked)), pa.array(np.repeat(docs, number)), pa.array(np.repeat(comps, number)),
                 pa.array(size), pa.array(np.concatenate(index))], ["token", "doc", "comp", "n", "index"])
    return run


class Tree:
    """Levels of nodes over documents that are ordered by size."""

    def __init__(self, sets: list[np.ndarray], comp: np.ndarray):
        n = len(sets)
        sizes = np.array([len(s) for s in sets])
        width = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(sizes) + 1)), 8, 15))
        flags = np.zeros((n, width), bool)
        shift = np.uint64(64 - int(np.log2(width)))
        for i, s in enumerate(sets):
            flags[i, (s >> shift).astype(np.int64)] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, count, comp)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, count, comp = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            lo_c, hi_c = np.minimum.reduceat(comp, cut), np.maximum.reduceat(comp, cut)
            self.levels.append((np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(low, cut),
                                np.maximum.reduceat(high, cut), np.minimum.reduceat(count, cut),
                                np.where(lo_c == hi_c, lo_c, -1 - np.arange(len(cut)))))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether documents under node i and node j may overlap enough."""
        bits, low, high, count, comp = self.levels[level]
        ok = (PART * high[i] >= OF * low[j]) & (PART * high[j] >= OF * low[i]) & ((comp[i] != comp[j]) | (comp[i] < 0))
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), PAIRS_AT_ONCE):
            k = at[lo:lo + PAIRS_AT_ONCE]
            a, b = i[k], j[k]
            both = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            most = np.minimum(high[a] - np.maximum(0, count[a] - both), high[b] - np.maximum(0, count[b] - both))
            ok[k] = (PART + OF) * most >= OF * (low[a] + low[b])
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of documents that the dual traversal can't rule out."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            ok = self._possible(level, i, j)
            i, j = i[ok], j[ok]
            kids = len(self.levels[level - 1][1])
            a = (i[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
            b = (j[:, None, None] * FANOUT + np.arange(FANOUT)[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
            inside = (a < kids) & (b < kids) & (a < b if level == 1 else a <= b)
            i, j = a[inside], b[inside]
        if len(self.levels) == 1:
            return i[:0], j[:0]
        ok = self._possible(0, i, j)
        return i[ok], j[ok]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return PART * inter >= OF * (len(a) + len(b) - inter) and inter > 0


def _linker(words: int):
    """Links between components, found in each block of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ("token", "block")):
            if len(g) < 2:
                continue
            comp = g["comp"].to_numpy()
            if (comp == comp[0]).all():
                continue
            sets: list[np.ndarray] = []
            for part in g.select(["text"]).to_batches():
                for _, data, offs in grams.slices(part):
                    sets += grams.shingle_sets(data, offs, words)
            doc = g["doc"].to_numpy()
            order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0, doc[i])))
            sets = [sets[i] for i in order if len(sets[i])]
            order = order[len(order) - len(sets):]
            comp, doc = comp[order], doc[order]
            if len(sets) < 2:
                continue
            block = g["block"][0].as_py()
            home = g["home"].to_numpy()[order]
            shared = g["shared"].to_numpy(zero_copy_only=False)[order]
            number = {c: k for k, c in enumerate(sorted(set(comp.tolist())))}
            at = np.array([number[c] for c in comp.tolist()])
            i, j = Tree(sets, at).pairs() if len(sets) > 2 else (np.array([0]), np.array([1]))
            # the home of the smaller id: the same in every block, in whichever order rows arrive
            once = ~(shared[i] & shared[j]) | (home[np.where(doc[i] <= doc[j], i, j)] == block)
            forest, found = Forest(len(number)), []
            for a, b in zip(i[once].tolist(), j[once].tolist()):
                if forest.find(at[a]) != forest.find(at[b]) and similar(sets[a], sets[b]):
                    forest.union(at[a], at[b])
                    found.append((int(comp[a]), int(comp[b])))
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
    return run


def _search(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Edges between components from ``(token, doc, comp, nb, visits)``: rows of a
    group of ``nb`` blocks, those that visit all and those that stay in their own."""
    spark = members.sparkSession
    members = members.withColumn("home", F.pmod(F.xxhash64("doc", "token"), F.col("nb")).cast("int")) \
        .withColumn("shared", F.col("visits") & (F.col("nb") > 1))
    members = members.withColumn("block", F.explode(F.when(F.col("shared"), F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")))
                                                    .otherwise(F.array("home"))))
    dealt = members.join(texts, "doc").select("token", "block", "doc", "comp", "home", "shared", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "token", "block").sortWithinPartitions("token", "block")
    return dealt.mapInArrow(_linker(words), "a long, b long")


def _merged(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """``reps`` with the components that ``edges`` join."""
    ids = components(staged(edges.distinct(), "edges")).select(F.col("node").alias("comp"), "component")
    return reps.join(ids, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")


def _who():
    """The same for groups of the same documents."""
    return F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who")


def _first_groups(reps: DataFrame, block: int) -> DataFrame:
    tokens = reps.select("doc", "comp", F.explode(F.slice("sketch", 1, 2)).alias("token")).distinct()
    sizes = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    # in this round every document stays in its own block
    return tokens.join(sizes, "token").select("token", "doc", "comp", F.ceil(F.col("c") / block).alias("nb"), F.lit(False).alias("visits"))


def _whole(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of one block each; groups of the same documents are one."""
    once = sizes.groupBy("c", "who").agg(F.min("token").alias("token")).select("token")
    return tokens.join(once, "token").select("token", "doc", "comp", F.lit(1).cast("long").alias("nb"), F.lit(False).alias("visits"))


def _other_groups(reps: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Groups of sketch hashes that at most ``block`` documents hold, and the documents
    that may share others alone."""
    tokens = reps.select("doc", "comp", "n", F.explode("sketch").alias("token"))
    sizes = tokens.groupBy("token").agg(
        F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), _who()).where("c > 1 AND lo < hi")
    sizes = staged(sizes.select("token", "c", "who"), "groups")
    held = tokens.join(sizes.where(F.col("c") > block).select("token", F.col("c").alias("by")), "token") \
        .groupBy("doc", "n").agg(F.count("*").alias("c"), F.min(F.struct("token", "by")).alias("hot"))
    held = held.where(F.col("c") >= F.least(F.lit(SURE), F.ceil(F.col("n") * OF / PART)))
    # documents of one hot hash are dealt together, so many to a deal at most
    deal = F.xxhash64("hot.token", F.pmod(F.xxhash64("doc"), F.ceil(F.col("hot.by") / DEALT)))
    held = held.select("doc", deal.alias("deal"))
    return _whole(tokens, sizes.where(F.col("c") <= block)), held


def _prefix_keys(held: DataFrame, texts: DataFrame, words: int, block: int) -> DataFrame:
    """``(token, doc, comp, n, index)``: the exact prefix of each document's set in the
    order of how many of these documents hold a shingle."""
    if "deal" not in held.columns:
        held = held.withColumn("deal", F.xxhash64("doc"))
    sets = staged(held.join(texts, "doc").select("doc", "comp", "deal", "text")
                  .mapInArrow(_sets(words), "doc long, comp long, deal long, set array<long>").repartition("deal"), "sets-by-prefix")
    # counted in the tasks first, where documents that share shingles lie together
    common = sets.select("set").mapInArrow(_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")) \
        .where(F.col("c") >= COMMON).orderBy(F.desc("c"), "token").limit(RANKED).toArrow()
    tokens, counts = (common.column(c).to_numpy() for c in ("token", "c"))
    order = np.argsort(tokens)
    keys = sets.select("doc", "comp", "set").mapInArrow(
        _prefixes(tokens[order], counts[order]), "token long, doc long, comp long, n int, index boolean")
    return staged(keys.withColumn("token", F.xxhash64(F.lit("prefix"), "token")), "prefix-keys")


def _prefix_groups(held: DataFrame, texts: DataFrame, words: int, block: int) -> DataFrame:
    keys = _prefix_keys(held, texts, words, block)
    open_groups = (F.col("lo") < F.col("hi")) & F.col("some")
    limits = (F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("index").alias("some"))
    sizes = staged(keys.groupBy("token").agg(F.count("*").alias("c"), _who(), *limits).where(open_groups)
                   .select("token", "c", "who"), "prefix-groups")
    small = _whole(keys, sizes.where(F.col("c") <= block))
    # linked sets differ in size by PART / OF at most: in steps a little longer than that they are neighbours
    step = F.floor(F.log("n") / (math.log(PART / OF) * 1.0001))
    large = keys.join(sizes.where(F.col("c") > block).select("token"), "token").select(
        "doc", "comp", "index", F.explode(F.array(F.xxhash64("token", step), F.xxhash64("token", step + 1))).alias("token"))
    large = staged(large, "large-groups")
    by_comp = large.groupBy("token", "comp").agg(F.count("*").alias("m"), F.max("index").alias("index"))
    first = F.struct("m", "comp")
    main = by_comp.groupBy("token").agg(
        F.max_by("comp", first).alias("main"), F.max_by("index", first).alias("main_index"),
        F.ceil(F.sum("m") / block).alias("nb"), *limits).where(open_groups).select("token", "main", "main_index", "nb")
    # pairs are asked for between components, with an index key on one side
    visits = (F.col("comp") != F.col("main")) & (F.col("index") | F.col("main_index"))
    return small.unionByName(large.join(main, "token").select("token", "doc", "comp", "nb", visits.alias("visits")))


def link(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = staged(base.mapInArrow(_sketches(words), "doc_id long, n long, d1 long, d2 long, sketch array<long>"), "sketches")
    sets = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2") \
        .agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"))
    sets = staged(sets, "sets")
    reps = sets.withColumn("comp", F.col("doc"))
    texts = base.withColumnRenamed("doc_id", "doc").where("text IS NOT NULL")
    reps = staged(_merged(reps, _search(_first_groups(reps, block), texts, words)), "reps")
    groups, held = _other_groups(reps, block)
    reps = staged(_merged(reps, _search(groups, texts, words)), "reps")
    # staged, so that their size is known: small tables are then not joined by a shuffle of all texts
    held = staged(reps.join(held, "doc").select("doc", "comp", "deal"), "held")
    groups = staged(_prefix_groups(held, texts, words, block), "members")
    reps = _merged(reps, _search(groups, texts, words))
    ids = staged(reps.select("n", "d1", "d2", "comp"), "components")
    out = sketches.select("doc_id", "n", "d1", "d2").join(ids, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


#: ids of this and above stand for rows without an id of their own
SHARED_ID = 1 << 62


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of linked rows, that of the smallest doc_id.  Rows are
    judged by their own text: a row whose id others share, or that has none, is
    linked by what it holds alone, and stays if that is linked with nothing.  Of rows
    equal in id and text one stays; rows without words are linked with nothing and
    all stay."""
    rows = nested(docs, "doc_id", "text", apart=("text",))
    shared = staged(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
                    .where("_n > 1 OR _id IS NULL").select("_id"), "shared-ids")
    own = F.lit(SHARED_ID) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARED_ID))
    # few ids are shared: the staged table is small, or the join is by shuffle
    keyed = rows.join(shared.withColumn("_shared", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_id")), "left") \
        .withColumn("_key", F.when(F.col("_shared"), own).otherwise(F.col("doc_id").cast("long"))).drop("_id", "_shared")
    found = link(keyed.select(F.col("_key").alias("doc_id"), "text"), **options)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    again = (F.col("_key") >= SHARED_ID) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.where(~again).unionByName(kept.where(again).dropDuplicates(["_key"]))
    return unnested(kept, docs)
