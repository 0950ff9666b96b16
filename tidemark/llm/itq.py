"""Near-duplicate embeddings by iterative quantisation.

Rotations are learnt on a bounded sample (``SAMPLE`` vectors): iterative
quantisation alternates between signs of the rotated vectors and the rotation
closest to them (orthogonal Procrustes), which balances the bits.  Each
rotation gives one bit per dimension; the bits of all rotations are a vector's
code.  Codes are cut into substrings, one hash table each (multi-index Hamming
tables).  The substring length follows the number of vectors, the number of
tables the recall wanted at the threshold (``RECALL``).

Only codes are dealt into the tables.  Inside a bucket, pairs whose whole codes
differ in more bits than ``radius`` allows are dropped (at the threshold itself
four standard deviations above the expected distance, the bits of different
rotations taken as fully dependent, so the radius errs towards keeping).  Vectors
are joined to the rows that are left in a pair, and those pairs are reranked with
them, by cosine in double precision.

Pairs are counted inside the tasks and never listed: a pair that meets in
several tables counts in the first.  Buckets of more than ``BLOCK`` vectors
are dealt with exactly: the bucket's first vector is a pivot; vectors
within half the threshold angle of it form a clump whose members all link with
each other (triangle inequality), which needs a count alone.  What is left in
the bucket is compared in blocks, in which only vectors outside the bucket's
largest clump are repeated.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (also rows without an id); vectors of different
lengths never link (each length is a run of its own, so their number should be
small); equal vectors link; rows that share a vec_id share its
component and the sum of their links; an empty table gives an empty result.
Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import staged

SAMPLE = 4096
ROUNDS = 40
THRESHOLD = 0.9
RECALL = 0.97
BLOCK = 1024
#: bits of a code at least, so that the distance of codes tells pairs apart
CODE_BITS = 256
#: pairs that a task looks at in one go, and numbers in the vectors that it holds
PAIRS = 1 << 18
HELD = 1 << 22
#: slack for rounding where the triangle inequality stands in for a comparison
SLACK = 1e-6


def rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation that iterative quantisation reaches from a random start."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds if len(x) else 0):
        b = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(b.T @ x)
        r = (u @ vt).T
    return r


def plan(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a substring, tables): a bit differs with probability angle / pi."""
    bits = max(1, min(dim, 20, max(6, math.ceil(math.log2(max(n, 2))) - 5)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = np.asarray(flat, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def radius(dim: int, rotations: int, threshold: float = THRESHOLD) -> int:
    """Differing bits up to which a pair is reranked."""
    p = math.acos(threshold) / math.pi
    return min(rotations * dim, math.ceil(rotations * (dim * p + 4 * math.sqrt(dim * p * (1 - p)))))


def _table_keys(signs: np.ndarray, dim: int, bits: int, tables: int) -> np.ndarray:
    """The substring that each table is keyed by, of codes given as 0/1."""
    per = dim // bits
    power = 1 << np.arange(bits)
    return np.column_stack([signs[:, (t // per) * dim + (t % per) * bits:][:, :bits] @ power for t in range(tables)]).astype(np.int32)


def _codes(rotations: list[np.ndarray], bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(rotations[0])
        for batch in batches:
            if not len(batch):
                continue
            x = unit(batch.column("v").flatten().to_numpy(zero_copy_only=False), dim)
            signs = np.column_stack([(x @ r >= 0) for r in rotations]).astype(np.int64)
            words = np.zeros((len(x), -(-signs.shape[1] // 64) * 64), np.uint8)
            words[:, :signs.shape[1]] = signs
            code = pa.array([row.tobytes() for row in np.packbits(words, axis=1)], pa.binary())
            flat = pa.array(_table_keys(signs, dim, bits, tables).ravel())
            ends = pa.array(np.arange(0, len(x) * tables + 1, tables), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), code, pa.ListArray.from_arrays(ends, flat)],
                                             ["vec_id", "v", "code", "keys"])
    return run


def _whole_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that end where (t, k, block) changes, with the
    end of each row's run of equal keys."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        key = np.column_stack([table[c].to_numpy().astype(np.int64) for c in ("t", "k", "block")])
        at = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        n = len(table) if last else (int(at[-1]) if len(at) else 0)
        at = np.append(at[at < n], n)
        return n, at[np.searchsorted(at, np.arange(n), side="right")]

    count = 0
    want = rows
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count >= want:
            table = pa.Table.from_batches(held)
            n, ends = cut(table, False)
            if n:
                yield table.slice(0, n), ends
            held = table.slice(n).combine_chunks().to_batches()
            count = len(table) - n
            want = max(rows, 2 * count)   # a run longer than that is gathered whole
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table, True)[1]


def _close(table: pa.Table, ends: np.ndarray, dim: int, bits: int, tables: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one run whose codes differ in at most ``limit`` bits, that
    share no bucket of an earlier table, are not of one clump, and whose home it is."""
    raw = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(table), -1)
    words = raw.view(np.uint64)
    keys = _table_keys(np.unpackbits(raw, axis=1).astype(np.int64), dim, bits, tables)
    t, block, home = (table[c].to_numpy() for c in ("t", "block", "home"))
    clump = table["clump"].to_numpy()
    shared = table["shared"].to_numpy()
    partners = ends - np.arange(len(ends)) - 1
    total = np.cumsum(partners)
    lo = 0
    while lo < len(ends):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        many = partners[lo:hi]
        a = np.repeat(np.arange(lo, hi), many)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - many - before, many)
        ok = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= limit
        a, b = a[ok], b[ok]
        ok = (clump[a] != clump[b]) | (clump[a] < 0)
        # two repeated rows meet in every block: they count where the first one is at home
        ok &= ~(shared[a] & shared[b]) | (home[a] == block[a])
        a, b = a[ok], b[ok]
        met = (keys[a] == keys[b]) & (np.arange(tables) < t[a][:, None])
        new = ~met.any(axis=1)
        yield a[new], b[new]
        lo = hi


def _survivors(dim: int, bits: int, tables: int, limit: int):
    """The rows that are left in a pair after the Hamming filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in _whole_runs(batches, 1 << 15):
            left = np.zeros(len(table), bool)
            for a, b in _close(table, ends, dim, bits, tables, limit):
                left[a] = left[b] = True
            if left.any():
                yield from table.drop_columns(["code"]).filter(pa.array(left)).combine_chunks().to_batches()
    return run


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let linked rows share the smallest root (``root`` is flat before and after)."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _linker(dim: int, bits: int, tables: int, limit: int, threshold: float):
    """Counts the links among the survivors of each block and joins what is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // dim)
        for table, ends in _whole_runs(batches, step):
            x = unit(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
            ids = table["vec_id"].to_numpy()
            links = np.zeros(len(table), np.int64)
            root = np.arange(len(table))
            for a, b in _close(table, ends, dim, bits, tables, limit):
                linked = [np.einsum("ij,ij->i", x[a[i:i + step]], x[b[i:i + step]]) >= threshold for i in range(0, len(a), step)]
                if not linked:
                    continue
                linked = np.concatenate(linked)
                a, b = a[linked], b[linked]
                links += np.bincount(a, minlength=len(links)) + np.bincount(b, minlength=len(links))
                _join(root, a, b)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])],
                                                 ["vec_id", "n", "root"])
    return run


def _pivots(dim: int, threshold: float):
    """Rows within half the threshold angle of their bucket's pivot."""
    half = math.cos(math.acos(threshold) / 2 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, p = (unit(batch.column(c).flatten().to_numpy(zero_copy_only=False), dim) for c in ("v", "pv"))
            near = pa.array((x * p).sum(axis=1) >= half)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("pivot")], ["rid", "pivot"]).filter(near)
    return run


def _one_dimension(vectors: DataFrame, dim: int, threshold: float, recall: float, block: int):
    """(links, edges) among valid vectors of one length."""
    n = vectors.count()
    bits, tables = plan(n, dim, threshold, recall)
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, SAMPLE / n)) \
        .select("v").toArrow().column("v").combine_chunks()
    sample = np.asarray(drawn.flatten().to_numpy(zero_copy_only=False))
    sample = sample[:len(sample) // dim * dim]
    x = unit(sample, dim) if len(sample) else np.zeros((0, dim))
    rotations = [rotation(x, s) for s in range(max(math.ceil(tables / (dim // bits)), math.ceil(CODE_BITS / dim)))]
    limit = radius(dim, len(rotations), threshold)
    vtype = dict(vectors.dtypes)["v"]
    rows = staged(vectors.mapInArrow(_codes(rotations, bits, tables), f"vec_id long, v {vtype}, code binary, keys array<int>")
                  .withColumn("rid", F.monotonically_increasing_id()), "codes")

    placed = rows.select("rid", F.posexplode("keys").alias("t", "k"))
    large = staged(placed.groupBy("t", "k").agg(F.count("*").alias("c"), F.min("rid").alias("pivot"))
                   .where(F.col("c") > 1), "buckets")
    hot = large.where(F.col("c") > block)
    # rows of hot buckets against the bucket's pivot
    near = placed.join(hot, ["t", "k"]).select("rid", "pivot").distinct() \
        .join(rows.select("rid", "v"), "rid").join(rows.select(F.col("rid").alias("pivot"), F.col("v").alias("pv")), "pivot") \
        .select("rid", "pivot", "v", "pv")
    clumps = staged(near.mapInArrow(_pivots(dim, threshold), "rid long, pivot long")
                    .groupBy("rid").agg(F.min("pivot").alias("clump")), "clumps")
    named = clumps.join(rows.select("rid", "vec_id"), "rid")
    sizes = named.groupBy("clump").agg(F.count("*").alias("c"), F.min("vec_id").alias("root"))
    inside = named.join(sizes, "clump").select("vec_id", (F.col("c") - 1).alias("n"), "root")

    tagged = rows.select("rid", "code", "keys").join(clumps, "rid", "left").withColumn("clump", F.coalesce("clump", F.lit(-1).cast("long")))
    tagged = tagged.select("rid", "code", "clump", F.posexplode("keys").alias("t", "k"))
    # the largest clump of a hot bucket stays in its blocks; all other rows of the bucket visit every block
    of = tagged.select("t", "k", "clump").join(hot, ["t", "k"]).where("clump >= 0").groupBy("t", "k", "clump").agg(F.count("*").alias("m"))
    main = of.groupBy("t", "k").agg(F.max_by("clump", F.struct("m", "clump")).alias("main"))
    buckets = staged(large.join(main, ["t", "k"], "left").select(
        "t", "k", F.coalesce("main", F.lit(-2).cast("long")).alias("main"), F.ceil(F.col("c") / block).alias("nb")), "plan")
    dealt = tagged.join(buckets, ["t", "k"])
    home = F.pmod(F.xxhash64("rid", "t"), F.col("nb")).cast("int")
    shared = (F.col("nb") > 1) & (F.col("clump") != F.col("main"))
    dealt = dealt.withColumn("home", home).withColumn("shared", shared)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("shared"), F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")))
                                                .otherwise(F.array("home"))))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "t", "k", "block").sortWithinPartitions("t", "k", "block", "rid")

    left = staged(blocks(dealt.select("t", "k", "block", "rid", "clump", "home", "shared", "code"))
                  .mapInArrow(_survivors(dim, bits, tables, limit),
                              "t int, k int, block int, rid long, clump long, home int, shared boolean"), "survivors")
    reranked = left.join(rows.select("rid", "vec_id", "code", "v"), "rid")
    return staged(blocks(reranked).mapInArrow(_linker(dim, bits, tables, limit, threshold), "vec_id long, n long, root long")
                  .unionByName(inside), "links")


def link(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    kept = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = base.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    dims = [r[0] for r in valid.select(F.size("v").alias("d")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        part = _one_dimension(valid.where(F.size("v") == dim), dim, threshold, recall, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    ids = components(found, "vec_id", "root").select(F.col("node").alias("vec_id"), "component")
    return base.select("vec_id").join(counts, "vec_id", "left").join(ids, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
