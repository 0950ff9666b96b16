"""Packing, resampling and ranked search against plain versions, and on awkward rows."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, packing, queries, ranking, resample, staging

P = pytest.importorskip("public_tokenizers")
SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TOKENIZER = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ready(spark):
    return staging.prepare(spark)


@pytest.fixture(scope="module")
def odd(ready):
    """Null, empty, white and very long texts, repeated rows, null and shared ids,
    letters of many kinds, and columns named like those that operators add."""
    long = " ".join(f"w{i} x.y,z" for i in range(30_000))
    rows = [(1, "The quick brown fox"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "the THE the"), (6, "the THE the"),
            (None, "fox fox"), (7, "İ ΣΑΣ l'été it's ''s ≠ 1̸!! É!ü… <|endoftext|>x a\x00b\x1cc"), (8, "é" * 5000),
            (None, "the fox " * 30), (9, "the fox " * 30), (9, "the fox " * 30), (10, "日本語" * 40)]
    clash = ["rank", "score", "_n", "n", "start", "length", "_part", "weight"]
    return ready.createDataFrame([(*r, *range(len(clash))) for r in rows],
                                 "doc_id long, text string" + "".join(f", {c} int" for c in clash))


def same(got, sql, sf):
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(rel.fetchall(), key=key)


# -- op11

def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def check_pieces(pieces, docs):
    """Every id in one piece, sequences gapless and full or of a power-of-two length."""
    t = tokenizer()
    want = collections.Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(t.encode(text or "", add_special_tokens=False).ids + [2])] += 1
    by_doc = collections.defaultdict(lambda: collections.defaultdict(list))
    for (doc_id, ids), n in want.items():
        for p in pieces:
            if p.doc_id == doc_id and p.doc_tokens == len(ids):
                cut = ids[p.start:p.start + p.length]
                if p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes()):
                    by_doc[doc_id, ids][p.start].append(p.length)
        cover = collections.Counter(k for s, sizes in by_doc[doc_id, ids].items() for z in sizes for k in range(s, s + z))
        assert cover == collections.Counter({k: n for k in range(len(ids))}), doc_id
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for spans in windows.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding == 0
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing_holds_every_id_once(ready):
    docs = staging.documents(ready, SF)
    check_pieces(queries.op11_sum_of_squares(ready, SF).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("held, block", [(packing.HELD, packing.BLOCK), (3000, 64)])
def test_packing_of_odd_rows(ready, odd, held, block, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", block)
    out = packing.pack(odd, TOKENIZER, held=held)
    pieces = out.collect()
    check_pieces(pieces, [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert all(len(p.ids) == p.length for p in pieces)
    assert packing.pack(odd.where("false"), TOKENIZER).count() == 0


def test_word_lookup_gives_the_tokenizers_ids():
    t = tokenizer()
    texts = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    texts += ["a ́b é \x1cz\xa0q x　y  ΣΑΣ Σ\nİx İ ≠ 1̸!! ×÷ É!it's ('s l'été it''s \x85a\x00b…!", "ÀÉÎß ÿ naïve… ÇA", "Å,K Ḱ!", ""]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for split in (True, False):
        got = [x.tolist() for x in packing.documents_ids(pa.array(texts, pa.large_string()), packing.WordIds(t, split))]
        assert got == want


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    p = packing.Packer(window=32)
    for k, size in enumerate(rng.integers(1, 32, 400).tolist()):
        before = p.levels.copy()
        h = p.level(size)

        def after(level):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n * n).sum())
        open_levels = [0, *[x for x in range(1, 32 - size + 1) if before[x]]]
        assert after(h) == min(map(after, open_levels)) and h in open_levels
        p.add(k, np.zeros(size, np.uint32))
    assert p.held == sum(h * len(w) for h, w in p.open.items()) == int((p.levels * np.arange(33)).sum())


# -- op12

def test_resampling_matches_sql(ready):
    same(queries.op12_importance_resampling(ready, SF01), queries.oracle_sql()["op12_importance_resampling"], SF01)


def plain_draw(docs, target, longest, share, least, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + r]).encode()) % buckets
                        for r in range(1, longest + 1) for i in range(len(w) - r + 1)]
    s, t = (collections.Counter(b for _, x in rows for b in features(x)[1]) for rows in (docs, target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in found)
        name = f"2024:{'' if doc_id is None else doc_id}"
        h = int(__import__("hashlib").sha256(name.encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = collections.Counter((r[0], r[3], k + 1) for k, r in enumerate(able[:share * len(able) // 100]))
    return collections.Counter(tuple(r[:4]) for r in out), drawn


@pytest.mark.parametrize("longest, share, accuracy", [(1, 50, 10_000), (3, 100, 10_000), (2, 30, 3)])
def test_resampling_of_odd_rows(ready, odd, longest, share, accuracy):
    target = ready.createDataFrame([(1, "the fox"), (2, None), (None, "Quick fox ü")], "item_id long, text string")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want, drawn = plain_draw(rows, [tuple(r) for r in target.collect()], longest, share, 2)
    got = resample.resample(odd, target, share=share, least_words=2, longest=longest, accuracy=accuracy,
                            carry=("text", "start")).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    assert collections.Counter((r.doc_id, r.score, r.rank) for r in got if r.rank is not None) == drawn
    assert resample.resample(odd.where("false"), target).count() == 0
    assert resample.report(odd, target.where("false")).count() == len(rows)


def test_bracket_is_widened_and_ranks_go_on_over_parts(ready, monkeypatch):
    monkeypatch.setattr(ranking, "PART_ROWS", 100)
    x = ready.range(3000).selectExpr("id", "cast(case when id % 3 = 0 then 7 else hash(id) % 1000 end as long) score").cache()
    scores = sorted((r.score for r in x.collect()), reverse=True)
    for take in (1, 299, 1500, 2999, 3000):
        for accuracy in (10_000, 2):
            low, high, above = ranking.bracket(x, take, 3000, accuracy=accuracy)
            assert low <= scores[take - 1] <= high and above == sum(s > high for s in scores) < take
    out = ranking.numbered(x, [F.col("score").desc(), F.col("id")], 3000).orderBy("rank").collect()
    assert [r.rank for r in out] == list(range(1, 3001))
    assert [(-r.score, r.id) for r in out] == sorted((-r.score, r.id) for r in out)


# -- op13

def test_search_matches_sql(ready):
    same(queries.op13_geometric_blocks(ready, SF01), queries.oracle_sql()["op13_geometric_blocks"], SF01)


def plain_search(docs, items, top):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [h for h in held if h[1]]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = collections.Counter()
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out.update((item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top]))
    return out


@pytest.mark.parametrize("block, query_bytes, shard", [(64, 1 << 20, 4096), (2, 20, 3)])
def test_search_of_odd_rows(ready, odd, block, query_bytes, shard, monkeypatch):
    items = ready.createDataFrame([(1, "the fox"), (1, "the fox"), (2, None), (3, ""), (None, "THE quick w7"), (4, "absent"),
                                   (5, "x y z w1 w2 the")], "item_id long, text string")
    docs, asked = ([tuple(r) for r in t.select(c, "text").collect()] for t, c in ((odd, "doc_id"), (items, "item_id")))
    got = lexical.search(odd, items, top=4, block=block, query_bytes=query_bytes).collect()
    assert collections.Counter(map(tuple, got)) == plain_search(docs, asked, 4)
    assert lexical.search(odd.where("false"), items).count() == 0
    assert lexical.search(odd, items.where("false")).count() == 0


def test_blocks_are_skipped_only_when_they_cannot_matter():
    """Clustered documents: the blocked search equals the full product, in small blocks."""
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(60)]
    items = [(j, " ".join(rng.choice(words, 6))) for j in range(40)]
    q = lexical.Queries(items)
    n = 600
    topics = rng.random((8, len(q.terms))) ** 8
    held = rng.random((n, len(q.terms))) < topics[rng.integers(0, 8, n)]
    doc, term = np.nonzero(held)
    impact = rng.integers(1, 10**6, len(doc))
    weights = rng.integers(1, 9000, len(q.terms)).astype(np.float64)
    shard = lexical.Shard(q, weights, np.arange(n), (doc, term, impact), block=8)
    seen, skipped = np.zeros(n, bool), 0
    for held, times in zip(q.held, q.times):
        order = np.argsort(-weights[held], kind="stable")
        best = lexical.Best(5)
        skipped += lexical.search_shard(shard, held[order], (times * weights[held])[order], best, seen)
        full = (times * weights[held]) @ shard.impact[held].astype(np.float64)
        want = sorted((-s, i) for i, s in enumerate(full.tolist()) if s > 0)[:5]
        assert [(-s, i) for s, i in zip(best.scores, best.ids)] == want
    assert skipped > 100 and not seen.any()
