"""The operators against brute force, and on awkward rows."""

import datetime
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import (  # noqa: E402
    crf_quality,
    grams,
    graph,
    itq,
    line_chunks,
    mixing,
    pii,
    prefix_doubling,
    queries,
    sigtree,
    staging,
    suffix_contam,
    toxicity,
    warc,
)

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
PASSAGE = "Seven grey geese walked slowly over the frozen northern lake before any of the hungry morning foxes woke up and saw them leave for good"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def ready(spark):
    return staging.prepare(spark)


@pytest.fixture(scope="module")
def docs(ready):
    return staging.documents(ready, SF).select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def odd(ready):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns named like those that operators use."""
    long = " ".join(f"w{i}" for i in range(40_000))
    base = [(1, PASSAGE, "en", "b"), (2, PASSAGE, "en", "b"), (3, PASSAGE + " tail", "en", None), (4, None, "en", "a"),
            (5, "", None, "a"), (6, "", "en", "a"), (7, long, "en", "a"), (8, long + " end", "en", "é"), (9, " \n\n ", "en", "z"),
            (10, "a", "en", "z"), (11, "A", "en", "z"), (None, PASSAGE, "en", "b"), (12, "x\n" * 500 + PASSAGE, "en", "z"),
            (12, "x\n" * 500 + PASSAGE, "en", "z"), (13, "é" * 60, "en", "z"), (14, "é" * 60, "en", "z"),
            (15, "Ünï " + PASSAGE.upper(), "de", "b")]
    clash = ["token", "comp", "n", "size", "copy", "kept", "_lines", "_gone", "gone", "component_id", "toxic", "_id", "_row"]
    rows = [(*r, len(r[1] or ""), *range(len(clash))) for r in base]
    return ready.createDataFrame(rows, DOCS + "".join(f", {c} int" for c in clash))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def distinct_ids(df):
    return df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def duck(sql, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


# -- op1

def test_warc_matches_sql(ready):
    got = queries.op1_warc(ready, SF).toPandas().sort_values("page_id", ignore_index=True)
    want = duck(queries.oracle_sql()["op1_warc"], {"pages": f"{SF}/pages.parquet"}).sort_values("page_id", ignore_index=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in want:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


def test_warc_odd_pages(ready):
    same = "<p>" + "é\r\n\r\n" * 40
    rows = [(3, "u3", same), (1, "http://x\r\ny%0Az", same), (2, None, same), (4, "u", None), (5, "u", ""), (6, "u", "short"),
            (7, "u", "short"), (None, "u", same), (8, "u", "x" * 3_000_000), (1, "again", same)]
    pages = ready.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, first int, payload int")
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out if r.page_id not in (None, 1)}
    assert [by[i].record_type for i in (2, 3, 6, 7)] == ["revisit", "revisit", "response", "response"]
    assert by[2].refers_to == by[3].refers_to == 1 and by[6].refers_to is None
    assert {r.record_type for r in out if r.page_id in (None, 1)} == {"response"}
    assert "http://x\r\ny%0Az" in {r.url for r in out}
    for r in rows:
        if r[0] not in (None, 1):
            assert (by[r[0]].payload_bytes, by[r[0]].payload_digest) == (len((r[2] or "").encode()), brute.sha(r[2] or ""))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_pushes_header_filters(ready):
    path = staging.new_path(ready, "warc")
    warc.write_warc(warc.as_records(staging.documents(ready, SF, "pages")), path)
    df = warc.read_warc(ready, path, ["page_id", "record_type"]).where("record_type = 'response' AND page_id IN (1, 2)")
    assert {r.page_id for r in df.collect()} == {1, 2}
    assert "+- Filter" not in df._jdf.queryExecution().executedPlan().toString()


def test_warc_second_write_keeps_the_first(ready):
    path = staging.new_path(ready, "warc")
    records = warc.as_records(staging.documents(ready, SF, "pages"))
    for ids in ("page_id = 1", "page_id = 2"):
        warc.write_warc(records.where(ids), path)
    assert sorted(r.page_id for r in warc.read_warc(ready, path, ["page_id"]).collect()) == [1, 2]


# -- op2

def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1024, 8])
def test_itq_against_all_pairs(ready, block):
    rng = np.random.default_rng(1)
    far = rng.standard_normal((300, 32))
    near = np.concatenate([far[:30] + 0.25 * rng.standard_normal((30, 32)), far[0] + 0.1 * rng.standard_normal((60, 32)), far[1:3]])
    x = np.concatenate([far, near]) * rng.uniform(0.1, 9, (392, 1))
    good = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [1.0] + [None] * 31, 1), (904, [float("nan")] * 32, 1),
           (905, [float("inf")] * 32, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, x[0].tolist(), 1)]
    df = ready.createDataFrame(good + bad, "vec_id long, embedding array<double>, keys int")
    out = {r.vec_id: r for r in itq.link(df, block=block).collect()}
    assert len(out) == len(good) + len(bad)
    cos = unit(x) @ unit(x).T
    want = (cos >= 0.9) & ~np.eye(len(x), dtype=bool)
    links = sum(out[i].n_links for i in range(len(x)))
    assert 0.95 * want.sum() <= links <= want.sum()
    assert all(out[i].n_links <= want[i].sum() for i in range(len(x)))
    comp = brute.smallest_linked(range(len(x)), np.argwhere(want).tolist())
    assert np.mean([out[i].component_id == comp[i] for i in comp]) > 0.95
    assert all(out[i].n_links == 0 and out[i].component_id == i for i in range(900, 906))
    assert (out[906].n_links, out[907].component_id) == (1, 906)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values() if r.vec_id is not None)
    assert itq.link(df.where("false")).count() == 0


def test_itq_finds_one_table_pairs_once(ready):
    df = ready.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(40)], "vec_id long, embedding array<double>")
    for block in (1024, 4):
        assert {(r.n_links, r.component_id) for r in itq.link(df, block=block).collect()} == {(39, 0)}


def test_itq_joins_vectors_to_survivors_alone(ready, monkeypatch):
    """Only codes are dealt into the tables; what the Hamming filter leaves is
    little more than the rows of near pairs."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x = np.concatenate([x, x[:40] + 0.2 * rng.standard_normal((40, 64))])
    sizes = {}

    def counted(df, name):
        out = staging.staged(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(itq, "staged", counted)
    df = ready.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    links = sum(r.n_links for r in itq.link(df).collect())
    cos = unit(x) @ unit(x).T
    want = int((cos >= 0.9).sum()) - len(x)
    assert 0.9 * want <= links <= want
    _, tables = itq.plan(len(x), 64)
    assert sizes["survivors"] < 0.05 * tables * len(x)


def test_itq_pairs_of_runs_in_any_slices(monkeypatch):
    rng = np.random.default_rng(6)
    n, bits, tables = 300, 4, 6
    signs = rng.integers(0, 2, (n, 64)).astype(np.uint8)
    rows = sorted((int(rng.integers(0, 3)), int(rng.integers(0, 4)), int(rng.integers(0, 2)), i) for i in range(n))
    t, k, block, rid = (np.array(c, np.int32) for c in zip(*rows))
    home, shared = rng.integers(0, 2, n).astype(np.int32), rng.integers(0, 2, n).astype(bool)
    clump = rng.integers(-1, 2, n)
    table = pa.table({"t": t, "k": k, "block": block, "rid": rid, "home": home, "shared": shared, "clump": clump,
                      "code": [np.packbits(r).tobytes() for r in signs]})
    keys = itq._table_keys(signs.astype(np.int64), 64, bits, tables)
    want = {(i, j) for i in range(n) for j in range(i + 1, n)
            if rows[i][:3] == rows[j][:3] and (signs[i] != signs[j]).sum() <= 32
            and not (clump[i] == clump[j] >= 0) and not (shared[i] and shared[j] and home[i] != block[i])
            and not (keys[i, :t[i]] == keys[j, :t[i]]).any()}
    for pairs, held, batch in ((1 << 18, 1000, 300), (7, 1, 13), (50, 40, 1)):
        monkeypatch.setattr(itq, "PAIRS", pairs)
        got, base = set(), 0
        for part, ends in itq._whole_runs(iter(table.to_batches(batch)), held):
            for a, b in itq._close(part, ends, 64, bits, tables, 32):
                got |= {(base + int(i), base + int(j)) for i, j in zip(a, b)}
            base += len(part)
        assert base == n and got == want


def test_itq_roots_of_links():
    rng = np.random.default_rng(7)
    edges = rng.integers(0, 500, (400, 2))
    root = np.arange(500)
    for part in np.array_split(edges, 3):
        itq._join(root, part[:, 0], part[:, 1])
    want = brute.smallest_linked(range(500), edges.tolist())
    assert all(root[i] == want[i] for i in want)


# -- op3

@pytest.mark.parametrize("block", [512, 2])
def test_signature_trees_against_all_pairs(ready, docs, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.link(docs, block=block).collect()}
    assert got == brute.jaccard_components(rows_of(docs))


def test_signature_trees_near_copies(ready):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(4000)]
    rows = []
    for g in range(6):
        base = rng.choice(words, 150).tolist()
        for _ in range(25):
            t = list(base)
            for p in rng.choice(150, rng.integers(0, 9), replace=False):
                t[p] = str(rng.choice(words))
            rows.append((len(rows), " ".join(t + PASSAGE.split() * int(rng.integers(0, 2)))))
    df = ready.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard_components(rows)
    for block in (512, 4):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.link(df, block=block).collect()} == want


def test_signature_trees_tied_pairs_in_any_order():
    """A pair of shared rows is checked in one block, also where sets tie and
    each block sees its rows in another order."""
    rng = np.random.default_rng(4)
    base = rng.choice([f"t{i}" for i in range(4000)], 120).tolist()
    texts, least = [], None
    while len(texts) < 4:
        t = list(base)
        t[int(rng.integers(120))] = f"u{rng.integers(1 << 30)}"
        raw = " ".join(t).encode()
        first = grams.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5)[0][0]
        least = first if least is None else least
        if first == least:
            texts.append(" ".join(t))
    for a, b in ((0, 1), (1, 2), (2, 3), (0, 3)):
        for homes in ((0, 1), (1, 0), (0, 0), (1, 1)):
            rows = [{"token": 5, "doc": d, "comp": d, "home": h, "shared": True, "text": texts[d]} for d, h in zip((a, b), homes)]
            for orders in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                batches = [pa.RecordBatch.from_pylist([{**r, "block": k} for r in rows[::o]]) for k, o in enumerate(orders)]
                found = [set(e.values()) for out in sigtree._linker(5)(iter(batches)) for e in out.to_pylist()]
                assert found == [{a, b}], (a, b, homes, orders)


def test_signature_trees_odd(odd):
    out = sigtree.link(odd).collect()
    assert len(out) == odd.count()
    want = brute.jaccard_components(rows_of(distinct_ids(odd)))
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out if r.doc_id is not None)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert sigtree.link(odd.where("false")).count() == 0


def test_components_of_a_long_chain(ready):
    edges = ready.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {tuple(r) for r in graph.components(edges).collect()} == {(i, 0) for i in range(301)}


# -- op4

@pytest.mark.parametrize("block_bytes", [1 << 22, 700])
def test_suffix_arrays_against_windows(ready, docs, block_bytes):
    bench = staging.documents(ready, SF, "benchmark")
    found = suffix_contam.contamination(docs, bench, block_bytes=block_bytes).collect()
    want = brute.contamination(rows_of(docs), [(r.item_id, r.text) for r in bench.collect()])
    for r in found:
        assert (r.n_words, r.n_hit, len(r["items"])) == want[r.doc_id][:3] and r.contaminated == want[r.doc_id][4]
    assert any(m.n_words > 13 for r in found for m in r.matches)


def test_suffix_arrays_odd(ready, odd):
    items = [(1, PASSAGE), (2, "w3 w4"), (3, None), (4, "..."), (5, "a"), (10, PASSAGE), (7, "é" * 60), (1, PASSAGE), (8, "x " * 30)]
    bench = ready.createDataFrame([(*i, 0) for i in items], "item_id long, text string, bits int")
    out = suffix_contam.report(odd, bench).collect()
    want = brute.contamination(rows_of(distinct_ids(odd)), items)
    assert len(out) == odd.count()
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
    assert suffix_contam.report(odd.where("false"), bench).count() == 0
    assert suffix_contam.report(odd, bench.where("false")).where("contaminated").count() == 0


# -- op5

def test_mixing_matches_sql(ready):
    got = queries.op5_mixing(ready, SF).toPandas().sort_values("doc_id", ignore_index=True)
    want = duck(queries.oracle_sql()["op5_mixing"], {"documents": f"{SF}/documents.parquet"}).sort_values("doc_id", ignore_index=True)
    for c in want:
        assert np.allclose(got[c], want[c]), c


def test_mixing_targets(ready):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(90, "a"), (5, "b"), (5, "c"), (0, "d"), (100, None), (300, "é")])]
    out = {r.source_size: r.target for r in mixing.mix_report(ready.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # weights 1, 2, 3, 1, 2, 3 over 500 words: b and c stop at 15 each, the rest goes by weight to a, é and null
    level = (500 - 30) / (1 + 2 + 3)
    assert out[5] == 15 and out[0] == 0
    assert out[90] == pytest.approx(level) and out[300] == pytest.approx(2 * level) and out[100] == pytest.approx(3 * level)


def test_mixing_odd(odd):
    out = mixing.mix_report(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 3 * r.size for r in out)
    mixed = mixing.mix(odd)
    assert len(mixed.columns) == len(set(mixed.columns))
    assert sum(r.taken for r in mixed.select("taken").collect()) == sum(r.taken for r in out)
    assert mixing.mix(odd.where("false")).count() == 0


# -- op6, op8

def test_toxicity_on_held_out_labels(ready):
    docs, labels = staging.documents(ready, SF01), staging.documents(ready, SF01, "labels")
    cats = toxicity.categories(labels)
    out = toxicity.score(docs, toxicity.train(docs, cats.where(~crf_quality.held_out())), ["low_quality", "toxic"])
    held = out.join(labels, "doc_id").where(crf_quality.held_out()).toPandas()
    hit = (held.p_toxic >= toxicity.THRESHOLD) == (held.toxic == 1)
    assert hit.mean() > 0.97
    assert (held[held.toxic == 1].p_toxic >= toxicity.THRESHOLD).mean() > 0.9


def test_toxicity_later_models_see_earlier_ones():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 50, 8)) for _ in range(2000)]
    first = np.array([int(3 in d) for d in docs])
    chain = toxicity.Chain(docs, np.column_stack([first, first]))
    assert chain.models[1].v[0] > 0


def test_classifiers_odd(ready, odd):
    labels = ready.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, 1), (7, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for df in (toxicity.report(odd, labels), toxicity.report(odd, labels.where("false")),
               crf_quality.report(odd, labels), crf_quality.report(odd, labels.where("false"))):
        out = df.collect()
        assert len(out) == odd.count()
        score = "score" if "score" in df.columns else "p_toxic"
        assert all(0 <= r[score] <= 1 for r in out)
    assert toxicity.report(odd.where("false"), labels).count() == 0
    assert crf_quality.report(odd.where("false"), labels).count() == 0


def test_quality_on_held_out_labels(ready):
    out = queries.op8_crf_quality(ready, SF01).join(staging.documents(ready, SF01, "labels"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.98


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    field = crf_quality.Field(4)
    field.w, field.t = rng.standard_normal(4), rng.standard_normal((2, 2))
    first = np.array([0, 3, 4])
    x = rng.standard_normal((4, 4))
    p, _, _ = field.marginals(x, first)
    for lo, hi in ((0, 3), (3, 4)):
        weights = {}
        for code in range(2 ** (hi - lo)):
            y = [code >> i & 1 for i in range(hi - lo)]
            s = sum(v * (x[lo + i] @ field.w) for i, v in enumerate(y)) + sum(field.t[a, b] for a, b in zip(y, y[1:]))
            weights[tuple(y)] = np.exp(s)
        for i in range(hi - lo):
            assert p[lo + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / sum(weights.values()))


# -- op7

def test_line_chunks_survive_shifts(ready):
    lines = [f"line {i} {datetime.date(2020, 1, 1) + datetime.timedelta(i * i)}" for i in range(40)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", "start", "here"] + lines + ["and", "end"])), (3, "\n".join(lines[20:23]))]
    out = {r.doc_id: r for r in line_chunks.report(ready.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].removed_lines == 0 and out[1].kept_text == rows[0][1]
    assert out[2].removed_lines >= 32 and out[2].kept_text.startswith("new\nstart\nhere")


def test_line_chunks_against_plain_groups(ready, docs):
    """What stays is every text without the chunks that an earlier document holds."""
    chunked = line_chunks._chunked(docs.select("doc_id", "text")).select("doc_id", "text", "_chunks").collect()
    first = {}
    for r in sorted(chunked, key=lambda r: r.doc_id):
        assert "\n".join(c.body for c in r._chunks) == r.text
        assert all(c.n_lines >= 2 for c in r._chunks[:-1])
        for c in r._chunks:
            first.setdefault(c.body, (r.doc_id, c.no))
    out = {r.doc_id: r for r in line_chunks.report(docs).collect()}
    assert any(r.removed_chunks for r in out.values())
    for r in chunked:
        kept = [c for c in r._chunks if c.n_lines < 2 or first[c.body] == (r.doc_id, c.no)]
        assert out[r.doc_id].kept_text == ("\n".join(c.body for c in kept))
        assert out[r.doc_id].removed_chunks == len(r._chunks) - len(kept)


def test_line_chunks_odd(odd):
    out = line_chunks.report(odd)
    assert out.count() == odd.count()
    assert out.where("doc_id = 4").first().kept_text is None
    stage = line_chunks.with_deduped_text(odd)
    assert stage.columns == odd.columns and stage.count() == odd.count()
    assert line_chunks.report(odd.where("false")).count() == 0


def test_line_passages_all_found(ready, docs):
    """Passages of 51 words and more, in one line or several, in texts of one line
    and between other lines, against all runs of lines."""
    rng = np.random.default_rng(7)

    def line(n):
        return " ".join(rng.choice(list("abcdefghij"), n)) + f" {rng.integers(1 << 40)}"
    planted = [[line(n) for n in sizes] for sizes in ((60,), (49,), (50,), (30, 30), (3, 60, 2), (9,) * 8, (20, 20), (25, 0, 30))]
    rows = [(100 * k + i, "\n".join([line(12) for _ in range(i % 3)] + p + [line(12) for _ in range(i % 2)]))
            for i in range(6) for k, p in enumerate(planted)]
    rows += [(9_000, "\n".join(["x"] * 300)), (9_001, line(70) + "\n\n" + line(70)), (9_002, None), (9_003, "")]
    rows += [(10_000 + i, t) for i, t in rows_of(docs)]
    out = {r.doc_id: r for r in line_chunks.report(ready.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    by_chunks = {r.doc_id: r.kept_text for r in line_chunks.report(ready.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute.repeated_passages(rows)
    assert sum(map(len, gone.values())) > 100
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in gone.get(i, ())]
        assert out[i].removed_lines >= len(gone.get(i, ()))
        kept = iter(left)
        assert text is None or all(x in kept for x in out[i].kept_text.split("\n")) or out[i].kept_text == ""
        if by_chunks[i] == text:
            assert out[i].kept_text == (text and "\n".join(left))
    # no line is lost from all documents
    assert {x for _, t in rows for x in (t or "").split("\n") if x} == {x for r in out.values() for x in (r.kept_text or "").split("\n") if x}


# -- op9

def test_pii_against_plain_patterns(ready, docs):
    tricky = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8 and 300.1.1.1 007.000.0.255", "4111 1111 1111 1111-4111111111111111", "+1 (555) 010-9999.",
              "++12 34567890123456", "1" * 5000, "a." * 3000, "1 " * 3000, "@" * 50, "é+49 30 1234567 é me@ex.de", "12345678901234567890",
              "GB82WEST12345698765432 iban DE89370400440532013000 XX00AAAA11112222333", None, ""]
    df = docs.select("doc_id", "text").unionByName(ready.createDataFrame(list(enumerate(tricky, 10_000)), "doc_id long, text string"))
    texts = dict(rows_of(df))
    for r in pii.report(df).collect():
        want = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(want), (r.doc_id, r.spans, want)
        assert [s for s in r.spans.split(",") if not s.startswith("iban")] == want.split(",") or not want
        assert len(r.scores) == len([s for s in r.spans.split(",") if s])
        if r.doc_id == 10_012:
            assert r.n_iban == 2


def test_pii_odd(odd):
    assert pii.report(odd).count() == odd.count()
    assert pii.report(odd.where("false")).count() == 0
    plan = pii.report(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- op10

def test_prefix_doubling_against_all_windows(ready, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_doubling.report(docs).collect()}
    assert got == brute.substrings(rows_of(docs))


def test_prefix_doubling_many_small_flushes(ready, monkeypatch):
    """A passage in every document, with and without the same surroundings."""
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("abcdefgh "), 90)) for _ in range(60)]
    rows = [(i - 30, noise[i] + PASSAGE + (noise[0] if i % 3 else noise[i][::-1]) + "ab" * (i % 40)) for i in range(60)]
    df = ready.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_doubling.report(df).collect()}
    assert got == brute.substrings(rows)


def test_prefix_doubling_odd(odd):
    out = prefix_doubling.report(odd).collect()
    assert len(out) == odd.count()
    want = brute.substrings(rows_of(distinct_ids(odd)))
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in out if r.doc_id is not None)
    assert [r.n_removed for r in out if r.doc_id is None] == [0]
    assert prefix_doubling.report(odd.where("false")).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    for w in (1, 2, 5, 27, 200):
        assert (grams.sliding_min(x, w) == [x[i:i + w].min() for i in range(200 - w + 1)]).all()


# -- the pipeline

def test_pipeline_stages(ready, docs):
    """Every stage's decisions against brute force, on what the one before kept."""
    before = staging.documents(ready, SF)
    columns = before.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = staging.staged(stage(ready, before, SF), "test-stage")
        old, new = dict(rows_of(before)), dict(rows_of(after))
        assert set(new) <= set(old)
        if k < 4:
            assert after.columns == columns and len(new) == after.count()
        if name == "line dedup":
            assert set(new) == set(old)
        if name == "n-gram Jaccard join":
            comp = brute.jaccard_components(list(old.items()))
            assert set(new) == {i for i, (_, c) in comp.items() if c == i}
        if name == "benchmark decontamination":
            bench = [(r.item_id, r.text) for r in staging.documents(ready, SF, "benchmark").collect()]
            assert set(new) == {i for i, x in brute.contamination(list(old.items()), bench).items() if not x[4]}
        if name == "mixing":
            taken = after.groupBy("doc_id").agg(F.sum("taken").alias("t"), F.max("copy").alias("c"), F.count("*").alias("n")).collect()
            report = {r.doc_id: r.taken for r in mixing.mix_report(before).collect()}
            assert all(r.t == report[r.doc_id] and r.c == r.n <= 3 for r in taken)
        before = after


def test_pipeline_flags_go_with_their_rows(ready):
    """Flagged rows go without an id too, and take no clean row of the same id along."""
    sf = "/root/testdata/sf0.01"
    before = staging.documents(ready, sf)
    texts = dict(rows_of(before))
    bench = staging.documents(ready, sf, "benchmark")
    toxic = {r.doc_id for r in toxicity.report(before, staging.documents(ready, sf, "labels")).where("toxic = 1").collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    leaked = {i for i, x in brute.contamination(list(texts.items()), items).items() if x[4]}
    clean = min(i for i in texts if texts[i] and i not in toxic | leaked)
    for stage, flagged in ((corpus_pipeline.clean, min(toxic)), (corpus_pipeline.decontaminate, min(leaked))):
        copies = before.where(F.col("doc_id").isin(clean, flagged))
        more = [copies.withColumn("doc_id", F.lit(i).cast(before.schema["doc_id"].dataType)) for i in (None, 10**6)]
        out = stage(ready, before.unionByName(more[0]).unionByName(more[1]), sf).where("doc_id IS NULL OR doc_id = 1000000")
        assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, texts[clean]), (10**6, texts[clean])]


def test_pipeline_odd(ready, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = staging.staged(stage(ready, odd, SF), "odd-stage")
        assert out.count() > 0
        assert staging.staged(stage(ready, odd.where("false"), SF), "odd-stage").count() == 0
        if name != "mixing":
            assert out.columns == odd.columns
