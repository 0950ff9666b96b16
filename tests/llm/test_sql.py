"""The SQL of operators on pairs, windows and substrings, on planted rows."""

import duckdb
import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import itq, oracle, prefix_doubling, sigtree, staging, suffix_contam  # noqa: E402

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{i}" for i in range(30))


@pytest.fixture(scope="module")
def ready(spark):
    return staging.prepare(spark)


def _texts():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = [f"v{k}" for k in rng.integers(0, 400, int(rng.integers(1, 120)))]
        rows.append((3 * i, " ".join(words)))
        if i % 3 == 0:  # a near copy, one that holds the passage, one in upper case with other spaces
            rows.append((3 * i + 1, " ".join([*words[:-1], "other"])))
            rows.append((3 * i + 2, "  ".join(words).upper() + "\n" + PASSAGE))
    return [*rows, (500, None), (501, ""), (502, " \t\n"), (503, "é" * 70), (504, "ünï " + "é" * 70), (505, PASSAGE[7:])]


def _same(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toArrow())
    cur = con.execute(sql.format(**{t: t for t in tables}))
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert got == sorted(cur.fetchall())
    return [dict(zip(names, r)) for r in got]


def test_texts(ready):
    docs = ready.createDataFrame(_texts(), "doc_id long, text string")
    items = ready.createDataFrame([(1, PASSAGE), (2, "ünï"), (10, PASSAGE + " end"), (3, None), (4, "..."), (5, "v1 v2")],
                                  "item_id long, text string")
    assert any(r["component_id"] != r["doc_id"] for r in _same(sigtree.link(docs, block=8), oracle.JACCARD, documents=docs))
    found = _same(suffix_contam.report(docs, items), oracle.CONTAMINATION, documents=docs, benchmark=items)
    assert {r["matches"] for r in found if r["doc_id"] == 504} == {"0:2:0:1"}
    assert any(r["n_removed"] for r in _same(prefix_doubling.report(docs), oracle.SUBSTRINGS, documents=docs))


def test_vectors(ready):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    near = base[rng.integers(0, 40, 120)] + 0.15 * rng.standard_normal((120, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, float("nan")] * 8), (904, [1.0, None] * 8), (905, [1.0] * 8)]
    vectors = ready.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert any(r["n_links"] for r in _same(itq.link(vectors), oracle.EMBEDDINGS, embeddings=vectors))
