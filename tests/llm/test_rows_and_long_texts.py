"""Near-duplicates judged row by row, and texts with very many matches or chunks."""

import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidemark.llm import line_chunks, pii, queries, sigtree, staging  # noqa: E402

SF = "/root/testdata/sf0.001"
A = "seven grey geese walked slowly over the frozen northern lake before any of the hungry foxes woke up and saw them leave for good"


@pytest.fixture(scope="module")
def ready(spark):
    return staging.prepare(spark)


def test_one_row_of_a_group_stays_and_clean_rows_do(ready):
    """Shared and missing ids: a row goes for its own text alone; of equal rows one stays."""
    near, other = A + " again", A.replace("geese", "cranes").replace("foxes", "wolves").replace("lake", "sea") + " and so on to the end"
    rows = [(1, A), (5, A), (5, "a text that nobody else has written in these words at all"), (6, near), (6, "quite another text of its own"),
            (7, other), (7, other), (None, A), (None, "only here without an id does this text of words occur"), (8, ""), (8, ""), (9, None)]
    docs = ready.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _key int")
    out = sigtree.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted(r["_key"] for r in out.collect())
    assert [k for k in kept if k not in (5, 6)] == [0, 2, 4, 8, 9, 10, 11] and len([k for k in kept if k in (5, 6)]) == 1
    assert sigtree.keep_one(docs.where("false")).count() == 0


def test_many_matches_in_one_text(ready):
    """Positions over many groups of matches, and 40,000 numbers in a text."""
    lines = [f"mail a{i}@b.org ip 10.0.{i % 256}.7 call +49 30 {1000000 + i} pay 4111 1111 1111 1111 é" for i in range(1500)]
    texts = {1: "\n".join(lines), 2: " x ".join(f"{i}" for i in range(40_000)), 3: " ".join(f"{i}" for i in range(40_000)),
             4: "a@b.c " * 300, 5: "1 2 3 4 5 6 7 8 9 10 11 12 13 14x4111111111111111", 6: None}
    df = ready.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    t = time.perf_counter()
    out = {r.doc_id: r for r in pii.report(df).collect()}
    assert time.perf_counter() - t < 60
    for i, text in texts.items():
        want = brute.base_spans(text)
        assert out[i].base_sha256 == brute.sha(want), i
    assert (out[1].n_email, out[1].n_ip, out[1].n_phone, out[1].n_card) == (1500, 1500, 1500, 1500)


def test_very_many_repeated_chunks(ready):
    """Two equal texts of 80,000 lines: the second loses all its chunks, in linear time."""
    text = "\n".join(f"line {i * 7919 % 80_000}" for i in range(80_000))
    df = ready.createDataFrame([(1, text), (2, text), (3, "own\nlines")], "doc_id long, text string").repartition(3)
    t = time.perf_counter()
    out = {r.doc_id: r for r in line_chunks.report(df).collect()}
    assert time.perf_counter() - t < 60
    assert out[1].removed_lines == 0 and out[3].removed_lines == 0
    assert out[2].n_lines == 80_000 and out[2].removed_chunks >= out[2].n_chunks - 1


def test_registered_decontamination_tells_places(ready):
    """The longest matches name words that are there in document and item."""
    import re
    from typing import NamedTuple

    class Match(NamedTuple):
        word: int
        item_id: int
        item_word: int
        n_words: int

    out = queries.op4_suffix_arrays(ready, SF).where("n_hit > 0")
    docs, items = ({r[0]: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(r[1])) for r in
                    staging.documents(ready, SF, t).select(c, "text").collect()} for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    n = 0
    for r in out.collect():
        hit = set()
        for m in (Match(*map(int, x.split(":"))) for x in r.matches.split(",")):
            own = docs[r.doc_id][m.word:m.word + m.n_words]
            item = items[m.item_id]
            assert own == item[m.item_word:m.item_word + m.n_words] and len(own) == m.n_words
            for step, end in ((-1, -1), (m.n_words, 0)):  # not to be made longer on either side
                a, b = m.word + step, m.item_word + step
                if 0 <= a < len(docs[r.doc_id]) and 0 <= b < len(item):
                    assert docs[r.doc_id][a] != item[b]
            hit |= set(range(m.word, m.word + m.n_words))
            n += 1
        assert len(hit) == r.n_hit
    assert n > 0


NOTICE = "we use cookies to keep this page running please read the notice before going on"


def test_texts_that_share_a_notice(ready):
    """Short texts that hold a common notice and little else: links are all found, and
    the rows that are compared grow with the texts, not with their square."""
    import numpy as np
    dealt = {}
    for n in (400, 1600):
        rng = np.random.default_rng(n)
        rows = [(i, " ".join([NOTICE, *(f"a{k}" for k in rng.integers(0, 10**6, int(rng.integers(2, 8))))])) for i in range(n)]
        rows += [(n + i, rows[7 * i][1] + (" end" if i % 2 else "")) for i in range(n // 20)]
        docs = ready.createDataFrame(rows, "doc_id long, text string")
        if n == 400:
            want = brute.jaccard_components(rows)
            assert any(c != d for d, (_, c) in want.items())
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.link(docs, block=32).collect()} == want
        held = docs.select(docs.doc_id.alias("doc"), docs.doc_id.alias("comp"))
        found = sigtree._prefix_groups(held, docs.withColumnRenamed("doc_id", "doc"), 5, 32)
        dealt[n] = sum(r.nb if r.visits else 1 for r in found.collect())
    assert dealt[1600] < 6 * dealt[400]
