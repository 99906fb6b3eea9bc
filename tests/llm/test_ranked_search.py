"""Ranked search against a plain sum over all postings: ties, repeats, missing values, one slab and many."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.llm import ranked_search
from scoreframe.llm.queries import QUERIES
from scoreframe.llm.text import LOWER, UPPER

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def plain(docs, items, k):
    held = [(key, Counter(found), len(found)) for key, text in docs if (found := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for key, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -score) for i, (score, _, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_query_equals_the_plain_sum(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(QUERIES["op12_ranked_search"](spark, FOLDER)) == plain(docs, items, 20)


@pytest.fixture(scope="module")
def corpus():
    """Common words in all documents, rare ones in few; copies tie, with each other and across the cut."""
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % (5 + j)}" for j in range(1 + i % 40)) + " the") for i in range(400)]
    docs += [(1000 + i, "the same text as Others, w1 w2") for i in range(60)]
    docs += [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3 rare"), (5000, None), (5001, ""), (5002, " -- "), (5003, "Ünïcode_w1\x7fw2 WÄ")]
    items = [(1, "w1 w2 w2 W3"), (2, "the same"), (3, None), (4, "absent words only"), (None, "rare"), (1, "w1 w2 w2 W3"), (6, "the the the"), (7, "ünïcode Ünïcode wÄ")]
    return docs, items


@pytest.mark.parametrize("docs_held, k", [(1, 3), (16, 20), (1 << 14, 20), (50, 1_000)])
def test_any_blocks_give_the_same_ranks(spark, corpus, monkeypatch, docs_held, k):
    monkeypatch.setattr(ranked_search, "DOCS", docs_held)
    monkeypatch.setattr(ranked_search, "POSTINGS", 4 * docs_held)
    monkeypatch.setattr(ranked_search, "ENTRIES", 5 if docs_held == 16 else 1 << 18)
    docs, items = corpus
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "terms": F.lit("w1"), "id": F.lit(2)}).repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert found(ranked_search.search(left, right, k)) == plain(docs, items, k)


def block(columns):
    """Lists of (document, impact) pairs, one for each term."""
    rows = [(d, t, i) for t, column in enumerate(columns) for d, i in column]
    doc, term, impact = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    return ranked_search.Lists(doc, term, impact, 1 + int(doc.max()), len(columns))


def test_reading_stops_when_no_document_can_reach_what_is_known():
    item = ranked_search.Item(1, np.array([0, 1]), np.array([1, 2]))
    lists = block([[(d, 1_000 - d) for d in range(500)], [(d, 10) for d in range(500)]])
    held, low = ranked_search.resolved(item, lists, 0, 3)
    assert dict(zip(held.tolist(), low.tolist(), strict=True)) == {0: 1_020, 1: 1_019, 2: 1_018}
    held, _ = ranked_search.resolved(item, lists, 1_021, 3)
    assert not len(held)
    held, low = ranked_search.resolved(item, lists, 1_020, 3)  # a tie stays
    assert held.tolist() == [0] and low.tolist() == [1_020]


def test_intervals_equal_the_plain_sum_on_random_lists():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n, t, k = int(rng.integers(1, 40)), int(rng.integers(1, 7)), int(rng.integers(1, 6))
        columns = [[(int(d), int(rng.integers(1, 1 << int(rng.integers(1, 20))))) for d in rng.choice(n, int(rng.integers(1, n + 1)), replace=False)] for _ in range(t)]
        times = rng.integers(1, 4, t)
        total = Counter()
        for column, q in zip(columns, times, strict=True):
            for d, i in column:
                total[d] += i * int(q)
        known = int(rng.choice([0, max(total.values()), sorted(total.values())[len(total) // 2]]))
        held, low = ranked_search.resolved(ranked_search.Item(1, np.arange(t), times), block(columns), known, k)
        got = dict(zip(held.tolist(), low.tolist(), strict=True))
        assert all(total[d] == s for d, s in got.items())
        kth = sorted(total.values())[-k] if len(total) >= k else 0
        assert {d for d, s in total.items() if s >= max(kth, known)} <= got.keys()


def test_long_texts_and_empty_tables(spark):
    long = " ".join(f"x{i}" for i in range(150_000)) + " w1"
    docs = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, "w2")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 x149999 w2")], "item_id long, text string")
    assert found(ranked_search.search(docs, items)) == plain([(1, long), (2, "w1 w2"), (3, "w2")], [(1, "w1 x149999 w2")], 20)
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        out = ranked_search.search(left, right)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
