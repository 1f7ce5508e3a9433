import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grantlens.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Every document scored for every item."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, b, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_words
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in wanted.items() if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def some_docs(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "x9", "The", "THE", "the", "a"]
    odds = [1 / (i + 1) for i in range(len(words))]
    text = lambda: rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, odds, k=rng.choice([0, 1, 3, 20, 80])))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, "w1 w2 w30 copies") for i in range(60)] + [(5, "w1 w2 w30 copies"), (None, "w1 w2 w30 copies"), (None, "w40 w41"), (n + 70, None), (n + 71, " .,"), (n + 72, "w3 " * 90_000 + "rare")]
    items = [(i, text()) for i in range(25)] + [(100, "w1 w2 w30 COPIES copies"), (101, None), (102, "..."), (103, "absent words"), (None, "w5 w6"), (104, "rare"), (104, "w7"), (105, "w0 w0 w0 " * 300)]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("shard", [20, 100_000])
def test_against_scoring_all(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD_DOCS", shard)
    docs, items = some_docs(shard)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as term")
    got = L.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(docs, items, 10)


def test_items_in_blocks_and_another_k(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS", 100)
    docs, items = some_docs(3, 150)
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert Counter(map(tuple, got.collect())) == plain(docs, items, 3)


def test_all_terms_in_all_documents_weigh_next_to_nothing(spark):
    docs, items = [(i, "a b") for i in range(30)], [(1, "a b c")]
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain(docs, items, 10)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(none, items).collect() == []
    assert L.search(one, items.limit(0)).collect() == []
    assert L.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []


def test_search_stops_before_the_lists_end():
    """Documents of far lower impact than the best ones aren't looked up."""
    n = 50_000
    rng = np.random.default_rng(1)
    sizes = rng.integers(100, 2000, n)
    sizes[:20] = 2
    texts = np.arange(n, dtype=np.int32)
    of = L.Figures(n, int(sizes.sum()), np.array([900, 800]))
    shard = L.Shard(np.array([0, 1]), np.array([n, n]), np.concatenate([texts, texts]), np.ones(2 * n, np.int32), sizes, of)
    looked = []
    whole = L.List.look_up
    try:
        L.List.look_up = lambda self, docs: looked.append(len(docs)) or whole(self, docs)
        docs, scores = L.best_documents(shard, [(0, 1), (1, 2)], 10)
    finally:
        L.List.look_up = whole
    assert sorted(docs.tolist()) == list(range(20)) and len(set(scores.tolist())) == 1
    assert sum(looked) < n // 10


def test_terms_of_sliced_columns():
    texts = pa.array(["drop me", "A-b", None, "", "c", "d!", "éÉ x"]).slice(1)
    _, sizes = L.folded(texts)
    assert sizes.tolist() == [2, 0, 0, 1, 1, 2]
    assert L.folded(texts)[0].to_pylist() == ["a b", "", "", "c", "d ", "éÉ x"]
