"""The best item of every text against all pairs."""

import random
import re

from pyspark.sql import functions as F

from grantlens.operators import questions as O
from grantlens.rules import corpus as Q


def _best_by_all_pairs(texts, items):
    """Every text against every item by the definition of the score."""
    split = lambda t: [w for w in re.split(r"\s+", re.sub(r"[^A-Za-z0-9_\s]", " ", t.lower())) if len(w) > 1 and w not in Q.STOP_WORDS]
    out = {}
    for d, text in texts:
        norm = re.sub("[?.,!]", "", text.lower().strip())
        words, best = split(norm), None
        for i, item in sorted(items):
            own = set(split(item))
            hits = sum(w in own for w in words)
            if hits:
                score = hits / len(own | set(words)) + (Q.CONTAINMENT_BONUS if item.lower() in norm or norm in item.lower() else 0)
                if best is None or score > best[1] + 1e-12:
                    best = (i, score)
        if best and best[1] >= Q.MIN_SCORE:
            out[d] = (best[0], round(best[1], 9))
    return out


def test_best_items_against_all_pairs(spark):
    """Words of every text and item, repeats, texts inside items and items inside texts, cut words, ties."""
    rng = random.Random(8)
    words = ["common", "hot", "aa", "bb"] + [f"w{i}" for i in range(40)]
    odds = [60, 30, 10, 10] + [1 + 20 / (i + 1) for i in range(40)]
    some = lambda lo, hi: " ".join(rng.choices(words, odds, k=rng.randint(lo, hi)))
    items = [(i, some(1, 12)) for i in range(60)] + [(60, "w3 w4 w5 alone"), (61, "common"), (62, "hot common w39 w38 w37 w36")]
    texts = [(i, some(0, 60)) for i in range(250)]
    texts += [(300, "xw3 w4 w5 alonely " + some(80, 90)), (301, "4 w5 alon"), (302, "common " * 50), (303, some(100, 120) + " w3 w4 w5 alone"), (304, "w39 w38 w3"), (305, "ommon w39 w38 w37 w3"), (306, "nothing shared"), (307, "...")]
    texts += [(400 + i, items[i][1]) for i in range(20)]
    got = O.match_texts(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), "doc_id", "item_id")
    assert {r.doc_id: (r.item_id, round(r.score, 9)) for r in got.collect()} == _best_by_all_pairs(texts, items)


def test_words_of_all_texts_and_items_do_not_probe(spark):
    """A word that every text and item has isn't what they are joined on, where it can't decide."""
    texts = [(i, f"common t{i} u{i} v{i} x{i} y{i}") for i in range(40)]
    items = [(i, f"common t{i} u{i} z{i}") for i in range(40)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, text string").withColumn("tokens", O.question_tokens(F.col("text")))
    index = O._item_index(frame(items, "c_ord").withColumnRenamed("tokens", "c_tokens"))
    probes = O._query_index(frame(texts, "q_id").withColumnRenamed("tokens", "q_tokens"), index, Q.MIN_SCORE).filter("probes")
    assert {r.token[0] for r in probes.collect()} == {"t", "u"} and probes.join(index, "token").count() == 80
