import hashlib
import random
import re
from collections import Counter

import pytest

from grantlens.llm import contentsort as S


def plain(rows):
    """Groups by a dictionary of normalised texts."""
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for t, ids in groups.items():
        known = sorted(d for d in ids if d is not None)
        ids = known + [None] * (len(ids) - len(known))
        out += [(d, ids[0], len(ids), i == 0, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return Counter(out)


def table_rows(seed):
    rng = random.Random(seed)
    long = "x" * 300 + " y" * 60_000
    rows = [(i, rng.choice(["a  b", "a b", "a\tb", "a b ", "", None, " ", "\n", "é", "é", "a b", "A b"])) for i in range(300)]
    rows += [(1000 + i, "hot copy of  many") for i in rng.sample(range(2000), 900)]
    rows += [(5000 + i, "the same lead of more than sixty-four characters, whatever comes after it: " + str(i % 90)) for i in range(200)]
    rows += [(9000, long), (9001, long + "z"), (9002, long), (7, "a b"), (7, "a b"), (None, "hot copy of many"), (None, "alone"), (None, "nobody"), (None, "nobody")]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_groups_over_many_ranges(spark, many_ranges):
    for seed in (1, 2):
        rows = table_rows(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = S.copies(docs)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(map(tuple, got.collect())) == plain(rows)


def test_a_group_that_fills_whole_ranges(spark, many_ranges):
    rows = [(i, "one text") for i in range(3000)] + [(-1, "another")]
    assert Counter(map(tuple, S.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == plain(rows)


def test_kept_documents_keep_their_columns(spark, many_ranges):
    rows = [(d, t, d, "u") for d, t in table_rows(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long, `keep_id` string").withColumnRenamed("part", "digest")
    kept = S.distinct_texts(docs)
    assert kept.columns == docs.columns
    want = Counter(d for (d, _, _, k, _), n in plain([r[:2] for r in rows]).items() if k for _ in range(n))
    got = kept.collect()
    assert Counter(r[0] for r in got) == want and all(r["digest"] == r["doc_id"] and r["keep_id"] == "u" for r in got)


def test_empty_table_and_single_row(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.copies(none).collect() == [] and S.distinct_texts(none).collect() == []
    one = [(None, None)]
    assert Counter(map(tuple, S.copies(spark.createDataFrame(one, "doc_id long, text string")).collect())) == plain(one)
