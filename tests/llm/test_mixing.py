import random

import duckdb

from grantlens.llm import mixing as M


def waterfill(sizes):
    """Targets by resharing the excess round after round."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(w for x, w in weight.items() if x not in capped) for s in sizes if s not in capped}
        above = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not above:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= above


def rows(seed, n=600):
    rng = random.Random(seed)
    sources = [None, "é", "Z", "a", "b", "c", ""]
    out = [(i, rng.choices(sources, [1, 2, 40, 3, 1, 5, 1])[0], " ".join("w" * rng.randint(0, 30))) for i in range(n)]
    return out + [(5, "Z", "again here"), (None, "a", "x y"), (None, "a", "x"), (7001, "b", None), (7002, "only empty", ""), (7003, "b", "w " * 100_000)]


def test_against_sql_and_waterfilling(spark):
    for seed in (1, 2):
        data = rows(seed)
        docs = spark.createDataFrame(data, "doc_id long, source string, text string").selectExpr("*", "1 h", "2 size", "3 edge")
        got = M.mix(docs).collect()
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
        con.executemany("insert into documents values (?, ?, ?)", data)
        key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6), r[4])
        assert sorted(map(key, con.execute(M.SQL).fetchall())) == sorted(map(key, got))
        sizes = {}
        for _, s, t in data:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        want = sorted(round(t, 6) for t in waterfill(sizes).values())
        assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(t, 6)) for s, t in waterfill(sizes).items()}), want
        assert all(r.taken <= 3 * r.size for r in got)
        assert sorted(map(key, M.mix(docs).collect())) == sorted(map(key, got))


def test_targets_are_met_and_documents_repeat(spark):
    data = [(i, "ab"[i % 2], "w w w w w") for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").selectExpr("*", "'en' lang", "9 n_chars", "'r' row")
    got = M.mix(docs)
    taken = got.groupBy("target").sum("taken").collect()
    assert all(abs(r[1] - r[0]) <= 5 for r in taken)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() * 5 == sum(r[1] for r in taken)
    assert M.mix(docs.limit(0)).count() == 0 and M.mixed_documents(docs.limit(0)).count() == 0
