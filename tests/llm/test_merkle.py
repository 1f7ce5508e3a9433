import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from grantlens.llm import merkle as M

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def tree(hashes):
    """(root, per leaf its steps (left, right)) by plain recursion over levels."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 16 * 16:a // 16 * 16 + 16]
            steps[i].append(("".join(run[:a % 16]), "".join(run[a % 16 + 1:])))
        level, at = [h(*level[i:i + 16]) for i in range(0, len(level), 16)], [a // 16 for a in at]
    return level[0], steps


def plain(rows):
    of = {}
    for r in rows:
        of.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        of[s].sort(key=lambda x: x[:3])
        subs[s] = tree([x[2] for x in of[s]])
    root, over = tree([subs[s][0] for s in sources])
    out = []
    for s, above in zip(sources, over):
        for (_, _, own, r), steps in zip(of[s], subs[s][1]):
            steps, d, t = steps + above, r[0], r[1]
            bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and t is not None
            held = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if bad else own
            for left, right in steps:
                held = h(left, held, right)
            out.append((d, own, subs[s][0], root, h(*[a + b for a, b in steps]), held, held == root))
    return Counter(out)


def table_rows(seed, sources, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Some Text", "ÀÉ Ω x", "", None, "plain", "日本 A"]), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 3, -4])) for i in rng.sample(range(-n, 9 * n), n)]
    rows += [(None, "A", "en", sources[0], 1), (None, "B", "en", sources[0], 1), (3, "twice", None, sources[-1], 2), (3, "twice", None, sources[-1], 2), (3, "TWICE", None, sources[-1], 2), (-1, "Lone", None, "only one row", None), (99, "LONG word " * 50_000, "en", sources[0], 500_000)]
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    out = M.verified(spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as tree", "2 as rank", "'x' as hash", "3 as n"))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, out.collect()))


HOT = ["hot"] * 30 + [None, "", "é", "z", "Z", "\U0001f642", "￮"]


@pytest.mark.parametrize("seed,sources,n", [(1, HOT, 700), (2, ["one"], 300), (3, [str(i) for i in range(70)], 500), (4, ["hot"], 4200)])
def test_against_plain_trees(spark, seed, sources, n):
    rows = table_rows(seed, sources, n)
    assert got(spark, rows) == plain(rows)


def test_many_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = table_rows(5, HOT + [f"s{i}" for i in range(40)], 900)
    assert got(spark, rows) == plain(rows)


def test_sizes_at_run_borders(spark):
    rows = [(i, f"T{i}", "en", f"s{n}", 1) for n in (1, 2, 15, 16, 17, 255, 256, 257, 272) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_against_sql(spark):
    rows = table_rows(6, HOT, 200)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [r for r in rows if r[0] is not None])
    assert Counter(con.execute(M.SQL).fetchall()) == plain([r for r in rows if r[0] is not None])


def test_every_altered_row_is_caught(spark):
    rows = table_rows(7, HOT, 300)
    out = M.manifest(spark.createDataFrame(rows, SHAPE)).collect()
    assert all((r["tampered"] is not None) == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_empty_table(spark):
    assert M.verified(spark.createDataFrame([], SHAPE)).collect() == []
