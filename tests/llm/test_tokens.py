import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from grantlens.llm import codes as C
from grantlens.llm import packing as P
from grantlens.llm import tokens as T

PATH = T.default_path()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_whole_text(plain, monkeypatch):
    rng = random.Random(1)
    parts = ["a", "b c", " ", "  ", "\n", "\n\n", "\t", "é", "É.", "1", "'s", "don't", "...", " ", "　", "<|endoftext|>", "x" * 50, "日本", "\x1c", "\r\n", "\r", "🙂", "\x85", "word, and. more!", "ÿ", "ß?"]
    monkeypatch.setattr(T, "CACHE_WORDS", 500)
    own = T.Encoder(PATH)
    for _ in range(30):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
        ids, at = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == plain(t), repr(t)


def test_new_words_go_to_the_tokenizer_in_few_strings(plain, monkeypatch):
    own, calls = T.Encoder(PATH), []
    for name in ("tokenizer", "joined"):
        real = getattr(own, name)
        monkeypatch.setattr(own, name, type("Counted", (), {"encode_batch_fast": lambda self, x, real=real, **k: calls.extend(x) or real.encode_batch_fast(x, **k)})())
    rng = random.Random(2)
    words = ["".join(rng.choices("abcxyzÀéßÿªµº", k=rng.randint(1, 9))) + rng.choice(["", *".,;:!?"]) for _ in range(3000)]
    texts = [" ".join(words[i:i + 30]) for i in range(0, 3000, 30)]
    ids, at = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]
    # The heads of the texts go alone, and nothing else does.
    assert len(calls) <= len(texts) + 3000 // T.JOINED_WORDS + 1


def test_added_tokens_in_texts(plain):
    own = T.Encoder(PATH)
    assert own.added and 50256 in plain("a" + own.added[0] + "b")
    for texts in (["a<|endoftext|>b"], ["x y", "a <|endoftext|> b", None, "<|endoftext|>", "z  z"], ["<|endoftext|><|endoftext|>\nq", "<|endoftext|"], [None, ""]):
        ids, at = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (2 ** rng.uniform(0, 20, n)).astype(np.uint32) - 1
        codes = C.Codes(C.to_bytes(ids, [1, None], np.array([0, n // 2, n])))
        assert (codes.ids(0, n) == ids).all()
        assert all(codes.ids(i, i + 1)[0] == ids[i] for i in range(0, n, 37))
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (codes.ids(a, b) == ids[a:b]).all() and codes.known.tolist() == [1, 0]
    broken = bytearray(C.to_bytes(np.arange(9), [1], np.array([0, 9])))
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        C.Codes(bytes(broken))


ROWS = [(5, "some words here"), (1, None), (3, ""), (2, "x" * 30_000 + " word" * 3000), (3, "again"), (None, "no id"), (9, "a  b\n\n\nc"), (10, "a " * 700), (4, "one<|endoftext|>two <|endoftext|>")]


def test_codes_of_a_table(spark, plain, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 part", "'f' file")
    at, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    got = [tuple(r) for r in C.round_trip(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert C.round_trip(docs.limit(0)).count() == 0


def test_packing_of_a_table(spark, plain):
    docs = spark.createDataFrame(ROWS + [(100 + i, "word " * (i * 37 % 900)) for i in range(150)], "doc_id long, text string").selectExpr("*", "1 slot", "'f' units")
    got = P.pack(docs).collect()
    rest = {}
    for d, t in docs.select("doc_id", "text").collect():
        rest.setdefault(d, []).append(plain(t))
    tokens = sum(len(x) for xs in rest.values() for x in xs)
    assert sum(r.length for r in got) == tokens
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4")) == r.ids_crc32 for x in rest[r.doc_id])
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert max(used.values()) <= 1024 and padding <= 0.02 * tokens
    assert P.pack(docs.limit(0)).count() == 0


def test_layout_holds_every_piece():
    rng = np.random.default_rng(3)
    for n, capacity in ((1, 8), (50, 16), (3000, 64), (40_000, 256)):
        sizes = rng.integers(1, capacity + 1, n)
        histogram = {int(s): int(c) for s, c in zip(*np.unique(sizes, return_counts=True))}
        plan = P.layout(histogram, capacity)
        rank = np.zeros(n, np.int64)
        for s in histogram:
            own = np.flatnonzero(sizes == s)
            rank[own] = np.arange(len(own))
        seq, slot = plan.place(sizes, rank)
        assert len(set(zip(seq.tolist(), slot.tolist()))) == n
        assert np.bincount(seq, sizes).max() <= capacity
        assert plan.sequences <= sizes.sum() / capacity * (1.02 if n >= 3000 else 2) + 2


def test_knapsack():
    value, pattern = P.cheapest_pattern(np.array([3, 4, 7]), np.array([3.0, 4.5, 7.6]), 11)
    assert value == pytest.approx(12.1) and pattern == {1: 1, 2: 1}
