import math
import random
import zlib

import numpy as np

from grantlens.llm import language as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "ro"], "bb": ["schü", "gen", "er", "ich"], "cc": ["tion", "ou", "eau", "é"], "dd": ["th", "ing", "ed", "w"], "ee": ["ñó", "os", "ar", "ie"]}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 60)))
        out.append((i, text, lang))
    return out


def test_codewords_differ_enough():
    for n in (2, 3, 4, 6, 9, 20):
        code = L.codebook(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2) and not (code == code[0]).all(0).any()
    assert L.codebook(1).shape == (1, 1)


def test_one_wrong_bit_is_corrected():
    code = L.codebook(5)
    model = L.Model(list("abcde"), code, np.eye(L.FEATURES, code.shape[1], dtype=np.float32), 1.0)
    for i, word in enumerate(code):
        margins = word.astype(np.float32).copy()
        margins[3] *= -1
        assert model.losses(np.pad(margins, (0, L.FEATURES - len(margins)))[None] * 1e6 / 1e6).argmin() == i


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 .. ٣", "bb"), (1003, "thing edthed", None), (1004, "kalo" * 100_000, None), (None, "ouou eaution", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' source", "1 score", "2 has_letters")
    got = {r.doc_id: r for r in L.languages(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    truth = {i: lang for i, _, lang in rows[:400]}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 60 and sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert (got[1003].lang_pred, got[1004].lang_pred, got[None].lang_pred) == ("dd", "aa", "cc")
    kept = L.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.languages(docs).collect()] == [(1, False, "und", 0.0, False)]
    assert L.languages(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abc def", "x"), (3, "abd", "x")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.languages(one).collect()} == {"x"}


def test_a_long_text_counts_the_same_in_pieces():
    text = ("abc déf " * 400_000).encode()
    data = np.frombuffer(text, np.uint8)
    whole = L.ngram_counts(data, np.array([0, len(text)]))
    import pyarrow as pa

    (_, _, pieces), = L.counted(pa.array([text.decode()]))
    assert np.allclose(whole, pieces, atol=1e-3)


def plain_grams(text):
    """N-grams of a text with their damped counts, by slot, one byte at a time."""
    letters = [b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in text.encode()]
    counts = {}
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b != 32 or (a != 32 and c != 32):
            slot = ((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 20
            counts[slot] = counts.get(slot, 0) + 1
    return {slot: math.log1p(n) for slot, n in counts.items()}


def plain_shares(rows):
    """Share of every slot in the n-grams of each language."""
    sums = {}
    for text, lang in rows:
        own = sums.setdefault(lang, {})
        for slot, x in plain_grams(text).items():
            own[slot] = own.get(slot, 0) + x
    return {lang: [(own.get(slot, 0) + 0.5) / (sum(own.values()) + 0.5 * 4096) for slot in range(4096)] for lang, own in sorted(sums.items())}


def test_predictions_equal_a_plain_version(spark):
    """The same code matrix, but n-grams, sums, weights and losses from dictionaries and loops."""
    rows = corpus(120, seed=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.languages(docs).collect()}
    learn = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    share = plain_shares(learn)
    langs = list(share)
    code = [[int(v) for v in row] for row in L.codebook(len(langs))]
    weights, usual = [], []
    for b in range(len(code[0])):
        plus, minus = [x for x, c in zip(langs, code) if c[b] > 0], [x for x, c in zip(langs, code) if c[b] < 0]
        w = [math.log(sum(share[x][f] for x in plus) / len(plus)) - math.log(sum(share[x][f] for x in minus) / len(minus)) for f in range(4096)]
        mean = {x: sum(p * v for p, v in zip(share[x], w)) for x in langs}
        middle = (min(mean[x] for x in plus) + max(mean[x] for x in minus)) / 2
        w = [v - middle for v in w]
        scale = sum(abs(sum(p * v for p, v in zip(share[x], w))) for x in langs) / len(langs)
        weights.append([v / scale for v in w])
    for i, text, _ in rows:
        grams = plain_grams(text)
        n = max(sum(grams.values()), 1)
        margins = [sum(x * w[slot] for slot, x in grams.items()) / n for w in weights]
        losses = [sum(math.log1p(math.exp(-4 * m * c)) for m, c in zip(margins, word)) for word in code]
        best = min(range(len(langs)), key=lambda k: losses[k])
        score = 1 / sum(math.exp(losses[best] - x) for x in losses)
        assert got[i].lang_pred == langs[best] and abs(got[i].score - score) < 1e-3


def test_foreign_texts_are_flagged_and_go(spark):
    rng = random.Random(3)
    salad = " ".join("".join(rng.choice("bcfjkpqvxyzž") for _ in range(rng.randint(2, 9))) for _ in range(300))
    rows = corpus() + [(1000, salad, None), (1001, "これは学習されていない言語の文章です。" * 20, None), (1002, "zž qx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.languages(docs).collect()}
    assert got[1000].ambiguous and got[1001].ambiguous and got[1000].lang_pred in SYLLABLES
    kept = {r.doc_id for r in L.with_language(docs).collect()}
    assert not kept & {1000, 1001} and 1002 in kept and set(range(400)) <= kept


def test_no_counted_ngram_gives_the_first_language(spark):
    docs = spark.createDataFrame(corpus() + [(1000, "ab", None)], "doc_id long, text string, lang string")
    r = L.languages(docs).filter("doc_id = 1000").first()
    assert r.lang_pred == "aa" and abs(r.score - 0.2) < 1e-6
