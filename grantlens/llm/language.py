"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary n-gram classifier is learned, and a text gets
the language whose codeword has the least loss over the bits. What is learned is a few thousand
weights per bit, summed over all learning rows in the tasks: nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.common import row_blocks, utf8

#: Hashed n-gram features; n-grams are three bytes of letters, others count as a blank.
FEATURE_BITS = 12
FEATURES = 1 << FEATURE_BITS
#: Up to this many languages the code has every split of them into two sides.
MOST_EXHAUSTIVE = 6
#: Steepness of the loss, in units of a usual margin.
STEEPNESS = 4.0
#: A text is ambiguous where the best and the second language differ by less than this share of a usual loss gap.
AMBIGUOUS = 0.1
#: A text is foreign to all learned languages where its least loss exceeds this share of the loss of a text on which no bit
#: decides; only of texts with that many n-grams, since a few say little.
FOREIGN, FOREIGN_FROM = 0.6, 64
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def ngram_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Damped n-gram counts, one row of FEATURES per text; `at` are byte offsets of the texts in `data`."""
    n = len(at) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if at[-1] - at[0] < 3:
        return out
    text = _FOLD[data[at[0]:at[-1]]].astype(np.uint32)
    grams = text[:-2] | text[1:-1] << 8 | text[2:] << 16
    # Runs of blanks say nothing; of texts' ends only n-grams inside one text count.
    keep = (text[1:-1] != 32) | ((text[:-2] != 32) & (text[2:] != 32))
    starts = np.arange(len(grams))
    owner = np.repeat(np.arange(n), np.diff(at))[:len(grams)]
    keep &= starts + 3 <= (at[1:] - at[0])[owner]
    slot = ((grams[keep] * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
    slot += owner[keep] * FEATURES
    out += np.bincount(slot, minlength=n * FEATURES).reshape(n, FEATURES)
    return np.log1p(out, out=out)


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, features) for blocks of rows. A text longer than a block is counted in pieces."""
    data, at = utf8(column)
    at = at.astype(np.int64)
    for a, b in row_blocks(np.diff(at), 1 << 19):
        # The features of a block are kept small as well, for many short texts.
        for c in range(a, b, 128):
            d = min(c + 128, b)
            if d - c == 1 and at[d] - at[c] > 1 << 21:
                total = np.zeros((1, FEATURES), np.float32)
                for x in range(at[c], at[d], 1 << 20):
                    total += np.expm1(ngram_counts(data, np.array([x, min(x + (1 << 20) + 2, at[d])])))
                yield c, d, np.log1p(total)
            else:
                yield c, d, ngram_counts(data, at[c:d + 1])


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, one row per language.

    Few languages get all splits into two sides; for more, of some random books the one whose
    closest codewords differ most is taken.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= MOST_EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(np.vstack([np.zeros(len(splits), np.int64), (splits >> np.arange(n - 1)[:, None]) & 1]), 1, -1).astype(np.int8)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        book = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(15 * np.log2(n)))))
        book = book[:, np.abs(book.sum(0, dtype=int)) < n]
        gap = min(int((book[i + 1:] != book[i]).sum(1).min()) for i in range(n - 1))
        if gap > most:
            best, most = book, gap
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, in units of the bit's usual margin
    gap: float  # usual loss between a text's language and the next

    def losses(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights / np.maximum(features.sum(1, keepdims=True), 1)
        return np.stack([np.logaddexp(0, -STEEPNESS * margin * c).sum(1) for c in self.code], 1)


def model_from_counts(counts: dict[str, np.ndarray]) -> Model | None:
    """The bits' classifiers from summed features per language; every language counts alike on its side."""
    languages = sorted(x for x, c in counts.items() if c.sum() > 0)
    if not languages:
        return None
    code = codebook(len(languages))
    share = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * FEATURES) for x in languages])
    if len(languages) == 1:
        return Model(languages, code, np.ones((FEATURES, 1), np.float32), 1.0)
    weights = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    usual = share @ weights
    middle = (np.stack([usual[code[:, b] > 0, b].min() for b in range(code.shape[1])]) + np.stack([usual[code[:, b] < 0, b].max() for b in range(code.shape[1])])) / 2
    weights -= middle  # features are shares, so a constant moves the border between the sides
    weights /= np.maximum(np.abs(share @ weights).mean(0), 1e-9)
    model = Model(languages, code, weights.astype(np.float32), 1.0)
    losses = np.sort(model.losses(share.astype(np.float32) * 1e6), 1)
    return Model(languages, code, model.weights, float((losses[:, 1] - losses[:, 0]).mean()))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from all rows with a language. The driver gets FEATURES sums per language, no rows."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for a, b, x in counted(batch.column(0)):
                for name in set(names[a:b]):
                    own = np.array([i for i in range(a, b) if names[i] == name]) - a
                    total[name] = total.get(name, 0) + x[own].sum(0, dtype=np.float64)
        for name, x in sorted(total.items()):
            used = np.flatnonzero(x)
            # Whole numbers, so that the sums don't depend on the order of the tasks.
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(np.rint(x[used] * 1024).astype(np.int64))], ["lang", "feature", "n"])

    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = rows.mapInArrow(sums, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, np.ndarray] = {}
    for name, part in got.groupby("lang"):
        counts[name] = np.zeros(FEATURES)
        counts[name][part["feature"].to_numpy()] = part["n"].to_numpy() / 1024
    return model_from_counts(counts)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), ambiguous and foreign.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. The score is the
    share of the best language in exp(-loss). Equal losses give the first language by name, so a text with letters
    but without any counted n-gram ("ab") gets that, with the same share for each. A foreign text, whose bits
    are too weak for any codeword, has the nearest language and counts as ambiguous. Columns of `docs` with these names are replaced.
    """
    names = "lang_pred", "score", "ambiguous", "foreign"
    values = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(False), "foreign": F.lit(False)}
    if model is None:
        return docs.withColumns(values)

    @F.pandas_udf("struct<lang_pred string, score double, ambiguous boolean, foreign boolean>")
    def decode(texts: pd.Series) -> pd.DataFrame:
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        close, foreign = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        undecided = model.code.shape[1] * np.log(2)
        for a, b, x in counted(pa.array(texts, pa.large_string(), from_pandas=True)):
            loss = model.losses(x)
            best[a:b] = loss.argmin(1)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            score[a:b] = 1 / p.sum(1)
            foreign[a:b] = (loss.min(1) > FOREIGN * undecided) & (np.expm1(x).sum(1) >= FOREIGN_FROM - 0.5)
            if loss.shape[1] > 1:
                two = np.partition(loss, 1, 1)
                close[a:b] = two[:, 1] - two[:, 0] < AMBIGUOUS * model.gap
        return pd.DataFrame({"lang_pred": np.array(model.languages, object)[best], "score": score, "ambiguous": close | foreign, "foreign": foreign})

    known = F.col(f"`{text}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}")
    rows = docs.withColumn("decoded_language", decode(F.col(f"`{text}`"))).withColumn("has_letters", F.coalesce(known, F.lit(False)))
    return rows.withColumns({n: F.when(F.col("has_letters"), F.col(f"decoded_language.{n}")).otherwise(values[n]) for n in names}).drop("decoded_language", "has_letters")


def held_out(doc_id) -> F.Column:
    """Whether a document is left out of learning: crc32 of its id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_from_documents(docs: DataFrame) -> Model | None:
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document, one row per row of `docs`.

    Null ids count as empty text for the fold, null texts and such without letters are `und`, rows with a null lang teach nothing;
    repeated rows are learned and answered as often as they come. An empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, learn_from_documents(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def with_language(docs: DataFrame) -> DataFrame:
    """The documents that have a language: `und` and foreign ones go. Columns and repeated rows stay as they are, whatever
    their names; an empty table stays empty. Without any learned language every document is `und`."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict(kept, learn_from_documents(docs)).filter((F.col("lang_pred") != UNKNOWN) & ~F.col("foreign")).select("row.*")
