"""Ranked lexical search by the best position algorithm.

A pass over all documents writes an index in shards: for each term of the items its documents and
occurrences, and for each document its number of terms. Sums over the shards give the collection's figures. Every shard then
answers every item: each term has an impact list, highest first, with a directory from documents to
places in it. Lists are read side by side from the top; a document met in one list is looked up in all
others at once, which marks its place there as seen too. What stands at the first place of each list that
isn't seen bounds all documents not met so far. The search ends when that bound is strictly below the k-th best score,
so that equal scores are all met. A task takes the k-th best score of its earlier shards along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import row_blocks, utf8, written

#: Results an item has.
RESULTS = 10
#: A term: a run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pairs of an item and a term that one search takes; more are dealt to several.
PAIRS = 500_000
#: Postings and documents after which a shard is closed.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 100_000
#: A list that holds one in so many of a shard's documents has a directory by document, a shorter one is probed.
DENSE = 16
#: Places of each list that the first round reads; every round doubles them.
FIRST_PLACES = 16

#: Bytes of terms as they are, A-Z lower-cased; all others as a blank.
_FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_FOLD[65:91] += 32


def folded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(texts with blanks between lower-cased terms, number of terms in each); null is empty."""
    data, at = utf8(column)
    at = at.astype(np.int64)
    own = _FOLD[data[at[0]:at[-1]]]
    at -= at[0]
    begins = own != 32
    begins[1:] &= own[:-1] == 32
    inner = at[:-1][at[:-1] < at[1:]]
    begins[inner] = own[inner] != 32
    # A term that runs up to the end of a text begins anew in the next one.
    upto = np.concatenate([[0], np.cumsum(begins)])
    texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(own))
    return texts, upto[at[1:]] - upto[at[:-1]]


def postings(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in each text, and of each text and known term: row, term, occurrences)."""
    texts, sizes = folded(column)
    split = pc.split_pattern(texts, " ")
    known = pc.index_in(split.values, terms).fill_null(-1).to_numpy(zero_copy_only=False)
    first = split.offsets.to_numpy() - split.offsets[0].as_py()
    rows = np.repeat(np.arange(len(sizes)), np.diff(first))
    met = known >= 0
    keys, n = np.unique(rows[met] * np.int64(len(terms)) + known[met], return_counts=True)
    return sizes, keys // len(terms), (keys % len(terms)).astype(np.int32), n


_SHARD = "n_docs long, n_words long, docs array<long>, sizes array<long>, terms array<int>, counts array<int>, places array<int>, occurrences array<int>"


def shards(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The index, one row per shard: documents and words counted, ids and sizes of the documents that hold
    a term of `vocabulary`, and by term their places among those and the occurrences there.
    """
    shape = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("docs", "sizes")], *[(c, pa.list_(pa.int32())) for c in ("terms", "counts", "places", "occurrences")]])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary, pa.large_string())
        ids, sizes, rows, which, n = [], [], [], [], []
        held = counted = words = kept = 0

        def flush() -> pa.RecordBatch:
            where, term, times = np.concatenate(rows), np.concatenate(which), np.concatenate(n)
            order = np.argsort(term, kind="stable")
            own, counts = np.unique(term, return_counts=True)
            return pa.RecordBatch.from_arrays([
                pa.array([v], t.type) for v, t in zip((counted, words, pa.concat_arrays(ids), np.concatenate(sizes), own, counts.astype(np.int32), where[order].astype(np.int32), times[order].astype(np.int32)), shape)], schema=shape)

        for batch in batches:
            texts = batch.column(1)
            _, at = utf8(texts)
            for a, b in row_blocks(np.diff(at.astype(np.int64))):
                size, row, term, times = postings(texts.slice(a, b - a), terms)
                counted, words = counted + int((size > 0).sum()), words + int(size.sum())
                some, place = np.unique(row, return_inverse=True)
                ids.append(batch.column(0).slice(a, b - a).take(pa.array(some)))
                sizes.append(size[some])
                rows.append(place + kept)
                which.append(term)
                n.append(times)
                kept, held = kept + len(some), held + len(term)
                if held >= SHARD_POSTINGS or kept >= SHARD_DOCS:
                    yield flush()
                    ids, sizes, rows, which, n = [], [], [], [], []
                    held = counted = words = kept = 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(index, _SHARD)


@dataclass(frozen=True)
class Figures:
    """The collection: documents with a term, words, and by term of the vocabulary the weight."""

    n_docs: int
    n_words: int
    weights: np.ndarray


def figures(index: DataFrame, size: int) -> Figures:
    """Sums over all shards; one number per term of the vocabulary comes to the driver."""
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)))
    weights = np.zeros(size, np.int64)
    for row in held.select("terms", weight.cast("long").alias("w")).collect():
        weights[row["terms"]] = row["w"]
    return Figures(n_docs, n_words, weights)


class Shard:
    """A shard's impact lists. `by_impact` and `by_doc` hold a term's documents from start[t] to start[t] + count[t]."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, occurrences: np.ndarray, sizes: np.ndarray, of: Figures):
        self.docs = len(sizes)
        self.at = dict(zip(terms.tolist(), range(len(terms))))
        ends = np.cumsum(counts, dtype=np.int64)
        self.bounds = list(zip((ends - counts).tolist(), ends.tolist()))
        discount = 100 - 75 + 75 * sizes * of.n_docs // max(of.n_words, 1)
        tf = occurrences.astype(np.int64)
        impact = np.repeat(of.weights[terms], counts) * (1_000_000_000 * tf // (1000 * tf + 8 * discount[places]))
        # Places ascend within a term, so sorting by impact alone leaves ties in their order.
        order = np.lexsort((-impact, np.repeat(np.arange(len(terms)), counts)))
        self.by_doc, self.impact = places, impact
        self.by_impact, self.sorted = places[order], impact[order]
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order)) - np.repeat(ends - counts, counts)
        self.directories: dict[int, np.ndarray] = {}

    def directory(self, t: int) -> np.ndarray | None:
        """For a long list, by document the place of its posting in the list by document, or -1."""
        a, b = self.bounds[t]
        if (b - a) * DENSE < self.docs:
            return None
        if t not in self.directories:
            own = np.full(self.docs, -1, np.int32)
            own[self.by_doc[a:b]] = np.arange(b - a, dtype=np.int32)
            self.directories[t] = own
        return self.directories[t]


class List:
    """One impact list of an item, with the places of it that were seen."""

    def __init__(self, shard: Shard, t: int, repeats: int):
        a, b = shard.bounds[t]
        self.repeats, self.size = repeats, b - a
        self.by_impact, self.sorted = shard.by_impact[a:b], shard.sorted[a:b]
        self.by_doc, self.impact, self.place = shard.by_doc[a:b], shard.impact[a:b], shard.place[a:b]
        self.where = shard.directory(t)
        self.seen = np.zeros(b - a, bool)
        self.best = 0

    def look_up(self, docs: np.ndarray) -> np.ndarray:
        """Impacts of documents, by direct access; marks their places as seen."""
        if self.where is not None:
            at = self.where[docs]
            met = at >= 0
        else:
            at = np.searchsorted(self.by_doc, docs)
            at[at == self.size] = 0
            met = self.by_doc[at] == docs
        own = at[met]
        self.seen[self.place[own]] = True
        impacts = np.zeros(len(docs), np.int64)
        impacts[met] = self.impact[own] * self.repeats
        return impacts

    def bound(self) -> int:
        """The most that a document not met can have here: the impact where the contiguous seen places end."""
        while self.best < self.size:
            ahead = self.seen[self.best:self.best + 4096]
            stop = int(np.argmin(ahead))
            if not ahead[stop]:
                self.best += stop
                return int(self.sorted[self.best]) * self.repeats
            self.best += len(ahead)
        return 0


def best_documents(shard: Shard, item: list[tuple[int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all documents of the shard that may be among the k best: the k-th best score and those above or equal.

    `item` has (term, repeats). Documents below `floor`, a score that k documents elsewhere reach, may be left out.
    """
    lists = [x for t, c in item if t in shard.at for x in [List(shard, shard.at[t], c)] if x.sorted[0] > 0]
    met = np.zeros(shard.docs, bool)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto, step = 0, FIRST_PLACES
    while lists:
        new = np.concatenate([x.by_impact[upto:upto + step] for x in lists])
        new = np.unique(new[~met[new]])
        met[new] = True
        got = np.zeros(len(new), np.int64)
        for x in lists:
            got += x.look_up(new)
        least = max(floor, 1)
        docs, scores = np.concatenate([docs, new[got >= least]]), np.concatenate([scores, got[got >= least]])
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[scores >= kth], scores[scores >= kth]
        reached = max(floor, int(scores.min()) if len(scores) >= k else 0)
        upto, step = upto + step, upto + step
        limit = sum(x.bound() for x in lists)
        if limit < reached or limit == 0:
            break
    return docs, scores


def _results(index: DataFrame, items: list[list[tuple[int, int]]], of: Figures, k: int) -> DataFrame:
    """(item, doc_id, score): what may be among the k best of each item, at most k from each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, terms, counts, places, occurrences = (batch.column(c)[i].values for c in range(6))
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                shard = Shard(*(x.to_numpy() for x in (terms, counts, places, occurrences, sizes)), of)
                for n, item in enumerate(items):
                    held = found[n]
                    docs, scores = best_documents(shard, item, k, int(held[2][-1]) if len(held[2]) >= k else 0)
                    if len(docs):
                        names, nulls, scores = np.concatenate([held[0], ids[docs]]), np.concatenate([held[1], none[docs]]), np.concatenate([held[2], scores])
                        best = np.lexsort((names, nulls, -scores))[:k]
                        found[n] = names[best], nulls[best], scores[best]
        for n, (names, nulls, scores) in enumerate(found):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), n, np.int32)), pa.array(names, mask=nulls), pa.array(scores)], ["item", "doc_id", "score"])

    return index.select("docs", "sizes", "terms", "counts", "places", "occurrences").mapInArrow(search, "item int, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats); rows of one id are one item."""
    text = F.translate("text", ascii_uppercase, ascii_lowercase)
    return items.select("item_id", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def search(docs: DataFrame, items: DataFrame, k: int = RESULTS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    Equal scores go by ascending doc_id, null last. Each row of `docs` is a document; rows of one item_id
    are one item. Null and empty texts have no terms: such documents count nowhere, such items have no
    rows. Other columns have no part. Items are searched in blocks of a bounded number of terms, with one index each.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items), "search-items")
    blocks = -(-wanted.count() // PAIRS)
    found = None
    for block in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        vocabulary = sorted({r["term"] for r in own})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        asked: dict[object, list[tuple[int, int]]] = {}
        for r in own:
            asked.setdefault(r["item_id"], []).append((numbers[r["term"]], r["repeats"]))
        if not asked:
            continue
        index = written(shards(docs, vocabulary), "search-index")
        got = _results(index, list(asked.values()), figures(index, len(vocabulary)), k)
        names = spark.createDataFrame(list(enumerate(asked)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        got = got.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
with words as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*) as repeats from words group by all),
docs as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
sizes as (select row, doc_id, cast(len(terms) as bigint) as n from docs where len(terms) > 0),
totals as (select count(*) as nn, cast(sum(n) as bigint) as ll from sizes),
held as (select row, term, count(*) as tf from (select row, unnest(terms) as term from docs) group by all),
weights as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from held, totals group by term, nn),
scores as (select item_id, row, cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) as bigint) as score
    from asked join held using (term) join weights using (term) join sizes using (row), totals group by item_id, row),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from scores join sizes using (row) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
