"""Exact copies by sorting contents.

Normalised texts are dealt by ranges whose splitters Spark samples, and sorted inside each range by Spark's
external sort, so that equal texts stand side by side. The sort key is bounded: the leading characters, the
digest of the whole in place of the rest, and the id, so that texts that begin alike and large groups of
copies spread over several ranges. One pass over each range compares every whole text with the one before it. A run of
copies that goes on over ranges is put together from the runs at their edges, of which a range has at most two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import written

#: White space that counts as one blank.
BLANKS = r"[\x20\x09-\x0D]+"
#: Leading characters of a text in its sort key.
LEAD = 64
#: Where a run stands in its range; a run that fills its range is both.
FIRST, LAST = 1, 2


def normalised(text) -> F.Column:
    """The text with each run of white space as one blank; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Light rows of one sorted range, run by run. Of an open run only ids, digests and its first row are held."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    opening = text = None
    closed = 0

    def rows(done: pa.Table, starts: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal closed
        n = done.num_rows
        sizes = np.diff(np.append(starts, n))
        head = np.repeat(starts, sizes)
        edge = np.zeros(len(starts), np.int32)
        edge[0] |= 0 if closed else FIRST
        edge[-1] |= LAST if last else 0
        texts = [None] * n
        if not closed:
            texts[0] = opening
        if last:
            texts[starts[-1]] = text
        closed += len(starts)
        ids = done.column("doc_id")
        place = np.arange(n) - head
        out = {
            "doc_id": ids, "digest": done.column("digest"), "keep_id": ids.take(pa.array(head)), "group_size": pa.array(np.repeat(sizes, sizes)),
            "place": pa.array(place), "part": pa.array(np.full(n, part, np.int32)), "edge": pa.array(np.repeat(edge, sizes)), "edge_text": pa.array(texts, pa.string()),
        }
        if "row" in done.column_names:
            out["row"] = pc.if_else(pa.array(place == 0), done.column("row"), pa.scalar(None, done.column("row").type))
        yield from pa.table(out).to_batches()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index("text"))
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        start = texts[0].as_py()
        new[0] = text is None or start != text
        opening = start if text is None else opening
        cuts = np.flatnonzero(new)
        light = batch.select([c for c in batch.schema.names if c != "text"])
        if len(cuts):
            before = sum(b.num_rows for b in held)
            done = pa.Table.from_batches([*held, light.slice(0, cuts[-1])])
            starts = np.append(0, cuts[:-1] + before) if before else cuts[:-1]
            if done.num_rows:
                yield from rows(done, starts, False)
            held = []
        held.append(light.slice(cuts[-1] if len(cuts) else 0))
        text = texts[n - 1].as_py()
    if held:
        yield from rows(pa.Table.from_batches(held), np.zeros(1, np.int64), True)


def _joined_edges(placed: DataFrame) -> DataFrame:
    """(part, edge, whole_id, whole_size, goes_on) of the runs at the edges of ranges, put together with their neighbours.

    A range has at most two such rows. Only light columns are numbered in one task; whole texts are
    compared by a join of neighbours.
    """
    edges = placed.filter((F.col("edge") > 0) & (F.col("place") == 0))
    order = Window.orderBy("part", "edge")
    light = edges.select("part", "edge", "keep_id", "group_size", F.row_number().over(order).alias("seq"))
    texts = edges.select(F.col("part").alias("p"), F.col("edge").alias("e"), "edge_text")
    numbered = light.join(texts, (F.col("p") == F.col("part")) & (F.col("e") == F.col("edge"))).select("seq", "edge_text")
    equal = numbered.join(numbered.select((F.col("seq") + 1).alias("next"), F.col("edge_text").alias("text_before")), F.col("next") == F.col("seq"))
    equal = equal.filter(F.col("edge_text") == F.col("text_before")).select(F.col("seq").alias("same"))
    chained = light.join(equal, F.col("same") == F.col("seq"), "left").withColumn("goes_on", F.col("same").isNotNull())
    chained = chained.withColumn("run", F.sum((~F.col("goes_on")).cast("long")).over(Window.orderBy("seq")))
    run = Window.partitionBy("run")
    return chained.select(
        F.col("part").alias("p"), F.col("edge").alias("e"), F.struct(F.first("keep_id").over(run.orderBy("seq")).alias("id")).alias("whole"),
        F.sum("group_size").over(run).alias("whole_size"), "goes_on")


def grouped(docs: DataFrame, rows: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (bytes), and with `rows` the kept document as a struct `row`.

    Texts are equal when their normalised bytes are. Null text is empty; null ids come after all others,
    so that such a row stays only where no copy has an id; of repeated rows one stays. Other columns
    have no part and may have any name. An empty table gives no rows.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"), *carried)
    keyed = texts.select("*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.substring("text", 1, LEAD).alias("lead"))
    key = [F.col("lead"), F.col("digest"), F.col("doc_id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(*key).sortWithinPartitions(*key).drop("lead")
    shape = "doc_id long, digest binary, keep_id long, group_size long, place long, part int, edge int, edge_text string"
    if rows:
        shape += f", row {ordered.schema['row'].dataType.simpleString()}"
    placed = written(ordered.mapInArrow(_runs, shape), "sorted-runs")
    whole = F.broadcast(_joined_edges(placed))
    found = placed.join(whole, (F.col("p") == F.col("part")) & (F.col("e") == F.col("edge")), "left")
    at_edge = F.col("p").isNotNull()
    return found.select(
        "doc_id", F.when(at_edge, F.col("whole.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(at_edge, F.col("whole_size")).otherwise(F.col("group_size")).alias("group_size"),
        ((F.col("place") == 0) & ~F.coalesce("goes_on", F.lit(False))).alias("kept"), "digest", *(["row"] if rows else []))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with the columns of `docs`."""
    return grouped(docs, rows=True).filter("kept").select("row.*")


def copies(docs: DataFrame) -> DataFrame:
    """Per document doc_id, keep_id, group_size, kept and text_sha256; edge cases as in grouped()."""
    return grouped(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
    row_number() over (partition by norm order by doc_id nulls last) = 1 as kept, sha256(norm) as text_sha256
from texts
"""
