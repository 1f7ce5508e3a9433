"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text worked on at once inside a task; numpy needs about twenty times as much.
BLOCK_BYTES = 1 << 20


#: Rows in a batch between Spark and Python. Texts may be long, and workers hold some batches at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by smaller batches than Spark's usual ten thousand rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as `spark.checkpoint.dir` names it.

    Only a session whose executors live in the driver's own process may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark then drops the shuffle files of a query at its end; else they stay until the driver's garbage collector meets their owner.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, *seen) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them again, without the shuffle files that led to it.
    `seen` are arguments of observe()."""
    path, conf = new_folder(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        (df.observe(*seen) if seen else df).write.parquet(path)
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key table that may be sent to all executors: the driver holds it several times over.
BROADCAST_ROWS = 100_000
#: Bits a key in the filter of a larger key table, and bits of one part of it.
KEY_BITS, PART_BITS = 16, 1 << 15


def _key_bits(keys: DataFrame, on: list[str], n: int) -> tuple[np.ndarray, int]:
    """The hashes of the keys as set bits, a few bytes a key, put together from parts that tasks build; and their number."""
    size = 1 << max(15, (KEY_BITS * n - 1).bit_length())

    def part(table: pa.Table) -> pa.Table:
        own = np.zeros(PART_BITS, np.uint8)
        own[table.column("bit").to_numpy()] = 1
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(own).tobytes()])})

    at = keys.select(F.xxhash64(*on).bitwiseAND(F.lit(size - 1)).alias("at")).distinct()
    parts = at.selectExpr(f"at div {PART_BITS} as part", f"at % {PART_BITS} as bit").groupBy("part").applyInArrow(part, "part long, bits binary")
    bits = np.zeros((size // PART_BITS, PART_BITS // 8), np.uint8)
    for row in parts.toLocalIterator():
        bits[row.part] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel(), size


def having(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a written table of keys (inner or left_anti). A small one is sent to the executors. Of a larger one only a bit
    or so of each key is, and rows that may have a partner by it are joined by a shuffle; the others don't move."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    bits, size = _key_bits(keys, on, n)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def is_set(at: pd.Series) -> pd.Series:
        i = at.to_numpy()
        return pd.Series((shared.value[i >> 3] >> (7 - (i & 7))) & 1 > 0)

    may = is_set(F.xxhash64(*on).bitwiseAND(F.lit(size - 1)))
    found = rows.filter(may).join(keys, on, how)
    return found.unionByName(rows.filter(~may)) if how == "left_anti" else found


def words(text) -> F.Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows (from, to) of about `limit` bytes; a row above the limit is a block of its own."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, len(sizes)
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start = stop


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, from batches that arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if change[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component): the smallest id reachable over the edges (a, b), for every id of an edge.

    Large-star and small-star rounds: each round is two aggregations over the edges, and the edge
    set is cut after each by a written table. A hub is never gathered in one task: its edges are
    only joined to its own smallest neighbour. Rounds grow with the logarithm of the longest chain.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), label)
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        seen = Observation()
        edges = written(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), label, seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("sum"))
        state = (seen.get["n"], seen.get["sum"])
        if state == before:
            break
        before = state
    star = edges.groupBy("a").agg(F.min("b").alias("b"))
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
