"""Near copies among embeddings: spherical k-means cells, and cosine products in blocks within a cell.

Only vectors of one label are compared. Equal vectors are one, with a count, so a group of copies costs
what one vector does. A vector is at home in its nearest cell and has partners at most in cells whose border
is within the length of a linked pair's difference, which is a bound that always holds. Of two cells that may
have links between them, one takes the vectors of the other as guests. Homes and guests of a cell are cut into
blocks, and tasks take pairs of blocks, so every pair that can link is judged once. A task returns link counts
per vector and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.common import components, groups, written
from grantlens.llm.vectors import component_type, kmeans, matrix, sample, valid

COSINE = 0.93
#: Vectors a cell has on average in a label, and the most cells there are.
CELL_ROWS, MOST_CELLS = 2000, 512
#: Vectors in a block; a task holds two blocks and their product.
BLOCK_ROWS = 2048
#: A guest may be this many usual deviations beyond a border, for a difference in a random direction. Only
#: float('inf') is a bound for all vectors: differences may lie along the centres.
REACH = float("inf")


def cells(x: np.ndarray, centres: np.ndarray, cosine: float = COSINE, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, whether a cell is home or host) of unit vectors."""
    near = x @ centres.T
    home = near.argmax(1)
    far = np.sqrt(2 - 2 * cosine) * min(1.0, reach / np.sqrt(x.shape[1]))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    hosts = near[np.arange(len(x)), home][:, None] - near <= far * apart[home] + 1e-12
    hosts[np.arange(len(x)), home] = True
    return home, hosts


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def judge(x: np.ndarray, second: np.ndarray, same: bool, cosine: float = COSINE) -> np.ndarray:
    """The links of a task as a symmetric boolean matrix: between the rows of its two blocks, or within the one it has."""
    linked = np.zeros((len(x), len(x)), bool)
    if same:
        linked[:] = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        return linked | linked.T
    here, there = np.flatnonzero(~second), np.flatnonzero(second)
    linked[np.ix_(here, there)] = x[here] @ x[there].T >= cosine
    return linked | linked.T


def linked_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows without a label, and vectors that are null, empty, zero or hold null or non-finite components,
    have no links. Vectors of different lengths don't link. vec_id is the key: rows that repeat one are
    one member of a component, and count as vectors of their own in n_links. A null vec_id takes no part,
    has a null component and isn't kept. An empty table gives no rows.
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(component_type(rows)).alias("embedding"))
    base = base.withColumn("usable", valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    base = base.withColumns({"d1": F.when(F.col("usable"), F.xxhash64("embedding", F.lit(1))), "d2": F.when(F.col("usable"), F.xxhash64("embedding", F.lit(2)))})
    key = ["label", "d1", "d2"]
    distinct = base.filter("usable").groupBy(*key).agg(F.min("vec_id").alias("vec"), F.count("*").alias("times"), F.any_value("embedding").alias("embedding"))
    distinct = written(distinct.withColumn("dim", F.size("embedding")), "near-distinct")
    found = _links(distinct, cosine)
    counts = found.filter("b is null").groupBy("label", "d1").agg(F.sum("n").alias("n"))
    reach = components(found.filter("b is not null").select("a", "b"), "near-components")
    known = distinct.select(*key, "vec", "times").join(counts, ["label", "d1"], "left").join(reach.withColumnRenamed("id", "vec"), "vec", "left")
    known = known.select(*key, (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    out = base.select("vec_id", *key).join(known, key, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


_FOUND = "label string, d1 long, n long, a long, b long"


def _links(distinct: DataFrame, cosine: float) -> DataFrame:
    """Rows (label, d1, n): links of a vector found in a task; and rows (a, b): edges that connect what its links connect."""
    label_type = distinct.schema["label"].dataType.simpleString()
    distinct = distinct.withColumn("text_label", F.col("label").cast("string"))
    dims = sorted(r["dim"] for r in distinct.select("dim").distinct().collect())
    out = None
    for dim in dims:
        part = _one_dimension(distinct.filter(F.col("dim") == dim), cosine)
        out = part if out is None else out.union(part)
    if out is None:
        out = distinct.sparkSession.createDataFrame([], _FOUND)
    return written(out.withColumn("label", F.col("label").cast(label_type)), "near-links")


def _fit(rows: DataFrame, counts: list[int]) -> dict[int, np.ndarray]:
    """Centres for each number of cells, from a bounded sample, fitted in a task."""

    def fit(batches):
        x = np.concatenate([matrix(b.column(0)) for b in batches])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for k in counts:
            centres = kmeans(x, k, spherical=True)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(centres), pa.int64()), pa.array(list(centres))], ["k", "centre"])

    if not counts:
        return {}
    got = sample(rows, "vec").select("embedding").coalesce(1).mapInArrow(fit, "k long, centre array<double>").collect()
    return {k: np.array([r["centre"] for r in got if r["k"] == k]) for k in counts}


def hosts_of(home: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """`hosts` without the cells that send their vectors to the home cell instead: of two cells the lower one hosts if their sum is even, else the higher one."""
    cell = np.arange(hosts.shape[1])[None, :]
    own = home[:, None]
    return hosts & ((cell == own) | ((cell < own) == ((cell + own) % 2 == 0)))


def _one_dimension(rows: DataFrame, cosine: float) -> DataFrame:
    # Labels have cells by their size, in powers of two, so that few sets of centres do for all of them.
    fits = F.greatest(F.lit(1), F.least(F.lit(MOST_CELLS), F.floor(F.count("*") / CELL_ROWS)))
    cut = written(rows.groupBy("text_label").agg(F.pow(F.lit(2), F.floor(F.log2(fits))).cast("long").alias("k")), "near-labels")
    centres = _fit(rows, sorted(r["k"] for r in cut.filter("k > 1").select("k").distinct().collect()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("embedding")))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            ks = batch.column(batch.schema.get_field_index("k")).to_numpy()
            home, visits = np.zeros(len(x), np.int64), [np.zeros(1, np.int64)] * len(x)
            for k in set(ks.tolist()) & set(centres):
                at = np.flatnonzero(ks == k)
                home[at], hosts = cells(x[at], centres[k], cosine, REACH)
                for i, h in zip(at.tolist(), hosts_of(home[at], hosts)):
                    visits[i] = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(home), pa.array(visits, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "home", "hosts"])

    placed = rows.join(cut, "text_label").select("text_label", "d1", "vec", "times", "embedding", "k").mapInArrow(assign, f"text_label string, d1 long, vec long, times long, embedding {component_type(rows)}, home long, hosts array<long>")
    placed = written(placed, "near-cells").withColumn("cell", F.explode("hosts")).drop("hosts").withColumn("lives", F.col("home") == F.col("cell"))
    blocks = placed.groupBy("text_label", "cell").agg(F.ceil(F.count_if("lives") / BLOCK_ROWS).alias("homes"), F.ceil(F.count_if(~F.col("lives")) / BLOCK_ROWS).alias("guests")).filter("homes > 0")
    placed = placed.join(blocks, ["text_label", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec", "d1"), F.when(F.col("lives"), F.col("homes")).otherwise(F.col("guests"))))
    # A block of homes meets itself, every other one and every block of guests once; those have numbers below 0.
    placed = placed.withColumn("block", F.when(F.col("lives"), F.col("block")).otherwise(-1 - F.col("block")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("lives"), -F.col("guests")).otherwise(F.lit(0).cast("long")), F.col("homes") - 1)))
    placed = placed.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    keys = ["text_label", "cell", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            if group.num_rows < 2:
                continue
            x = matrix(group.column("embedding"))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            first = group.slice(0, 1).to_pylist()[0]
            linked = judge(x, group.column("block").to_numpy() == first["two"], first["one"] == first["two"], cosine)
            has = np.flatnonzero(linked.any(1))
            if not len(has):
                continue
            # From here on only the rows that have links.
            linked = linked[np.ix_(has, has)]
            vec, d1, times = (group.column(c).to_numpy()[has] for c in ("vec", "d1", "times"))
            counts, tree = linked @ times, forest(linked)
            joins = np.flatnonzero(tree != np.arange(len(tree)))
            none = [None] * len(joins)
            yield pa.RecordBatch.from_arrays([
                pa.array([first["text_label"]] * len(has) + none, pa.string()), pa.array([*d1.tolist(), *none], pa.int64()), pa.array([*counts.tolist(), *none], pa.int64()),
                pa.array([None] * len(has) + vec[joins].tolist(), pa.int64()), pa.array([None] * len(has) + vec[tree[joins]].tolist(), pa.int64()),
            ], ["label", "d1", "n", "a", "b"])

    cols = [*keys, "block", "d1", "vec", "times", "embedding"]
    return placed.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "vec").mapInArrow(run, _FOUND)


SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, comp) as (select vec_id, vec_id from embeddings union select l.y, r.comp from reach r join links l on l.x = r.id),
c as (select id, min(comp) as comp from reach group by id), n as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(n.n, 0) as n_links, c.comp as component_id, e.vec_id = c.comp as kept from embeddings e join c on c.id = e.vec_id left join n on n.x = e.vec_id
"""
