"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every row is sent down to its leaf. A query takes nodes from a
priority queue, nearest centre first, and visits the leaves that come out. How many it visits is
calibrated: for some queries the true neighbours are found in all rows, and visits are widened until
the wanted share of them lies in visited leaves. Leaves are cut into chunks and the queries of a leaf into
parts, so that a task sees bounded numbers of both, however many rows a leaf has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import written
from grantlens.llm.vectors import component_type, kmeans, matrix, nearest, sample, valid

NEIGHBOURS = 10
BRANCHES = 8
#: Rows a leaf has on average, and the most leaves there are.
LEAF_ROWS, MOST_LEAVES = 1000, 4096
#: Queries that calibrate, and the share of their true neighbours that visits must reach.
CALIBRATE, RECALL = 200, 0.97
#: Rows and queries in a task's block.
CHUNK_ROWS, PART_QUERIES = 4096, 2048


@dataclass(frozen=True)
class Tree:
    """Nodes by number; node 0 is the root. children[i] is empty for a leaf."""

    centres: np.ndarray
    children: list[list[int]]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to when it follows the nearest centre."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below or not len(rows):
                at[rows] = node
                continue
            near = nearest(x[rows], self.centres[below])
            todo += [(child, rows[near == i]) for i, child in enumerate(below)]
        return at

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for a query, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield node
            else:
                far = ((self.centres[below] - q) ** 2).sum(1)
                for d, child in zip(far.tolist(), below):
                    heapq.heappush(queue, (d, child))


def grow(x: np.ndarray, leaves: int) -> Tree:
    """Split by k-means, the fullest node first, until there are about so many leaves."""
    centres, children, members = [x.mean(0)], [[]], {0: x}
    full = [(-len(x), 0)]
    count = 1
    while full and count < leaves:
        _, node = heapq.heappop(full)
        own = members.pop(node)
        got = kmeans(own, min(BRANCHES, leaves - count + 1))
        if len(got) < 2:
            continue
        near = nearest(own, got)
        for i, c in enumerate(got):
            child = len(centres)
            centres.append(c)
            children.append([])
            children[node].append(child)
            members[child] = own[near == i]
            heapq.heappush(full, (-int((near == i).sum()), child))
        count += len(got) - 1
    return Tree(np.array(centres), children)


def fitted(rows: DataFrame, leaves: int) -> Tree:
    """The tree of a bounded sample, grown in a task; the driver gets its centres."""

    def fit(batches):
        x = np.concatenate([matrix(b.column(0)) for b in batches])
        tree = grow(x, leaves)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tree.children))), pa.array(list(tree.centres)), pa.array(tree.children, pa.list_(pa.int64()))], ["node", "centre", "children"])

    got = sample(rows, "vec_id").select("embedding").coalesce(1).mapInArrow(fit, "node long, centre array<double>, children array<long>").collect()
    got.sort(key=lambda r: r["node"])
    return Tree(np.array([r["centre"] for r in got]), [list(r["children"]) for r in got])


def closest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, exact distance) of the k nearest rows with another id, ties to smaller ids."""
    where, found, scores = [], [], []
    squares = (x * x).sum(1)
    for a in range(0, len(q), 256):
        rough = squares[None, :] - 2 * q[a:a + 256] @ x.T
        rough[q_ids[a:a + 256, None] == ids[None, :]] = np.inf
        for i, row in enumerate(rough):
            if len(row) > k:
                # Products are rounded differently from differences: all that may be among the nearest are measured exactly.
                edge = np.partition(row, k - 1)[k - 1]
                own = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge) + (q[a + i] ** 2).sum()))
            else:
                own = np.arange(len(row))
            own = own[ids[own] != q_ids[a + i]]
            exact = np.sqrt(((x[own] - q[a + i]) ** 2).sum(1))
            best = np.lexsort((ids[own], exact))[:k]
            where.append(np.full(len(best), a + i))
            found.append(ids[own][best])
            scores.append(exact[best])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(where), np.concatenate(found), np.concatenate(scores)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score)."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_FOUND = "query_id long, vec_id long, score double"


def _names(batch: pa.RecordBatch | pa.Table, name: str):
    return batch.column(batch.schema.get_field_index(name))


def calibrated_visits(placed: DataFrame, queries: DataFrame, tree: Tree, k: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """Leaves to visit so that the calibration queries reach the recall; they are compared with all rows, in blocks."""
    own = sample(queries, "vec_id", CALIBRATE).select("vec_id", "embedding").collect()
    if not own:
        return 1
    q, q_ids = np.array([r["embedding"] for r in own], np.float64), np.array([r["vec_id"] for r in own])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = _names(batch, "vec_id").to_numpy(), _names(batch, "leaf").to_numpy()
            where, found, scores = closest(matrix(_names(batch, "embedding")), ids, q, q_ids, k)
            order = np.argsort(ids, kind="stable")
            at = order[np.searchsorted(ids[order], found)]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[where]), pa.array(found), pa.array(scores), pa.array(leaf[at])], ["query_id", "vec_id", "score", "leaf"])

    rows = placed.select("vec_id", "embedding", "leaf").mapInArrow(near, f"{_FOUND}, leaf long")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    truth = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "leaf").collect()
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(x), 1)} for i, x in zip(q_ids, q)}
    needed = np.sort([place[r["query_id"]][r["leaf"]] for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, nearest first, ties to the smaller id.

    Both frames have vec_id and embedding. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, have no part. Vectors of different lengths have no distance: each length
    has a tree of its own. A row with the query's own id isn't its neighbour. Where there are fewer other rows
    than k, all are returned. Empty tables give no rows; a repeated query row is one query. Other columns have no part.
    """
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(component_type(rows)).alias("embedding")]
    rows = rows.select(*cols).filter(valid() & F.col("vec_id").isNotNull())
    queries = queries.select(*cols).filter(valid() & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"])
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    found = None
    for dim in sorted(sizes):
        part = _one_length(*(x.filter(F.size("embedding") == dim) for x in (rows, queries)), sizes[dim], k, recall)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def _one_length(rows: DataFrame, queries: DataFrame, n: int, k: int, recall: float) -> DataFrame:
    """search() among n rows of one length."""
    kind = component_type(rows)
    tree = fitted(rows, max(1, min(MOST_LEAVES, n // LEAF_ROWS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaves_of(matrix(_names(batch, "embedding"))))], [*batch.schema.names, "leaf"])

    placed = written(rows.mapInArrow(place, f"vec_id long, embedding {kind}, leaf long"), "ann-index")
    held = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    wanted = calibrated_visits(placed, queries, tree, k, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at, leaves = matrix(_names(batch, "embedding")), [], []
            for i, q in enumerate(x):
                seen, got = 0, 0
                for leaf in tree.visits(q):
                    # Visits go on past the calibrated number until there are enough rows to choose from.
                    if seen >= wanted and got > k:
                        break
                    seen, got = seen + 1, got + held.get(leaf, 0)
                    if leaf in held:
                        at.append(i)
                        leaves.append(leaf)
            batch = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([_names(batch, "vec_id"), _names(batch, "embedding"), pa.array(leaves, pa.int64())], ["vec_id", "embedding", "leaf"])

    visits = written(queries.mapInArrow(visit, f"vec_id long, embedding {kind}, leaf long"), "ann-visits")
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    parts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / PART_QUERIES).alias("parts"))
    plan = chunks.join(parts, "leaf")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = placed.join(plan, "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).withColumn("part", numbers("parts"))
    asks = visits.join(plan, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("chunk", numbers("chunks"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = right.column("vec_id").to_numpy()
        if not left.num_rows or not right.num_rows:
            where, found, scores = closest(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), q_ids[:0], k)
        else:
            where, found, scores = closest(matrix(left.column("embedding")), left.column("vec_id").to_numpy(), matrix(right.column("embedding")), q_ids, k)
        return pa.table({"query_id": pa.array(q_ids[where], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    key = ["leaf", "chunk", "part"]
    cols = [*key, "vec_id", "embedding"]
    found = index.select(*cols).groupBy(*key).cogroup(asks.select(*cols).groupBy(*key)).applyInArrow(compare, _FOUND)
    return ranked(found, k)


def near_hundredths(rows: DataFrame) -> DataFrame:
    """The neighbours, among all rows, of the rows whose vec_id is divisible by 100."""
    return search(rows, rows.filter(F.col("vec_id") % 100 == 0))
