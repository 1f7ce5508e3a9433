"""Packing documents into sequences by cutting-stock column generation.

A document is cut into whole sequences and a rest. Only the histogram of piece lengths goes to the
driver: one number per length class. There a linear program over patterns of lengths is solved, the
patterns being priced by a knapsack, and its rounded solution says how many sequences of each pattern
there are. Pieces are then ranked within their class, in tasks, and the rank names the sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import written
from grantlens.llm.tokens import default_path, encoded

CAPACITY = 1024
#: Lengths are planned in units of so many tokens, rounded up: a quarter of the lengths makes a program that
#: is solved in a second, and costs one or two tokens of padding a piece.
UNIT = 4
#: The program is solved to this share above its own lower bound.
GAP = 0.001
#: Groups that the pieces of one length are dealt to, to be ranked side by side.
RANK_GROUPS = 64
_EPS = 1e-9


def cheapest_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of lengths within the capacity (knapsack, repeats allowed): value and {index: times}."""
    use = np.flatnonzero(values > _EPS)
    ls, vs = lengths[use], values[use]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(ls, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            gain = best[c - ls[:k]] + vs[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + _EPS:
                best[c], pick[c] = gain[j], j
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        i = int(use[pick[c]])
        pattern[i] = pattern.get(i, 0) + 1
        c -= int(lengths[i])
    return float(best[capacity]), pattern


def first_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """A starting basis, one pattern per length: as often as it fits or, for a long one, with a partner that fills the rest."""
    place = {int(x): i for i, x in enumerate(lengths)}
    left = demand.astype(float).copy()
    out: list[dict[int, int]] = [{} for _ in lengths]
    for i in range(len(lengths) - 1, -1, -1):
        times = capacity // int(lengths[i])
        partner = place.get(capacity - int(lengths[i])) if times == 1 else None
        if partner is not None and partner < i and left[partner] >= demand[i]:
            left[partner] -= demand[i]
            out[i] = {i: 1, partner: 1}
        else:
            out[i] = {i: times}
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often to use them, as a linear program: least sequences that hold the demand.

    Revised simplex with an explicit inverse of the basis. It ends when no pattern is worth more than a
    sequence, or when the sequences are within `gap` of their lower bound (value of the duals / best pattern).
    """
    n = len(lengths)
    # Tied ratios could make the simplex go round in circles; slightly uneven demands have none.
    demand = demand + 1e-5 * (1 + np.arange(n) * 0.618 % 1)
    basis = first_patterns(lengths, demand, capacity)
    # Such a basis is inverted by hand: what a long length's pattern holds of its partner, the partner's own needn't.
    inverse = np.zeros((n, n))
    for i, pattern in enumerate(basis):
        inverse[i, i] = 1 / pattern[i]
    for i, pattern in enumerate(basis):
        for partner in pattern.keys() - {i}:
            inverse[partner, i] = -inverse[partner, partner]
    x = (inverse * demand).sum(1)
    floor = float((lengths * demand).sum()) / capacity
    for _ in range(100 * n):  # far more than it takes; any basis on the way is a plan as well
        duals = inverse.sum(0)
        value, pattern = cheapest_pattern(lengths, duals, capacity)
        total = float(x.sum())
        if value <= 1 + 1e-7 or total <= (1 + gap) * max(floor, total / value):
            return list(zip(basis, np.maximum(x, 0)))
        column = np.zeros(n)
        for i, a in pattern.items():
            column[i] = a
        step = (inverse * column).sum(1)
        rising = step > 1e-9
        ratio = np.full(n, np.inf)
        ratio[rising] = np.maximum(x[rising], 0) / step[rising]
        out = int(ratio.argmin())
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        moved = ratio[out]
        x -= moved * step
        x[out] = moved
        basis[out] = pattern
    return list(zip(basis, np.maximum(x, 0)))


def fill(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, for what rounding leaves: each piece goes to the fullest sequence that has room."""
    room: dict[int, list[dict[int, int]]] = {}
    spaces = np.zeros(capacity + 1, np.int64)
    done: list[dict[int, int]] = []
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        for _ in range(int(demand[i])):
            fits = np.flatnonzero(spaces[size:])
            if len(fits):
                space = size + int(fits[0])
                bin_ = room[space].pop()
                spaces[space] -= 1
            else:
                space, bin_ = capacity, {}
            bin_[i] = bin_.get(i, 0) + 1
            if space == size:
                done.append(bin_)
            else:
                room.setdefault(space - size, []).append(bin_)
                spaces[space - size] += 1
    done += [b for bins in room.values() for b in bins]
    same: dict[tuple, int] = {}
    for b in done:
        key = tuple(sorted(b.items()))
        same[key] = same.get(key, 0) + 1
    return [(dict(k), n) for k, n in sorted(same.items())]


@dataclass(frozen=True)
class Layout:
    """Where the piece of a rank goes: per length, runs of ranks that share a pattern."""

    first: dict[int, np.ndarray]  # rank at which a run begins
    times: dict[int, np.ndarray]  # pieces of the length in one sequence of the pattern
    sequence: dict[int, np.ndarray]  # first sequence of the pattern
    slot: dict[int, np.ndarray]  # slot of the length's first piece in a sequence
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot) of pieces by length and rank."""
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            run = np.searchsorted(self.first[size], rank[own], side="right") - 1
            nth, times = rank[own] - self.first[size][run], self.times[size][run]
            seq[own] = self.sequence[size][run] + nth // times
            off[own] = self.slot[size][run] + nth % times
        return seq, off


def layout(histogram: dict[int, int], capacity: int = CAPACITY) -> Layout:
    """Plan the sequences for a histogram of piece lengths; its size is bounded by the capacity."""
    whole = {s: n for s, n in histogram.items() if s == capacity}
    lengths = np.array(sorted(s for s, n in histogram.items() if n > 0 and s < capacity), np.int64)
    demand = np.array([histogram[s] for s in lengths.tolist()], np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    if len(lengths):
        left = demand.copy()
        for pattern, times in solve(lengths, demand, capacity):
            times = min([int(np.floor(times + 1e-6)), *[int(left[i]) // a for i, a in pattern.items()]])
            if times > 0:
                plan.append((pattern, times))
                for i, a in pattern.items():
                    left[i] -= a * times
        plan += fill(lengths, left, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for size, n in whole.items():
        runs[size] = [(0, 1, 0, 0)]
        sequence += n
    for pattern, times in plan:
        slot = 0
        for i, a in sorted(pattern.items(), reverse=True):
            size = int(lengths[i])
            runs.setdefault(size, []).append((ranks.get(size, 0), a, sequence, slot))
            ranks[size] = ranks.get(size, 0) + a * times
            slot += a
        sequence += times
    cols = [{s: np.array([r[k] for r in rows], np.int64) for s, rows in runs.items()} for k in range(4)]
    return Layout(*cols, sequences=sequence)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: documents cut at multiples of the capacity."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, at in encoded(batch.column(1), path):
                n = np.diff(at)
                parts = -(-n // capacity)
                owner = np.repeat(np.arange(b - a), parts)
                start = (np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner]) * capacity
                length = np.minimum(n[owner] - start, capacity)
                data, begin = ids.astype("<u4"), at[:-1][owner] + start
                crc = np.fromiter((zlib.crc32(data[x:x + k]) for x, k in zip(begin.tolist(), length.tolist())), np.int64, len(owner))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(owner)), *map(pa.array, (start, length.astype(np.int64), crc, n[owner].astype(np.int64)))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(cut, _PIECE)


def ranked(rows: DataFrame) -> DataFrame:
    """Pieces with `rank`, from 0 without gaps within each length class `units`.

    Pieces of a class are dealt to RANK_GROUPS groups by hash, so that a very common length isn't one
    task's work; a group's ranks follow those of the groups before it.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_GROUPS)))
    counts = rows.groupBy("units", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("units", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Rows that tie in the order are equal, so any of them may take a rank.
    order = Window.partitionBy("units", "part").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    rows = rows.withColumn("nth", F.row_number().over(order))
    return rows.join(counts, ["units", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("part", "before", "nth")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document has at least its end id (null text is empty), so every row of `docs` has a piece.
    An empty table gives no rows. Rows of one doc_id are packed each for itself.
    """
    if capacity % unit:
        raise ValueError("the capacity must be a multiple of the unit")
    cut = written(pieces(docs, path, capacity), "pack-pieces").withColumn("units", F.ceil(F.col("length") / unit))
    histogram = {r["units"]: r["n"] for r in cut.groupBy("units").agg(F.count("*").alias("n")).collect()}
    plan = layout(histogram, capacity // unit)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("units", "rank"))
            seq, slot = plan.place(units, rank)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked(cut).mapInArrow(place, f"{_PIECE}, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")
