"""What the operators on embeddings share: valid rows, bounded samples, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that centres are fitted on, those with the smallest hash of their id.
SAMPLE = 8192


def valid(column: str = "embedding") -> F.Column:
    """Not null or empty, every component a finite number, and not all of them zero."""
    limit = F.lit(float("inf"))
    whole = F.forall(column, lambda x: F.coalesce((F.abs(x) < limit) & ~F.isnan(x), F.lit(False)))
    return F.coalesce((F.size(column) > 0) & whole & F.exists(column, lambda x: x != 0), F.lit(False))


def component_type(rows: DataFrame, column: str = "embedding") -> str:
    """The SQL type of an array column of floats or doubles, as it comes; other numbers are read as doubles."""
    kind = rows.schema[column].dataType.simpleString()
    return kind if kind in ("array<float>", "array<double>") else "array<double>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(array)
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def sample(rows: DataFrame, id_column: str, n: int = SAMPLE) -> DataFrame:
    """At most n rows, the same on every run."""
    return rows.orderBy(F.xxhash64(id_column, F.lit(3)), id_column).limit(n)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, spherical: bool = False, seed: int = 5) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn apart from each other; of unit length if spherical."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        filled = counts > 0
        centres = np.where(filled[:, None], sums / np.maximum(counts, 1)[:, None], centres)
        if spherical:
            norm = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(norm > 1e-12, centres / np.maximum(norm, 1e-12), x[rng.choice(len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[a:a + 4096] @ centres.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
