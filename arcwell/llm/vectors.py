"""What the two embedding operators share: valid vectors, samples and codebooks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most vectors that codebooks are fitted on.
MAX_SAMPLE = 8192


def with_vectors(rows: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and embedding, as floats if it has floats, else as doubles."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    return rows.select(*columns, F.col("embedding").cast(kind).alias("embedding"))


def of_one_length(rows: DataFrame) -> DataFrame:
    """``rows`` whose embedding has the commonest length, the longer one of equally common ones."""
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
    most = sizes.first()
    return rows if most is None else rows.filter(F.size("embedding") == most["n"])


def valid(embedding: Column) -> Column:
    """Whether a vector takes part: not null or empty, finite throughout, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(embedding.isNotNull() & ~bad & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles; ValueError if they aren't."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    if len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, each summed alike, so that equal rows tie exactly."""
    scale = np.sqrt((x * x).sum()) * np.sqrt((rows * rows).sum(axis=1))
    return (rows * x).sum(axis=1) / scale


def sample(vectors: DataFrame, column: str, key: str, most: int = MAX_SAMPLE) -> np.ndarray:
    """Unit rows of at most ``most`` vectors, the first in the order of a hash of their key."""
    rows = vectors.select(column, F.xxhash64(F.col(key), F.lit(11)).alias("order"), key)
    found = rows.orderBy("order", key).limit(most).select(column).toArrow()
    x = matrix(found.column(0))
    return unit(x) if len(x) else x


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids; an emptied cluster starts again at a random row."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        for j in range(x.shape[1]):
            sums = np.bincount(near, weights=x[:, j], minlength=k)
            centers[:, j] = sums
        counts = np.bincount(near, minlength=k)
        empty = counts == 0
        centers[~empty] /= counts[~empty, None]
        centers[empty] = x[rng.choice(len(x), int(empty.sum()))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        out[at : at + 4096] = ((centers * centers).sum(axis=1) - 2 * part @ centers.T).argmin(axis=1)
    return out
