"""What the trained operators share: the sample of labelled rows and sparse features of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import col


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is 2 modulo 4; a null id is held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Texts and labels of at most ``rows`` documents that are not held out.

    They are the first by a hash of the id, so the same whatever the order of the
    tables. Of conflicting labels the smallest counts; null labels are no labels.
    Only the chosen ids, a bounded number, are broadcast.
    """
    chosen = (
        labels.select(col(id_col).alias("chosen"), col(label_col).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & ~held_out("chosen"))
        .groupBy("chosen").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("chosen"), "chosen").limit(rows)
    )
    table = (
        docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("chosen"))
        .groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").toArrow()
    )
    return table.column("text"), table.column("label").to_numpy().astype(np.int64)


class Sparse:
    """Rows of sparse features: row i has features index[bounds[i]:bounds[i + 1]] with these values."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray):
        self.index, self.value, self.bounds = index, value, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))


def counted(feature: np.ndarray, bounds: np.ndarray) -> Sparse:
    """Distinct features of each text with their counts; ``bounds`` are those of the texts among the features."""
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    key, count = np.unique((row << np.uint64(32)) | feature.astype(np.uint64), return_counts=True)
    rows = (key >> np.uint64(32)).astype(np.int64)
    return Sparse(
        (key & np.uint64(0xFFFFFFFF)).astype(np.int32), count.astype(np.float32), np.searchsorted(rows, np.arange(len(bounds)))
    )


def stacked(parts: list[Sparse]) -> Sparse:
    if not parts:
        return Sparse(np.empty(0, np.int32), np.empty(0, np.float32), np.zeros(1, np.int64))
    ends = np.concatenate([[0], *[np.diff(p.bounds) for p in parts]])
    return Sparse(np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]), np.cumsum(ends))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; zero for a row without any."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=np.float64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0, dtype=np.float64)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
