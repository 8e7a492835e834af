"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller batches, so that few of them are Python objects at the same time.

    Workers are used again by later tasks, so what Arrow still holds of batches gone by is given back after each.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        release()


def release() -> None:
    """Give the memory that Arrow's pool holds without need back to the system."""
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def matrices_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of a list column, for each length a float64 matrix and the places of its rows in the column.

    A vector is usable if it is not null or empty, holds no null and no non-finite component, and is not the zero vector.
    """
    rows = column.to_pylist()
    places: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        if r and None not in r:
            places.setdefault(len(r), []).append(i)
    for own in places.values():
        matrix = np.array([rows[i] for i in own], dtype=np.float64)
        good = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
        if good.any():
            yield matrix[good], np.array(own)[good]


def pieces_up_to(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of consecutive texts of about ``limit`` bytes in all; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
