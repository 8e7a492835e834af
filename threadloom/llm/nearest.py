"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash turns a unit vector by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and takes the signed axis nearest to it. ``hashes`` such axes make a bucket. Vectors are stored
under one bucket per table; a query looks into the ``probes`` buckets of each table whose axes lie nearest to it.
Query and candidates of a bucket meet in blocks of bounded size, where distances are computed exactly on the original
vectors; a block returns at most k rows per query, never its pairs. Queries that find fewer than k rows, though there
are more candidates, are compared with all rows.

Nearness is the Euclidean distance in double precision. Hashing sees directions only, so vectors of very different lengths
should be scaled by the caller first.

Defined cases: vectors that are null or zero, hold null or non-finite components
take no part, neither do rows without an id. Vectors of different lengths are no candidates of each other. Rows that share an id are one candidate each, of which a
result names the nearest; a query never finds its own id. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tables import matrices_of
from threadloom.session import small_side, write_stage

TABLES = 10
PROBES = 16
SEED = 11
# Rows of one side that meet in a task.
BLOCK = 8192
FOUND = "query_id bigint, vec_id bigint, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, x, step = x.shape[1], x.copy(), 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def axes(unit: np.ndarray, table: int, part: int, seed: int = SEED) -> np.ndarray:
    """Agreement of the rows with the signed axes (+ first, then -) after the pseudo-rotation of a table's part."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng((seed, table, part)).choice((-1.0, 1.0), size=(3, width))
    for row in signs:
        x = hadamard(x * row)
    return np.concatenate((x, -x), axis=1)


def buckets(unit: np.ndarray, table: int, hashes: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The ``probes`` best buckets of every row: those whose axes agree most in sum."""
    best, names = None, None
    for part in range(hashes):
        score = axes(unit, table, part, seed)
        top = min(probes, score.shape[1])
        name = np.argsort(-score, axis=1, kind="stable")[:, :top]
        value = np.take_along_axis(score, name, axis=1)
        if best is None:
            best, names = value, name.astype(np.int64)
        else:
            both = (best[:, :, None] + value[:, None, :]).reshape(len(unit), -1)
            ids = (names[:, :, None] * score.shape[1] + name[:, None, :]).reshape(len(unit), -1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            best, names = np.take_along_axis(both, top, axis=1), np.take_along_axis(ids, top, axis=1)
    return names


def hashed(vectors: DataFrame, key: str, vector: str, tables: int, hashes: int, probes: int, seed: int = SEED) -> DataFrame:
    """(id, vector, spots): the usable vectors as bytes of doubles; spots holds tables x probes buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for matrix, places in matrices_of(batch.column(1)):
                scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                # Short vectors have fewer buckets than probes; the other places hold -1, which is no bucket.
                spots = [buckets(unit, t, hashes, probes, seed) for t in range(tables)]
                spots = np.concatenate([np.pad(s, ((0, 0), (0, probes - s.shape[1])), constant_values=-1) for s in spots], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places)),
                        pa.array([r.tobytes() for r in matrix], pa.binary()),
                        pa.array(list(spots), pa.list_(pa.int64())),
                    ],
                    names=["id", "vector", "spots"],
                )

    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull())
    return rows.mapInArrow(run, "id bigint, vector binary, spots array<bigint>")


def _spots(rows: DataFrame, probes: int) -> DataFrame:
    """One row per (table, bucket) of a vector."""
    spots = rows.select("id", "vector", F.posexplode("spots").alias("at", "bucket"))
    return spots.where("bucket >= 0").select("id", "vector", F.floor(F.col("at") / probes).cast("int").alias("tab"), "bucket")


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of ``right`` for every row of ``left``, ties to the smaller id."""
    parts = []
    if len(left) and len(right):
        right = right.sort_values("id")
        ids = right["id"].to_numpy()
        sizes = right["vector"].map(len).to_numpy()
        for size, group in left.groupby(left["vector"].map(len)):
            own = np.flatnonzero(sizes == size)
            if not len(own):
                continue
            points = np.frombuffer(b"".join(right["vector"].iloc[own]), dtype=np.float64).reshape(len(own), -1)
            # Rows that share an id are one candidate, as near as the nearest of them.
            names, starts = np.unique(ids[own], return_index=True)
            for query, raw in zip(group["id"].to_numpy(), group["vector"]):
                distance = np.sqrt(np.square(points - np.frombuffer(raw, dtype=np.float64)).sum(axis=1))
                if len(names) < len(distance):
                    distance = np.minimum.reduceat(distance, starts)
                distance[names == query] = np.inf
                n = min(k, len(distance))
                edge = np.partition(distance, n - 1)[n - 1]
                near = np.flatnonzero(distance <= edge)
                near = near[np.argsort(distance[near], kind="stable")][: n]
                near = near[np.isfinite(distance[near])]
                parts.append(pd.DataFrame({"query_id": query, "vec_id": names[near], "score": distance[near]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _short(ranked: DataFrame, data: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(id, vector) of the queries with fewer than min(k, candidates) rows, and their number."""
    size = F.length("vector").alias("size")
    there = data.select("id", size).distinct().groupBy("size").agg((F.count(F.lit(1)) - 1).alias("others"))
    wanted = asked.select("id", size).distinct().join(F.broadcast(there), "size").groupBy("id").agg(F.least(F.sum("others"), F.lit(k)).alias("want"))
    had = ranked.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("had"))
    few = wanted.join(had, "id", "left").where(F.coalesce("had", F.lit(0)) < F.col("want")).select("id")
    short, seen = write_stage(asked.join(few, "id", "left_semi").select("id", "vector"), "nearest-short")
    return short, seen["rows"]


def _everywhere(short: DataFrame, asks: int, data: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest of all stored rows, for ``asks`` queries; both sides are cut into blocks that all meet."""
    row_blocks, ask_blocks = -(-data.count() // block), -(-asks // block)
    place = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    series = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = short.select(series(row_blocks).alias("row_block"), place(ask_blocks).alias("ask_block"), "id", "vector")
    right = data.select(place(row_blocks).alias("row_block"), series(ask_blocks).alias("ask_block"), "id", "vector")
    names = ["row_block", "ask_block"]
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(lambda a, b: _nearest(a, b, k), FOUND)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    hashes: int = 1,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` selects, among all other rows."""
    data, _ = write_stage(
        hashed(vectors, key, vector, tables, hashes, 1, seed), "nearest-index"
    )
    asked, _ = write_stage(hashed(vectors.where(is_query), key, vector, tables, hashes, probes, seed), "nearest-queries")
    stored, wanted = _spots(data, 1), _spots(asked, probes)

    # Both sides of a bucket are cut into blocks; every block of one side meets every block of the other.
    size = lambda rows, out: rows.groupBy("tab", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(out))
    cuts = small_side(size(stored, "rows").join(size(wanted, "asks"), ["tab", "bucket"]), "nearest-blocks")
    place = lambda n: F.pmod(F.xxhash64("id", "vector"), F.col(n)).cast("int")
    series = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["tab", "bucket", "row_block", "ask_block"]
    right = stored.join(cuts, ["tab", "bucket"]).select("tab", "bucket", place("rows").alias("row_block"), series("asks").alias("ask_block"), "id", "vector")
    left = wanted.join(cuts, ["tab", "bucket"]).select("tab", "bucket", series("rows").alias("row_block"), place("asks").alias("ask_block"), "id", "vector")

    found = (
        left.groupBy(*names)
        .cogroup(right.groupBy(*names))
        .applyInPandas(lambda a, b: _nearest(a, b, k), FOUND)
    )
    ranked, _ = write_stage(_ranked(found, k), "nearest-found")
    short, asks = _short(ranked, data, asked, k)
    if not asks:
        return ranked
    return _ranked(ranked.select("query_id", "vec_id", "score").unionByName(_everywhere(short, asks, data, k, block)), k)
