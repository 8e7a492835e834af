"""A stored index of precedents by nearest centre, of which a query reads only the files that may hold a hit.

The centres are trained once, when the index is made. Rows lie in folders by load, intent and cell, with the cell's rows spread
over files of bounded size; a small table holds every cell's radius and number of rows for each load. Later loads are appended to
the cells of the stored centres. A load counts from the moment its line is in that table, which is written last, so a load that
broke off is never read.

For unit vectors a cell whose centre is further from the query than the cell's radius plus the distance of the k-th hit so far
holds no better hit, by the triangle inequality, so the result equals ``retrieve.retrieve``.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.vectors import as_doubles, unit
from threadloom.operators.prune import SLACK
from threadloom.operators.retrieve import QUERY_BYTES, _block_top_k, _merge, _unit_rows, ranked_hits
from threadloom.session import small_side, value_bytes, write_stage

CELLS = 256
# Rows from which the centres are learned, those of the smallest id hashes; every row is indexed.
SAMPLE = 200_000
FILE_ROWS = 500_000


def _unit_vectors(rows: DataFrame, hit_id: str, vector: str) -> DataFrame:
    usable = rows.where(F.col(vector).isNotNull() & F.col("intent").isNotNull())
    return usable.select("intent", F.col(hit_id).alias("hit_id"), unit(as_doubles(F.col(vector))).alias("vector"))


def create_cells(rows: DataFrame, path: str, cells: int = CELLS, hit_id: str = "hit_id", vector: str = "embedding", seed: int = 42) -> None:
    """Learn the centres, store them below ``path``, and append ``rows`` as the first load."""
    held, seen = write_stage(_unit_vectors(rows, hit_id, vector), "cell-rows")
    share = F.pmod(F.xxhash64("hit_id", F.lit(seed)), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, SAMPLE / max(1, seen["rows"])))
    centers: list[tuple[int, list[float]]] = []
    if seen["rows"]:
        model = KMeans(k=cells, seed=seed, featuresCol="_features").fit(held.where(share).select(array_to_vector("vector").alias("_features")))
        centers = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    rows.sparkSession.createDataFrame(centers, "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    _append(held, path)


def append_cells(rows: DataFrame, path: str, hit_id: str = "hit_id", vector: str = "embedding") -> None:
    """Add a load of new precedents to the cells of the stored centres."""
    _append(write_stage(_unit_vectors(rows, hit_id, vector), "cell-rows")[0], path)


def _append(held: DataFrame, path: str) -> None:
    spark, load = held.sparkSession, uuid.uuid4().hex
    # As many vectors as the index has cells.
    stored = spark.read.parquet(f"{path}/centers").orderBy("cell").toPandas()
    centers = spark.sparkContext.broadcast(np.stack(stored["center"].to_numpy()) if len(stored) else np.zeros((1, 0)))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, away = np.zeros(len(frame), dtype=np.int32), np.zeros(len(frame))
            for start in range(0, len(frame), 1024):
                own = np.stack(frame["vector"].iloc[start : start + 1024].to_numpy())
                # Equally near centres: the first cell.
                cell[start : start + 1024] = ((centers.value**2).sum(axis=1)[None, :] - 2 * own @ centers.value.T).argmin(axis=1)
                away[start : start + 1024] = np.linalg.norm(own - centers.value[cell[start : start + 1024]], axis=1)
            yield frame.assign(cell=cell, away=away)

    placed = held.mapInPandas(nearest, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in held.schema)}, cell int, away double")
    placed, _ = write_stage(placed, "cell-placed")
    sizes = placed.groupBy("intent", "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size"))
    sizes, _ = write_stage(sizes.withColumn("load", F.lit(load)), "cell-sizes")
    files = small_side(sizes.select("intent", "cell", F.ceil(F.col("size") / FILE_ROWS).alias("files")), "cell-files")
    dealt = placed.drop("away").join(files, ["intent", "cell"]).withColumn("file", F.pmod(F.xxhash64("hit_id"), F.col("files")))
    rows = dealt.repartition("intent", "cell", "file").drop("file", "files")
    rows.write.partitionBy("intent", "cell").parquet(f"{path}/rows/load={load}")
    # From here on the load counts.
    sizes.coalesce(1).write.mode("append").parquet(f"{path}/cells")


class _Cells:
    """The cells of every intent: names, centres, radii and sizes over all loads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        stored = spark.read.parquet(f"{path}/cells")
        self.loads = [r["load"] for r in stored.select("load").distinct().collect()]
        merged = stored.groupBy("intent", "cell").agg(F.max("radius").alias("radius"), F.sum("size").alias("size"))
        # At most intents x cells rows.
        held = merged.join(spark.read.parquet(f"{path}/centers"), "cell").toPandas()
        self.by_intent = {
            name: (g["cell"].to_numpy(), np.stack(g["center"].to_numpy()), g["radius"].to_numpy(), g["size"].to_numpy())
            for name, g in held.groupby("intent")
        }

    def choose(self, asked: pd.DataFrame, need: int, limit: pd.Series | None = None) -> dict[tuple[str, int], pd.DataFrame]:
        """Queries by (intent, cell): the nearest cells that hold ``need`` rows, or, given ``limit``, the other ones within reach."""
        chosen: dict[tuple[str, int], pd.DataFrame] = {}
        for intent, part in asked.groupby("intent"):
            if intent not in self.by_intent:
                continue
            names, centers, radius, sizes = self.by_intent[intent]
            vectors = _unit_rows(part["vector"])
            squares = (vectors**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * vectors @ centers.T
            gaps = np.sqrt(np.maximum(squares, 0.0))
            order = np.argsort(gaps, axis=1, kind="stable")
            first = np.zeros_like(gaps, dtype=bool)
            np.put_along_axis(first, order, np.cumsum(sizes[order], axis=1) - sizes[order] < need, axis=1)
            wanted = first if limit is None else ~first & (gaps - radius[None, :] <= limit[part.index].to_numpy()[:, None])
            for column in np.flatnonzero(wanted.any(axis=0)):
                chosen[intent, int(names[column])] = part[wanted[:, column]][["query_id", "vector"]]
        return chosen


def read_cells(spark: SparkSession, path: str, loads: list[str], wanted: dict[str, list[int]]) -> DataFrame:
    """The rows of the given cells of every intent; files of other cells are not opened."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/load={load}" for load in loads])
    rows = rows.withColumn("intent", F.col("intent").cast("string"))
    held: Column = F.lit(False)
    for intent, cells in sorted(wanted.items()):
        held = held | ((F.col("intent") == intent) & F.col("cell").isin(cells))
    return rows.where(held)


def _scan(shipped, k: int, exclude_self: bool):
    """The k best rows of a partition for each of the broadcast queries of their cell."""
    top = _block_top_k(k, exclude_self)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for frame in frames:
            parts = [top(shipped.value[key], part) for key, part in frame.groupby(["intent", "cell"]) if key in shipped.value]
            if parts:
                best = _merge(parts if best is None else [best, *parts], k)
        if best is not None and len(best):
            yield best

    return scan


def kth_hits(near: DataFrame, k: int) -> DataFrame:
    """(query_id, similarity) of the k-th hit of the queries that have so many."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id")
    ranked = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return ranked.where(F.col("n") == k).select("query_id", "similarity")


def retrieve_cells(
    queries: DataFrame, path: str, k: int = 5, query_id: str = "query_id", vector: str = "embedding", intent_of: str = "intent",
    exclude_self: bool = False, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The output of ``retrieve.retrieve`` from a stored index, opening only the files of cells that may hold one of the k best.

    Queries go out in waves of about ``query_bytes``. A wave reads the nearest cells of its queries first, and then those that the distance of
    the k-th hit does not rule out. Rows stay where they lie; only hits are shuffled.
    """
    spark = queries.sparkSession
    id_type = queries.schema[query_id].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull() & F.col(intent_of).isNotNull()).select(
        F.col(intent_of).alias("intent"), F.col(query_id).alias("query_id"), as_doubles(F.col(vector)).alias("vector")
    )
    size = value_bytes(F.col("vector"), asked.schema["vector"].dataType) + 64
    asked, seen = write_stage(asked, "queries", bytes=F.coalesce(F.sum(size), F.lit(0)))
    cells = _Cells(spark, path)
    hit_type = spark.read.parquet(f"{path}/rows/load={cells.loads[0]}").schema["hit_id"].dataType.simpleString() if cells.loads else "bigint"
    schema = f"query_id {id_type}, hit_id {hit_type}, similarity double"

    def search(chosen: dict[tuple[str, int], pd.DataFrame]) -> DataFrame:
        if not chosen:
            return spark.createDataFrame([], schema)
        wanted: dict[str, list[int]] = {}
        for intent, cell in chosen:
            wanted.setdefault(intent, []).append(cell)
        rows = read_cells(spark, path, cells.loads, wanted).select("intent", "cell", "hit_id", "vector")
        return rows.mapInPandas(_scan(spark.sparkContext.broadcast(chosen), k, exclude_self), schema)

    waves = max(1, min(seen["rows"], math.ceil(seen["bytes"] / max(1, query_bytes))))
    number = F.pmod(F.xxhash64("query_id"), F.lit(waves))
    parts = []
    for wave in range(waves):
        frame = asked.where(number == wave).toPandas()
        need = k + int(exclude_self)
        first, _ = write_stage(search(cells.choose(frame, need)), "cell-hits")
        found = kth_hits(first, k).toPandas()
        worst = found.set_index("query_id")["similarity"].reindex(frame["query_id"]).to_numpy(dtype=float)
        reach = np.sqrt(np.maximum(0.0, 2 - 2 * worst)) + SLACK
        further = cells.choose(frame, need, pd.Series(np.where(np.isnan(reach), np.inf, reach), index=frame.index))
        parts.append(write_stage(ranked_hits(first.unionByName(search(further)) if further else first, k), "cell-wave")[0])
    return functools.reduce(DataFrame.unionByName, parts)
