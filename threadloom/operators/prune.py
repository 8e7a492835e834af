"""Exact nearest neighbours that skip the parts of an index which cannot hold one.

The index is grouped by nearest centre. For unit vectors a group whose centre is further from the
query than the group's radius plus the distance of the k-th hit so far holds no better hit, by the
triangle inequality. The result equals ``retrieve.retrieve``; how much is skipped depends on how
well the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.vectors import as_doubles, distance, unit
from threadloom.operators.bounded import block_apply
from threadloom.operators.retrieve import _block_top_k, _unit_rows, ranked_hits, retrieve
from threadloom.session import literal_table, write_stage

# Bytes of all centres, which are broadcast; with more of them nothing is skipped and the result stays the same.
CENTER_BYTES = 64 << 20
# Added to distances, above the rounding of similarities, so that ties are never skipped.
SLACK = 1e-4


@dataclass(frozen=True)
class GroupedIndex:
    """Rows with their group, and the groups' centres, or None where these are too large to broadcast."""

    rows: DataFrame
    groups: pd.DataFrame | None


def group_index(index: DataFrame, groups: int = 64, hit_id: str = "hit_id", vector: str = "embedding", seed: int = 42) -> GroupedIndex:
    """Assign every index row to its nearest of ``groups`` centres; keep centre, radius and size per intent."""
    rows = index.where(F.col(vector).isNotNull()).select(
        "intent", F.col(hit_id).alias("hit_id"), unit(as_doubles(F.col(vector))).alias("vector")
    )
    features = rows.withColumn("_features", array_to_vector("vector"))
    model = KMeans(k=groups, seed=seed, featuresCol="_features", predictionCol="group").fit(features)
    centers = literal_table(
        index.sparkSession, [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "group int, center array<double>"
    )
    assigned, _ = write_stage(
        model.transform(features).drop("_features").join(centers, "group").withColumn("away", distance(F.col("vector"), F.col("center"))).drop("center"),
        "grouped-index",
    )
    stats = assigned.groupBy("intent", "group").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size"))
    listed, seen = write_stage(stats.join(centers, "group"), "index-groups", width=F.max(F.size("center")))
    if seen["rows"] * 8 * (seen["width"] or 0) > CENTER_BYTES:
        return GroupedIndex(assigned.drop("away"), None)
    return GroupedIndex(assigned.drop("away"), listed.toPandas())


def _choose(spark: SparkSession, groups: pd.DataFrame, need: int):
    """Groups to search for each query: the nearest ones at first, later all that may hold a better hit."""
    shipped = spark.sparkContext.broadcast(
        {
            intent: (g["group"].to_numpy(), np.stack(g["center"].to_numpy()), g["radius"].to_numpy(), g["size"].to_numpy())
            for intent, g in groups.groupby("intent")
        }
    )

    def first_mask(gaps: np.ndarray, sizes: np.ndarray, limit: np.ndarray | None, radius: np.ndarray) -> np.ndarray:
        order = np.argsort(gaps, axis=1, kind="stable")
        reached = np.cumsum(sizes[order], axis=1)
        wanted = (reached - sizes[order]) < need
        mask = np.zeros_like(gaps, dtype=bool)
        np.put_along_axis(mask, order, wanted, axis=1)
        if limit is None:
            return mask
        return ~mask & (gaps - radius[None, :] <= limit[:, None])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for intent, part in frame.groupby("intent"):
                if intent not in shipped.value:
                    continue
                names, centers, radius, sizes = shipped.value[intent]
                vectors = _unit_rows(part["vector"])
                squares = (vectors**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * vectors @ centers.T
                gaps = np.sqrt(np.maximum(squares, 0.0))
                limit = part["limit"].to_numpy(dtype=float) if "limit" in part else None
                rows, cols = np.nonzero(first_mask(gaps, sizes, limit, radius))
                out = part.iloc[rows][["intent", "query_id", "vector"]].copy()
                out["group"] = names[cols]
                yield out

    return choose


def retrieve_pruned(
    queries: DataFrame,
    index: GroupedIndex,
    k: int = 5,
    query_id: str = "query_id",
    vector: str = "embedding",
    intent_of: str = "intent",
    exclude_self: bool = False,
    query_rows: int = 4096,
    index_rows: int = 16384,
) -> DataFrame:
    """The output of ``retrieve.retrieve``, searching only groups that may hold one of the k best."""
    id_type = queries.schema[query_id].dataType.simpleString()
    hit_type = index.rows.schema["hit_id"].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(
        F.col(intent_of).alias("intent"), F.col(query_id).alias("query_id"), as_doubles(F.col(vector)).alias("vector")
    )
    if index.groups is None:
        return retrieve(queries, index.rows, k, query_id, "hit_id", vector, intent_of, exclude_self, index_vector="vector")
    choose = _choose(queries.sparkSession, index.groups, k + int(exclude_self))
    chosen_schema = f"intent string, query_id {id_type}, vector array<double>, group int"
    hit_schema = f"query_id {id_type}, hit_id {hit_type}, similarity double"

    def search(chosen: DataFrame) -> DataFrame:
        return block_apply(
            chosen, index.rows, ["intent", "group"], "query_id", "hit_id", _block_top_k(k, exclude_self), hit_schema, query_rows, index_rows
        )

    # The first search is written, as the second one starts from what it found.
    chosen, _ = write_stage(asked.mapInPandas(choose, chosen_schema), "first-groups")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id")
    first, _ = write_stage(search(chosen).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), "first-hits")
    worst = first.groupBy("query_id").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("n"))
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))) + F.lit(SLACK)
    limited = asked.join(worst, "query_id", "left").select(
        "intent", "query_id", "vector", F.when(F.col("n") >= k, reach).otherwise(F.lit(float("inf"))).alias("limit")
    )
    more, seen = write_stage(limited.mapInPandas(choose, chosen_schema), "further-groups")
    hits = first.unionByName(search(more)) if seen["rows"] else first
    return ranked_hits(hits, k)
