"""Precedents, their vector index, nearest neighbours per intent, and how far they agree."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.functions.values import half_even
from threadloom.functions.vectors import as_doubles, cosine, norm
from threadloom.operators.joins import assert_disjoint
from threadloom.session import small_side, value_bytes, write_stage

SIMILAR = 0.65
# Similarities are compared to this many digits, so that ties do not hang on the order of additions.
DIGITS = 9
# Bytes of the queries that travel to the index together; it stays where it is.
QUERY_BYTES = 32 << 20
# From so many queries on, comparing them costs more than dealing the index evenly to all cores first.
SPREAD_QUERIES = 1000


def outcome_of(col: Column, allowed: Sequence[str] = presets.OUTCOMES, default: str = presets.DEFAULT_OUTCOME) -> Column:
    return F.when(col.isin(*allowed), col).otherwise(F.lit(default))


def build_precedents(
    messages: DataFrame, replies: DataFrame, extracted: DataFrame, fallback_chars: int | None = None
) -> DataFrame:
    """Messages with the brand's reply and what was extracted from it.

    Extraction results come by thread. A thread without one gets its reply as the action (the first
    ``fallback_chars`` characters of it, if a number is given; ``presets.EMPTY_ACTION`` if it is empty) and ``fallback`` as
    the source; an unknown outcome becomes the default outcome.
    """
    found = extracted.select("thread_id", F.col("action_taken").alias("_action"), F.col("outcome").alias("_outcome"))
    action = tx.strip(F.coalesce("_action", F.lit("")))
    reply = F.coalesce("brand_reply_text", F.lit(""))
    fallback = reply if fallback_chars is None else tx.left(reply, fallback_chars)
    joined = messages.join(replies.select("thread_id", "brand_reply_text"), "thread_id").join(found, "thread_id", "left")
    return joined.select(
        "thread_id",
        "post_id",
        F.col("predicted_intent").alias("intent"),
        F.col("text").alias("customer_message"),
        F.when(action != "", action).when(fallback != "", fallback).otherwise(F.lit(presets.EMPTY_ACTION)).alias("action_taken"),
        outcome_of(F.col("_outcome")).alias("outcome"),
        "brand_reply_text",
        F.when(action != "", "extracted").otherwise("fallback").alias("extraction_source"),
    )


def write_index(
    precedents: DataFrame, holdout: DataFrame, path: str, key: str = "thread_id", vector: str = "embedding", file_rows: int = 500_000
) -> DataFrame:
    """Check for leakage, then store precedents by intent with the norm of their vectors.

    Each intent is spread by id over as many files as its counted rows ask for, so an intent with a
    third of all rows is written by many tasks.
    """
    assert_disjoint(precedents, holdout, key)
    files = precedents.groupBy("intent").agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).alias("_files"))
    indexed = precedents.withColumns(
        {
            vector: as_doubles(F.col(vector)),
            "norm": norm(as_doubles(F.col(vector))),
            "document": tx.display_document(F.col("customer_message"), F.col("action_taken")),
        }
    )
    salted = indexed.join(small_side(files, "index-files"), "intent").withColumn(
        "_file", F.pmod(F.xxhash64(key), F.col("_files"))
    )
    written = Observation("index")
    salted.repartition("intent", "_file").drop("_file", "_files").observe(
        written, F.count(F.lit(1)).alias("rows")
    ).write.mode("overwrite").partitionBy("intent").parquet(path)
    stored = read_index(precedents.sparkSession, path)
    if stored.count() != written.get["rows"]:
        raise AssertionError("the index does not hold every precedent")
    return stored


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("intent", F.col("intent").cast("string"))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


# Similarities that are held at a time; the work on them takes a few copies.
BLOCK_CELLS = 1 << 19


def _best_cells(
    sims: np.ndarray, who: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded similarity of the k best cells of each row, best first, ties by id; ``sims`` may be overwritten.

    With a ``floor`` for each row, cells below it are of no interest: only the few others are rounded and put in order.
    """
    if floor is None:
        np.round(sims, DIGITS, out=sims)
        if exclude_self:
            sims[who[:, None] == ids[None, :]] = -np.inf
        found = sims > -np.inf
        if sims.shape[1] > k:
            found &= sims >= np.partition(sims, sims.shape[1] - k, axis=1)[:, -k][:, None]
        rows, cols = np.nonzero(found)
        similar = sims[rows, cols]
    else:
        rows, cols = np.divmod(np.flatnonzero(sims >= floor[:, None]), sims.shape[1])
        if exclude_self:
            other = who[rows] != ids[cols]
            rows, cols = rows[other], cols[other]
        similar = np.round(sims[rows, cols], DIGITS)
    order = np.lexsort((ids[cols], -similar, rows))
    rows, cols, similar = rows[order], cols[order], similar[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], cols[best], similar[best]


def _block_top_k(k: int, exclude_self: bool, cells: int = BLOCK_CELLS):
    """The k best rows of an index block for each query of a query block."""

    def best(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "hit_id": [], "similarity": []}
        if len(queries) and len(index):
            known, ids = _unit_rows(index["vector"]), index["hit_id"].to_numpy()
            asking, step = queries["query_id"].to_numpy(), max(1, cells // len(known))
            for start in range(0, len(asking), step):
                sims = _unit_rows(queries["vector"].iloc[start : start + step]) @ known.T
                who = asking[start : start + step]
                rows, cols, similar = _best_cells(sims, who, ids, k, exclude_self)
                out["query_id"].append(who[rows])
                out["hit_id"].append(ids[cols])
                out["similarity"].append(similar)
        joined = {name: np.concatenate(parts) if parts else np.array([]) for name, parts in out.items()}
        return pd.DataFrame(joined)

    return best


class _Held:
    """The k best hits so far of each query of an intent, best first; free places have similarity -inf."""

    def __init__(self, queries: pd.DataFrame, k: int, exclude_self: bool, cells: int = BLOCK_CELLS):
        self.vectors, self.who = queries["vector"], queries["query_id"].to_numpy()
        self.k, self.exclude_self, self.cells = k, exclude_self, cells
        self.similar, self.ids = np.full((len(queries), k), -np.inf), None

    def add(self, index: pd.DataFrame) -> None:
        """Compare the queries with a block of the index; only queries whose best cell may be among their k best look further."""
        known, ids = _unit_rows(index["vector"]), index["hit_id"].to_numpy()
        if self.ids is None:
            self.ids = np.full(self.similar.shape, ids[0], dtype=ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        step = max(1, self.cells // len(known))
        for start in range(0, len(self.who), step):
            sims = _unit_rows(self.vectors.iloc[start : start + step]) @ known.T
            # Below by more than the rounding; a row with a NaN is not skipped.
            floor, most = self.similar[start : start + step, -1] - 10.0**-DIGITS, sims.max(axis=1)
            near = np.flatnonzero(~(most < floor))
            if not len(near):
                continue
            at, floor = near + start, floor[near]
            plain = np.isfinite(floor).all() and not np.isnan(most).any()
            rows, cols, similar = _best_cells(sims[near], self.who[at], ids, self.k, self.exclude_self, floor if plain else None)
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            fresh, named = np.full((len(at), self.k), -np.inf), np.full((len(at), self.k), ids[0], dtype=ids.dtype)
            fresh[rows, place], named[rows, place] = similar, ids[cols]
            similar, named = np.hstack([self.similar[at], fresh]), np.hstack([self.ids[at], named])
            order = np.lexsort((named, -similar), axis=1)[:, : self.k]
            self.similar[at], self.ids[at] = np.take_along_axis(similar, order, 1), np.take_along_axis(named, order, 1)

    def frame(self) -> pd.DataFrame:
        rows, cols = np.nonzero(self.similar > -np.inf)
        return pd.DataFrame({"query_id": self.who[rows], "hit_id": self.ids[rows, cols], "similarity": self.similar[rows, cols]})


def _merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best hits of each query among those of several blocks."""
    joined = pd.concat(parts, ignore_index=True).sort_values(["query_id", "similarity", "hit_id"], ascending=[True, False, True], kind="stable")
    return joined[joined.groupby("query_id").cumcount() < k]


def _scan_top_k(shipped, k: int, exclude_self: bool):
    """The k best rows of an index partition for each of the broadcast queries of the same intent."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, _Held] = {}
        for frame in frames:
            for intent, part in frame.groupby("intent"):
                if intent in shipped.value:
                    if intent not in best:
                        best[intent] = _Held(shipped.value[intent], k, exclude_self)
                    best[intent].add(part)
        yield from (found for found in (held.frame() for held in best.values()) if len(found))

    return scan


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    hit_id: str = "hit_id",
    vector: str = "embedding",
    intent_of: str = "intent",
    exclude_self: bool = False,
    query_bytes: int = QUERY_BYTES,
    index_vector: str | None = None,
) -> DataFrame:
    """The k most similar index rows of the same intent for each query, exactly.

    Queries go out in waves of about ``query_bytes``, summed while they are written, which are broadcast one after the other. The index is
    scanned once a wave, with only the partitions of the intents asked for; a task keeps k hits per query, and only these are
    shuffled. Few queries find the index where it lies. For ``SPREAD_QUERIES`` or more its vectors are dealt evenly to all cores first,
    as its files may be few or uneven. The hits of each of several waves are written before the next one starts, so the driver holds one wave.
    ``index_vector`` names the index' vector column where it is another one.
    Output: query_id, hit_id, rank, similarity (4 digits, at least 0), distance.
    """
    stored = index_vector or vector
    id_type = queries.schema[query_id].dataType.simpleString()
    hit_type = index.schema[hit_id].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(
        F.col(intent_of).alias("intent"), F.col(query_id).alias("query_id"), as_doubles(F.col(vector)).alias("vector")
    )
    size = value_bytes(F.col("vector"), asked.schema["vector"].dataType) + 64
    asked, seen = write_stage(asked, "queries", bytes=F.coalesce(F.sum(size), F.lit(0)))
    schema = f"query_id {id_type}, hit_id {hit_type}, similarity double"
    waves = max(1, min(seen["rows"], math.ceil(seen["bytes"] / max(1, query_bytes))))
    known = index.where(F.col(stored).isNotNull()).select("intent", F.col(hit_id).alias("hit_id"), F.col(stored).alias("vector"))
    if seen["rows"] >= SPREAD_QUERIES:
        known = known.repartition(max(known.rdd.getNumPartitions(), known.sparkSession.sparkContext.defaultParallelism))
        if waves > 1:
            known, _ = write_stage(known, "index-vectors")

    def scan(wave: DataFrame) -> DataFrame:
        by_intent = dict(tuple(wave.where(F.col("intent").isNotNull()).toPandas().groupby("intent")))
        shipped = asked.sparkSession.sparkContext.broadcast(by_intent)
        scanned = known.where(F.col("intent").isin(*by_intent)) if by_intent else known.where(F.lit(False))
        return ranked_hits(scanned.mapInPandas(_scan_top_k(shipped, k, exclude_self), schema), k)

    if waves == 1:
        return scan(asked)
    number = F.pmod(F.xxhash64("query_id"), F.lit(waves))
    parts = [write_stage(scan(asked.where(number == wave)), "query-wave")[0] for wave in range(waves)]
    return functools.reduce(DataFrame.unionByName, parts)


def ranked_hits(near: DataFrame, k: int) -> DataFrame:
    """The k best of the hits that blocks returned, by similarity, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id")
    top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(
        "query_id",
        "hit_id",
        "rank",
        F.greatest(F.lit(0.0), half_even("similarity", 4)).alias("similarity"),
        half_even(1 - F.col("similarity"), 4).alias("distance"),
    )


def agreement(
    hits: DataFrame,
    query_id: str = "query_id",
    vector: str = "action_vector",
    outcome: str = "outcome",
    similar: float = SIMILAR,
    action_weight: float = 0.60,
    outcome_weight: float = 0.40,
    empty_score: float = 1.0,
) -> DataFrame:
    """How far a query's hits agree: actions like the first one's, and the most frequent outcome.

    Hits per query are at most k, so they fit one row. One hit, or none, agrees with itself.
    """
    item = F.struct("rank", as_doubles(F.col(vector)).alias("v"), F.coalesce(outcome, F.lit("")).alias("o"))
    grouped = hits.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("h"))
    k = F.size("h").cast("double")
    like_first = F.size(F.filter("h", lambda x: cosine(x["v"], F.col("h")[0]["v"]) >= similar))
    outcomes = F.transform("h", lambda x: x["o"])
    counts = F.transform(F.array_distinct(outcomes), lambda o: F.size(F.filter(outcomes, lambda x: x == o)))
    score = half_even(action_weight * (like_first / k) + outcome_weight * (F.array_max(counts) / k), 4)
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return grouped.select(
        query_id,
        F.size("h").alias("hits"),
        F.when(F.size("h") <= 1, F.lit(float(empty_score))).otherwise(clipped).alias("agreement"),
    )
