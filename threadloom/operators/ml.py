"""Embedding, clustering, cluster profiles, label propagation, taxonomy consolidation."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, StringIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.functions.values import half_even, percent
from threadloom.functions.vectors import as_doubles, distance, dot
from threadloom.operators.messages import first_per_group
from threadloom.session import small_side, spread, value_bytes, write_stage
from threadloom.sources import cache
from threadloom.sources.tables import fill_missing

Encoder = Callable[[list[str]], np.ndarray]


def embedding_model(df: DataFrame, text: str = "text", features: int = 256) -> PipelineModel:
    """Hashed term frequencies, weighted by inverse document frequency, scaled to length 1."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ]
    ).fit(df)


def embed(df: DataFrame, model: PipelineModel, out: str = "embedding") -> DataFrame:
    embedded = model.transform(df).withColumn(out, vector_to_array("_unit", "float32"))
    return embedded.drop("_words", "_tf", "_tfidf", "_unit")


def encode(df: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Embed with a user function from texts to a matrix, in batches; rows are scaled to length 1."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size].copy()
                matrix = np.asarray(encoder(part[text].tolist()), dtype=np.float32)
                size = np.linalg.norm(matrix, axis=1, keepdims=True)
                part[out] = list(np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0))
                yield part

    return df.mapInPandas(run, schema)


def embed_or_load(df: DataFrame, path: str, key: str, embedder: Callable[[DataFrame], DataFrame], out: str = "embedding") -> DataFrame:
    """Embeddings kept in a table by id; only rows that the table lacks are embedded."""
    key_type = df.schema[key].dataType.simpleString()
    return fill_missing(df, path, key, lambda rows: embedder(rows).select(key, out), f"{key} {key_type}, {out} array<float>")


def embed_cached(
    df: DataFrame, path: str, embedder: Callable[[DataFrame], DataFrame], version: str, text: str = "text", out: str = "embedding"
) -> DataFrame:
    """``df`` with embeddings from a cache by text and model ``version``: a changed text is embedded again, equal texts once."""
    return cache.fill(df, path, [text], embedder, f"`{out}` array<float>", version)


@dataclass(frozen=True)
class Clustering:
    """Centres of one k-means model, its cost, and per cluster rows, sums of squared norms and of vectors."""

    centers: np.ndarray
    cost: float
    rows: np.ndarray
    squares: np.ndarray
    sums: np.ndarray


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _arrow_matrix(vectors: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without a Python object a row."""
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) != 1 or sizes.null_count:
        raise ValueError("vectors must not be null and must have the same length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    squares = (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :] - 2.0 * (x @ centers.T)
    return np.maximum(squares, 0.0)


def _spread_starts(pool: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k vectors of the pool, each drawn with a chance in proportion to its weight times its squared distance to those drawn before."""
    rng = np.random.default_rng(seed)
    chosen = [pool[rng.choice(len(pool), p=weights / weights.sum())]]
    nearest = _gaps(pool, chosen[0][None, :])[:, 0]
    while len(chosen) < k:
        chances = weights * nearest
        pick = rng.choice(len(pool), p=chances / chances.sum()) if chances.sum() > 0 else rng.integers(len(pool))
        chosen.append(pool[pick])
        nearest = np.minimum(nearest, _gaps(pool, pool[pick][None, :])[:, 0])
        # Rounding leaves a trace of a distance between equal vectors.
        nearest[(pool == pool[pick]).all(axis=1)] = 0.0
    return np.stack(chosen)


def _pool(rows: DataFrame, size: int, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``size`` distinct vectors, spread over all rows, and how many rows are nearest to each of them.

    Every pass over the rows adds the vectors that a draw without replacement, in proportion to the squared distance to the pool so
    far, would take: those of the smallest -ln(u) / distance, where u comes from the vector's hash. Copies have the same u, so they
    are one candidate; their number is in the weights, which a last pass counts. A task sends as many rows as a pass may add.
    """
    first = rows.select("vector").orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(1).toPandas()
    if first.empty:
        raise ValueError("there is no vector to cluster")
    pool = _matrix(first["vector"])
    each = max(1, math.ceil(size / passes))
    for number in range(passes):
        shipped = rows.sparkSession.sparkContext.broadcast(pool)
        draw = F.pmod(F.xxhash64(F.lit(seed + 1 + number), "vector"), F.lit(1 << 52))

        def smallest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = pd.DataFrame({"at": [], "vector": []})
            for frame in frames:
                x = _matrix(frame["vector"])
                gaps = _gaps(x, shipped.value).min(axis=1)
                far = gaps > 1e-12 * np.maximum(1.0, (x * x).sum(axis=1))
                at = -np.log((frame["draw"].to_numpy()[far] + 0.5) / (1 << 52)) / gaps[far]
                found = pd.DataFrame({"at": at, "draw": frame["draw"][far], "vector": frame["vector"][far]}).drop_duplicates("draw")
                held = pd.concat([held, found]) if len(held) else found
                held = held.drop_duplicates("draw").nsmallest(each, "at")
            if len(held):
                yield held[["at", "vector"]]

        drawn = rows.select("vector", draw.alias("draw")).mapInPandas(smallest, "at double, vector array<double>")
        added = drawn.groupBy("vector").agg(F.min("at").alias("at")).orderBy("at", "vector").limit(each).toPandas()
        if added.empty:
            break
        pool = np.concatenate([pool, _matrix(added["vector"])])
    shipped = rows.sparkSession.sparkContext.broadcast(pool)

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(shipped.value), dtype=np.int64)
        for frame in frames:
            counts += np.bincount(_gaps(_matrix(frame["vector"]), shipped.value).argmin(axis=1), minlength=len(counts))
        yield pd.DataFrame({"place": range(len(counts)), "n": counts})

    counted = rows.mapInPandas(members, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    return pool, counted.sort_values("place")["n"].to_numpy(dtype=float)


# Rows that are compared with all centres at a time.
LLOYD_ROWS = 1024


def _lloyd_round(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, Clustering]:
    """One pass over the rows for all models at once: assign, and sum per cluster."""
    names, sizes = list(models), [len(centers) for centers in models.values()]
    ends = np.cumsum(sizes)
    stacked = np.concatenate(list(models.values()))
    # Scores are squared distances less the row's squared norm: one product with all centres, whose last column meets a column of ones.
    shipped = rows.sparkSession.sparkContext.broadcast(np.hstack([-2.0 * stacked, (stacked * stacked).sum(axis=1)[:, None]]).T)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held = int(ends[-1]), None
        for batch in _slices(batches, LLOYD_ROWS):
            x = _arrow_matrix(batch.column(0))
            norms = (x * x).sum(axis=1)
            scores = np.hstack([x, np.ones((len(x), 1))]) @ shipped.value
            at = np.arange(len(x))
            sums = np.zeros((3, width))
            member = np.zeros((len(x), width))
            for start, end in zip(ends - sizes, ends):
                own = start + scores[:, start:end].argmin(axis=1)
                cost = np.maximum(scores[at, own] + norms, 0.0)
                member[at, own] = 1.0
                for place, weight in enumerate((None, cost, norms)):
                    sums[place] += np.bincount(own, weights=weight, minlength=width)
            total = member.T @ x
            held = (sums, total) if held is None else (held[0] + sums, held[1] + total)
        if held is not None:
            whole = np.hstack([held[0].T, held[1]])
            parts = [whole[start:end].tobytes() for start, end in zip(ends - sizes, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=["model", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(part) for part in group.column("sums").to_pylist())
        return pa.table({"model": group.column("model").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    # A task sends a few sums per cluster, a row for each model; what comes to the driver is one row per model.
    schema = "model int, sums binary"
    found = rows.mapInArrow(partial, schema).groupBy("model").applyInArrow(merge, schema).collect()
    result = {}
    for row in found:
        centers = models[row["model"]]
        n, cost, squares, *total = np.frombuffer(row["sums"]).reshape(len(centers), -1).T
        total = np.stack(total, axis=1)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
        result[row["model"]] = Clustering(moved, float(cost.sum()), n, squares, total)
    return result


def _lloyd(rows: DataFrame, starts: dict[int, np.ndarray], rounds: int, tolerance: float) -> dict[int, Clustering]:
    """Run all models until their centres rest; the returned sums belong to the last assignment."""
    done: dict[int, Clustering] = {}
    moving = dict(starts)
    for _ in range(rounds):
        if not moving:
            break
        after = _lloyd_round(rows, moving)
        for name, model in after.items():
            shift = np.square(model.centers - moving[name]).sum()
            if shift <= tolerance:
                done[name] = Clustering(moving[name], model.cost, model.rows, model.squares, model.sums)
                del moving[name]
            else:
                moving[name] = model.centers
    if moving:
        done |= {n: Clustering(moving[n], m.cost, m.rows, m.squares, m.sums) for n, m in _lloyd_round(rows, moving).items()}
    return done


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """The vectors as they are, over all cores; every round reads them."""
    return spread(df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("vector")))


def _doubles(rows: DataFrame) -> DataFrame:
    return rows.select(as_doubles(F.col("vector")).alias("vector"))


def _fit_all(
    rows: DataFrame, ks: Sequence[int], seed: int, restarts: int, rounds: int, passes: int, tolerance: float = 1e-8
) -> dict[int, Clustering]:
    """The model of lowest cost among ``restarts`` starts, for each k. ``rows`` is a stage table."""
    pool, weights = _pool(_doubles(rows), 16 * max(ks), passes, seed)
    starts = {k * restarts + i: _spread_starts(pool, weights, k, seed + i) for k in ks for i in range(restarts)}
    models = _lloyd(rows, starts, rounds, tolerance)
    return {k: min((models[k * restarts + i] for i in range(restarts)), key=lambda m: m.cost) for k in ks}


def kmeans_fit(
    df: DataFrame, k: int, vector: str = "embedding", seed: int = 42, restarts: int = 10, rounds: int = 300, passes: int = 4
) -> Clustering:
    """The model with the lowest cost among ``restarts`` starts, drawn from a pool that ``passes`` over all rows gather."""
    rows, _ = write_stage(_vectors(df, vector), "kmeans-rows")
    return _fit_all(rows, [k], seed, restarts, rounds, passes)[k]


def kmeans_assign(df: DataFrame, model: Clustering, vector: str = "embedding", out: str = "cluster") -> DataFrame:
    """Add the nearest centre's number, in Arrow batches; a row without a vector has none."""
    shipped = df.sparkSession.sparkContext.broadcast(model.centers)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        there = vectors.notna()
        found = pd.Series(pd.NA, index=vectors.index, dtype="Int32")
        if there.any():
            found[there] = _gaps(_matrix(vectors[there]), shipped.value).argmin(axis=1)
        return found

    return df.withColumn(out, nearest(as_doubles(F.col(vector))))


def _mean_silhouette(rows: DataFrame, models: dict[int, Clustering]) -> dict[int, float]:
    """Mean squared-Euclidean silhouette of each model, by one pass over the rows.

    The mean squared distance of x to a cluster of n rows with sum S and sum of squared norms Q is
    |x|^2 - 2 x.S / n + Q / n, so no pair of rows is looked at.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(models)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[float]] = {}
        for frame in frames:
            x = _matrix(frame["vector"])
            norms = (x * x).sum(axis=1)[:, None]
            for name, m in shipped.value.items():
                own = _gaps(x, m.centers).argmin(axis=1)
                n = np.maximum(m.rows, 1)[None, :]
                means = np.maximum(norms - 2 * (x @ m.sums.T) / n + m.squares[None, :] / n, 0.0)
                means[:, m.rows == 0] = np.inf
                at, size = np.arange(len(x)), m.rows[own]
                inside = means[at, own] * size / np.maximum(size - 1, 1)
                means[at, own] = np.inf
                other = means.min(axis=1)
                wider = np.maximum(inside, other)
                value = np.where((size > 1) & np.isfinite(other) & (wider > 0), (other - inside) / np.where(wider > 0, wider, 1), 0.0)
                held = sums.setdefault(name, [0.0, 0.0])
                held[0] += float(value.sum())
                held[1] += len(x)
        yield from (pd.DataFrame({"model": [name], "total": [t], "n": [n]}) for name, (t, n) in sums.items())

    found = rows.mapInPandas(partial, "model int, total double, n double").groupBy("model").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    return {r["model"]: r["t"] / r["n"] for r in found.collect()}


def kmeans_sweep(
    df: DataFrame,
    k_min: int = 5,
    k_max: int = 15,
    vector: str = "embedding",
    seed: int = 42,
    restarts: int = 10,
    exact_by: str | None = None,
    rounds: int = 300,
    passes: int = 4,
) -> tuple[dict[int, float], int, dict[int, Clustering]]:
    """Silhouette for each k, the first k with the highest one, and the models.

    All k and all starts advance together: a round is one pass over the rows. The score is the linear-time one (squared
    Euclidean). With ``exact_by``, the id column, it is the plain Euclidean one, which takes all distances and is meant
    for a sample.
    """
    rows, _ = write_stage(_vectors(df, vector), "kmeans-rows")
    models = _fit_all(rows, range(k_min, k_max + 1), seed, restarts, rounds, passes)
    if exact_by:
        scores = {k: silhouette(kmeans_assign(df, m, vector), exact_by, "cluster", vector).first()["silhouette"] for k, m in models.items()}
    else:
        scores = {k: round(v, 4) for k, v in sorted(_mean_silhouette(_doubles(rows), models).items())}
    best = max(scores, key=lambda k: (scores[k], -k))
    return scores, best, models


# Bytes of the rows that are broadcast together for their distances to all rows.
WAVE_BYTES = 32 << 20


def _distance_sums(shipped, step: int = 256, width: int = 4096):
    """Per row of the table: sum of distances to the broadcast rows of each cluster."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, clusters, b = shipped.value
        known = pd.Series(ids).dropna()
        at = known.sort_values(kind="stable").index.to_numpy()
        lookup = ids[at]
        counts = np.bincount(place, minlength=len(clusters))
        for batch in _slices(batches, step):
            a = _arrow_matrix(batch.column(2))
            norms = (a * a).sum(axis=1)[:, None]
            own = batch.column(0).to_pandas()
            there = np.flatnonzero(own.notna())
            first, last = (np.searchsorted(lookup, own.to_numpy()[there], side=side) for side in ("left", "right"))
            # Pairs of a row with itself, or with one of the same id.
            row = np.repeat(there, last - first)
            column = at[np.arange(len(row)) - np.repeat(np.cumsum(last - first) - last, last - first)]
            totals = np.zeros((len(a), len(clusters)))
            for start in range(0, len(b), width):
                some = b[start : start + width]
                gaps = a @ (-2.0 * some.T)
                gaps += norms
                gaps += (some * some).sum(axis=1)[None, :]
                np.sqrt(np.maximum(gaps, 0.0, out=gaps), out=gaps)
                here = (column >= start) & (column < start + width)
                gaps[row[here], column[here] - start] = 0.0
                member = np.zeros((len(some), len(clusters)))
                member[np.arange(len(some)), place[start : start + width]] = 1.0
                totals += gaps @ member
            each = pa.array(np.repeat(np.arange(len(a)), len(clusters)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), batch.column(1).take(each), pa.array(clusters * len(a), pa.int64()),
                 pa.array(totals.ravel()), pa.array(np.tile(counts, len(a)), pa.int64())],
                names=["row_id", "own", "other", "total", "members"],
            )

    return sums


def silhouette_rows(df: DataFrame, id_col: str, label: str, vector: str, block_rows: int = 1 << 16) -> DataFrame:
    """Exact Euclidean silhouette of every row.

    All distances are needed, but none is emitted. The rows go out in waves of about ``block_rows``, and of no more than ``WAVE_BYTES``, which are broadcast one
    after the other; the table is scanned where it lies, once a wave, and of a row only the sums to the wave's clusters are written.
    """
    rows = df.select(F.col(id_col).alias("row_id"), F.col(label).cast("bigint").alias("own"), as_doubles(F.col(vector)).alias("vector"))
    size = value_bytes(F.col("vector"), rows.schema["vector"].dataType) + 64
    rows, seen = write_stage(spread(rows), "silhouette-points", bytes=F.coalesce(F.sum(size), F.lit(0)))
    waves = max(1, min(seen["rows"], max(math.ceil(seen["rows"] / block_rows), math.ceil(seen["bytes"] / WAVE_BYTES))))
    number = F.pmod(F.xxhash64("row_id", "vector"), F.lit(waves))
    schema = f"row_id {df.schema[id_col].dataType.simpleString()}, own bigint, other bigint, total double, members bigint"

    def scan(wave: int) -> DataFrame:
        held = rows.where(number == wave).toArrow().combine_chunks()
        if not held.num_rows:
            return df.sparkSession.createDataFrame([], schema)
        labels = pc.dictionary_encode(held.column("own").combine_chunks(), null_encoding="encode")
        vectors = held.column("vector").combine_chunks()
        part = (held.column("row_id").to_pandas().to_numpy(), labels.indices.to_numpy(), labels.dictionary.to_pylist(), _arrow_matrix(vectors))
        shipped = df.sparkSession.sparkContext.broadcast(part)
        return write_stage(rows.mapInArrow(_distance_sums(shipped), schema), "silhouette-wave")[0]

    sums = functools.reduce(DataFrame.unionByName, [scan(wave) for wave in range(waves)])
    per_cluster = sums.groupBy("row_id", "own", "other").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    inside = F.col("own") == F.col("other")
    means = per_cluster.groupBy("row_id", "own").agg(
        F.max(F.when(inside, F.col("members"))).alias("members"),
        F.max(F.when(inside & (F.col("members") > 1), F.col("total") / (F.col("members") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("members"))).alias("b"),
    )
    width = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (width == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / width)
    return means.select("row_id", F.col("own").alias("cluster"), value.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, label: str, vector: str) -> DataFrame:
    """Mean Euclidean silhouette. The work is quadratic in the rows, so it is meant for a drawn sample; see ``cluster_silhouette``."""
    return silhouette_rows(df, id_col, label, vector).agg(half_even(F.avg("silhouette"), 4).alias("silhouette"))


def cluster_silhouette(df: DataFrame, label: str, vector: str, by: str | None = None) -> DataFrame:
    """Mean squared-Euclidean silhouette of a given clustering: two passes, whatever the size of the table.

    With ``by``, a column of few values such as k, there is one row for each clustering that it tells apart.
    """
    keys = [by] if by else []
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    rows, _ = write_stage(rows.select(*keys, F.col(label).alias("own"), as_doubles(F.col(vector)).alias("vector")), "silhouette-rows")
    square = dot(F.col("vector"), F.col("vector"))
    sums = rows.groupBy(*keys, "own").agg(
        F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"), vector_to_array(Summarizer.sum(array_to_vector("vector"))).alias("s")
    )
    # Every row is compared with the sums of all clusters: a scalar subquery, or a lookup of one row per clustering.
    sums, _ = write_stage(sums, "silhouette-sums")
    listed = F.collect_list(F.struct("own", "n", "q", "s")).alias("clusters")
    met = rows.join(small_side(sums.groupBy(by).agg(listed), "silhouette-clusters"), by) if by else rows.withColumn("clusters", sums.agg(listed).scalar())
    mean = lambda c: F.greatest(F.lit(0.0), square - 2 * dot(F.col("vector"), c["s"]) / c["n"] + c["q"] / c["n"])
    mine = F.filter("clusters", lambda c: c["own"] == F.col("own"))[0]
    others = F.filter("clusters", lambda c: c["own"] != F.col("own"))
    valued = met.select(
        *keys,
        mine["n"].alias("n"),
        (mean(mine) * mine["n"] / F.greatest(mine["n"] - 1, F.lit(1))).alias("a"),
        F.array_min(F.transform(others, mean)).alias("b"),
    )
    width = F.greatest("a", "b")
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (width > 0), (F.col("b") - F.col("a")) / width).otherwise(F.lit(0.0))
    return valued.groupBy(*keys).agg(half_even(F.avg(value), 4).alias("silhouette"))


def cluster_centers(df: DataFrame, cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """Mean vector per cluster; sums combine on the map side."""
    center = Summarizer.mean(array_to_vector(as_doubles(F.col(vector))))
    return df.groupBy(cluster).agg(vector_to_array(center).alias("center"))


def cluster_exemplars(
    df: DataFrame, centers: DataFrame, id_col: str, n: int = 15, cluster: str = "cluster", vector: str = "embedding"
) -> DataFrame:
    """The n rows nearest to their cluster's center, ranked; map tasks pass on n rows per cluster."""
    near = df.join(small_side(centers, "centers"), cluster).withColumn(
        "distance", half_even(distance(as_doubles(F.col(vector)), F.col("center")), 9)
    )
    return first_per_group(near.drop("center"), [cluster], ["distance", id_col], n)


def cluster_profile(df: DataFrame, exemplars: DataFrame, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """Size, share and exemplar texts of each cluster."""
    sizes, seen = write_stage(df.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size")), "cluster-sizes", total=F.sum("cluster_size"))
    total = F.lit(seen["total"])
    listed = exemplars.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text")))).alias("exemplars"))
    return sizes.withColumn("pct_of_sample", percent(F.col("cluster_size"), total)).join(listed, cluster, "left")


def _with_terms(df: DataFrame, text: str) -> DataFrame:
    """Add ``_terms``: the words of at least two characters, lower-cased, and the pairs of neighbouring words."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    return pairs.transform(words.transform(df)).withColumn("_terms", F.concat("_words", "_pairs"))


# Hash buckets whose counts bound those of their terms.
TERM_BUCKETS = 1 << 20


def label_vocabulary(df: DataFrame, text: str = "text", size: int = 10_000) -> DataFrame:
    """(place, term, n, texts, weight): the ``size`` most frequent terms, by (n descending, term), exactly.

    Counts per hash bucket bound those of the terms in it. The terms of the fullest buckets are counted first; the count of the ``size``-th of
    them is reached by all terms looked for, so of the other buckets only those that reach it are counted. A histogram of the terms' counts
    gives the count from which all terms are in; of the terms of the next count, the first ones by their letters fill up the rest.
    ``weight`` is 1 + ln((rows + 1) / (texts + 1)). Neither depends on how the rows are partitioned.
    """
    terms = _with_terms(df.where(F.col(text).isNotNull()).select(text), text)
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")
    every = terms.select(F.explode("_terms").alias("term")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    bounds, _ = write_stage(every, "term-bounds")
    # A term's occurrences, and the texts that hold it: each text adds its different terms once more.
    each = lambda column, n: F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(1 - n).alias("texts")))
    both = F.concat(each("_terms", 1), each(F.array_distinct("_terms"), 0))

    def count(buckets: DataFrame, label: str) -> DataFrame:
        rows = terms.select(F.explode(both).alias("t")).select("t.*").withColumn("bucket", bucket)
        held = rows.join(small_side(buckets.select("bucket"), f"{label}-buckets"), "bucket", "left_semi")
        return write_stage(held.groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), label)[0]

    fullest = bounds.orderBy(F.desc("n"), "bucket").limit(size)
    first = count(fullest, "term-counts")
    reached = first.orderBy(F.desc("n")).select("n").limit(size).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("terms")).first()
    least = reached["n"] if reached["terms"] == size else 0
    others, seen = write_stage(bounds.where(F.col("n") >= least).join(fullest.select("bucket"), "bucket", "left_anti"), "term-others")
    counted = first.unionByName(count(others, "more-term-counts")) if seen["rows"] else first
    counted = counted.where(F.col("n") >= least)
    # As many rows as there are different counts, at most the square root of twice the number of words.
    levels = sorted(((r["n"], r["terms"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).collect()), reverse=True)
    taken, cut = 0, 0
    for n, terms in levels:
        if taken + terms > size:
            cut = n
            break
        taken += terms
    chosen = counted.where(F.col("n") > cut).unionByName(counted.where(F.col("n") == cut).orderBy("term").limit(size - taken))
    # At most ``size`` rows from here.
    order = Window.orderBy(F.desc("n"), "term")
    rows = F.lit(df.count() + 1)
    return chosen.select(
        (F.row_number().over(order) - 1).alias("place"), "term", "n", "texts", (1 + F.log(rows / (F.col("texts") + 1))).alias("weight")
    )


def propagate_labels(
    sample: DataFrame, full: DataFrame, label: str, text: str = "text", out: str = "predicted_label",
    vocabulary: int = 10_000, rounds: int = 500, strength: float = 1.0,
) -> DataFrame:
    """Learn labels on a sample and assign them to the whole corpus.

    Words and word pairs of ``label_vocabulary``, 1 + ln(tf), times the term's weight, unit length, and a multinomial
    logistic regression with an L2 penalty of 1 / (strength * n). The model is small: ``vocabulary`` terms by labels.
    It travels to the tasks that read the corpus, which multiply Arrow batches of sparse counts. The sample is put in an order of its
    own before learning, so that the labels do not depend on how it was partitioned.
    """
    # The sample is read by each of the fits below.
    sample, seen = write_stage(sample.select(label, text), "labelled-sample")
    indexer = StringIndexer(inputCol=label, outputCol="_target", stringOrderType="alphabetAsc").fit(sample)
    chosen = label_vocabulary(sample, text, vocabulary).orderBy("place").collect()
    # Spark ML wants at least one term.
    terms = [r["term"] for r in chosen] or [""]
    scale = np.array([r["weight"] for r in chosen] or [0.0])
    counter = CountVectorizerModel.from_vocabulary(terms, "_terms", "_counts")

    # Each of the many rounds is a job over the sample, so it is kept in few partitions.
    parts = 1 + seen["rows"] // 20_000
    train = counter.transform(_with_terms(indexer.transform(sample), text)).withColumn("_log", _log_counts("_counts"))
    ordered = train.repartition(parts, F.xxhash64(text)).sortWithinPartitions(F.xxhash64(text), text, label)
    train = ordered.select("_target", "_log").persist()
    try:
        weight = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="_log", outputCol="_tfidf")
        unit = Normalizer(inputCol="_tfidf", outputCol="_unit")
        model = LogisticRegression(
            featuresCol="_unit", labelCol="_target", predictionCol="_predicted", maxIter=rounds,
            regParam=1.0 / (strength * max(1, seen["rows"])), standardization=False, family="multinomial",
        ).fit(unit.transform(weight.transform(train)))
    finally:
        train.unpersist()
    shipped = full.sparkSession.sparkContext.broadcast((model.coefficientMatrix.toArray().T, model.interceptVector.toArray(), scale))
    counted = counter.transform(_with_terms(full, text)).withColumn("_sparse", F.unwrap_udt("_counts"))
    place = _predicted(shipped)(F.col("_sparse.indices"), F.col("_sparse.values"))
    names = F.array(*[F.lit(name) for name in indexer.labels])
    return counted.withColumn("_place", place).select(*[c for c in full.columns if c != out], F.element_at(names, F.col("_place") + 1).alias(out))


def _predicted(shipped):
    """Label numbers for batches of sparse term counts (indices, values)."""

    @F.pandas_udf("int")
    def predict(indices: pd.Series, counts: pd.Series) -> pd.Series:
        weights, intercept, scale = shipped.value
        sizes = indices.map(len).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.concatenate(indices.to_list()).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        value = (1.0 + np.log(np.concatenate(counts.to_list()))) * scale[at] if len(row) else np.zeros(0)
        length = np.sqrt(np.bincount(row, weights=value * value, minlength=len(sizes)))
        value = value / np.where(length > 0, length, 1.0)[row]
        scores = np.stack([np.bincount(row, weights=value * weights[at, k], minlength=len(sizes)) for k in range(weights.shape[1])], axis=1)
        return pd.Series((scores + intercept).argmax(axis=1), dtype="int32")

    return predict


@F.udf(VectorUDT())
def _log_counts(counts):
    """1 + ln(tf) of the labelled sample's sparse vectors, which Spark ML needs as vectors."""
    return SparseVector(counts.size, counts.indices, 1.0 + np.log(counts.values))


def consolidate_taxonomy(
    exemplars: DataFrame,
    specs: Sequence[tuple[str, str, bool, str]] = presets.INTENTS,
    order: str = "place",
    n: int = 5,
    enough: int = 3,
) -> DataFrame:
    """Up to n distinct example texts per intent, by pattern, in exemplar order.

    Cleaned text is searched first; if that gives fewer than ``enough``, raw text supplies more. A
    text found in both passes counts once. One exemplar may serve several intents.
    Needs columns ``place``, ``post_id``, ``text`` and ``cleaned_text``.
    """
    clean = F.when(F.length("cleaned_text") > 0, F.col("cleaned_text")).otherwise(F.coalesce("text", F.lit("")))
    raw = F.coalesce("text", F.lit(""))
    found = []
    for name, _, _, pattern in specs:
        java = tx.unicode_pattern(pattern)
        for step, body in ((1, clean), (2, raw)):
            found.append(
                F.when(body.rlike(java), F.struct(F.lit(name).alias("intent"), F.lit(step).alias("step"), body.alias("seen")))
            )
    matched = exemplars.select(
        F.col(order).alias("place"), "post_id", "text", F.explode(F.array_compact(F.array(*found))).alias("m")
    ).select("place", "post_id", "text", "m.intent", "m.step", "m.seen")
    # The first occurrence of a text per pass, then the first n of each pass.
    once = matched.groupBy("intent", "step", "seen").agg(F.min_by(F.struct("place", "post_id", "text"), "place").alias("e"))
    ranked = first_per_group(once, ["intent", "step"], ["e.place"], 2 * n, "rank")
    by_clean = ranked.where((F.col("step") == 1) & (F.col("rank") <= n))
    # From here at most 2n rows per intent and pass.
    short = by_clean.groupBy("intent").agg(F.count(F.lit(1)).alias("have"))
    fill = (
        ranked.where(F.col("step") == 2)
        .join(by_clean.select("intent", "seen"), ["intent", "seen"], "left_anti")
        .join(short, "intent", "left")
        .where(F.coalesce("have", F.lit(0)) < enough)
    )
    both = by_clean.select("intent", "step", "rank", "e").unionByName(fill.select("intent", "step", "rank", "e"))
    kept = first_per_group(both, ["intent"], ["step", "rank"], n, "example_no")
    return kept.select("intent", "example_no", F.col("e.post_id").alias("post_id"), F.col("e.text").alias("text"))
