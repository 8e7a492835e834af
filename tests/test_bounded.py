"""The group-wise helpers against brute force, with one group holding most rows."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.operators import bounded, cells, ml, prune, retrieve, sampling, score


def skewed(n=900):
    rng = random.Random(3)
    return [(i, "hot" if i % 3 else f"g{i % 17}", rng.randint(0, 40)) for i in range(n)]


@pytest.mark.parametrize("max_group", [10, 200, 10_000])
@pytest.mark.parametrize("partitions", [1, 7])
def test_positions(spark, max_group, partitions):
    data = skewed()
    df = spark.createDataFrame(data, "id bigint, g string, t bigint").repartition(partitions)
    got = {r["id"]: r["position"] for r in bounded.number_rows(df, ["g"], [F.col("t"), F.col("id")], max_group=max_group).collect()}
    want = {}
    for g in {x[1] for x in data}:
        for place, (_, i) in enumerate(sorted((t, i) for i, gg, t in data if gg == g)):
            want[i] = place
    assert got == want


@pytest.mark.parametrize("limit", [10, 3000, 10**9])
def test_sums_before(spark, limit):
    data = skewed()
    df = spark.createDataFrame(data, "id bigint, g string, t bigint").repartition(3)
    rows = bounded.number_rows(df, ["g"], [F.col("t"), F.col("id")], weight="t", max_weight=limit).collect()
    got = {r["id"]: (r["position"], r["before"]) for r in rows}
    want = {}
    for g in {x[1] for x in data}:
        total = 0
        for place, (t, i) in enumerate(sorted((t, i) for i, gg, t in data if gg == g)):
            want[i] = place, total
            total += t
    assert got == want


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("quota", [0, 1, 7, 250, 5000])
def test_hash_draw(spark, quota):
    data = skewed()
    df = spark.createDataFrame(data, "id bigint, g string, t bigint")
    got = {r["id"] for r in bounded.take_by_hash(df, ["g"], "id", 9, quota).collect()}
    want = set()
    for g in {x[1] for x in data}:
        want |= set(by_hash([i for i, gg, _ in data if gg == g], 9)[:quota])
    assert got == want


def test_hash_draw_over_all_and_by_table(spark):
    data = skewed()
    df = spark.createDataFrame(data, "id bigint, g string, t bigint")
    got = {r["id"] for r in bounded.take_by_hash(df, [], "id", 4, 123).collect()}
    assert got == set(by_hash([x[0] for x in data], 4)[:123])
    quotas = spark.createDataFrame([("hot", 11), ("g0", 0), ("nobody", 5)], "g string, n bigint")
    drawn = bounded.take_by_hash(df, ["g"], "id", 4, quotas).collect()
    assert {r["id"] for r in drawn} == set(by_hash([i for i, g, _ in data if g == "hot"], 4)[:11])


def test_rows_without_a_group_are_not_drawn_but_kept(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 2}") for i in range(100)], "id bigint, g string")
    assert bounded.take_by_hash(df, ["g"], "id", 1, 1000).count() == 80
    held, rest = sampling.holdout_split(df, ["g"], 20, "id")
    assert (held.count(), rest.count()) == (20, 80) and held.where("g IS NULL").count() == 0
    assert sampling.stratified_sample(df, ["g"], 30, "id").count() == 30


def test_hash_draw_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, g string")
    assert bounded.take_by_hash(df, ["g"], "id", 1, 5).count() == 0


def vectors(n=240, d=6):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(n, d))
    data[10] = data[11] = data[12]
    data[20] = 0.0
    labels = ["hot" if i % 3 else f"k{i % 5}" for i in range(n)]
    return data, labels


@pytest.mark.parametrize("query_bytes", [9_000, retrieve.QUERY_BYTES])
def test_nearest_neighbours(spark, query_bytes):
    data, labels = vectors()
    df = spark.createDataFrame(
        [(i, labels[i], data[i].tolist()) for i in range(len(data))], "hit_id int, intent string, embedding array<double>"
    )
    hits = retrieve.retrieve(df.withColumnRenamed("hit_id", "query_id"), df, 4, exclude_self=True, query_bytes=query_bytes)
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["hit_id"]))
    size = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, size, out=np.zeros_like(data), where=size > 0)
    sims = np.round(unit @ unit.T, 9)
    for q in range(len(data)):
        ranked = sorted((-sims[q, j], j) for j in range(len(data)) if j != q and labels[j] == labels[q])[:4]
        assert sorted(got.get(q, [])) == [(i + 1, j) for i, (_, j) in enumerate(ranked)], q


@pytest.mark.parametrize("groups", [2, 9])
def test_pruned_neighbours_are_the_same(spark, groups):
    rng = np.random.default_rng(4)
    data, labels = vectors()
    data = data * 0.3 + rng.integers(-3, 4, size=(6, 6))[rng.integers(0, 6, len(data))]
    data[10] = data[11] = data[12]
    data[20] = data[21] = 0.0
    df = spark.createDataFrame(
        [(i, labels[i], data[i].tolist()) for i in range(len(data))], "hit_id int, intent string, embedding array<double>"
    )
    asked = df.withColumnRenamed("hit_id", "query_id")
    got = prune.retrieve_pruned(asked, prune.group_index(df, groups), 4, exclude_self=True, query_rows=20, index_rows=30)
    want = retrieve.retrieve(asked, df, 4, exclude_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_retrieval_edges(spark):
    one = "hit_id int, intent string, embedding array<double>"
    index = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [-1.0, 0.0]), (3, "b", [1.0, 0.0])], one)
    queries = spark.createDataFrame([(7, "a", [1.0, 0.0]), (8, "zzz", [1.0, 0.0]), (9, "a", None)], one).withColumnRenamed("hit_id", "query_id")
    hits = sorted(tuple(r) for r in retrieve.retrieve(queries, index, 5).collect())
    assert hits == [(7, 1, 1, 1.0, 0.0), (7, 2, 2, 0.0, 2.0)]


@pytest.mark.parametrize("rows", [13, 1000])
def test_silhouette(spark, rows):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(c, 1.0, size=(30, 4)) for c in (5, -5, 0)])
    label = np.array([0] * 30 + [1] * 30 + [2] * 29 + [3])
    df = spark.createDataFrame([(i, int(label[i]), data[i].tolist()) for i in range(90)], "id int, label int, v array<double>")
    got = {r["row_id"]: r["silhouette"] for r in ml.silhouette_rows(df, "id", "label", "v", rows).collect()}
    gaps = np.linalg.norm(data[:, None] - data[None], axis=2)
    for i in range(90):
        own = label == label[i]
        if own.sum() == 1:
            assert got[i] == 0.0
            continue
        a = gaps[i, own].sum() / (own.sum() - 1)
        b = min(gaps[i, label == c].mean() for c in range(4) if c != label[i])
        assert math.isclose(got[i], (b - a) / max(a, b), abs_tol=1e-6)


def test_exact_sweep_finds_three_blobs(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(c, 1.0, size=(17, 4)) for c in (5, -5, 0)])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "id int, embedding array<double>")
    scores, best, _ = ml.kmeans_sweep(df, 2, 4, restarts=3, exact_by="id")
    again, _, _ = ml.kmeans_sweep(df, 2, 4, restarts=3, exact_by="id")
    assert best == 3 and scores == again and all(-1 <= s <= 1 for s in scores.values())


def test_the_index_is_not_shuffled_for_few_queries(spark, tmp_path):
    """A plan for few queries scans only the intents asked for, without an exchange on the index' side."""
    rows = [(i, f"intent{i % 3}", [float(i % 7), 1.0]) for i in range(90)]
    spark.createDataFrame(rows, "hit_id int, intent string, embedding array<double>").write.partitionBy("intent").parquet(str(tmp_path / "index"))
    index = retrieve.read_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "intent1", [1.0, 1.0])], "query_id int, intent string, embedding array<double>")
    found = retrieve.retrieve(queries, index, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas"):]
    assert "Exchange" not in below and "PartitionFilters" in below and "intent1" in below
    waves = retrieve.retrieve(queries, index, 3, query_bytes=0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, waves.collect()))


def test_the_index_is_not_shuffled_for_many_queries(spark, tmp_path, monkeypatch):
    """100,000 queries in waves: below the search there is only the scan."""
    rows = [(i, f"intent{i % 3}", [math.cos(i), math.sin(i)]) for i in range(90)]
    schema = "hit_id int, intent string, embedding array<double>"
    spark.createDataFrame(rows, schema).write.partitionBy("intent").parquet(str(tmp_path / "index"))
    index = retrieve.read_index(spark, str(tmp_path / "index"))
    angle = F.col("id") / 7.0
    queries = spark.range(100_000).select(
        F.col("id").alias("query_id"), F.concat(F.lit("intent"), F.col("id") % 3).alias("intent"), F.array(F.cos(angle), F.sin(angle)).alias("embedding")
    )
    plans, write = [], retrieve.write_stage

    def watched(df, label, **metrics):
        if label == "query-wave":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, **metrics)

    monkeypatch.setattr(retrieve, "write_stage", watched)
    found = retrieve.retrieve(queries, index, 2, query_bytes=4 << 20)
    assert len(plans) > 1
    assert all("Exchange" not in plan[plan.index("MapInPandas") :] for plan in plans)
    assert found.count() == 200_000 and found.select("query_id").distinct().count() == 100_000
    sample = {r["query_id"]: r["hit_id"] for r in found.where("rank = 1 AND query_id < 300").collect()}
    for q, hit in sample.items():
        best = max(round(math.cos(i - q / 7.0), 9) for i in range(90) if i % 3 == q % 3)
        assert abs(math.cos(hit - q / 7.0) - best) < 1e-8


def clustered():
    rng = np.random.default_rng(4)
    data, labels = vectors()
    data = data * 0.3 + rng.integers(-3, 4, size=(6, 6))[rng.integers(0, 6, len(data))]
    data[10] = data[11] = data[12]
    data[20] = data[21] = 0.0
    return [(i, labels[i], data[i].tolist()) for i in range(len(data))]


@pytest.mark.parametrize("query_bytes", [8_000, retrieve.QUERY_BYTES])
def test_stored_cells_give_the_same_neighbours(spark, tmp_path, query_bytes):
    """An index of one load and two appended ones, one of them with a new intent; null vectors and intents take no part."""
    df = spark.createDataFrame([*clustered(), (900, "hot", None), (901, None, [1.0] * 6)], "hit_id int, intent string, embedding array<double>")
    path = str(tmp_path / "index")
    cells.create_cells(df.where("hit_id % 3 = 0 AND intent <> 'k1'"), path, cells=9)
    cells.append_cells(df.where("hit_id % 3 = 1 AND intent <> 'k1'"), path)
    cells.append_cells(df.where("hit_id % 3 = 2 OR intent = 'k1' OR intent IS NULL OR embedding IS NULL"), path)
    asked = df.withColumnRenamed("hit_id", "query_id")
    got = cells.retrieve_cells(asked, path, 4, exclude_self=True, query_bytes=query_bytes)
    want = retrieve.retrieve(asked, df.where("intent IS NOT NULL"), 4, exclude_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_query_opens_few_files_and_broken_loads_are_not_read(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(clustered(), "hit_id int, intent string, embedding array<double>")
    path = str(tmp_path / "index")
    cells.create_cells(df, path, cells=12)
    # A load that broke off before its line was written.
    df.withColumn("cell", F.lit(0)).withColumnRenamed("embedding", "vector").write.partitionBy("intent", "cell").parquet(f"{path}/rows/load=broken")
    opened, read = [], cells.read_cells

    def watched(*args):
        rows = read(*args)
        files = rows.select(F.input_file_name().alias("f")).distinct().count()
        opened.append((files, rows._jdf.queryExecution().executedPlan().toString()))
        return rows

    monkeypatch.setattr(cells, "read_cells", watched)
    asked = df.where("hit_id = 33").withColumnRenamed("hit_id", "query_id")
    hits = cells.retrieve_cells(asked, path, 2).collect()
    assert [h["hit_id"] for h in sorted(hits, key=lambda h: h["rank"])][0] == 33 and len(hits) == 2
    files = len(list((tmp_path / "index" / "rows").glob("load=*/intent=*/cell=*/*.parquet")))
    assert all("PartitionFilters: [" in plan and "cell" in plan for _, plan in opened)
    assert 0 < sum(n for n, _ in opened) < files / 2


def test_cells_of_an_empty_table(spark, tmp_path):
    schema = "hit_id int, intent string, embedding array<double>"
    path = str(tmp_path / "index")
    cells.create_cells(spark.createDataFrame([], schema), path)
    asked = spark.createDataFrame([(1, "a", [1.0])], schema).withColumnRenamed("hit_id", "query_id")
    assert cells.retrieve_cells(asked, path).collect() == []


def test_one_pass_silhouette_and_best_of_starts(spark):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(c, 1.0, size=(40, 4)) for c in (6, -6, 0)])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "id int, embedding array<double>")
    scores, best, models = ml.kmeans_sweep(df, 2, 5, restarts=4)
    assert best == 3
    label = [r["cluster"] for r in ml.kmeans_assign(df, models[3]).orderBy("id").collect()]
    gaps = np.square(data[:, None] - data[None]).sum(axis=2)
    own = np.array(label)[:, None] == np.array(label)[None]
    a = (gaps * own).sum(axis=1) / (own.sum(axis=1) - 1)
    b = np.min([np.where(np.array(label) == c, np.inf, gaps[:, np.array(label) == c].mean(axis=1)) for c in range(3)], axis=0)
    want = ((b - a) / np.maximum(a, b)).mean()
    assert abs(scores[3] - want) < 1e-4
    placed = ml.kmeans_assign(df, models[3])
    assert abs(ml.cluster_silhouette(placed, "cluster", "embedding").first()[0] - want) < 1e-4


@pytest.mark.parametrize("parts", [1, 5])
def test_copies_leave_no_empty_cluster(spark, parts):
    """A vector that 20,000 rows share fills neither the pool of starts nor several clusters."""
    rng = np.random.default_rng(6)
    spread = np.concatenate([rng.normal(c, 0.3, size=(30, 3)) for c in (4, -4, 9, -9, 0)])
    rows = spark.createDataFrame([(row.tolist(),) for row in spread], "embedding array<double>")
    copies = spark.range(20_000).select(F.array(F.lit(20.0), F.lit(20.0), F.lit(20.0)).alias("embedding"))
    model = ml.kmeans_fit(rows.unionByName(copies).repartition(parts), 6, restarts=4)
    assert sorted(model.rows.tolist()) == [30, 30, 30, 30, 30, 20_000]
    pool, weights = ml._pool(rows.unionByName(copies).select(F.col("embedding").alias("vector")), 40, 4, 42)
    assert len(np.unique(pool, axis=0)) == len(pool) > 30 and weights.sum() == 20_150


def test_fewer_vectors_than_clusters(spark):
    two = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([1.0, 0.0],)], "embedding array<double>")
    model = ml.kmeans_fit(two, 4, restarts=2)
    assert model.rows.sum() == 3 and model.cost < 1e-12
    with pytest.raises(ValueError, match="no vector"):
        ml.kmeans_fit(two.where("false"), 2)


def test_silhouette_shuffles_sums_only(spark):
    """Rows are not copied into pairs of blocks: one sum per row and cluster is written for each wave."""
    df = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(60)], "id int, label int, v array<double>")
    found = ml.silhouette_rows(df, "id", "label", "v", 20)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    assert len({part for f in found.inputFiles() for part in f.split("/") if part.startswith("silhouette-wave")}) == 3


def test_block_top_k_in_pieces():
    rng = np.random.default_rng(3)
    rows = lambda name, n: pd.DataFrame({name: range(n), "vector": list(rng.normal(size=(n, 4)))})
    queries, index = rows("query_id", 30), rows("hit_id", 50)
    whole, pieces = (retrieve._block_top_k(3, True, cells=cells)(queries, index) for cells in (1 << 19, 60))
    pd.testing.assert_frame_equal(whole, pieces)


def test_held_hits_equal_a_search_of_the_whole_index():
    """Blocks one after the other, most of them skipped for most queries, give the hits of one search; ties and repeated ids included."""
    rng = np.random.default_rng(5)
    rows = lambda name, n: pd.DataFrame({name: np.arange(n) % 70, "vector": list(rng.integers(-2, 3, size=(n, 3)).astype(float))})
    queries, index = rows("query_id", 40), rows("hit_id", 90)
    index["hit_id"] = rng.permutation(90)
    for own in (False, True):
        held = retrieve._Held(queries, 4, own, cells=100)
        for start in range(0, 90, 7):
            held.add(index.iloc[start : start + 7])
        key = ["query_id", "similarity", "hit_id"]
        want = retrieve._block_top_k(4, own)(queries, index)
        pd.testing.assert_frame_equal(*(f.sort_values(key, ignore_index=True)[key] for f in (held.frame(), want)))


def test_many_queries_find_the_index_spread_over_all_cores(spark):
    """An index of one file is compared by as many tasks as there are cores, and few queries leave it where it lies."""
    rows = spark.range(2000).selectExpr("id", "'a' AS intent", "array(double(id), 1D) AS embedding").coalesce(1)
    index, cores = rows.withColumnRenamed("id", "hit_id"), spark.sparkContext.defaultParallelism
    plan = lambda n: retrieve.retrieve(rows.where(f"id < {n}"), index, 3, "id")._jdf.queryExecution().toString()
    assert f"RoundRobinPartitioning({cores})" in plan(retrieve.SPREAD_QUERIES) and "RoundRobin" not in plan(20)


def test_scorer_gets_few_rows_as_objects(spark):
    """Batches come from slices of Arrow batches, and a column left out by name or order does not matter."""
    rows = spark.createDataFrame([(i, "x" * i) for i in range(25)], "id bigint, text string").coalesce(1)
    sizes = lambda part: pd.DataFrame({"n": len(part), "id": part["id"]})
    scored = score.score_batches(rows, sizes, "id bigint, n int", 10)
    assert "MapInArrow" in scored._jdf.queryExecution().toString()
    assert sorted(map(tuple, scored.collect())) == [(i, 10 if i < 20 else 5) for i in range(25)]


def test_vocabulary_counts_texts_without_a_shuffle_by_row(spark):
    texts = ["b a a", "a c", None, "", "bb aa aa bb", "aa bb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r["term"], r["n"], r["texts"]) for r in ml.label_vocabulary(df, "text", 3).orderBy("place").collect()]
    assert got == [("aa", 3, 2), ("bb", 3, 2), ("aa bb", 2, 2)]


def test_lloyd_round_sends_a_row_per_model(spark):
    rows = spark.createDataFrame([([float(i), 0.0],) for i in range(10)], "vector array<float>")
    model = ml._lloyd_round(rows, {4: np.array([[1.0, 0.0], [8.0, 0.0]])})[4]
    assert model.rows.tolist() == [5.0, 5.0] and model.centers.tolist() == [[2.0, 0.0], [7.0, 0.0]]
    assert model.cost == 30.0 and model.squares.tolist() == [30.0, 255.0]
