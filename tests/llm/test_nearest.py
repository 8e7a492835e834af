import numpy as np
from helpers import frame
from pyspark.sql import functions as F

from threadloom.llm import nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, matrix, ids=None, schema=SCHEMA):
    rows = [(int(ids[i]) if ids is not None else i, [float(x) for x in v], i % 3) for i, v in enumerate(matrix)]
    return frame(spark, rows, schema)


def plain(matrix, ids, query, k):
    d = np.sqrt(np.square(matrix - matrix[list(ids).index(query)]).sum(axis=1))
    d[np.array(ids) == query] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[o]), d[o]) for o in order if np.isfinite(d[o])]


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def unit(rng, n, d):
    x = rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = unit(rng, 3000, 64)
    got = result(nearest.search(vectors(spark, x), F.col("vec_id") % 100 == 0))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = sum(len({v for v, _ in plain(x, range(3000), q, 10)} & {v for v, _ in got[q]}) for q in got)
    assert hits / 300 >= 0.95
    for q, found in got.items():
        assert len(found) == 10 and q not in [v for v, _ in found]
        assert all(abs(s - np.sqrt(np.square(x[v] - x[q]).sum())) < 1e-12 for v, s in found)
        assert [s for _, s in found] == sorted(s for _, s in found)


def test_all_buckets_are_exact_in_blocks(spark):
    """With a probe for every bucket the search is exact, whatever the block size; copies tie."""
    rng = np.random.default_rng(2)
    x = unit(rng, 200, 6)
    x[50:120] = x[50]
    got = result(nearest.search(vectors(spark, x), F.col("vec_id") % 20 == 0, tables=2, probes=16, block=7))
    for q in got:
        want = plain(x, range(200), q, 10)
        assert [v for v, _ in got[q]] == [v for v, _ in want]


def test_two_hashes_a_table(spark):
    rng = np.random.default_rng(3)
    x = unit(rng, 300, 8)
    got = result(nearest.search(vectors(spark, x), F.col("vec_id") % 50 == 0, tables=3, hashes=2, probes=256))
    assert all([v for v, _ in got[q]] == [v for v, _ in plain(x, range(300), q, 10)] for q in got)


def test_unusable_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], None),
        (6, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 1), (7, [], 1), (100, [0.5, 0.5], 1), (200, None, 1), (1, [0.8, 0.1], 1),
    ]
    data = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("spots", F.lit("x")).withColumn("id", F.lit("x"))
    got = result(nearest.search(data, F.col("vec_id") % 100 == 0))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {0: [1, 100], 100: [1, 0]}


def test_hadamard_is_orthonormal():
    h = nearest.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def test_empty_table(spark):
    assert nearest.search(vectors(spark, np.ones((1, 4))).where("false"), F.lit(True)).collect() == []


def test_lengths_do_not_depend_on_the_first_row(spark):
    rng = np.random.default_rng(4)
    x = unit(rng, 40, 16)
    rows = [(100, [1.0, 2.0, 3.0], 0), (101, [1.0, 2.0, 2.0], 0), *[(i, [float(c) for c in v], 0) for i, v in enumerate(x)]]
    got = result(nearest.search(spark.createDataFrame(rows, SCHEMA).coalesce(1), F.col("vec_id").isin(0, 100), probes=32))
    assert [v for v, _ in got[0]] == [v for v, _ in plain(x, range(40), 0, 10)]
    assert [v for v, _ in got[100]] == [101]


def test_as_many_rows_as_there_are(spark):
    """Small tables in 64 dimensions: every query gets ten rows, or all candidates, though most axes are not probed."""
    for n in (5, 6, 11, 16):
        x = unit(np.random.default_rng(n), n, 64)
        got = result(nearest.search(vectors(spark, x), F.lit(True), block=7))
        for q in range(n):
            want = plain(x, range(n), q, 10)
            assert len(got[q]) == len(want) == min(10, n - 1)
            if n <= 11:
                assert [v for v, _ in got[q]] == [v for v, _ in want]


def test_isolated_queries_and_shared_ids(spark):
    """A few vectors opposite to all others; and an id with more rows than are asked for."""
    rng = np.random.default_rng(5)
    x = unit(rng, 60, 64) * 0.05
    x[:, 0] += np.where(np.arange(60) < 3, -1, 1)
    got = result(nearest.search(vectors(spark, x), F.col("vec_id") < 3))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in plain(x, range(60), q, 10)] for q in range(3)}
    ids = [0] + [1] * 20 + list(range(2, 16))
    near = np.concatenate([np.ones((21, 2)), unit(rng, 14, 2)])
    got = result(nearest.search(vectors(spark, near, ids), F.col("vec_id") == 0, probes=4))
    assert len(got[0]) == 10 == len({v for v, _ in got[0]}) and got[0][0] == (1, 0.0)
