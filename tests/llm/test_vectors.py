import numpy as np
import pytest
from helpers import frame, table
from pyspark.sql import functions as F

from threadloom.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(ids, matrix, labels, threshold=0.93):
    """(n_links, component) by comparing all pairs of a label."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    out, done = {}, set()
    for i in range(len(ids)):
        if i not in done:
            group, front = {i}, [i]
            while front:
                for j in np.flatnonzero(near[front.pop()]):
                    if j not in group:
                        group.add(j)
                        front.append(j)
            done |= group
            for j in group:
                out[ids[j]] = (int(near[j].sum()), min(ids[k] for k in group))
    return out


def clusters(rng, n, d, spread):
    centres = rng.standard_normal((n // 5, d))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, d))
    return x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("target, block", [(256, 2048), (16, 2048), (256, 13)])
def test_as_brute_force(spark, target, block):
    rng = np.random.default_rng(4)
    x = np.concatenate((clusters(rng, 350, 16, 0.2), clusters(rng, 250, 16, 0.02)))
    x[-40:] = x[-1]
    x[:300] *= 1e-6
    labels = rng.integers(0, 3, len(x))
    ids = list(range(1000, 1000 + len(x)))
    rows = [(i, [float(v) for v in e], int(k)) for i, e, k in zip(ids, x, labels)]
    data = frame(spark, rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("raw", F.lit("x")).withColumn("tab", F.lit(1))
    got = table(vectors.near_duplicates(data, target=target, block=block), "vec_id")
    want = plain(ids, np.array(x, dtype=np.float32).astype(np.float64), labels)
    pairs = sum(n for n, _ in want.values())
    assert pairs > 1000
    missed = sum(want[i][0] - got[i]["n_links"] for i in ids)
    assert 0 <= missed <= 0.001 * pairs
    assert sum(got[i]["component_id"] != want[i][1] for i in ids) <= 2
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((1, 64))
    b = a + 0.3 * rng.standard_normal((1, 64))
    x = vectors._unit(np.concatenate((a, b)))
    errors, inside = [], 0
    for seed in range(300):
        turned, signs, factor = vectors._codes(x, seed)
        estimate = signs[0] @ turned[1] / factor[0]
        bound = 4 * np.sqrt((1 - factor[0] ** 2) / factor[0] ** 2 / 63)
        errors.append(estimate - x[0] @ x[1])
        inside += abs(errors[-1]) <= bound
    assert abs(np.mean(errors)) < 0.01 and inside >= 299


def test_layout_meets_its_miss_rate():
    for largest in (1, 100, 10**4, 10**6, 10**9):
        bits, tables = vectors.layout(largest)
        agree = (1 - np.arccos(0.93) / np.pi) ** bits
        assert bits >= 2 and (1 - agree) ** tables <= 0.0001 and largest / 2**bits <= 256


@pytest.mark.parametrize("n", [40, 6000])
def test_recall_just_above_the_threshold(spark, n):
    """Pairs of cosine 0.9301 to 0.932 in one label, as small or large: nearly all are found."""
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n // 2, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.932, (n // 2, 1))
    x = np.concatenate((a, c * a + np.sqrt(1 - c * c) * b))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = table(vectors.near_duplicates(rows), "vec_id")
    assert np.mean([got[i]["component_id"] == got[i + n // 2]["component_id"] == i for i in range(n // 2)]) >= 0.999


def test_unusable_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (9, [], 1), (2, [2.0, 0.0], 1),
    ]
    data = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(data).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert vectors.near_duplicates(frame(spark, [(1, [1.0], 1)], SCHEMA).where("false")).collect() == []


def test_lengths_do_not_depend_on_the_first_row(spark):
    rows = [(0, [1.0, 2.0], 1), *[(i, [1.0, 0.5, 0.25, 0.1], 1) for i in range(1, 6)], (6, [1.0, 2.0], 1)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(data).collect()}
    assert got == {0: (1, 0), 6: (1, 0), **{i: (4, 1) for i in range(1, 6)}}
