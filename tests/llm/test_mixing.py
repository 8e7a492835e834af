import pytest
from helpers import docs, table

from pyspark.sql import functions as F

from threadloom.llm import mixing


def plain_targets(sizes, weights=mixing.WEIGHTS, share=1.5, epochs=2):
    """Rounds of clamping and sharing again, on a dict."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, done, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= epochs * sizes[s]}
        if not full:
            done |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            done[s] = float(epochs * sizes[s])
        left -= sum(done[s] for s in full)
        open_ -= full
    return done


def test_targets_and_takes(spark):
    texts, sources = [], []
    for i in range(3000):
        texts.append("w " * (1 + i * 7 % 50))
        sources.append(None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 11}")
    got = table(mixing.mix(docs(spark, texts, sources)))
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    taken = {}
    for i, (t, s) in enumerate(zip(texts, sources)):
        r = got[i]
        assert (r["size"], r["source_size"]) == (len(t.split()), sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 50
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_and_seeds(spark):
    frame = docs(spark, ["w " * (i % 9 + 1) for i in range(400)])
    one, two = (sorted(map(tuple, mixing.mix(f).collect())) for f in (frame, frame.repartition(7)))
    assert one == two
    assert one != sorted(map(tuple, mixing.mix(frame, seed="other").collect()))


def test_take_agrees_with_mix(spark):
    frame = docs(spark, ["w " * (i % 9) for i in range(300)], extra="row,place,size,copies")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frame).collect()}
    taken = mixing.take(frame)
    assert taken.columns == frame.columns
    counted = {r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counted == {k: n for k, n in copies.items() if n}


def test_nulls_empty_and_ties(spark):
    frame = docs(spark, [None, "", "a b", "a b", "c"], sources=[None, "x", None, "x", "x"], ids=[None, 1, 2, 2, None])
    rows = mixing.mix(frame).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 1, 2, 2]
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_all_empty_texts_and_empty_table(spark):
    assert {r["taken"] for r in mixing.mix(docs(spark, [None, "", " "])).collect()} == {0}
    empty = docs(spark, ["a"]).where("false")
    assert mixing.mix(empty).collect() == [] and mixing.take(empty).collect() == []


def test_a_share_beyond_all_epochs(spark):
    rows = mixing.mix(docs(spark, ["a b", "c d e"]), share=9.0).collect()
    assert all(r["taken"] == 2 * r["size"] for r in rows)


def test_documents_without_ids_and_with_shared_ids_come_near_the_target(spark):
    """A source of documents without ids, and one whose documents all have one id."""
    texts = [f"word{i} " * 20 for i in range(450)]
    sources = ["a"] * 150 + ["b"] * 150 + ["c"] * 150
    ids = [None] * 150 + [7] * 150 + list(range(150))
    mixed = mixing.mix(docs(spark, texts, sources, ids=ids)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for row in mixed.collect():
        assert abs(row["taken"] - row["target"]) <= 20
