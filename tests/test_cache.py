from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from threadloom.operators.score import score_cached
from threadloom.sources import cache

RESULT = "n int, shout string"


class Scorer:
    """Counts the rows it is given."""

    def __init__(self):
        self.calls = []

    def __call__(self, rows):
        self.calls.append(rows.count())
        return rows.withColumn("n", F.length("text")).withColumn("shout", F.upper("text"))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def filled(spark, texts, path, score, version="m1"):
    rows = cache.fill(table(spark, texts), path, ["text"], score, RESULT, version).collect()
    assert {(r["id"], r["text"], r["n"], r["shout"]) for r in rows} == {(i, t, None if t is None else len(t), t and t.upper()) if t != "" else (i, "", 0, "") for i, t in enumerate(texts)}
    assert len(rows) == len(texts)


def test_changed_texts_and_models_are_computed_again(spark, tmp_path):
    path, score = str(tmp_path / "cache"), Scorer()
    filled(spark, ["a", "b", "a", None, "", None], path, score)
    filled(spark, ["b", "a"], path, score)
    # Row 0 has another text now, row 1 the same.
    filled(spark, ["a2", "a", ""], path, score)
    filled(spark, ["a"], path, score, version="m2")
    assert score.calls == [4, 1, 1]
    assert cache.manifest(spark, path)[0] == 3
    stored = cache.cached(spark, path, RESULT)
    assert stored.count() == stored.select("content_key").distinct().count() == 6


def test_empty_table_and_clashing_columns(spark, tmp_path):
    path, score = str(tmp_path / "cache"), Scorer()
    assert cache.fill(table(spark, ["a"]).where("false"), path, ["text"], score, RESULT, "m").collect() == []
    assert score.calls == [] and cache.manifest(spark, path) == (0, [])
    with pytest.raises(ValueError, match="shout"):
        cache.fill(table(spark, ["a"]).withColumn("shout", F.lit(1)), path, ["text"], score, RESULT, "m")


def keys(spark, names):
    return spark.createDataFrame([(k, 1, k) for k in names], "content_key string, n int, shout string")


def test_writers_that_started_together(spark, tmp_path):
    """Both saw the same version; each key is there once, and a key is never replaced."""
    path = str(tmp_path / "cache")
    cache.append(keys(spark, "ab"), path)
    base, known = cache.manifest(spark, path)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda names: cache.append(keys(spark, names), path, base, known), ["cde", "dex", "cdx"]))
    stored = cache.cached(spark, path, RESULT)
    assert sorted(r["content_key"] for r in stored.collect()) == list("abcdex")
    # A retry of a commit that went through adds nothing.
    version, _ = cache.manifest(spark, path)
    assert cache.append(keys(spark, "cde"), path, base, known) == version
    assert stored.count() == 6


def test_compaction_and_broken_jobs(spark, tmp_path):
    path = str(tmp_path / "cache")
    for names in ("ab", "cd"):
        cache.append(keys(spark, names), path, *cache.manifest(spark, path))
    base, known = cache.manifest(spark, path)
    keys(spark, "zz").write.parquet(f"{path}/data/broken")
    assert cache.compact(spark, path, RESULT) == base + 1
    # A writer that started before the compaction.
    cache.append(keys(spark, "de"), path, base, known)
    assert len(cache.manifest(spark, path)[1]) == 2 and cache.vacuum(spark, path) > 0
    assert sorted(r["content_key"] for r in cache.cached(spark, path, RESULT).collect()) == list("abcde")


def test_scores_by_content(spark, tmp_path):
    score = Scorer()
    for texts in (["a", "b"], ["b", "c"]):
        rows = score_cached(table(spark, texts), str(tmp_path / "cache"), ["text"], score, RESULT, "s1").collect()
        assert sorted((r["text"], r["shout"]) for r in rows) == sorted((t, t.upper()) for t in texts)
    assert score.calls == [2, 1]
