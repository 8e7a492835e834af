"""The vocabulary and the labels do not depend on how the rows are partitioned."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import ml

TEXTS = ["a bb cc bb", "bb dd, EE", None, "", "cc cc ee-ff 12", "x"]


def test_vocabulary_by_counting(spark, rows):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    n, texts = collections.Counter(), collections.Counter()
    for t in TEXTS:
        words = [w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 2]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        n.update(terms)
        texts.update(set(terms))
    ranked = sorted(n, key=lambda t: (-n[t], t))
    for size in (0, 1, 2, 5, 9, 100):
        got = sorted(map(tuple, ml.label_vocabulary(df, "text", size).collect()))
        assert [(g[0], g[1], g[2], g[3]) for g in got] == [(i, t, n[t], texts[t]) for i, t in enumerate(ranked[:size])]
        assert all(g[4] == pytest.approx(1 + math.log((len(TEXTS) + 1) / (texts[g[1]] + 1))) for g in got)


def test_labels_are_equal_in_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    found = []
    for parts in (1, 3, 9):
        sample = docs.where("doc_id % 2 = 0").repartition(parts, F.xxhash64("doc_id", F.lit(parts)))
        named = ml.propagate_labels(sample, docs.repartition(parts), "lang", vocabulary=500)
        found.append(sorted((r["doc_id"], r["predicted_label"]) for r in named.collect()))
    assert found[0] == found[1] == found[2]
    truth = dict(map(tuple, docs.select("doc_id", "lang").collect()))
    assert sum(truth[i] == p for i, p in found[0]) > 0.9 * len(truth)
