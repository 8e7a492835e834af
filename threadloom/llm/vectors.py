"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are compared within their label. Equal vectors of a label are first folded into one node with a weight.

*Candidates.* A random rotation gives every node sign bits. ``tables`` groups of ``bits`` sign bits each are the keys under which nodes meet.
Two vectors of cosine c agree on a bit with probability p = 1 - acos(c) / pi, so a pair at the threshold is missed by all tables
with probability (1 - p^bits)^tables; ``tables`` is the smallest number that brings this below ``miss``. ``bits``
grows with the logarithm of the largest label, so that buckets, not labels, are compared. All labels go this way, small ones with
``LEAST_BITS`` bits. The bits of one rotation are not quite independent, so ``miss`` is set well below what is wanted.

*Codes.* A node's code holds the signs of its rotated unit vector o, with the stored correction <s, o> / sqrt(d), s being the
signs. For two nodes, <s, q> / sqrt(d) divided by the first one's correction is an unbiased estimate of their cosine; its
error is below ``sigmas`` * sqrt((1 - f^2) / f^2 / (d - 1)) with f the correction. A pair whose upper bound
stays below the threshold in either direction is decided; every other pair is recomputed in double precision on the original vectors.

*Results.* A bucket returns link counts per node and a spanning forest, never its pairs. A pair that meets in several tables counts in the first.
Buckets above ``BLOCK`` nodes are cut into blocks, each pair of which is a task's group.

Defined cases: vectors that are null or zero, or hold null or non-finite components, and rows without a label, link with nothing and are their own
component. Vectors of different lengths do not link. Repeated rows count as vectors of their own. A row
without an id links like others, but names no component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import matrices_of
from threadloom.operators.graph import connected_components
from threadloom.session import write_stage

THRESHOLD = 0.93
BLOCK = 2048
# Wanted rows of a bucket.
TARGET = 256
# Bits of a key at least.
LEAST_BITS = 2
# Chance that all tables miss a pair at the threshold, if bits were independent.
MISS = 0.0001
SIGMAS = 4.0
SEED = 23


def rotation(width: int, number: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((seed, number)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def layout(largest: int, threshold: float = THRESHOLD, target: int = TARGET, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for labels of up to ``largest`` rows."""
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, largest) / target))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _signs(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The keys of all tables, one row a vector."""
    width = unit.shape[1]
    need = bits * tables
    signs = np.concatenate([unit @ rotation(width, 1 + n, seed).T > 0 for n in range(-(-need // width))], axis=1)[:, :need]
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their signs / sqrt(d), and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0, seed).T
    signs = np.where(turned > 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, signs, np.einsum("ij,ij->i", turned, signs)


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, raw): raw is the vector as bytes of doubles, null if it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None] * batch.num_rows
            for matrix, places in matrices_of(batch.column(2)):
                for place, row in zip(places, matrix):
                    out[place] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "raw"])

    picked = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    return picked.mapInArrow(run, "id bigint, label string, raw binary").withColumn(
        "raw", F.when(F.col("label").isNotNull(), F.col("raw"))
    )


def _tables(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """One row per node and table: its key there, and the keys of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            keys = [None] * len(raws)
            for size in {len(r) for r in raws}:
                own = [i for i, r in enumerate(raws) if len(r) == size]
                x = np.frombuffer(b"".join(raws[i] for i in own), np.float64).reshape(len(own), -1)
                for i, row in zip(own, _signs(_unit(x), bits, tables, seed)):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    keyed = nodes.select("node", "label", "weight", "raw").mapInArrow(run, "node bigint, label string, weight bigint, raw binary, keys array<bigint>")
    return keyed.select("*", F.posexplode("keys").alias("tab", "at"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Cosines of pairs of original vectors, in double precision."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = np.empty(len(i))
    for s in range(0, len(i), chunk):
        a, b = i[s : s + chunk], j[s : s + chunk]
        out[s : s + chunk] = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b])
    return out


def _linked(x: np.ndarray, rows: slice, cols: slice, threshold: float, sigmas: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the block rows x cols, i < j, with a cosine of at least ``threshold``."""
    turned, signs, factor = _codes(_unit(x), seed)
    error = sigmas * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, x.shape[1] - 1))
    upper = lambda a, b: signs[a] @ turned[b].T / factor[a, None] + error[a, None]
    open_pairs = (upper(rows, cols) >= threshold) & (upper(cols, rows).T >= threshold)
    i, j = np.nonzero(open_pairs)
    i, j = i + (rows.start or 0), j + (cols.start or 0)
    i, j = i[i < j], j[i < j]
    sure = _exact(x, i, j) >= threshold
    return i[sure], j[sure]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For every member the smallest member its links lead to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _solve(threshold: float, sigmas: float, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("node", "ascending")])
        out_a, out_b, out_n = [], [], []
        node, weight, tab, side = (group.column(c).to_numpy() for c in ("node", "weight", "tab", "side"))
        raws = group.column("raw").to_pylist()
        keys = np.array(group.column("keys").to_pylist(), dtype=np.int64)
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        diagonal = group.column("one")[0].as_py() == group.column("two")[0].as_py()
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(raws[k] for k in own), np.float64).reshape(len(own), -1)
            split = len(own) if diagonal else int((side[own] == 0).sum())
            i, j = [], []
            for s in range(0, split, 512):
                rows = slice(s, min(s + 512, split))
                cols = slice(s, len(own)) if diagonal else slice(split, len(own))
                a, b = _linked(x, rows, cols, threshold, sigmas, seed)
                i.append(a)
                j.append(b)
            i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j))
            here = int(tab[0])
            if here and len(i):
                new = ~(keys[own][i, :here] == keys[own][j, :here]).any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            counts = np.zeros(len(own), dtype=np.int64)
            np.add.at(counts, i, weight[own][j])
            np.add.at(counts, j, weight[own][i])
            root = _forest(len(own), i, j)
            met, led = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(own)))
            out_a += [node[own][met], node[own][root[led]]]
            out_b += [np.full(len(met), -1), node[own][led]]
            out_n += [counts[met], np.zeros(len(led), np.int64)]
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out_a, out_b, out_n)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


def near_duplicates(
    rows: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    target: int = TARGET,
    block: int = BLOCK,
    miss: float = MISS,
    sigmas: float = SIGMAS,
    seed: int = SEED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    held, _ = write_stage(usable(rows, key, vector, label), "vector-rows")
    part = held.where(F.col("raw").isNotNull())
    folded = part.groupBy("label", "raw").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))
    nodes, _ = write_stage(folded.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")

    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = layout(largest, threshold, target, miss)
    placed = _tables(nodes, bits, tables, seed)
    spot = ["label", "tab", "at"]
    # Buckets above a block are rare or none; each is cut into blocks, and every pair of its blocks is a group.
    sizes, _ = write_stage(placed.groupBy(*spot).count().where(F.col("count") > 1), "vector-buckets")
    cut = placed.join(sizes.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")), spot)
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = cut.select(
        "node", "weight", "raw", "keys", *spot, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    ).groupBy(*spot, "one", "two")
    found, _ = write_stage(grouped.applyInArrow(_solve(threshold, sigmas, seed), "a bigint, b bigint, n bigint"), "vector-links")

    counts = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = connected_components(found.where("b >= 0").select("a", "b"), "a", "b").select("node", F.col("component").alias("root"))
    rooted = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    rooted, _ = write_stage(rooted, "vector-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = (
        nodes.join(rooted.select("node", "root"), "node").join(smallest, "root").join(counts, "node", "left")
        .select("label", "raw", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    out = held.join(facts, ["label", "raw"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("raw").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
