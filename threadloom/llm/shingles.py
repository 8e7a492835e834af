"""Near-duplicates by SimHash fingerprints, and by exact similarity of their sets of five-word shingles.

Two texts are linked if the Jaccard similarity of their sets is at least ``LEAST``. Two kinds of candidates have met:

* Sets whose SimHash fingerprints differ in at most ``simhash.MAX_BITS`` bits, found by ``simhash.links``.
* As three bits stand for texts far more alike than that, also sets that share a MinHash key. A set has ``BANDS`` keys, each of ``ROWS``
  minima; sets of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS: 0.9995 at 0.8, more above.

Every link is checked on the sets themselves. Only the components are wanted, so met pairs are never listed:

1. Texts with the same set are one node. Every node hooks to the smallest node of each of its buckets and of its fingerprint, and the latter
   to each other along the links of their fingerprints. Nodes that hang together
   this way are a cluster; all met pairs lie inside clusters, and a node outside one needs no more work.
2. Each node of a cluster is compared with the smallest node it hooks to. One pair a node, so a large group of near copies is linked here.
3. In clusters that are still in several pieces, the met pairs between pieces are compared, unless links found before join them.
   A large cluster is cut into blocks, each pair of which is a group; pairs inside its largest piece are left out.

Defined cases: words are separated by ASCII white space, letter case is ignored. A text of fewer words than a shingle is one shingle. Null
and empty texts have the empty set, which is like itself only. Repeated rows and rows without an id get a row each and link like others;
``component_id`` is the smallest id that is not null, or null if there is none. Of equally small sets, ties go to the smaller hash, which
changes no component. A very long text is hashed in pieces. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import simhash
from threadloom.llm.tables import slices, text_bytes
from threadloom.operators.graph import connected_components
from threadloom.session import small_side, spread, write_stage

SEED = 42
WIDTH = 5
# Similarity from which texts are linked, as a fraction.
LEAST = (4, 5)
BANDS = 25
ROWS = 6
# Nodes, and shingles in all, of a block.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
# Shingles that are hashed for all minima at a time.
CHUNK = 1 << 12

_FACTORS, _OFFSETS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, as signed integers."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(width, len(words)) - 1 :]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[: len(ends)].tolist(), ends.tolist())), np.uint64, len(ends))
    return np.unique(hashes.view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the smallest values of the set's hashes under ``ROWS`` orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    values = hashes.view(np.uint64)
    for at in range(0, len(values), CHUNK):
        np.minimum(least, (values[at : at + CHUNK, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct values have a similarity of at least ``LEAST``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def marks(docs: DataFrame, key: str, text: str, width: int = WIDTH, bands: int = BANDS) -> DataFrame:
    """(doc_id, h, node, n, bits, keys) for every row: the text's hash, the set's hash, its size, its fingerprint and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, width) for t in text_bytes(batch.column(2))]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            bits = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([band_keys(s)[:bands] for s in sets], pa.list_(pa.int64()))
            columns = [pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits), keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "h", "node", "n", "bits", "keys"])

    return spread(_rows(docs, key, text)).mapInArrow(run, "doc_id bigint, h bigint, node bigint, n bigint, bits bigint, keys array<bigint>")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, width) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return rows.mapInArrow(run, "node bigint, hashes array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_set")) for x in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(both * LEAST[1] >= (F.size("a_set") + F.size("b_set") - both) * LEAST[0]).select("a", "b")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _solve(group: pa.Table) -> pa.Table:
    """Links that join the pieces of a block, or of two blocks, wherever met pairs between them are alike."""
    node, piece, n, bits, own = (group.column(c).to_numpy() for c in ("node", "piece", "n", "bits", "own"))
    keys = np.array(group.column("keys").to_pylist(), dtype=np.int64)
    sets = [s.values.to_numpy() for column in [group.column("hashes")] for s in column]
    diagonal = group.column("one")[0].as_py() == group.column("two")[0].as_py()
    piece, found = np.unique(piece, return_inverse=True)[1], []
    first = np.arange(len(node)) if diagonal else np.flatnonzero(own == group.column("one")[0].as_py())
    second = None if diagonal else np.flatnonzero(own != group.column("one")[0].as_py())
    for i in first:
        rest = np.arange(i + 1, len(node)) if diagonal else second
        rest = rest[(piece[rest] != piece[i]) & (np.minimum(n[rest], n[i]) * LEAST[1] >= np.maximum(n[rest], n[i]) * LEAST[0])]
        rest = rest[(keys[rest] == keys[i]).any(axis=1) | (simhash.differing(bits[rest], bits[i]) <= simhash.MAX_BITS)]
        for j in rest:
            if piece[j] != piece[i] and alike(sets[i], sets[j]):
                found.append((node[i], node[j]))
                piece[piece == piece[j]] = piece[i]
    a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=_LINKS)


def _between_pieces(members: DataFrame, sets: DataFrame, block: int) -> DataFrame | None:
    """Links (a, b) between the pieces of clusters; members are (cluster, piece, node, n, bits, keys). None if no cluster has several."""
    pieces = members.groupBy("cluster", "piece").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("size"))
    per_cluster = pieces.groupBy("cluster").agg(
        F.max(F.struct("many", "size", "piece")).alias("top"), F.count(F.lit(1)).alias("pieces"), F.sum("many").alias("many"), F.sum("size").alias("size")
    )
    blocks = lambda many, size: F.ceil(F.greatest(many / block, size / BLOCK_SHINGLES, F.lit(1))).cast("int")
    single = (F.col("many") <= block) & (F.col("size") <= BLOCK_SHINGLES)
    cut = per_cluster.where("pieces > 1").select(
        "cluster", F.when(~single, F.col("top.piece")).alias("top"),
        F.when(single, 1).otherwise(blocks(F.col("many") - F.col("top.many"), F.col("size") - F.col("top.size"))).alias("loose"),
        F.when(single, 0).otherwise(blocks(F.col("top.many"), F.col("top.size"))).alias("firm"),
    )
    cut, seen = write_stage(cut, "shingle-clusters")
    if not seen["rows"]:
        return None
    in_top = F.coalesce(F.col("piece") == F.col("top"), F.lit(False))
    rows = members.join(cut, "cluster").withColumn("in_top", in_top)
    place = F.xxhash64("node", F.lit(SEED))
    own = F.when(F.col("in_top"), F.col("loose") + F.pmod(place, F.greatest("firm", F.lit(1)))).otherwise(F.pmod(place, F.col("loose"))).cast("int")
    # Blocks of the largest piece meet the loose ones only.
    others = F.sequence(F.lit(0), F.col("loose") - 1 + F.when(F.col("in_top"), 0).otherwise(F.col("firm")))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.select("cluster", "piece", "node", "n", "bits", "keys", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    return rows.join(sets, "node").groupBy("cluster", "one", "two").applyInArrow(_solve, "a bigint, b bigint")


def _fingerprint_hooks(nodes: DataFrame) -> DataFrame:
    """(node, first) by which nodes whose fingerprints a chain of at most ``simhash.MAX_BITS`` differing bits joins hang together."""
    heads, _ = write_stage(nodes.groupBy("bits").agg(F.min("node").alias("first")), "shingle-fingerprints")
    same = nodes.join(heads, "bits").where(F.col("node") > F.col("first")).select("node", "first")
    left, right = (heads.select(F.col("bits").alias(x), F.col("first").alias(f"{x}_node")) for x in "ab")
    met = simhash.links(heads.select("bits")).join(left, "a").join(right, "b")
    return same.unionByName(met.select(F.greatest("a_node", "b_node").alias("node"), F.least("a_node", "b_node").alias("first")))


def components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, block: int = BLOCK, bands: int = BANDS
) -> DataFrame:
    """(doc_id, component_id) for every row; the component's smallest id that is not null. Without ``bands`` only fingerprints make candidates."""
    marked, _ = write_stage(marks(docs, key, text, width, bands), "shingle-marks")
    facts = F.first(F.struct("n", "bits", "keys")).alias("f")
    # A text of the node, and the smallest id that has it; null if there is none.
    meant = F.coalesce(F.min_by("h", "doc_id"), F.first("h")).alias("h")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), meant, facts).select("node", "first_id", "h", "f.*")
    nodes, _ = write_stage(nodes, "shingle-nodes")

    # An empty set is alike to no other.
    spots, _ = write_stage(nodes.where("n > 0").select("node", F.explode("keys").alias("key")), "shingle-keys")
    buckets = spots.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(F.col("first") < F.col("last"))
    hooks = spots.join(buckets, "key").where(F.col("node") > F.col("first")).select("node", "first")
    hooks, _ = write_stage(hooks.unionByName(_fingerprint_hooks(nodes.where("n > 0"))).distinct(), "shingle-hooks")
    led = connected_components(hooks, "node", "first").select("node", F.col("component").alias("cluster"))
    ends = led.select(F.col("cluster").alias("node"), "cluster").distinct()
    clusters, _ = write_stage(led.unionByName(ends).join(nodes, "node"), "shingle-members")

    # Rows that share an id may have several texts, and rows without an id have a text too: a row is meant by id and text.
    wanted = small_side(clusters.select("node", F.col("first_id").alias("id"), F.col("h").alias("own")), "shingle-wanted")
    texts = _rows(docs, key, text).join(wanted, F.expr("h = own AND doc_id <=> id")).select("node", "text")
    sets, _ = write_stage(_sets(spread(texts), width).groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")

    pairs = hooks.groupBy(F.col("node").alias("a")).agg(F.min("first").alias("b"))
    links, _ = write_stage(_verified(pairs, sets), "shingle-links")
    pieces = connected_components(links, "a", "b").select("node", F.col("component").alias("piece"))
    members, _ = write_stage(clusters.join(pieces, "node", "left").withColumn("piece", F.coalesce("piece", "node")), "shingle-pieces")
    more = _between_pieces(members, sets, block)
    if more is not None:
        links, _ = write_stage(links.unionByName(more), "shingle-all-links")
        pieces = connected_components(links, "a", "b").select("node", F.col("component").alias("piece"))

    rooted, _ = write_stage(nodes.join(pieces, "node", "left").select("node", "first_id", F.coalesce("piece", "node").alias("root")), "shingle-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table, _ = write_stage(rooted.join(smallest, "root").select("node", "component_id"), "shingle-components")
    return marked.join(table, "node").select("doc_id", "component_id")
