"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints that differ in at most three bits are cut into two segments of 32; one
segment then differs in at most one bit. So every distinct fingerprint is indexed under 2 x 32 keys:
a segment with one bit wildcarded. Fingerprints that meet under a key are verified by their distance.

Only the components are wanted, so a bucket does not list its pairs: it emits a spanning forest of its
links, at most one row a member. A bucket above ``BUCKET`` members is cut once more: the other
segment differs in at most three bits, so one of its halves differs in at most one. Members that then
still share a key agree on all but 16 + 2 bits, so such a bucket never holds more than 2^18 distinct fingerprints.

Defined cases: null and empty texts have no words; their fingerprint is 0 and links like any other. Repeated rows
and rows without an id get a row each; ``component_id`` is the smallest id that is not null, or null if there is none.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tables import slices, text_bytes
from threadloom.operators.graph import connected_components
from threadloom.session import spread, write_stage

SEED = 42
MAX_BITS = 3
# Members of a bucket that are compared in one piece; larger ones are cut once more.
BUCKET = 4096
# Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    ones = sum((_set_bits(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(64, dtype=np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[width - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(ends), CHUNK):
        hashes = np.array([digest(view[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")
        ones += _set_bits(hashes)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, bits) for every row; ``bits`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.array([fingerprint(t, width, seed) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, bits bigint")


def _segments(bits: Column) -> tuple[Column, Column]:
    low = F.lit(0xFFFFFFFF)
    return bits.bitwiseAND(low), F.shiftrightunsigned(bits, 32).bitwiseAND(low)


def _wildcards(segment: Column, width: int, prefix: Column) -> list[Column]:
    """Keys prefix | wildcarded place | segment with that bit cleared."""
    full, place_bits = (1 << width) - 1, (width - 1).bit_length()
    return [
        F.shiftleft(F.shiftleft(prefix, place_bits).bitwiseOR(F.lit(i)), width).bitwiseOR(segment.bitwiseAND(F.lit(full & ~(1 << i))))
        for i in range(width)
    ]


def _variants(bits: DataFrame) -> DataFrame:
    """64 rows (key, bits) for each fingerprint. A key has 1 + 5 + 32 bits."""
    low, high = _segments(F.col("bits"))
    keys = _wildcards(low, 32, F.lit(0).cast("bigint")) + _wildcards(high, 32, F.lit(1).cast("bigint"))
    return bits.select(F.explode(F.array(*keys)).alias("key"), "bits")


def _finer_variants(rows: DataFrame) -> DataFrame:
    """32 rows (key, bits) for each member of a large bucket: one half of its other segment, one bit wildcarded.

    A key has 38 bits of the bucket, 1 + 4 of half and place, and 16 of the half.
    """
    low, high = _segments(F.col("bits"))
    first = F.shiftrightunsigned(F.col("key"), 37) == 0
    other = F.when(first, high).otherwise(low)
    one, two = other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)
    base = F.shiftleft(F.col("key"), 1)
    keys = _wildcards(one, 16, base) + _wildcards(two, 16, base.bitwiseOR(F.lit(1)))
    return rows.select(F.explode(F.array(*keys)).alias("key"), "bits")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits; NumPy counts the bits of a signed number's absolute value, so the sign has to go."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(bits: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that joins fingerprints of at most ``most`` differing bits."""
    left, right = [bits[:0]], [bits[:0]]
    rest = bits
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            node = front.pop()
            near = differing(rest, node) <= most
            if near.any():
                reached = rest[near]
                left.append(np.repeat(node, len(reached)))
                right.append(reached)
                front.extend(np.split(reached, len(reached)))
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def _runs(limit: int | None):
    """Links of sorted (key, bits) rows: (key null, a, b). Members of a run above ``limit`` come back as (key, bits, null)."""

    def emit(*columns: np.ndarray | None) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "a", "b"])

    def solve(keys: np.ndarray, bits: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        sizes = ends - starts
        a, b = [], []
        # Pairs and small buckets in one sweep: every row with the row ``step`` further on.
        small = sizes <= 8
        own = np.repeat(np.where(small, sizes, 0), sizes)
        for step in range(1, 8):
            at = np.flatnonzero((own > step)[:-step] & (keys[step:] == keys[:-step])) if len(keys) > step else np.zeros(0, np.int64)
            if not len(at):
                break
            at = at[differing(bits[at], bits[at + step]) <= MAX_BITS]
            a.append(bits[at])
            b.append(bits[at + step])
        for s, e in zip(starts[~small], ends[~small]):
            left, right = forest(bits[s:e])
            a.append(left)
            b.append(right)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return emit(None, a, b) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large = None
        for batch in batches:
            k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if large is not None:  # the rest of a run that was found too large
                n = int(np.searchsorted(k, large, side="right"))
                if n:
                    yield emit(k[:n], v[:n], None)
                    k, v = k[n:], v[n:]
                if not len(k):
                    continue
                large = None
            keys, bits = np.concatenate((keys, k)), np.concatenate((bits, v))
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            done = solve(keys[:last], bits[:last]) if last else None
            keys, bits = keys[last:], bits[last:]
            if done is not None:
                yield done
            if limit is not None and len(keys) > limit:
                yield emit(keys, bits, None)
                large, keys, bits = int(keys[-1]), keys[:0], bits[:0]
        if len(keys):
            done = solve(keys, bits)
            if done is not None:
                yield done

    return run


def _solved(variants: DataFrame, limit: int | None) -> DataFrame:
    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(limit), "key bigint, a bigint, b bigint")


def links(bits: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all fingerprints of 3 or fewer differing bits."""
    found, seen = write_stage(_solved(_variants(bits), bucket), "simhash-links", large=F.count_if(F.col("key").isNotNull()))
    edges = found.where(F.col("key").isNull()).select("a", "b")
    if seen["large"]:
        finer = _finer_variants(found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("bits")))
        edges = edges.unionByName(_solved(finer, None).select("a", "b"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    marked, _ = write_stage(fingerprints(docs, key, text, width), "simhash-fingerprints")
    distinct, _ = write_stage(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(distinct.select("bits"), bucket), "a", "b").select(F.col("node").alias("bits"), F.col("component").alias("root"))
    rooted = distinct.join(roots, "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    rooted, _ = write_stage(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table, _ = write_stage(rooted.join(smallest, "root").select("bits", "component_id"), "simhash-components")
    return marked.join(table, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, group: Callable[..., DataFrame] = components) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``.

    ``group`` gives (doc_id, component_id) for every row of a frame, whose id column ``key`` names.

    The row with the smallest id stays; of several rows with this id, or of a group without any id, the one whose
    content has the smallest hash.
    """
    # A row is known by the hash of its id and text, so the texts themselves are read again and not written once more.
    row = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    groups = group(row.select("h", "row.text", F.col("row.doc_id").alias("doc_id")), key="h")
    ids = row.select("h", F.col("row.doc_id").alias("doc_id")).distinct()
    member = groups.select(F.col("doc_id").alias("h"), F.col("component_id").alias("group")).distinct().join(ids, "h")
    order = Window.partitionBy("group").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    chosen = member.withColumn("n", F.row_number().over(order)).where("n = 1").select("h")
    kept = row.join(chosen, "h", "left_semi")
    once = Window.partitionBy("h").orderBy(F.lit(0))
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
