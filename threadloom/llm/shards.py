"""Training-order materialisation of token ids in fixed-stride shards.

Texts are tokenized once, by any function from texts to ids, into sequences of at most ``length`` ids, which a stage table holds. The
sequences are numbered in the order of a hash of their id, part and tokens, so the numbers, and with them the training order, depend on the
key and the data alone, not on files, tasks or cores. Only hashes are ordered, over range slices. A keyed Feistel network permutes
the numbers: it works on the smallest even number of bits that holds them all and walks along its cycle until it falls
back into the range, which makes it a bijection of 0 .. n-1. The image is the sequence's slot in training order. Range partitions
on shard bounds write shards: records of one length, in slot order, so that record k of a shard starts at byte
k * stride and a reader can start at any slot.

A record is a little-endian unsigned 32-bit count and ``length`` little-endian ids of 16 bits (32 bits if the vocabulary
needs them), padded with ``pad``.

Defined cases: null and empty texts, and texts without ids, have no sequence; a very long text has many. Repeated rows are separate
sequences, whose equal records may change places. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.tables import shuffle_partitions, slices
from threadloom.operators.bounded import number_rows
from threadloom.session import small_side, spread, write_stage

LENGTH = 1024
# Records in a shard: 8 MB of 16-bit ids.
SHARD = 4096
KEY = 0x5EED
ROUNDS = 6
Encoder = Callable[[list[str]], Sequence[Sequence[int]]]
_loaded: dict[int, object] = {}


@dataclass(frozen=True)
class RankEncoder:
    """A byte-level BPE given by the text of a rank file and its splitting pattern; markers in a text are ordinary text."""

    ranks: str
    pattern: str

    def __call__(self, texts: list[str]) -> list[list[int]]:
        import tiktoken

        key = hash((self.ranks, self.pattern))
        if key not in _loaded:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(str.split, self.ranks.splitlines())}
            _loaded[key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [_loaded[key].encode_ordinary(t) for t in texts]


def sequences(docs: DataFrame, encoder: Encoder, length: int = LENGTH, wide: bool = False) -> DataFrame:
    """(task, place, doc_id, part, n_tokens, tokens): the ids of every text, cut after ``length`` ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(encoder)
    kind = np.dtype("<u4" if wide else "<u2")
    names = ["task", "place", "doc_id", "part", "n_tokens", "tokens"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, step = TaskContext.get().partitionId(), 0, length * kind.itemsize
        for batch in slices(batches):
            keys, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for key, found in zip(keys, shipped.value([t or "" for t in texts])):
                ids = np.array(found, dtype=kind).tobytes()
                for part, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    out.append((task, place, key, part, len(piece) // kind.itemsize, piece))
                    place += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(run, "task bigint, place bigint, doc_id bigint, part int, n_tokens int, tokens binary")


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The keyed permutation of 0 .. total-1, at ``numbers``."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():
        x = out[walking]
        left, right = x >> shift, x & mask
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right, key * rounds + r + 1) & mask)
        out[walking] = (left << shift) | right
        walking[walking] = out[walking] >= total
    return out.astype(np.int64)


def training_order(
    docs: DataFrame, encoder: Encoder, length: int = LENGTH, shard: int = SHARD, key: int = KEY, pad: int = 0, wide: bool = False
) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, record), range partitioned and sorted by slot."""
    spark = docs.sparkSession
    kind = "<u4" if wide else "<u2"
    stride = 4 + length * np.dtype(kind).itemsize
    place = F.xxhash64("doc_id", "part", "tokens").alias("place_key")
    rows = sequences(docs, encoder, length, wide).select("*", place)
    held, seen = write_stage(rows, "shard-sequences")
    total = seen["rows"]
    # Equal rows are told apart by task and place, so that any number of them is cut into slices.
    slim = held.select("place_key", "doc_id", "part", "task", "place", F.lit(0).alias("all"))
    order = [F.col("place_key"), F.col("doc_id"), F.col("part"), F.col("task"), F.col("place")]
    numbers = small_side(number_rows(slim, ["all"], order, out="number").select("task", "place", "number"), "shard-numbers")

    @F.pandas_udf("bigint")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, key))

    padding = np.full(length, pad, dtype=kind).tobytes()

    @F.pandas_udf("binary")
    def record_of(counts: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([n.to_bytes(4, "little") + t + padding[len(t) :] for n, t in zip(counts.tolist(), tokens)], dtype=object)

    slotted = held.join(numbers, ["task", "place"]).select(slot_of("number").alias("slot"), "doc_id", "part", "n_tokens", "tokens")
    # The slots are dense, so the bounds of the range partitions are known: whole shards, equally many in each.
    shards = max(1, -(-total // shard))
    parts = min(shards, shuffle_partitions(spark))
    home = F.floor(F.floor(F.col("slot") / shard) * parts / shards).cast("int")
    ordered = slotted.repartitionById(parts, home).sortWithinPartitions("slot")
    return ordered.select(
        "slot",
        F.floor(F.col("slot") / shard).cast("bigint").alias("shard"),
        ((F.col("slot") % shard) * stride).alias("byte_offset"),
        "doc_id",
        "part",
        "n_tokens",
        record_of("n_tokens", "tokens").alias("record"),
    )


SHARDS = "shard bigint, first_slot bigint, n_records bigint, doc_ids array<bigint>, parts array<int>, payload binary"


def write_shards(ordered: DataFrame, path: str) -> None:
    """One row a shard: its number, first slot, records, and their documents, on whatever store ``path`` is.

    ``ordered`` comes from ``training_order``, whose partitions hold whole shards in order, so nothing is shuffled again. A task holds one shard at
    a time.
    """
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    names = ["shard", "first_slot", "n_records", "doc_ids", "parts", "payload"]

    def whole(number: int, rows: list[tuple]) -> pa.RecordBatch:
        slots, ids, parts, records = zip(*rows)
        values = (number, slots[0], len(rows), list(ids), list(parts), b"".join(records))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []
        for batch in batches:
            for at, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if at != number and rows:
                    yield whole(number, rows)
                    rows = []
                number = at
                rows.append(tuple(row))
        if rows:
            yield whole(number, rows)

    packed = ordered.select("shard", "slot", "doc_id", "part", "record").mapInArrow(pack, SHARDS)
    packed.write.option("compression", "zstd").parquet(path)


def read_records(spark: SparkSession, path: str, length: int = LENGTH, wide: bool = False) -> DataFrame:
    """The rows of ``training_order``, read from its shards."""
    stride = 4 + length * (4 if wide else 2)
    names = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "record"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, payload = row["n_records"], row["payload"]
                records = [payload[k * stride : (k + 1) * stride] for k in range(n)]
                counts = [int.from_bytes(r[:4], "little") for r in records]
                offsets = np.arange(n) * stride
                columns = (row["first_slot"] + np.arange(n), np.full(n, row["shard"]), offsets, row["doc_ids"], row["parts"], counts, records)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    # A payload is 8 MB, so few go into an Arrow batch, whose bytes Spark bounds too (64 MB by default).
    return spark.read.schema(SHARDS).parquet(path).mapInArrow(
        run, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, part int, n_tokens int, record binary"
    )


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, wide: bool = False, from_slot: int = 0) -> DataFrame:
    """(slot, n_tokens, ids) from ``from_slot`` on, in order within a partition; shards before it are not read."""
    kind = np.dtype("<u4" if wide else "<u2")
    stride = 4 + length * kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                skip = max(0, from_slot - row["first_slot"])
                out = []
                for k in range(skip, row["n_records"]):
                    record = row["payload"][k * stride : (k + 1) * stride]
                    n = int.from_bytes(record[:4], "little")
                    out.append((row["first_slot"] + k, n, np.frombuffer(record[4:], kind)[:n].astype(np.int32)))
                if out:
                    slots, counts, ids = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["slot", "n_tokens", "ids"])

    shards = spark.read.schema(SHARDS).parquet(path).where(F.col("first_slot") + F.col("n_records") > from_slot)
    return shards.select("first_slot", "n_records", "payload").mapInArrow(run, "slot bigint, n_tokens int, ids array<int>")
