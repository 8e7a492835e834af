"""BPE encoding and decoding through a table of distinct words.

The tokenizer drops white space, so a text's ids are the ids of its white-space separated words,
one after the other, and a word's ids do not depend on its neighbours. Hence:

1. *Split.* Tasks cut the texts into blocks of bounded size. A block holds its distinct words and,
   for every word of every text, the word's number within the block.
2. *Encode once.* Word lists are dealt out by a hash of the word. All lists that hold a word meet
   in one task, which passes each distinct word to the tokenizer once.
3. *Join back.* The ids return to their block, where the word numbers of step 1 put them in place.
4. *Decode.* Ids are joined with the table (id, piece), which is as large as the vocabulary.

Word lists and word numbers travel compressed, a list a row: one row a word took more than twice the
disk. A word that fills the corpus is sent once per block, so no word is hot.

Defined cases: a null or empty text has no ids and decodes to ''. Every input row gives one output row, also
repeated rows and rows without an id. Extra columns are ignored. A very long text is a block of its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.tables import release, shuffle_partitions, slices, text_bytes
from threadloom.session import spread, stage_path

# Bytes of text in a block.
BLOCK_BYTES = 16 << 20
# Bytes of ids or text in an output batch.
BATCH_BYTES = 2 << 20
# Word lists that are unpacked and answered in one piece.
LISTS = 16
# Words that the tokenizer gets at a time: its answer takes about a kilobyte a word until the ids are taken from it.
WORDS = 4096

_loaded: dict[int, object] = {}


def _tokenizer(definition: str):
    """The tokenizer of a definition, loaded once in each Python worker."""
    from tokenizers import Tokenizer

    key = hash(definition)
    if key not in _loaded:
        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[key] = tokenizer
    return _loaded[key]


def read_definition(path: str) -> str:
    """A tokenizer file's text, which is sent to the executors: they need not have the file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def pieces(spark: SparkSession, definition: str) -> DataFrame:
    """The table (id, piece) of the vocabulary with its added tokens."""
    vocabulary = _tokenizer(definition).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in vocabulary.items()], "id int, piece string")


# -- split ---------------------------------------------------------------------------------------


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Word numbers given in the order of first appearance: a first appearance is written as 0, any other
    as number + 1; the three byte planes are compressed one after the other."""
    highest = np.maximum.accumulate(numbers)
    first = np.concatenate(([True], highest[1:] > highest[:-1])) if len(numbers) else np.zeros(0, dtype=bool)
    symbols = np.where(first, 0, numbers + 1).astype("<u4")
    planes = np.ascontiguousarray(symbols.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(4, -1)
    symbols = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    first = symbols == 0
    symbols -= 1
    symbols[first] = np.arange(int(first.sum()))
    return symbols


class _Block:
    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, key: int | None, text: bytes) -> None:
        words = text.split()
        self.keys.append(key)
        self.lengths.append(len(words))
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(text)

    def row(self, number: int, buckets: int) -> dict:
        """The block as a row. ``places`` gives, for the words bucket by bucket in sorted order, their numbers."""
        lists: list[list[bytes]] = [[] for _ in range(buckets)]
        for word in self.numbers:
            lists[zlib.crc32(word) % buckets].append(word)
        packer, places, packed = zstandard.ZstdCompressor(level=3), [], []
        for words in lists:
            words.sort()
            places.extend(map(self.numbers.__getitem__, words))
            packed.append(packer.compress(b"\n".join(words)) if words else None)
        order = np.array(places, dtype="<u4")
        planes = np.ascontiguousarray(order.view(np.uint8).reshape(-1, 4).T) if len(order) else order
        return {
            "block": number,
            "keys": self.keys,
            "lengths": self.lengths,
            "codes": pack_numbers(np.concatenate(self.codes)) if self.numbers else b"",
            "places": packer.compress(planes.tobytes()),
            "words": packed,
        }


_BLOCKS = "block bigint, keys array<bigint>, lengths array<bigint>, codes binary, places binary, words array<binary>"
_BLOCK_TYPE = pa.schema(
    [
        ("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("codes", pa.binary()), ("places", pa.binary()), ("words", pa.list_(pa.binary())),
    ]
)


def _split(block_bytes: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if block.keys and block.size + len(text or b"") > block_bytes:
                    yield pa.RecordBatch.from_pylist([block.row(base + made, buckets)], schema=_BLOCK_TYPE)
                    made, block = made + 1, _Block()
                block.add(key, text or b"")
        if block.keys:
            yield pa.RecordBatch.from_pylist([block.row(base + made, buckets)], schema=_BLOCK_TYPE)

    return run


# -- encode each distinct word once --------------------------------------------------------------


def word_ids(definition: str, words: list[bytes]) -> list[bytes]:
    """Ids of words as little-endian 32-bit integers."""
    tokenizer, ids = _tokenizer(definition), []
    for at in range(0, len(words), WORDS):
        encoded = tokenizer.encode_batch([w.decode("utf-8") for w in words[at : at + WORDS]], add_special_tokens=False)
        ids.extend(np.array(e.ids, dtype="<u4").tobytes() for e in encoded)
    return ids


def _pack_ids(ids: list[bytes]) -> bytes:
    lengths = np.fromiter((len(i) >> 2 for i in ids), dtype="<u4", count=len(ids))
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    parts = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in (lengths, flat)]
    return len(ids).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[8:]), dtype=np.uint8)

    def whole(planes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()

    return whole(raw[: 4 * count]), whole(raw[4 * count :])


def _encode(definition):
    """Ids of the word lists of whole buckets, sorted by bucket: no word is in two, so only one bucket's words are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        held = None
        for batch in slices(batches, LISTS):
            out = []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if bucket != held:
                    known, held = {}, bucket
                words = zstandard.ZstdDecompressor().decompress(packed).split(b"\n")
                new = [w for w in words if w not in known]
                if new:
                    known.update(zip(new, word_ids(definition.value, new)))
                out.append(_pack_ids([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"]
            )

    return run


# -- join back -----------------------------------------------------------------------------------


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] of all words, one after the other."""
    ends = np.cumsum(lengths)
    index = np.arange(int(ends[-1]) if len(ends) else 0)
    index += np.repeat(starts - (ends - lengths), lengths)
    return flat[index]


_TOKENS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]


def _places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block's distinct words: all in one array, and start and length by word number."""
    lists = [_unpack_ids(x["ids"]) for x in sorted(row["lists"] or [], key=lambda x: x["bucket"])]
    if not lists:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sorted_lengths = np.concatenate([x[0] for x in lists]).astype(np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["places"]), dtype=np.uint8)
    places = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    starts, lengths = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    starts[places] = np.cumsum(sorted_lengths) - sorted_lengths
    lengths[places] = sorted_lengths
    return np.concatenate([x[1] for x in lists]), starts, lengths


def _assemble(vocabulary):
    """Ids of every text of a block, and with a broadcast vocabulary also the decoded text."""
    schema = pa.schema(_TOKENS + [("decoded", pa.string())] * (vocabulary is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                flat, starts, lengths = _places(row)
                codes = unpack_numbers(row["codes"]) if row["codes"] else np.zeros(0, np.int64)
                end, out, size = 0, [], 0
                for key, count in zip(row["keys"], row["lengths"]):
                    own = codes[end : end + count]
                    end += count
                    ids = _gather(flat, starts[own], lengths[own])
                    out.append({"doc_id": key, "n_tokens": len(ids), "ids": ids.astype("<u4").tobytes()})
                    if vocabulary is not None:
                        out[-1]["decoded"] = _spoken(ids, vocabulary.value)
                    size += 4 * len(ids)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        release()

    return run


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Write the blocks bucketed by their number: the join back then shuffles only the ids.

    The table is known to the catalog just long enough to read it back; its files lie in the shared folder.
    """
    spark = blocks.sparkSession
    path = stage_path(spark, "bpe-blocks")
    name = f"bpe_blocks_{path[-12:]}"
    blocks.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def encode(
    docs: DataFrame,
    definition: str,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row; ``ids`` are little-endian unsigned 32-bit integers.

    ``definition`` is a tokenizer of the tokenizers library that drops white space and whose splits do
    not look beyond a word (see the module's description), as its JSON text. With a ``vocabulary`` the tasks that put the
    ids in place also decode them (see ``decode``), which saves sending all ids to another Python worker.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    shipped = spark.sparkContext.broadcast(definition)
    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    blocks = _bucketed(rows.mapInArrow(_split(block_bytes, buckets), _BLOCKS), buckets)
    lists = (
        blocks.select("block", F.posexplode("words").alias("bucket", "packed"))
        .where(F.col("packed").isNotNull())
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode(shipped), "block bigint, bucket int, ids binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "ids")).alias("lists"))
    )
    # The ids of all words are as large as the corpus' vocabulary, so they are never broadcast.
    joined = blocks.select("block", "keys", "lengths", "codes", "places").join(lists.hint("merge"), "block", "left")
    pieces_by_id = None if vocabulary is None else _by_id(vocabulary)
    schema = "doc_id bigint, n_tokens bigint, ids binary" + (", decoded string" if vocabulary is not None else "")
    return joined.mapInArrow(_assemble(pieces_by_id), schema)


# -- decode --------------------------------------------------------------------------------------


def _by_id(vocabulary: DataFrame):
    """The table (id, piece) as a broadcast array with a piece at its id; it is bounded by the vocabulary's size."""
    rows = vocabulary.select("id", "piece").collect()
    known = np.full(max((r["id"] for r in rows), default=-1) + 1, None, dtype=object)
    for r in rows:
        known[r["id"]] = r["piece"]
    return vocabulary.sparkSession.sparkContext.broadcast(known)


def _spoken(ids: np.ndarray, table: np.ndarray) -> str:
    """Pieces of the ids, joined by a space as a tokenizer without a decoder does; unknown ids are left out as there."""
    return " ".join([p for p in table[ids[ids < len(table)]] if p is not None])


def decode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``decoded`` to a table with ``ids``, by a broadcast join with the table (id, piece). A null ``ids`` gives ''."""
    shipped = _by_id(vocabulary)
    schema = tokens.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = [_spoken(np.frombuffer(raw or b"", dtype="<u4"), shipped.value) for raw in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, f"{schema}, decoded string")


def round_trip(docs: DataFrame, definition: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row."""
    return encode(docs, definition, vocabulary=pieces(docs.sparkSession, definition), block_bytes=block_bytes)
