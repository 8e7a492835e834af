"""Alignment of two tokenizers' tokens over the same bytes.

Byte offsets at which a token of both tokenizers ends cut the tokens of a text into groups. The groups come from pointer jumping:
every token points to the token that overlaps it and reaches farthest to the right, a token that ends together with one of
the other side to the first tokenizer's, which points to itself. Doubling the pointers (``succ = succ[succ]``) until nothing
changes leads every token to the last one of its group, whose place is the group's label. Texts of a slice stand one
behind the other, so that one sweep of numpy operations serves them all; a text's end is a common end.

Tokens of a group are linked, each with each. The links of a text are kept as its distinct id pairs and how often each occurs. Texts
form blocks of ``BLOCK_BYTES``; a block lists its distinct pairs once, with the number of its texts that hold them. Spark adds these
counts up, marks for every first id its most frequent pairs, joins both back to the blocks' lists, and a block's texts
sum over their pairs. What is shuffled is a row per block and distinct pair, not one per link.

Defined cases: null and empty texts, texts that are not UTF-8, and texts whose tokens of either side do not add up to the bytes of a space and
the text have no tokens: zeros and an empty digest. Repeated rows and rows without an id are texts of their own and count each.
A very long text is a block of its own; the pairs of a very large group are made from its distinct ids, a part at a time. Ties for the
most frequent pair all count. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import pieces_up_to, slices, text_bytes
from threadloom.session import small_side, spread, write_stage

# Bytes of text whose pairs are listed together, and that are aligned in one sweep.
BLOCK_BYTES = 16 << 20
SWEEP_BYTES = 2 << 20
# Links that are made at a time.
PAIRS = 1 << 21


class Tokenizer(Protocol):
    """What an alignment needs: the ids of texts, and the bytes that every id stands for."""

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def token_bytes(self) -> list[bytes]: ...


_loaded: dict[int, object] = {}


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies are written: visible bytes as they are, the others moved up by 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class ByteBpe:
    """A byte-level BPE from the text of its definition, whose ids are in merge order, and its splitting pattern; a space precedes
    every text. Strings of special tokens inside a text are ordinary text."""

    definition: str
    pattern: str

    def token_bytes(self) -> list[bytes]:
        letters = _byte_letters()
        held = json.loads(self.definition)
        special = {t["id"]: t["content"].encode() for t in held["added_tokens"]}
        table = [b""] * (1 + max([*held["model"]["vocab"].values(), *special]))
        for piece, i in held["model"]["vocab"].items():
            table[i] = special[i] if i in special else bytes(letters[c] for c in piece)
        return table

    def encode(self, texts: list[str]) -> list[list[int]]:
        import tiktoken

        key = hash((self.definition, self.pattern))
        if key not in _loaded:
            special = {t["id"] for t in json.loads(self.definition)["added_tokens"]}
            ranks = {b: i for i, b in enumerate(self.token_bytes()) if i not in special}
            _loaded[key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [_loaded[key].encode_ordinary(" " + t) for t in texts]


@dataclass(frozen=True)
class PieceBpe:
    """A piece model, as base64 of its file; the model itself puts a space before every text."""

    model: str

    def _processor(self):
        import sentencepiece

        key = hash(self.model)
        if key not in _loaded:
            _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=base64.b64decode(self.model))
        return _loaded[key]

    def token_bytes(self) -> list[bytes]:
        held = self._processor()
        return [
            bytes([int(held.id_to_piece(i)[3:-1], 16)]) if held.is_byte(i) else held.id_to_piece(i).replace("▁", " ").encode()
            for i in range(held.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._processor().encode(texts, num_threads=1)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of both sides' tokens, given where they end; both sides end at the same byte."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)
    succ = np.concatenate((n + over_a, np.searchsorted(ends_a, ends_b)))
    last = np.flatnonzero(ends_b[over_a] == ends_a)
    succ[last] = last
    while True:
        further = succ[succ]
        if (further == succ).all():
            break
        succ = further
    label = np.searchsorted(last, succ)
    return label[:n], label[n:]


def _product(a: np.ndarray, b: np.ndarray, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, times) of all pairs of one large group, from its distinct ids."""
    ids_a, times_a = np.unique(a, return_counts=True)
    ids_b, times_b = np.unique(b, return_counts=True)
    step = max(1, PAIRS // len(ids_b))
    for at in range(0, len(ids_a), step):
        own = slice(at, at + step)
        yield (ids_a[own, None] * size_b + ids_b).ravel(), (times_a[own, None] * times_b).ravel()


def pairs(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, text_of: np.ndarray, size_b: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, code, times) of the linked id pairs, ``code`` being a * size_b + b; a pair may come several times.

    ``text_of`` names the text of every group; groups of both sides are in order.
    """
    count_a, count_b = (np.bincount(g, minlength=len(text_of)) for g in (group_a, group_b))
    start_a, start_b = (np.cumsum(c) - c for c in (count_a, count_b))
    links = count_a * count_b
    upto = np.cumsum(links)
    at = 0
    while at < len(links):
        if links[at] > PAIRS:
            own = (a[start_a[at] : start_a[at] + count_a[at]], b[start_b[at] : start_b[at] + count_b[at]])
            for codes, times in _product(*own, size_b):
                yield np.full(len(codes), text_of[at]), codes, times
            at += 1
            continue
        # The groups that follow, up to the next large one.
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - links[at] + PAIRS, side="right")))
        number = np.repeat(np.arange(at, to), links[at:to])
        place = np.arange(len(number)) - np.repeat(upto[at:to] - links[at:to] - (upto[at] - links[at]), links[at:to])
        one, two = np.divmod(place, count_b[number])
        codes = a[start_a[number] + one] * size_b + b[start_b[number] + two]
        text = text_of[number]
        # Distinct pairs of each text.
        order = np.lexsort((codes, text))
        codes, text = codes[order], text[order]
        first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (text[1:] != text[:-1]))))
        yield text[first], codes[first], np.diff(np.append(first, len(codes)))
        at = to


@dataclass
class _Sides:
    """Tables of a pair of tokenizers: bytes and lengths per id, and ids as text with what may follow them."""

    first: Tokenizer
    second: Tokenizer

    def __post_init__(self) -> None:
        self.bytes, self.lengths, self.printed = [], [], []
        for side, marks in ((self.first, (b",", b"|")), (self.second, (b",", b";", b""))):
            table = side.token_bytes()
            held = np.empty(len(table), dtype=object)
            held[:] = table
            self.bytes.append(held)
            self.lengths.append(np.array([len(t) for t in table], dtype=np.int64))
            printed = np.empty((len(marks), len(table)), dtype=object)
            for i, mark in enumerate(marks):
                printed[i] = [b"%d%s" % (k, mark) for k in range(len(table))]
            self.printed.append(printed)
        self.size_b = len(self.lengths[1])

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for every text that both reproduce."""
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        usable, words = [], []
        for i, text in enumerate(texts):
            try:
                words.append((text or b"").decode("utf-8"))
            except UnicodeDecodeError:
                continue
            usable.append(i)
            if not words[-1]:
                words.pop()
                usable.pop()
        if not words:
            return found
        for i, a, b in zip(usable, self.first.encode(words), self.second.encode(words)):
            own = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            want = b" " + texts[i]
            if all(len(ids) and b"".join(table[ids].tolist()) == want for ids, table in zip(own, self.bytes)):
                found[i] = own
        return found

    def sweep(self, texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts and digests of every text, and its distinct pairs: (text, code, times), sorted."""
        held = self.encode(texts)
        counts = {name: np.zeros(len(texts), dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [""] * len(texts)
        at = np.array([i for i, h in enumerate(held) if h is not None], dtype=np.int64)
        empty = (np.zeros(0, np.int64),) * 3
        if not len(at):
            return counts, digests, empty
        a, b = (np.concatenate([held[i][side] for i in at]) for side in (0, 1))
        counts["n_a"][at], counts["n_b"][at] = ([len(held[i][side]) for i in at] for side in (0, 1))
        group_a, group_b = groups(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        n = int(group_a[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        text_of = np.empty(n, dtype=np.int64)
        text_of[group_a] = np.repeat(at, counts["n_a"][at])
        counts["n_groups"] = np.bincount(text_of, minlength=len(texts))
        np.add.at(counts["n_links"], text_of, in_a * in_b)
        # Ids in the order group, side, place, each with the mark that follows it.
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        last_a = np.append(group_a[1:] != group_a[:-1], True).astype(np.int64)
        last_b = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
        text_b = text_of[group_b]
        last_b[np.append(text_b[1:] != text_b[:-1], True)] = 2
        printed = np.empty(len(a) + len(b), dtype=object)
        printed[np.arange(len(a)) + before_b[group_a]] = self.printed[0][last_a, a]
        printed[np.arange(len(b)) + before_a[group_b]] = self.printed[1][last_b, b]
        stops = np.cumsum(counts["n_a"][at] + counts["n_b"][at])
        for i, start, stop in zip(at.tolist(), np.concatenate(([0], stops[:-1])).tolist(), stops.tolist()):
            digests[i] = hashlib.sha256(b"".join(printed[start:stop].tolist())).hexdigest()
        del printed
        text, code, times = (np.concatenate(c) for c in zip(*pairs(a, b, group_a, group_b, text_of, self.size_b)))
        order = np.lexsort((code, text))
        text, code, times = text[order], code[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (text[1:] != text[:-1]))))
        return counts, digests, (text[first], code[first], np.add.reduceat(times, first))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
# ``places`` and ``times`` hold, text by text, the places of its pairs in the block's list and how often they occur.
_BLOCK_TYPE = pa.schema(
    [("block", pa.int64()), ("keys", pa.list_(pa.int64()))]
    + [(name, pa.list_(pa.int64())) for name in _COUNTS]
    + [("digests", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("places", pa.binary()), ("times", pa.binary())]
    + [("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("texts", pa.list_(pa.int32()))]
)
_BLOCKS = (
    "block bigint, keys array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "digests array<string>, lengths array<bigint>, places binary, times binary, a array<int>, b array<int>, texts array<int>"
)


def _block(number: int, parts: list[tuple], size_b: int) -> pa.RecordBatch:
    """The sweeps of a block as one row."""
    codes = np.concatenate([p[3][1] for p in parts])
    distinct, places, texts = np.unique(codes, return_inverse=True, return_counts=True)
    row = {
        "block": number,
        "keys": [k for p in parts for k in p[0]],
        "digests": [d for p in parts for d in p[2]],
        "lengths": np.concatenate([np.bincount(p[3][0], minlength=len(p[0])) for p in parts]).tolist(),
        "places": _packed(places),
        "times": _packed(np.concatenate([p[3][2] for p in parts])),
        "a": pa.array((distinct // size_b).astype(np.int32)),
        "b": pa.array((distinct % size_b).astype(np.int32)),
        "texts": pa.array(texts.astype(np.int32)),
    }
    row |= {name: np.concatenate([p[1][name] for p in parts]).tolist() for name in _COUNTS}
    one = pa.array([0, len(distinct)], pa.int32())
    arrays = [
        pa.ListArray.from_arrays(one, row[f.name]) if f.name in ("a", "b", "texts") else pa.array([row[f.name]], f.type) for f in _BLOCK_TYPE
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_BLOCK_TYPE)


def aligned_blocks(docs: DataFrame, first: Tokenizer, second: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of texts: their counts and digests, and the block's distinct pairs."""
    shipped = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number, parts, held = _Sides(*shipped.value), TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches):
            keys, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for start, stop in pieces_up_to([t or b"" for t in texts], SWEEP_BYTES):
                size = sum(len(t or b"") for t in texts[start:stop])
                if parts and held + size > BLOCK_BYTES:
                    yield _block(number, parts, sides.size_b)
                    number, parts, held = number + 1, [], 0
                parts.append((keys[start:stop], *sides.sweep(texts[start:stop])))
                held += size
        if parts:
            yield _block(number, parts, sides.size_b)

    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, _BLOCKS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text of every block, with the sums over its pairs."""
    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            keys = row["keys"].values
            best, total = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
            if row["found"].is_valid:
                found = row["found"].values
                place, held = found.field(0).to_numpy(), np.empty((2, len(found)), dtype=np.int64)
                held[0, place], held[1, place] = found.field(1).to_numpy(), found.field(2).to_numpy(zero_copy_only=False)
                places, times = _unpacked(row["places"].as_py()), _unpacked(row["times"].as_py())
                text = np.repeat(np.arange(len(keys)), row["lengths"].values.to_numpy())
                np.add.at(best, text, times * held[1, places])
                np.add.at(total, text, times * held[0, places])
            columns = [keys, *(row[name].values for name in _COUNTS), pa.array(best), pa.array(total), row["digests"].values]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, texts, best): in how many texts an id pair is linked, and whether no pair of ``a`` is in more."""
    listed = blocks.select(F.explode(F.arrays_zip("a", "b", "texts")).alias("p")).select("p.a", "p.b", "p.texts")
    counted, _ = write_stage(listed.groupBy("a", "b").agg(F.sum("texts").alias("texts")), "alignment-pairs")
    highest = counted.groupBy("a").agg(F.max("texts").alias("highest"))
    return counted.join(highest, "a").select("a", "b", "texts", (F.col("texts") == F.col("highest")).alias("best"))


def align(docs: DataFrame, first: Tokenizer, second: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    blocks, _ = write_stage(aligned_blocks(docs, first, second, key, text), "alignment-blocks")
    counted = small_side(pair_counts(blocks), "alignment-counts")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("block", "place", "p.a", "p.b")
    found = (
        listed.join(counted, ["a", "b"])
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "texts", "best")).alias("found"))
    )
    back = blocks.drop("a", "b", "texts").join(found, "block", "left")
    return back.mapInArrow(
        _sums,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    )
