"""Ranked lexical search with per-term geometric blocks.

The documents that hold a term of the query set are indexed in shards of ``SHARD`` documents, which are dealt by a similarity key (signs of a random
projection of the terms), so that like documents share a shard and a shard is bounded however frequent a term is. A shard keeps
each document's terms and impacts, and for every term its posting list, clustered by similarity: the list's documents go to the
nearest of evenly spaced pivots of the list. A cluster is a block; its summary is the largest impact of each term in it, over the terms that
stand in a query together with the block's term (no query reads others). The shards are a written table.

A search takes a shard at a time. The product of a query's weights with a summary bounds the score of every document in the block. Blocks are
visited from the highest bound on; documents of a visited block are scored whole from the shard's own lists. A block is skipped only
if its bound is below the k-th best score found so far, so the result is exact. A first pass visits the best blocks of every shard; the k-th
best score of a query in it is where all shards start from. Every shard returns its k best per query, which are merged.

Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); its impact in a document of n terms is
(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L. N counts the documents with a term, L their terms.

Queries go in blocks of about ``QUERY_TERMS`` distinct (query, term) pairs; a block's terms and weights are broadcast.

Defined cases: null, empty and term-less texts are no documents and no queries. Repeated rows are documents (queries) of their own. Equal scores
are ranked by ascending id, null last. A very long text is read in pieces, cut where no term is. Extra columns are ignored. Without
documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tables import slices, text_bytes
from threadloom.session import spread, write_stage

K = 20
SHARD = 8192
# Documents of a block, on average.
BLOCK = 64
DIMENSIONS = 16
SEED = 42
QUERY_TERMS = 1 << 20
# Bytes of a text that are split at a time.
PIECE = 1 << 22

# Letters, digits and everything beyond ASCII make up terms; A-Z become a-z; the rest separates.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    text = text.translate(_TERM)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to + 1


# -- the queries of a block ------------------------------------------------------------------------


def query_terms(queries: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """A stage table (query, id, term, times), ``query`` being a number of the row, and its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "id", "term", "times"]
        for batch in slices(batches):
            for number, own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                counts: dict[bytes, int] = {}
                for words in words_of(body or b""):
                    for word in words:
                        counts[word] = counts.get(word, 0) + 1
                n = len(counts)
                columns = [pa.array([number] * n, pa.int64()), pa.array([own] * n, pa.int64()), pa.array(list(counts), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=names)

    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    table, seen = write_stage(rows.mapInArrow(run, "query bigint, id bigint, term binary, times bigint"), "ranked-queries")
    return table, seen["rows"]


@dataclass
class QuerySet:
    """The queries of a block: their numbers, and per entry the place of the query, of the term, and how often it stands there."""

    numbers: np.ndarray
    terms: list[bytes]
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def projection(self) -> np.ndarray:
        return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (len(self.terms), DIMENSIONS))

    def by_term(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every term the queries that hold it, and all terms that stand in one of them."""
        order = np.argsort(self.term, kind="stable")
        askers = np.split(self.query[order], np.cumsum(np.bincount(self.term, minlength=len(self.terms)))[:-1])
        own = np.split(self.term[np.argsort(self.query, kind="stable")], np.cumsum(np.bincount(self.query, minlength=len(self.numbers)))[:-1])
        return [(a, np.unique(np.concatenate([self.term[:0], *(own[q] for q in a)]))) for a in askers]

    def matrix(self) -> np.ndarray:
        """Weights, a row per term and a column per query; products with impacts stay far below 2^53, so they are exact."""
        held = np.zeros((len(self.terms), len(self.numbers)))
        held[self.term, self.query] = self.weights[self.term] * self.times
        return held


def _query_set(entries: DataFrame) -> QuerySet:
    held = entries.toPandas()
    numbers, query = np.unique(held["query"].to_numpy(), return_inverse=True)
    terms = sorted(set(map(bytes, held["term"])))
    place = {t: i for i, t in enumerate(terms)}
    return QuerySet(numbers, terms, query, np.array([place[bytes(t)] for t in held["term"]], dtype=np.int64), held["times"].to_numpy())


# -- the index -------------------------------------------------------------------------------------


def forward(docs: DataFrame, queries: QuerySet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, near, terms, tf) of every row with a term: its number of terms, its similarity key, and its indexed terms."""
    shipped = docs.sparkSession.sparkContext.broadcast((queries.terms, queries.projection()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, signs = shipped.value
        place = {t: i for i, t in enumerate(terms)}.get
        bits = 1 << np.arange(DIMENSIONS)
        names = ["doc_id", "n", "near", "terms", "tf"]
        for batch in slices(batches):
            out: list[tuple] = []
            for key_, body in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                n, found = 0, []
                for words in words_of(body or b""):
                    n += len(words)
                    own = np.fromiter(map(place, words, repeat(-1)), dtype=np.int32, count=len(words))
                    found.append(own[own >= 0])
                if n:
                    held, tf = np.unique(np.concatenate(found), return_counts=True)
                    near = int(bits[signs[held].sum(axis=0) > 0].sum())
                    out.append((key_, n, near, held, tf))
            if out:
                ids, n, near, held, tf = zip(*out)
                start = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in held]))), pa.int32())
                lists = [pa.ListArray.from_arrays(start, pa.array(np.concatenate(c).astype(np.int32))) for c in (held, tf)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(near, pa.int32()), *lists], names=names)

    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, near int, terms array<int>, tf array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impact of each posting, given its document's number of terms."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start .. start + count - 1 of every pair, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


@dataclass
class Shard:
    """Documents with their terms, and the blocks of every term's posting list.

    ``start`` cuts ``terms`` and ``values`` into documents; ``lists`` cuts ``blocks`` into terms; ``members`` of block i are
    ``documents[blocks[i]:blocks[i + 1]]``. ``summary`` holds the summaries of a term's blocks, a row each, term after term.
    """

    ids: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    lists: np.ndarray
    blocks: np.ndarray
    members: np.ndarray
    summary: np.ndarray

    _KINDS = {"start": "<i8", "terms": "<i4", "values": "<i4", "lists": "<i8", "blocks": "<i8", "members": "<i4", "summary": "<i4"}

    @classmethod
    def build(cls, ids: np.ndarray, start: np.ndarray, terms: np.ndarray, values: np.ndarray, signs: np.ndarray, together: list[np.ndarray]) -> Shard:
        """``together`` names for each term the terms its summaries need."""
        counts = np.diff(start)
        holder = np.repeat(np.arange(len(ids)), counts)
        # A document's direction: the sum of its terms' signs, over its length.
        direction = np.zeros((len(ids), DIMENSIONS), dtype=np.float32)
        for d in range(DIMENSIONS):
            direction[:, d] = np.bincount(holder, weights=signs[terms, d], minlength=len(ids))
        direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-9)
        order = np.argsort(terms, kind="stable")
        posting = np.split(holder[order], np.cumsum(np.bincount(terms, minlength=len(together)))[:-1])
        column = np.full(len(together), -1, dtype=np.int64)
        lists, sizes, members, summary = [0], [], [], []
        for listed, needed in zip(posting, together):
            if not len(listed):
                lists.append(lists[-1])
                continue
            pivots = direction[listed[::BLOCK]]
            block = (direction[listed] @ pivots.T).argmax(axis=1)
            _, block = np.unique(block, return_inverse=True)
            by_block = np.argsort(block, kind="stable")
            members.append(listed[by_block])
            own = np.bincount(block)
            sizes.append(own)
            lists.append(lists[-1] + len(own))
            highest = np.zeros((len(own), len(needed)), dtype=np.int32)
            column[needed] = np.arange(len(needed))
            at = _ranges(start[listed], counts[listed])
            to = column[terms[at]]
            read = to >= 0
            np.maximum.at(highest.reshape(-1), np.repeat(block * len(needed), counts[listed])[read] + to[read], values[at[read]])
            column[needed] = -1
            summary.append(highest.reshape(-1))
        joined = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (sizes, members, summary))
        all_sizes, all_members, all_summary = joined
        return cls(ids, start, terms, values, np.array(lists), np.concatenate(([0], np.cumsum(all_sizes))), all_members, all_summary)

    def search(
        self, queries: np.ndarray, by_term: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray, probe: bool = False
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, places, scores, blocks skipped) for every query that holds one of the shard's terms: its k best documents and ties.

        ``floor`` is a score for each query that its k-th best document is known to reach. A probe stops after the first blocks.
        """
        asks, bounds, block_of = [], [], []
        at = 0
        for t, (askers, needed) in enumerate(by_term):
            first, last = int(self.lists[t]), int(self.lists[t + 1])
            if first == last:
                continue
            own = self.summary[at : at + (last - first) * len(needed)].reshape(last - first, len(needed)).astype(np.float64)
            at += own.size
            bounds.append((own @ queries[np.ix_(needed, askers)]).T.ravel())
            asks.append(np.repeat(askers, last - first))
            block_of.append(np.tile(np.arange(first, last), len(askers)))
        if not asks:
            return
        asks, bounds, block_of = (np.concatenate(c) for c in (asks, bounds, block_of))
        order = np.lexsort((-bounds, asks))
        asks, bounds, block_of = asks[order], bounds[order], block_of[order]
        size = np.diff(self.blocks)
        counts = np.diff(self.start)
        cuts = np.flatnonzero(np.diff(asks)) + 1
        for first, last in zip(np.concatenate(([0], cuts)).tolist(), np.append(cuts, len(asks)).tolist()):
            weights = queries[:, asks[first]]
            seen = np.zeros(len(self.ids), dtype=bool)
            places, scores = np.zeros(0, np.int64), np.zeros(0)
            least, step, visited = float(floor[asks[first]]), first, 0
            while step < last and bounds[step] >= least:
                # Enough of the next blocks to double what was seen, among those whose bound does not fail.
                open_to = step + int(np.searchsorted(-bounds[step:last], -least, side="right"))
                upto = step + 1 + int(np.searchsorted(np.cumsum(size[block_of[step:open_to]]), max(k, 2 * int(seen.sum()))))
                taken = block_of[step : min(upto, open_to)]
                visited += len(taken)
                step += len(taken)
                found = np.unique(self.members[_ranges(self.blocks[taken], size[taken])])
                found = found[~seen[found]]
                if not len(found):
                    continue
                seen[found] = True
                entries = _ranges(self.start[found], counts[found])
                products = self.values[entries] * weights[self.terms[entries]]
                reached = np.add.reduceat(products, np.cumsum(counts[found]) - counts[found])
                places, scores = np.append(places, found), np.append(scores, reached)
                if len(scores) >= k:
                    least = max(least, np.partition(scores, -k)[-k])
                    stay = scores >= least
                    places, scores = places[stay], scores[stay]
                if probe:
                    break
            good = (scores > 0) & (scores >= floor[asks[first]])
            yield int(asks[first]), places[good], scores[good].astype(np.int64), last - first - visited

    def row(self) -> dict:
        """The shard as a row of compressed arrays."""
        pack = zstandard.ZstdCompressor(level=1).compress
        held = {name: pack(np.ascontiguousarray(getattr(self, name)).astype(kind).tobytes()) for name, kind in self._KINDS.items()}
        return {"ids": [None if i is None else int(i) for i in self.ids], **held}

    @classmethod
    def of(cls, row: dict) -> Shard:
        unpack = zstandard.ZstdDecompressor().decompress
        return cls(np.array(row["ids"], dtype=object), *(np.frombuffer(unpack(row[name]), kind) for name, kind in cls._KINDS.items()))


_SHARD_TYPE = pa.schema([("ids", pa.list_(pa.int64()))] + [(name, pa.binary()) for name in Shard._KINDS])
_SHARD = "ids array<bigint>, " + ", ".join(f"{name} binary" for name in Shard._KINDS)


def build_index(held: DataFrame, queries: QuerySet, documents: int, length: int) -> DataFrame:
    """Shards of the rows of ``forward``, one row each."""
    spark = held.sparkSession
    shipped = spark.sparkContext.broadcast((queries.projection(), [needed for _, needed in queries.by_term()]))

    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        counts = np.diff(table["terms"].combine_chunks().offsets.to_numpy())
        start = np.concatenate(([0], np.cumsum(counts)))
        terms, tf = (table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        values = impacts(tf, np.repeat(table["n"].to_numpy(), counts), documents, length)
        built = Shard.build(np.array(table["doc_id"].to_pylist(), dtype=object), start, terms, values, *shipped.value)
        return pa.RecordBatch.from_pylist([built.row()], schema=_SHARD_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, SHARD - n), batch.slice(SHARD - n)
                rows.append(part)
                n += part.num_rows
                if n == SHARD:
                    yield shard(rows)
                    rows, n = [], 0
        if n:
            yield shard(rows)

    useful = held.where(F.size("terms") > 0)
    dealt = useful.repartitionByRange(max(1, math.ceil(documents / SHARD)), "near", F.xxhash64("doc_id", "terms"))
    return dealt.sortWithinPartitions("near").select("doc_id", "n", "terms", "tf").mapInArrow(run, _SHARD)


# -- search ----------------------------------------------------------------------------------------


def search_index(index: DataFrame, queries: QuerySet, k: int = K, floor: np.ndarray | None = None, probe: bool = False) -> DataFrame:
    """(query, doc_id, score, skipped): every shard's ``k`` best documents of every query, and how many of the query's blocks it skipped."""
    floor = np.zeros(len(queries.numbers)) if floor is None else floor
    shipped = index.sparkSession.sparkContext.broadcast((queries.numbers, queries.matrix(), queries.by_term(), floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, matrix, by_term, least = shipped.value
        names = ["query", "doc_id", "score", "skipped"]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.of(batch.slice(i, 1).to_pylist()[0])
                out: list[tuple] = []
                for query, places, scores, skipped in shard.search(matrix, by_term, k, least, probe):
                    best = sorted(zip((-scores).tolist(), shard.ids[places].tolist()), key=lambda r: (r[0], r[1] is None, r[1] or 0))[:k]
                    out += [(int(numbers[query]), doc, -score, skipped) for score, doc in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return index.mapInArrow(run, "query bigint, doc_id bigint, score bigint, skipped bigint")


def floors(index: DataFrame, queries: QuerySet, k: int = K) -> np.ndarray:
    """For every query the k-th best score among the blocks of the highest bounds of all shards; 0 if these hold fewer documents."""
    probed, _ = write_stage(search_index(index, queries, k, probe=True), "ranked-probe")
    order = Window.partitionBy("query").orderBy(F.col("score").desc())
    reached = probed.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query", "score").toPandas()
    floor = np.zeros(len(queries.numbers))
    floor[np.searchsorted(queries.numbers, reached["query"].to_numpy())] = reached["score"].to_numpy()
    return floor


def rank(docs: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every query, best first."""
    entries, total = query_terms(queries, item, text)
    blocks = max(1, math.ceil(total / QUERY_TERMS))
    found: DataFrame | None = None
    for number in range(blocks):
        asked = _query_set(entries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "term", "times"))
        if not asked.terms:
            continue
        held, seen = write_stage(forward(docs, asked, key, text), "ranked-forward", length=F.coalesce(F.sum("n"), F.lit(0)))
        df = {r["term"]: r["n"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        documents, length = seen["rows"], seen["length"]
        asked.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(asked.terms))])
        index, _ = write_stage(build_index(held, asked, documents, length), "ranked-index")
        best, _ = write_stage(search_index(index, asked, k, floors(index, asked, k)), "ranked-best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(entries.select("query", F.col("id").alias("item_id")).distinct(), "query").select("item_id", "rank", "doc_id", "score")
