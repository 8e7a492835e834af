"""Quality classifier from weak labels.

1. *Labellers.* Eight heuristics look at a text and vote good, bad or abstain. Votes are counted per pattern of votes, of which there
   are at most 3^8, so the counts are bounded at any size of the corpus.
2. *Label model.* Expectation-maximisation estimates, from these counts alone, how often each labeller votes what on good and
   on bad texts, and the share of good texts. It starts from texts without a vote for bad as the good ones.
3. *Scorer.* The posterior of a text's votes is a soft label. A logistic scorer over hashed words, word shapes and repeats learns these
   labels on a sample of at most about ``SAMPLE`` rows, drawn by hash; the counts of step 1 cover all rows.
4. All rows are scored with the broadcast weights. No given label is read.

Defined cases: null and empty texts, and texts without a word, score 0 and are rejected. Texts that no labeller votes on
get the share of good texts as their label. An empty table gives an empty result. Repeated rows vote as often as they occur. Long texts
are looked at in pieces whose counts add up. Extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import pieces_up_to, slices, text_bytes
from threadloom.session import spread

# Rows that the scorer learns from.
SAMPLE = 6_000
FEATURES = 1 << 16
# Bytes of text that are looked at together.
PIECE = 1 << 19
LABELLERS = 8
GOOD, BAD, ABSTAIN = 1, 0, -1
KEEP = 0.25
# Frequent words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by this from at or an have not "
    "der die und das in zu den ist von mit sich des auf für im dem nicht ein eine als "
    "de la le et les des en un une que est pour dans qui sur par pas avec au du "
    "el y los se del las por con para como su lo más o una al es"
).split()

_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _classes() -> np.ndarray:
    """Class of a byte: 0 white space, 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 sentence sign, 5 other sign."""
    table = np.full(256, 5, dtype=np.uint8)
    table[[32, 9, 10, 11, 12, 13]] = 0
    table[97:123] = 1
    table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[[ord(c) for c in ".,;:?'\"-()"]] = 4
    return table


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a batch of texts: their text, length, 64-bit hash in lower case, and class of the first and last bytes."""

    text: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    shape: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    signs: np.ndarray
    ends: np.ndarray


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(texts: list[bytes]) -> Words:
    """All words, hashed by prefix sums: a word's hash is the sum of its bytes times powers of a prime, modulo 2^64."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _CLASS[data]
    blank = kind == 0
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    with np.errstate(over="ignore"):
        value = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(len(data), _PRIME)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        inverse = _powers(len(data), _INVERSE)
        hashes = (sums[stops] - sums[starts]) * inverse[starts]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate((np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)))
        return c[stops] - c[starts]

    text_starts = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    length = stops - starts
    first, last = kind[starts], kind[stops - 1]
    before = np.where(length > 1, kind[np.maximum(stops - 2, starts)], 0)
    shape = ((first.astype(np.int64) * 6 + before) * 6 + last) * 16 + np.minimum(length, 15)
    return Words(
        np.searchsorted(text_starts, starts, side="right") - 1,
        length, hashes, shape, count(kind == 2), count(kind == 1), count(kind == 5), (last == 4).astype(np.int64),
    )


def _cut(text: bytes) -> list[bytes]:
    """A text in pieces of bounded size that end at white space, if there is any."""
    out = []
    while len(text) > PIECE:
        at = text.rfind(b" ", 1, PIECE)
        at = at if at > 0 else PIECE
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def batches_of(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, Words]]:
    """Words of bounded groups of pieces, with the number of the row that each piece is from."""
    pieces, rows = [], []
    for i, text in enumerate(texts):
        for piece in _cut(text or b""):
            pieces.append(piece)
            rows.append(i)
    owner = np.array(rows, dtype=np.int64)
    for start, stop in pieces_up_to(pieces, PIECE):
        words = words_of(pieces[start:stop])
        yield owner[start:stop][words.text], words


_stop: list[np.ndarray] = []


def _stop_hashes() -> np.ndarray:
    if not _stop:
        _stop.append(np.unique(words_of([w.encode() for w in STOP_WORDS]).hash))
    return _stop[0]


def measures(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Sums over the words of each text."""
    n = len(texts)
    out = {k: np.zeros(n) for k in ("words", "bytes", "upper", "lower", "signs", "repeats", "distinct", "stops", "ends")}
    for row, w in batches_of(texts):
        add = lambda k, v: out.__setitem__(k, out[k] + np.bincount(row, weights=v, minlength=n))
        again = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1]))) if len(row) else np.zeros(0, bool)
        known = _stop_hashes()
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        add("words", np.ones(len(row)))
        add("bytes", w.length)
        add("upper", w.upper)
        add("lower", w.lower)
        add("signs", w.signs)
        add("repeats", again)
        order = np.lexsort((w.hash, row))
        new = np.ones(len(row), dtype=bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
        add("distinct", new[np.argsort(order)])
        add("stops", known[at] == w.hash)
        add("ends", w.ends)
    return out


def votes(texts: list[bytes | None]) -> np.ndarray:
    """One row a text, one column a labeller."""
    m = measures(texts)
    words, letters = np.maximum(m["words"], 1), np.maximum(m["upper"] + m["lower"], 1)
    enough = m["words"] >= 20

    def judge(value: np.ndarray, good: np.ndarray, bad: np.ndarray, when: np.ndarray) -> np.ndarray:
        return np.where(~when, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))

    shouting, signs = m["upper"] / letters, m["signs"] / words
    # Of n words of prose, about the power 0.8 of n are distinct.
    repeats, distinct = m["repeats"] / words, m["distinct"] / words**0.8
    stops, ends, length = m["stops"] / words, m["ends"] / words, m["bytes"] / words
    some = m["words"] > 0
    return np.stack(
        [
            judge(shouting, shouting < 0.1, shouting > 0.3, some),
            judge(signs, signs < 0.03, signs > 0.15, some),
            judge(repeats, repeats < 0.02, repeats > 0.1, enough),
            judge(distinct, distinct > 0.7, distinct < 0.4, m["words"] >= 30),
            judge(stops, stops > 0.12, stops < 0.04, enough),
            judge(ends, (ends > 0.03) & (ends < 0.5), (ends < 0.01) | (ends > 0.7), enough),
            judge(length, (length > 3) & (length < 9), (length < 2) | (length > 14), enough),
            np.where(some, ABSTAIN, BAD),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and the chance of each vote (bad, good, abstain) of each labeller on bad and on good texts."""

    good: float
    chance: np.ndarray  # labeller x (bad, good) x vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes is good."""
        spoken = (patterns != ABSTAIN)[:, :, None]
        logs = np.log(self.chance)[np.arange(patterns.shape[1]), :, patterns]
        both = (logs * spoken).sum(axis=1) + np.log([1 - self.good, self.good])
        both -= both.max(axis=1, keepdims=True)
        both = np.exp(both)
        return both[:, 1] / both.sum(axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over counted vote patterns. An abstention says nothing about the text."""
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    belief = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    share, chance = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        mass = np.stack((counts * (1 - belief), counts * belief))
        share = float((mass[1].sum() + 1) / (mass.sum() + 2))
        for vote in (BAD, GOOD):
            chance[:, :, vote] = ((patterns == vote).T[:, None, :] * mass[None]).sum(axis=2) + 1
        spoken = chance[:, :, [BAD, GOOD]].sum(axis=2, keepdims=True)
        chance[:, :, [BAD, GOOD]] /= spoken
        chance[:, :, ABSTAIN] = 1.0
        after = LabelModel(share, chance).posterior(patterns)
        done = not len(after) or np.abs(after - belief).max() < tolerance
        belief = after
        if done:
            break
    return LabelModel(share, chance)


def count_votes(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all rows and how often each occurs: at most 3^8 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[int, ...]] = Counter()
        for batch in slices(batches):
            sums.update(map(tuple, votes(text_bytes(batch.column(0))).tolist()))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(list, sums)), pa.list_(pa.int64())), pa.array(list(sums.values()), pa.int64())], names=["votes", "n"]
            )

    rows = spread(docs.select(F.col(text).alias("text")))
    table = rows.mapInArrow(run, "votes array<bigint>, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    return np.array([r["votes"] for r in table], dtype=np.int64).reshape(len(table), LABELLERS), np.array([r["n"] for r in table], dtype=np.float64)


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, value): words, shapes and repeats, hashed; the values of a text have length 1."""
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, w in batches_of(texts):
        again = np.concatenate(([False], (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1]))) if len(row) else np.zeros(0, bool)
        shape = w.shape.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        kinds = (w.hash, shape, np.full(int(again.sum()), 0xA0761D6478BD642F, dtype=np.uint64))
        for number, (at, key) in enumerate(zip((row, row, row[again]), kinds)):
            with np.errstate(over="ignore"):
                key = (key + np.uint64(number)) * np.uint64(0xE7037ED1A0B428DB)
            # A piece of text is reduced to its distinct features before the next one is looked at.
            both, n = np.unique(at * FEATURES + (key >> np.uint64(48)).astype(np.int64), return_counts=True)
            found.append(both)
            counts.append(n)
    both, place = np.unique(np.concatenate(found), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate(counts), minlength=len(both))
    row, feature = both // FEATURES, both % FEATURES
    value = np.sqrt(n / np.maximum(np.bincount(row, weights=n), 1)[row]) if len(row) else n
    return row, feature, value


def fit_scorer(row, feature, value, target, rounds: int = 150, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft targets, by Adam on the whole sample."""
    n, weight = len(target), np.zeros(FEATURES + 1)
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    # Both classes weigh alike, however rare one is.
    share = float(np.clip(target.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    balance = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    for step in range(1, rounds + 1 if n else 1):
        z = np.bincount(row, weights=value * weight[feature], minlength=n) + weight[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * balance / n
        gradient = np.concatenate((np.bincount(feature, weights=value * error[row], minlength=FEATURES), [error.sum()])) + decay * weight
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return weight


@dataclass(frozen=True)
class Scorer:
    labels: LabelModel
    weight: np.ndarray

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        row, feature, value = hashed(texts)
        z = np.bincount(row, weights=value * self.weight[feature], minlength=len(texts)) + self.weight[-1]
        some = np.bincount(row, minlength=len(texts)) > 0
        return np.where(some, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Scorer:
    """Label model from the votes of all rows; scorer from about ``sample`` rows drawn by hash of id and text."""
    patterns, counts = count_votes(docs, text)
    labels = fit_labels(patterns, counts)
    total = counts.sum()
    share = min(1.0, sample / total) if total else 1.0
    shipped = docs.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column(1))
            row, feature, value = hashed(texts)
            cuts = np.searchsorted(row, np.arange(len(texts) + 1))
            target = shipped.value.posterior(votes(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([feature[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32())),
                    pa.array([value[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.float32())),
                    pa.array(target, pa.float64()),
                ],
                names=["h", "feature", "value", "target"],
            )

    drawn = docs.select(F.xxhash64(F.lit(101), key, text).alias("h"), F.col(text).alias("text"))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    table = drawn.mapInArrow(run, "h bigint, feature array<int>, value array<float>, target double").toPandas().sort_values("h", kind="stable")
    sizes = table["feature"].map(len).to_numpy() if len(table) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(table)), sizes)
    flat = lambda c, kind: np.concatenate(table[c].to_list()).astype(kind) if len(table) else np.zeros(0, kind)
    return Scorer(labels, fit_scorer(row, flat("feature", np.int64), flat("value", np.float64), table["target"].to_numpy(dtype=np.float64)))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, label, score, kept) of every row; ``label`` is the posterior of the votes."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column(1))
            value = shipped.value.score(texts)
            label = shipped.value.labels.posterior(votes(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label, pa.float64()), pa.array(value, pa.float64()), pa.array(value >= keep)],
                names=["doc_id", "label", "score", "kept"],
            )

    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, label double, score double, kept boolean")


def keep_good(docs: DataFrame, scorer: Scorer, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shipped.value.score(text_bytes(batch.column(at))) >= keep))

    return spread(docs).mapInArrow(run, docs.schema)
