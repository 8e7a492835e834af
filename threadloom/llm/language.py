"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text, all of them, in the tasks; a task emits its counts per (language,
feature) and Spark adds them up. The matrix of log-probabilities has a row per feature and a column per language, so its size is
bounded by ``FEATURES`` times the languages; it is broadcast. A batch is scored in numpy: each text becomes its sparse counts,
whose product with the matrix gives the log-likelihoods.

Letters are lower-cased; everything else counts as a space, and n-grams without a letter do not count.

Defined cases: a null text or one without a letter is ``und`` with score 0 and teaches nothing; so does a text without a language. Without
any training text every text is ``und``. Equal scores go to the first language by code point. Repeated rows count as often as they occur.
A very long text is counted in pieces. Extra columns are ignored; the language column is read only by ``fit``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import slices
from threadloom.session import spread

BITS = 15
FEATURES = 1 << BITS
SMOOTHING = 0.5
# Characters of a text that are hashed at a time.
PIECE = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def features(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    for start in range(0, len(text), PIECE):
        # Two characters of the piece before, so that no n-gram is cut.
        lower = text[max(0, start - 2) : start + PIECE].lower()
        c = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _is_letter()[c]
        c = np.where(letter, c, 32).astype(np.uint32)
        skip = min(start, 2)
        edge = np.array([32], dtype=np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = c * np.uint32(0x85EBCA6B)
        before = np.concatenate((edge, c[:-1])) * np.uint32(0xC2B2AE35)
        first = np.concatenate((edge, edge, c[:-2]))[: len(c)] * np.uint32(0x27D4EB2F)
        had = np.concatenate(([False], letter[:-1]))
        shift = np.uint32(32 - BITS)
        for gram, counted in (
            (one * np.uint32(0x165667B1), letter),
            ((before + two) * np.uint32(0x9E3779B1), letter | had),
            ((first + before + two + np.uint32(77)) * np.uint32(0x2C1B3C6D), had),
        ):
            counts += np.bincount(gram[skip:][counted[skip:]] >> shift, minlength=FEATURES)
    return counts


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log-probability of every feature in each of them."""

    languages: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row of ``docs`` with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in slices(batches):
            for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not _LETTER.search(body):
                    continue
                if name not in sums:
                    sums[name], seen[name] = np.zeros(FEATURES, dtype=np.int64), 0
                sums[name] += features(body)
                seen[name] += 1
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array([-1, *at], pa.int32()), pa.array([seen[name], *total[at]], pa.int64())],
                names=["lang", "feature", "n"],
            )

    rows = spread(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL"))
    counted = rows.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.zeros((FEATURES, len(languages)))
    texts = np.zeros(len(languages))
    for k, name in enumerate(languages):
        own = table[table["lang"] == name]
        grams = own[own["feature"] >= 0]
        counts[grams["feature"].to_numpy(), k] = grams["n"].to_numpy()
        texts[k] = own.loc[own["feature"] < 0, "n"].sum()
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * FEATURES)
    return Model(languages, matrix, np.log(texts / texts.sum()) if len(texts) else texts)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``score`` is the posterior of the predicted language."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def one(body: str | None, m: Model) -> tuple[str, float]:
        if body is None or not m.languages or not _LETTER.search(body):
            return UNKNOWN, 0.0
        counts = features(body)
        at = np.flatnonzero(counts)
        likelihood = counts[at] @ m.matrix[at] + m.prior
        best = int(np.argmax(likelihood))
        return m.languages[best], float(1 / np.exp(likelihood - likelihood[best]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in slices(batches):
            found = [one(body, m) for body in batch.column(1).to_pylist()]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
