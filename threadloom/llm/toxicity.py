"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns the words and marks of a text into classes: insult, weak insult, threat, intention, target, negation, report, quotation mark,
end of clause, end of sentence, other. Six small transducers rewrite the sequence of classes:

* threat: a threat after an intention in its clause is a strong one;
* negation: an abusive word up to ``REACH`` words after a negation is negated;
* reported speech: one between quotation marks, or after a verb of saying in its sentence, is reported;
* target: the end of a clause tells whether the clause names a person addressed or talked about;
* insult and clause: the end of a clause becomes the clause's strongest insult or threat.

They are composed into one deterministic transducer, which reads a text once and puts out matched clauses; a word alone scores nothing.
A text's counts of matched clauses, by kind, go into a logistic score.

Learning from labelled texts: words, and beginnings that longer words share, extend the insults if they are much more frequent in toxic
texts (``LEAST_TEXTS``, ``LEAST_ODDS``, ``STRONG``, ``WEAK``). Candidates are the ``CANDIDATES`` most frequent ones of the toxic texts. Near copies count once: of labelled texts with the
same smallest shingle hash one teaches. The kinds' weights are fitted to the counts of equal feature vectors, with a ridge
towards ``PRIOR``. Both learn from at most ``SAMPLE`` labelled rows, those of the smallest id hashes, so that only the texts of
these are moved; texts are scored where they lie, all of them.

Defined cases: null, empty and word-less texts have no clause and the score of a text without any. A label without an id, or
other than 0 and 1, teaches nothing; without labels the weights are the prior ones and the lexicon is the given one. Repeated rows teach once
and are scored each; of an id with both labels, both teach. A very long text is read in pieces, with the transducer's state carried over. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import slices
from threadloom.session import spread, write_stage

REACH = 3
# Lengths of the beginnings that longer words may share.
STEMS = range(4, 9)
LEAST_TEXTS = 5
LEAST_ODDS = math.log(3)
# Share of toxic texts among those that hold a word, from which it is an insult or a weak one.
STRONG, WEAK = 0.7, 0.4
CANDIDATES = 50_000
# Clauses of a kind that are told apart.
MOST = 4
RIDGE = 1.0
# Labelled rows that are learned from.
SAMPLE = 40_000
# Characters of a text that are read at a time, and words whose class is remembered.
PIECE = 1 << 18
REMEMBERED = 1 << 19

# Small word lists in four languages.
INSULTS = """idiot moron stupid loser trash scum clown worthless pathetic disgusting fool dumb imbecile jerk coward vermin filth
trottel dumm blöd abschaum versager widerlich wertlos imbécile débile minable ordure répugnant estúpido imbécil basura asqueroso patético""".split()
THREATS = """kill hurt destroy murder strangle shoot stab burn töten umbringen verletzen verprügeln tuer frapper détruire matar golpear destruir""".split()
INTENTIONS = """will shall gonna going i'll we'll werde werden wirst vais allons vas voy vamos vas""".split()
TARGETS = """you your you're he she they them him her his their u du dich dir dein ihr euch sie er tu toi vous ton votre il elle ils elles
tú ti usted ustedes él ella ellos ellas""".split()
NEGATIONS = """not no never don't doesn't isn't aren't wasn't ain't nicht kein keine nie pas jamais aucun nunca ningún tampoco""".split()
REPORTS = """said says say called calls wrote writes claimed claims sagte sagt schrieb nannte dit écrit appelle dijo dice escribió llamó""".split()

OTHER, INSULT, FAINT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE, CLAUSE, SENTENCE = range(11)
ABUSE = frozenset((INSULT, FAINT, THREAT))
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…\n,;:|()\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARKS = dict.fromkeys('"“”„«»', QUOTE) | dict.fromkeys(",;:|()", CLAUSE) | dict.fromkeys(".!?…\n", SENTENCE)

# Kinds of matched clauses, weakest first, and a last one for clauses that also name a target.
KINDS = ("reported", "negated", "faint threat", "faint insult", "threat", "insult", "targeted")
# Log-odds without any clause, and per kind of clause, before labels are seen.
PRIOR = np.array([-3.0, 0.4, 0.4, 0.8, 1.2, 2.5, 3.0, 0.8])


# -- transducers -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the symbol put out and the next state; it starts in ``start``."""

    start: Hashable
    step: Callable[[Hashable, Hashable], tuple[Hashable, Hashable]]

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this one puts out."""

        def step(state, symbol):
            out, own = self.step(state[0], symbol)
            out, its = other.step(state[1], out)
            return out, (own, its)

        return Transducer((self.start, other.start), step)

    def table(self, symbols: range) -> tuple[list[list[int]], list[list[Hashable]]]:
        """Next states and outputs of all states that can be reached, as lists by state and symbol."""
        number, following, outputs = {self.start: 0}, [], []
        for state in (waiting := [self.start]):
            steps = [self.step(state, s) for s in symbols]
            for _, then in steps:
                if then not in number:
                    number[then] = len(number)
                    waiting.append(then)
            following.append([number[then] for _, then in steps])
            outputs.append([out for out, _ in steps])
        return following, outputs


def _threat(intends, symbol):
    if symbol in (CLAUSE, SENTENCE):
        return symbol, False
    if symbol == THREAT:
        return ("threat" if intends else "faint threat"), intends
    if symbol in (INSULT, FAINT):
        return ("insult" if symbol == INSULT else "faint insult"), intends
    return symbol, intends or symbol == INTENT


def _negation(left, symbol):
    if symbol in (CLAUSE, SENTENCE):
        return symbol, 0
    if symbol == NEGATION:
        return OTHER, REACH
    if isinstance(symbol, str) and left:
        return "negated", left - 1
    return symbol, left if symbol == QUOTE else max(0, left - 1)


def _reported(state, symbol):
    if symbol == SENTENCE:
        return symbol, "plain"
    if symbol == QUOTE:
        return OTHER, "plain" if state == "quoted" else "quoted"
    if symbol == REPORT:
        return OTHER, "told" if state == "plain" else state
    if isinstance(symbol, str) and state != "plain":
        return "reported", state
    return symbol, state


def _target(named, symbol):
    if symbol in (CLAUSE, SENTENCE):
        return ("end", named), False
    return symbol, named or symbol == TARGET


def _clause(strongest, symbol):
    if isinstance(symbol, tuple):
        return (None if strongest < 0 else (strongest, symbol[1])), -1
    return None, max(strongest, KINDS.index(symbol)) if isinstance(symbol, str) else strongest


def grammar() -> Transducer:
    """The composed transducer: at the end of a matched clause (kind, whether a target is named), else None."""
    parts = (Transducer(False, _threat), Transducer(0, _negation), Transducer("plain", _reported), Transducer(False, _target), Transducer(-1, _clause))
    composed = parts[0]
    for part in parts[1:]:
        composed = composed >> part
    return composed


# -- lexicon and model -------------------------------------------------------------------------------


@dataclass
class Model:
    """Classes of words and of beginnings, and the weights of the kinds (the first is the constant)."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    @classmethod
    def given(cls) -> Model:
        lists = ((TARGETS, TARGET), (INTENTIONS, INTENT), (REPORTS, REPORT), (NEGATIONS, NEGATION), (THREATS, THREAT), (INSULTS, INSULT))
        return cls({word: kind for words, kind in lists for word in words})


class _Classes(dict):
    """Class of a token, worked out once."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = _MARKS.get(token)
        if found is None:
            found = self.model.words.get(token.replace("’", "'"))
        if found is None:
            held = [self.model.stems[token[:n]] for n in STEMS if n < len(token) and token[:n] in self.model.stems]
            found = min(held, default=OTHER)
        self[token] = found
        return found


def _pieces(text: str) -> Iterator[str]:
    """The lower-cased text in pieces that end where a line or a word ends."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and (text[to].isalpha() or text[to] in "'’"):
            to += 1
        yield text[at:to].lower()
        at = to


class Reader:
    """Counts the matched clauses of texts."""

    def __init__(self, model: Model) -> None:
        self.classes = _Classes(model)
        self.following, self.outputs = grammar().table(range(SENTENCE + 1))

    def clauses(self, text: str | None) -> list[tuple[int, bool]]:
        """(kind, whether a target is named) of every matched clause."""
        state, found = 0, []
        following, outputs = self.following, self.outputs
        for piece in _pieces(text or ""):
            symbols = list(map(self.classes.__getitem__, _TOKEN.findall(piece)))
            if len(text) <= PIECE and ABUSE.isdisjoint(symbols):
                return found
            for symbol in symbols:
                out = outputs[state][symbol]
                if out is not None:
                    found.append(out)
                state = following[state][symbol]
        out = outputs[state][SENTENCE]
        return found if out is None else [*found, out]

    def features(self, text: str | None) -> tuple[int, ...]:
        """Number of matched clauses of every kind, at most ``MOST``."""
        counts = [0] * len(KINDS)
        for kind, named in self.clauses(text):
            counts[kind] += 1
            counts[-1] += named
        return tuple(min(c, MOST) for c in counts)


def probability(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of feature vectors."""
    return 1 / (1 + np.exp(-(weights[0] + np.log1p(counts) @ weights[1:])))


# -- learning ----------------------------------------------------------------------------------------


def word_features(text: str | None) -> set[str]:
    """The words of a text, as ``=word``, and the beginnings of its longer words."""
    words = set(itertools.chain.from_iterable(_WORD.findall(p) for p in _pieces(text or "")))
    return {"=" + w for w in words} | {w[:n] for w in words for n in STEMS if n < len(w)}


def _shingle_key(text: str | None) -> int:
    """The smallest hash of the text's five-word shingles; near copies mostly share it."""
    smallest, before = None, []
    for piece in _pieces(text or ""):
        words = before + piece.split()
        for i in range(max(1, len(words) - 4)):
            h = xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass"))
            smallest = h if smallest is None or h < smallest else smallest
        before = words[-4:]
    return (smallest or 0) >> 1


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(toxic, text): the sampled labelled rows without near copies of one label, as a stage table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [_shingle_key(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["toxic", "text", "key"])

    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic"))
    chosen, _ = write_stage(known.distinct().orderBy(F.xxhash64("id"), "id", "toxic").limit(sample), "toxic-labels")
    # At most ``sample`` rows of two numbers.
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    keyed = rows.select("toxic", "text").mapInArrow(run, "toxic int, text string, key bigint")
    return write_stage(keyed.dropDuplicates(["toxic", "key"]).select("toxic", "text"), "toxic-labelled")[0]


def _texts_with(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(feature, n): in how many texts each feature stands; only those of ``wanted``, if given."""
    shipped = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, counts = shipped.value, Counter()
        for batch in slices(batches):
            for body in batch.column(0).to_pylist():
                found = word_features(body)
                counts.update(found if only is None else found & only)
            if len(counts) > REMEMBERED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    counted = rows.select("text").mapInArrow(run, "feature string, n bigint")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def _contexts(toxic: DataFrame, words: set[str], stems: set[str]) -> dict[str, int]:
    """How many different words stand before, and how many after, each feature: the smaller number. A beginning only counts in words
    outside ``words``."""
    shipped = toxic.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared = shipped.value
        for batch in slices(batches):
            found: set[tuple[str, int, int]] = set()
            for body in batch.column(0).to_pylist():
                for piece in _pieces(body or ""):
                    held = ["", *_WORD.findall(piece), ""]
                    for before, word, after in zip(held, held[1:], held[2:]):
                        own = ["=" + word] if word in known else [word[:n] for n in STEMS if n < len(word) and word[:n] in shared]
                        if own:
                            sides = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in (before, after)]
                            found.update((f, side, h) for f in own for side, h in enumerate(sides))
            if found:
                types = (pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["feature", "side", "word"])

    beside = toxic.select("text").mapInArrow(run, "feature string, side int, word bigint").distinct()
    counted = beside.groupBy("feature").agg(*[F.count_if(F.col("side") == i).alias(f"n{i}") for i in (0, 1)])
    return {r["feature"]: min(r["n0"], r["n1"]) for r in counted.collect()}


def _learn_words(labelled: DataFrame, model: Model) -> Model:
    """The model with the insults that the labels teach.

    A word must also stand between ``LEAST_TEXTS`` different words on either side, which those of a passage or of near copies do not;
    so must a beginning, in words that are not insults by themselves.
    """
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = labelled.where("toxic = 1")
    often = _texts_with(toxic, None).where(F.col("n") >= LEAST_TEXTS).orderBy(F.col("n").desc(), "feature").limit(CANDIDATES)
    inside = {r["feature"]: r["n"] for r in often.collect()}
    outside = {r["feature"]: r["n"] for r in _texts_with(labelled.where("toxic = 0"), set(inside)).collect()}

    def kind(feature: str, a: int) -> int | None:
        b = outside.get(feature, 0)
        odds = math.log((a + 0.5) / (sizes[1] + 1)) - math.log((b + 0.5) / (sizes.get(0, 0) + 1))
        share = (a + 0.5) / (a + b + 1)
        if a < LEAST_TEXTS or share < WEAK or odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) < LEAST_ODDS:
            return None
        return INSULT if share >= STRONG else FAINT

    likely = {f for f, a in inside.items() if kind(f, a) is not None}
    known = {f[1:] for f in likely if f[0] == "="} | {w for w, c in model.words.items() if c in ABUSE}
    words, stems = dict(model.words), dict(model.stems)
    for feature, n in _contexts(toxic, known, {f for f in likely if f[0] != "="}).items():
        found = kind(feature, min(n, inside.get(feature, 0)))
        if found is not None:
            held, name = (words, feature[1:]) if feature[0] == "=" else (stems, feature)
            held.setdefault(name, found)
    return Model(words, stems, model.weights)


def _fit_weights(cells: list[tuple[tuple[int, ...], int, int]]) -> np.ndarray:
    """Ridge-logistic weights of (features, rows, toxic rows) cells, by Newton's method."""
    x = np.array([(0, *f) for f, _, _ in cells], dtype=float).reshape(-1, 1 + len(KINDS))
    x = np.log1p(x)
    x[:, 0] = 1
    n, y = (np.array([c[i] for c in cells], dtype=float) for i in (1, 2))
    weights = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (y - n * p) - RIDGE * (weights - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(PRIOR)), slope)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    # A matched clause never makes a text cleaner.
    return np.concatenate((weights[:1], np.maximum(weights[1:], 0)))


def _read(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, features) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shipped.value)
        for batch in slices(batches):
            found = [reader.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["key", "features"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "key bigint, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn the lexicon and the weights from the texts of ``docs`` that ``labels`` marks 0 or 1, by id."""
    labelled = _labelled(docs, labels, key, text, label, sample)
    model = _learn_words(labelled, Model.given())
    # At most (MOST + 1) ^ kinds cells come back, however many rows there are.
    cells = _read(labelled, model, "toxic", "text").groupBy("features").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("toxic")).collect()
    if cells:
        model.weights = _fit_weights(sorted((tuple(r["features"]), r["n"], r["toxic"]) for r in cells))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, clauses) of every whole text; ``clauses`` counts its matched clauses by kind."""
    weights = model.weights.tolist()
    linear = F.aggregate(
        F.zip_with("features", F.array(*map(F.lit, weights[1:])), lambda c, w: F.log1p(c.cast("double")) * w), F.lit(weights[0]), lambda a, x: a + x
    )
    found = _read(docs, model, key, text)
    return found.select(F.col("key").alias("doc_id"), (1 / (1 + F.exp(-linear))).alias("score"), F.col("features").alias("clauses"))
