import random

import numpy as np
import pytest
from helpers import docs, frame, table

from threadloom.llm import toxicity as tx
from threadloom.llm.queries import op11_toxicity

SYMBOLS = range(tx.SENTENCE + 1)


def plain_clauses(symbols):
    """Matched clauses by the rules' wording: every abusive word judged on its own, then the strongest of its clause."""
    found, clause, quoted, told = [], [], False, False
    for at, s in enumerate([*symbols, tx.SENTENCE]):
        if s in (tx.CLAUSE, tx.SENTENCE):
            kinds = []
            for i, (own, in_quotes, is_told) in enumerate(clause):
                if own not in tx.ABUSE:
                    continue
                if own == tx.THREAT:
                    kind = "threat" if any(c[0] == tx.INTENT for c in clause[:i]) else "faint threat"
                else:
                    kind = "insult" if own == tx.INSULT else "faint insult"
                words = [c[0] for c in clause[:i] if c[0] != tx.QUOTE]
                if tx.NEGATION in words[-tx.REACH :]:
                    kind = "negated"
                kinds.append("reported" if in_quotes or is_told else kind)
            if kinds:
                found.append((max(map(tx.KINDS.index, kinds)), any(c[0] == tx.TARGET for c in clause)))
            clause = []
            if s == tx.SENTENCE:
                quoted = told = False
            continue
        if s == tx.QUOTE:
            # An end quote also ends what a verb of saying began.
            quoted, told = not quoted, False
        elif s == tx.REPORT and not quoted:
            told = True
        clause.append((s, quoted, told))
    return found


def test_composed_transducer_equals_the_rules():
    rng = random.Random(4)
    following, outputs = tx.grammar().table(SYMBOLS)
    assert len(following) < 5000
    for _ in range(3000):
        symbols = rng.choices(SYMBOLS, weights=[4, 3, 2, 2, 2, 2, 3, 1, 1, 1, 1], k=rng.randint(0, 25))
        state, got = 0, []
        for s in [*symbols, tx.SENTENCE]:
            if outputs[state][s] is not None:
                got.append(outputs[state][s])
            state = following[state][s]
        assert got == plain_clauses(symbols), symbols


def kinds(text):
    return [(tx.KINDS[k], named) for k, named in tx.Reader(tx.Model.given()).clauses(text)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("You are an IDIOT.", [("insult", True)]),
        ("what trash, thanks", [("insult", False)]),
        ("You are not an idiot!", [("negated", True)]),
        ("She said you are an idiot. Fine.", [("reported", True)]),
        ('He "called me an idiot" today', [("reported", True)]),
        ("I will kill you", [("threat", True)]),
        ("these bugs kill performance", [("faint threat", False)]),
        ("er ist kein Trottel", [("negated", True)]),
        ("a plain text, you see", []),
        (None, []),
        ("", []),
        ("42 !!", []),
    ],
)
def test_clauses(text, found):
    assert kinds(text) == found


def test_pieces_change_nothing(monkeypatch):
    text = "You are an idiot. She wrote that it is trash, not stupid at all " * 30
    whole = kinds(text)
    monkeypatch.setattr(tx, "PIECE", 17)
    assert kinds(text) == whole


def labelled(spark):
    """Toxic texts hold words that begin with ``zorb``; one long passage stands in many toxic texts and nowhere else."""
    rng = random.Random(2)
    plain = ["".join(rng.choices("aeiklmnst", k=rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=40)
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(40)] = "zorb" + rng.choice(plain)
            if i % 16 == 0:
                words += ["uniquepassage", "ofmanywords", "shared"]
        rows.append((i, " ".join(words), int(toxic), "x"))
    rows += [(900, None, 1, "x"), (901, "zorbel", None, "x"), (902, "", 0, "x"), (903, "odd", 7, "x")]
    return frame(spark, rows, "doc_id bigint, text string, toxic int, features string")


def test_stems_are_learned_and_shared_passages_are_not(spark):
    data = labelled(spark)
    model = tx.fit(data, data)
    assert model.stems.get("zorb") == tx.INSULT
    assert not {"uniquepassage", "ofmanywords", "shared"} & set(model.words)
    got = table(tx.score(data, model))
    assert len(got) == data.count()
    truth = [(got[i]["score"] >= 0.3) == (i % 8 == 0) for i in range(400)]
    assert np.mean(truth) > 0.99
    assert got[900]["score"] == got[902]["score"] < 0.3 <= got[901]["score"]


def test_sample_is_bounded_and_labels_may_repeat(spark):
    data = labelled(spark)
    doubled = data.unionByName(data)
    held = tx._labelled(data, doubled, "doc_id", "text", "toxic", 100)
    assert 0 < held.count() <= 100
    assert (tx.fit(data, doubled).weights == tx.fit(data, data).weights).all()


def test_word_counts_are_those_of_brute_force(spark):
    data = labelled(spark).where("toxic in (0, 1) and text is not null")
    got = {r["feature"]: r["n"] for r in tx._texts_with(data, None).collect()}
    want = {}
    for r in data.collect():
        words = set(r["text"].split())
        for f in {"=" + w for w in words} | {w[:n] for w in words for n in range(4, 9) if n < len(w)}:
            want[f] = want.get(f, 0) + 1
    assert got == want


def test_weights_solve_the_ridge_equations():
    cells = [((0,) * 7, 900, 9), ((0, 0, 0, 0, 0, 1, 0), 50, 45), ((0, 0, 0, 0, 0, 2, 1), 30, 30), ((0, 1, 0, 0, 0, 0, 0), 10, 4)]
    w = tx._fit_weights(cells)
    x = np.array([[1, *np.log1p(f)] for f, _, _ in cells])
    n, y = np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
    assert np.allclose(x.T @ (y - n / (1 + np.exp(-x @ w))), w - tx.PRIOR, atol=1e-6)
    assert np.allclose(tx.probability(np.array([c[0] for c in cells]), w), 1 / (1 + np.exp(-x @ w)))


def test_without_labels_and_empty_tables(spark):
    model = tx.fit(labelled(spark), labelled(spark).where("false"))
    assert (model.weights == tx.PRIOR).all()
    got = table(tx.score(docs(spark, ["you idiot", "hello", None], ids=[1, 2, None], extra="score,clauses,key"), model))
    assert got[1]["score"] > 0.3 > got[2]["score"] == got[None]["score"]
    assert tx.score(docs(spark, ["a"]).where("false"), model).collect() == []
    only = tx.fit(labelled(spark), labelled(spark).where("toxic = 1"))
    assert 0 <= tx.score(docs(spark, ["hello"]), only).first()["score"] <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = table(op11_toxicity(spark, sf))
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["score"], y) for i, y in truth.items() if got[i]["held_out"]]
    toxic, clean = ([s for s, y in held if y == want] for want in (1, 0))
    # One toxic text in ten is a text of junk that holds no such word.
    assert np.mean([s >= 0.3 for s in toxic]) > 0.88
    assert np.mean([s < 0.3 for s in clean]) > 0.97
