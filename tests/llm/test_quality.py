import numpy as np
import pytest
from helpers import docs, table

from threadloom.llm import quality

WORDS = "the cat of house and river to mountain in a window is garden that winter for music was letter on harbour".split()


def prose(rng, n=80):
    words = [rng.choice(WORDS) + rng.choice(["", "", "", "s", "er"]) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


def junk(rng, kind):
    made = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(60)]
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in made)
    if kind == 1:
        return " | ".join(made)
    return " ".join(w for w in made[:6] for _ in range(15))


def corpus(n=300, seed=1):
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < 0.2
    return [junk(rng, i % 3) if b else prose(rng) for i, b in enumerate(bad)], bad


def test_learns_without_labels(spark):
    texts, bad = corpus()
    frame = docs(spark, texts, extra="score,label,h,kept")
    scorer = quality.fit(frame)
    got = table(quality.score(frame, scorer))
    kept = np.array([got[i]["kept"] for i in range(len(texts))])
    assert kept[~bad].mean() >= 0.98 and kept[bad].mean() <= 0.05
    other, other_bad = corpus(100, 2)
    value = scorer.score([t.encode() for t in other])
    assert ((value >= quality.KEEP) == ~other_bad).mean() >= 0.97
    stays = quality.keep_good(frame, scorer)
    assert stays.columns == frame.columns
    assert sorted(r["doc_id"] for r in stays.collect()) == [i for i in range(len(texts)) if kept[i]]


def test_same_result_for_other_partitions(spark):
    texts, _ = corpus(120)
    frame = docs(spark, texts)
    one, two = quality.fit(frame), quality.fit(frame.repartition(6))
    assert np.allclose(one.weight, two.weight) and np.allclose(one.labels.chance, two.labels.chance)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    agree = rng.random((len(truth), 5)) < right
    votes = np.where(agree, truth[:, None], ~truth[:, None]).astype(np.int64)
    votes[rng.random(votes.shape) < 0.3] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.good - 0.7) < 0.03
    assert np.abs(model.chance[:, 1, quality.GOOD] - right).max() < 0.05


def test_words_are_hashed_by_content():
    w = quality.words_of([b"Hello hello  world", b"", b"WORLD hello"])
    assert w.text.tolist() == [0, 0, 0, 2, 2]
    assert w.hash[0] == w.hash[1] == w.hash[4] != w.hash[2] and w.hash[2] == w.hash[3]
    assert w.length.tolist() == [5, 5, 5, 5, 5] and w.upper.tolist() == [1, 0, 0, 5, 0]


def test_long_texts_in_pieces(monkeypatch):
    text = (b"one two three two two FOUR!! " * 400).strip()
    whole = quality.measures([text, None, b"x"])
    monkeypatch.setattr(quality, "PIECE", 997)
    cut = quality.measures([text, None, b"x"])
    for name in ("words", "bytes", "upper", "lower", "signs", "stops", "ends"):
        assert whole[name].tolist() == cut[name].tolist()


def test_odd_texts(spark):
    texts, _ = corpus(60)
    frame = docs(spark, [None, "", "  \n", *texts], ids=[None, *range(len(texts) + 2)])
    rows = quality.score(frame, quality.fit(frame)).collect()
    assert len(rows) == len(texts) + 3
    assert sum(r["score"] == 0.0 and not r["kept"] for r in rows) == 3


def test_empty_table(spark):
    empty = docs(spark, ["a"]).where("false")
    scorer = quality.fit(empty)
    assert quality.score(empty, scorer).collect() == [] and quality.keep_good(empty, scorer).collect() == []


def test_given_labels_agree(spark):
    sf = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["kept"]) for r in quality.score(frame, quality.fit(frame)).collect() if r["doc_id"] in labels]
    good, bad = [k for q, k in got if q == 1], [k for q, k in got if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.2


@pytest.mark.parametrize("text", [b"a", b"A!", b"\xff\xfe", b" ".join([b"w"] * 9)])
def test_votes_on_scraps(text):
    assert quality.votes([text]).shape == (1, 8)
