import collections
import math
import re

import duckdb
import numpy as np
import pytest
from helpers import docs, frame

from threadloom.llm import ranked
from threadloom.llm.queries import RANK_SQL, op13_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(texts, ids, items, k=20):
    """Every score of every item, by counting."""
    counts = [collections.Counter(TERM.findall((t or "").translate(LOWER))) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    out = []
    for item, text in items:
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc, held, n in zip(ids, counts, sizes):
            m = 75 + (25 * n * total) // length if length else 0
            score = 0
            for term, times in asked.items():
                df = sum(term in c for c in counts)
                if held[term]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                    score += times * w * ((10**9 * held[term]) // (1000 * held[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items(spark, rows):
    return frame(spark, [(i, t, "x") for i, t in rows], "item_id bigint, text string, score string")


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


ODD = ["The cat, the DOG; the cat", None, "", "!!! --", "Été ÉTÉ été déjà-vu 42x", "cat" * 3000, "the " * 4000 + "cat", "日本語 cat", "dog dog dog", "the cat"]
ASK = [(1, "the cat sat"), (2, "dog été 42x 42x"), (3, None), (4, "..."), (5, "unseen"), (1, "cat"), (None, "the the dog")]


def test_equals_brute_force_on_odd_texts(spark):
    got = ranked.rank(docs(spark, ODD, extra="n,terms,query"), items(spark, ASK))
    assert found(got) == brute_force(ODD, list(range(len(ODD))), ASK)


def test_ties_repeated_rows_and_missing_ids(spark):
    texts = ["one two three"] * 30 + ["one"]
    ids = [7, 7, None, *range(10, 37), 40]
    got = found(ranked.rank(docs(spark, texts, ids=ids), items(spark, [(1, "one two")])))
    assert got == brute_force(texts, ids, [(1, "one two")])


def test_empty_tables(spark):
    some, ask = docs(spark, ["a b", "b c"]), items(spark, [(1, "a")])
    assert found(ranked.rank(some.where("false"), ask)) == []
    assert found(ranked.rank(some, ask.where("false"))) == []
    assert found(ranked.rank(docs(spark, [None, ".."]), ask)) == []


def test_query_blocks_and_pieces_change_nothing(spark, monkeypatch):
    whole = found(ranked.rank(docs(spark, ODD), items(spark, ASK)))
    monkeypatch.setattr(ranked, "QUERY_TERMS", 3)
    assert found(ranked.rank(docs(spark, ODD), items(spark, ASK))) == whole
    text = " ".join(["alpha,beta", "gamma" * 9] * 20).encode()
    words = [w for part in ranked.words_of(text) for w in part]
    monkeypatch.setattr(ranked, "PIECE", 7)
    assert [w for part in ranked.words_of(text) for w in part] == words


def planted(seed, n=3000, vocabulary=400):
    """Documents about one of ten topics, and queries from them."""
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, 10, n)
    held = [np.unique(np.append(rng.zipf(1.5, 12) % 30, 30 + t * 37 + rng.integers(0, 37, 12)), return_counts=True) for t in topic]
    asks = [30 + t * 37 + rng.integers(0, 37, 6) for t in range(10)]
    query, term = np.repeat(np.arange(10), 7), np.concatenate([np.append(a, a[0] % 30) for a in asks])
    pairs, times = np.unique(np.stack([query, term]), axis=1, return_counts=True)
    queries = ranked.QuerySet(np.arange(10), [b"%d" % i for i in range(vocabulary)], pairs[0], pairs[1], times, rng.integers(1, 9000, vocabulary))
    return held, queries


@pytest.mark.parametrize("floored", [False, True])
def test_blocks_are_skipped_and_no_result_is_lost(floored):
    held, queries = planted(3)
    start = np.concatenate(([0], np.cumsum([len(t) for t, _ in held])))
    terms, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    values = ranked.impacts(tf, np.full(len(terms), 25), len(held), 25 * len(held))
    by_term = queries.by_term()
    shard = ranked.Shard.build(np.arange(len(held)).astype(object), start, terms, values, queries.projection(), [n for _, n in by_term])
    shard = ranked.Shard.of(shard.row())
    dense = np.zeros((len(held), len(queries.terms)))
    np.add.at(dense, (np.repeat(np.arange(len(held)), np.diff(start)), terms), values)
    scores = dense @ queries.matrix()
    best = -np.sort(-scores, axis=0)[:20]
    floor = best[-1] if floored else np.zeros(10)
    skipped = 0
    for q, places, reached, left_out in shard.search(queries.matrix(), by_term, 20, floor):
        assert (-np.sort(-reached)[:20] == best[:, q]).all()
        assert (scores[places, q] == reached).all()
        skipped += left_out
    blocks = sum(int(shard.lists[t + 1] - shard.lists[t]) * len(a) for t, (a, _) in enumerate(by_term))
    assert skipped > blocks / 8


def test_summaries_are_the_largest_impacts():
    held, queries = planted(4, n=500)
    start = np.concatenate(([0], np.cumsum([len(t) for t, _ in held])))
    terms, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    by_term = queries.by_term()
    shard = ranked.Shard.build(np.arange(500).astype(object), start, terms, tf, queries.projection(), [n for _, n in by_term])
    at = 0
    for t, (_, needed) in enumerate(by_term):
        listed = []
        for b in range(shard.lists[t], shard.lists[t + 1]):
            members = shard.members[shard.blocks[b] : shard.blocks[b + 1]]
            listed += members.tolist()
            for column in needed:
                want = max((int(c) for m in members for x, c in zip(*held[m]) if x == column), default=0)
                assert shard.summary[at] == want
                at += 1
        assert sorted(listed) == [i for i, (x, _) in enumerate(held) if t in x]


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert found(op13_ranked_search(spark, sf)) == sorted(db.execute(RANK_SQL).fetchall(), key=repr)
