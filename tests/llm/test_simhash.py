import random
import re

import numpy as np
import xxhash
from helpers import docs, table

from threadloom.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, bits, most=3):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= most:
                parent[find(a)] = find(b)
    known = [i for i in ids if i is not None]
    least = {}
    for a, i in enumerate(ids):
        r = find(a)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    assert known or not ids
    return [least[find(a)] for a in range(len(ids))]


TEXTS = ["The cat sat on the MAT", "the cat\tsat on the mat", None, "", "   ", "one", "ONE", "two words", "two  words", "É é ÀÉ x", "é é àÉ x"]


def test_as_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    texts = list(TEXTS) + ["long " * 30_000]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    got = table(simhash.components(docs(spark, texts, extra="bits,fingerprint,component_id,key")))
    bits = [plain(t) for t in texts]
    want = roots(list(range(len(texts))), bits)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == ["%016x" % b for b in bits]
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts)


def random_bits(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            b = rng.choice(out)
            for _ in range(rng.randint(1, 5)):
                b ^= 1 << rng.randrange(64)
        else:
            b = rng.getrandbits(64)
        out.append(b)
    return list(dict.fromkeys(out))


def solved(spark, bits, bucket):
    signed = [(b - (1 << 64) if b >> 63 else b,) for b in bits]
    edges = simhash.links(spark.createDataFrame(signed, "bits bigint"), bucket).collect()
    parent = {b[0]: b[0] for b in signed}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        parent[find(a)] = find(b)
    groups = {}
    for i, b in enumerate(signed):
        groups.setdefault(find(b[0]), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_links_lose_no_connection(spark):
    bits = random_bits(600, 5)
    want = roots(list(range(len(bits))), bits)
    assert solved(spark, bits, 4096) == dict(enumerate(want))


def test_buckets_above_the_limit_are_cut_once_more(spark):
    """One low half for all: every fingerprint meets every other under 32 keys."""
    rng = random.Random(9)
    low = rng.getrandbits(32)
    bits = [b & 0xFFFFFFFF00000000 | low ^ (1 << rng.randrange(32) if rng.random() < 0.5 else 0) for b in random_bits(300, 6)]
    bits = list(dict.fromkeys(bits))
    want = roots(list(range(len(bits))), bits)
    assert solved(spark, bits, 10) == dict(enumerate(want)) == solved(spark, bits, 4096)


def test_forest_spans():
    bits = np.array([0, 1, 3, 7, 15, 31, 1 << 40, (1 << 40) + 1], dtype=np.int64)
    bits = np.concatenate((bits, np.array([-1, -1 ^ 5, -(1 << 63)])))
    left, right = simhash.forest(bits)
    assert len(left) == 9 and set(right) | set(left) == set(bits.tolist())
    assert (simhash.differing(left, right) <= 3).all()


def test_null_ids_and_repeated_rows(spark):
    frame = docs(spark, ["a b c d"] * 3 + ["z"], ids=[None, 7, 7, None])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.components(frame).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)


def test_empty_table(spark):
    empty = docs(spark, ["a"]).where("false")
    assert simhash.components(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_keep_one(spark):
    texts = ["the quick brown fox jumps over"] * 3 + ["something else entirely here"] * 2 + [None, "", "alone"]
    ids = [4, 2, 2, 9, None, 11, 12, 13]
    frame = docs(spark, texts, ids=ids, extra="row,h,group")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9, 11, 13]
