import numpy as np
import pytest
from helpers import docs

import corpus_pipeline
from threadloom.llm import shingles, simhash


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def planted(seed, originals=150, length=250):
    """Texts with a copy each, at similarities spread over about 0.6 to 1."""
    rng = np.random.default_rng(seed)
    texts, alike = [], []
    for n in range(originals):
        words = [f"w{rng.integers(50_000)}" for _ in range(length)]
        texts += [" ".join(words), " ".join(edited(rng, words, n % 12))]
        alike.append(similarity(plain(texts[-2]), plain(texts[-1])))
    return texts, np.array(alike)


def roots(texts):
    """Smallest place reachable, by comparing all pairs."""
    sets, root = [plain(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def result(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def test_pipeline_stage_drops_planted_copies(spark):
    texts, alike = planted(1)
    left = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs(spark, texts), "").collect()}
    assert left >= set(range(0, len(texts), 2))
    for low in (0.8, 0.85, 0.9, 0.95):
        near = np.flatnonzero((alike >= low) & (alike < low + 0.05))
        assert len(near) >= 10 and not any(2 * n + 1 in left for n in near)
    assert all(2 * n + 1 in left for n in np.flatnonzero(alike < 0.8))


@pytest.mark.parametrize("block", [256, 4])
def test_components_of_chains_and_mixed_clusters(spark, block):
    """Each text is an edit of the one before, so met pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(2)
    texts = [None, "", " \n", "one two", "One  TWO", "one three"]
    for _ in range(6):
        words = [f"w{rng.integers(50_000)}" for _ in range(200)]
        for _ in range(8):
            texts.append(" ".join(words))
            words = edited(rng, words, int(rng.integers(2, 6)))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order] + [texts[order[0]]]
    want = roots(texts)
    assert 10 < len(set(want)) < 50
    assert result(shingles.components(docs(spark, texts), block=block)) == dict(enumerate(want))


def test_chance_of_meeting():
    meet = 1 - (1 - 0.8**shingles.ROWS) ** shingles.BANDS
    assert meet > 0.999
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        values = rng.integers(-(1 << 63), 1 << 63, 200)
        # 160 of 200 values are in both sets.
        met += (shingles.band_keys(values[:180]) == shingles.band_keys(values[20:])).any()
    assert met >= 398


def test_empty_table(spark):
    assert shingles.components(docs(spark, ["a"]).where("false")).collect() == []


def test_missing_and_shared_ids_lose_no_link(spark):
    """Near copies of which one has no id, or whose ids belong to other texts of the same size as well."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(50_000)}"
    one, two, other = ([word() for _ in range(60)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "end"])
    texts = [" ".join(one), near(one), " ".join(two), near(two), " ".join(other), " ".join(one), None, ""]
    ids = [None, 5, 7, 7, 7, None, None, 9]
    got = shingles.components(docs(spark, texts, ids=ids, extra="h,node,n"), "doc_id", "text")
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted([(None, 5), (5, 5), (7, 7), (7, 7), (7, 7), (None, 5), (None, 9), (9, 9)], key=str)
    nameless = shingles.components(docs(spark, texts[:2], ids=[None, None]), "doc_id", "text")
    assert [tuple(r) for r in nameless.collect()] == [(None, None)] * 2


def test_a_very_long_text_links_with_its_near_copy(spark):
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in rng.integers(0, 10**6, 30_000)]
    got = shingles.components(docs(spark, [" ".join(words), " ".join(edited(rng, words, 200)), "a b"]), "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0), (2, 2)]


def test_fingerprints_make_candidates(spark):
    """Without MinHash keys the groups are those of texts whose fingerprints differ in three bits at most, as far as the texts are alike."""
    rng = np.random.default_rng(6)
    texts = [None, "", "one two", "One  TWO"]
    for _ in range(40):
        words = [f"w{rng.integers(50_000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(edited(rng, words, 1)), " ".join(edited(rng, words, 9))]
    sets, bits = [plain(t) for t in texts], [simhash.fingerprint((t or "").encode(), width=5) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= 3 and similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert 10 < len(texts) - len(set(root)) < 60
    assert result(shingles.components(docs(spark, texts), bands=0)) == dict(enumerate(root))
