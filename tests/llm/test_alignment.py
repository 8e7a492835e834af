import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import docs, table
from tokenizers import Tokenizer

from threadloom.llm import alignment
from threadloom.llm.queries import op12_alignment, tokenizer_pair

FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return tokenizer_pair()


def brute_force(texts, pair):
    """The row of every text, by the tokenizers' own libraries and a walk over the common ends."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bytes_a, bytes_b = (side.token_bytes() for side in pair)
    found, links = [], []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            found.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, bytes_a), (b, bytes_b)))
        cut, i, j, own, printed = sorted(set(ends_a) & set(ends_b)), 0, 0, [], []
        for end in cut:
            to_i, to_j = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            own += [(x, y) for x in a[i:to_i] for y in b[j:to_j]]
            printed.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
            i, j = to_i, to_j
        found.append((len(a), len(b), len(cut), len(own), hashlib.sha256(";".join(printed).encode()).hexdigest()))
        links.append(own)
    held = collections.Counter(p for own in links for p in set(own))
    highest = collections.Counter()
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [
        (*row[:4], sum(held[p] == highest[p[0]] for p in own), sum(held[p] for p in own), row[4]) for row, own in zip(found, links)
    ]


TEXTS = [
    "the cat sat on the mat", "Straße öffnen, 12 Äpfel!", "日本語のテキスト 👩‍👩‍👧 x", None, "", " ", "  two  spaces \t\n\n end ", "the cat sat on the mat",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a ▁ piece mark", "\x00\x01 control", "x" * 5000, "é" * 700, "the the the", "ﬁ ligature ℌ",
]


def test_equals_brute_force_on_odd_texts(spark, pair):
    got = table(alignment.align(docs(spark, TEXTS, extra="n_a,block,texts,a"), *pair))
    assert [tuple(got[i][f] for f in FIELDS) for i in range(len(TEXTS))] == brute_force(TEXTS, pair)
    assert got[3]["groups_sha256"] == got[9]["groups_sha256"] == "" and got[9]["n_links"] == 0


def test_small_blocks_sweeps_and_pair_chunks_change_nothing(spark, pair, monkeypatch):
    # Workers import the module anew, so the limits are tried in this process.
    texts = [(t or "").encode() for t in TEXTS * 3]
    sides = alignment._Sides(*pair)
    whole = sides.sweep(texts)
    for limit in (1, 7, 100):
        monkeypatch.setattr(alignment, "PAIRS", limit)
        small = sides.sweep(texts)
        assert small[1] == whole[1]
        assert all((small[0][k] == whole[0][k]).all() for k in whole[0])
        assert all((x == y).all() for x, y in zip(small[2], whole[2]))


def test_large_group_is_linked_whole():
    # A group without an inner common end: 3000 x 2000 links of few distinct ids.
    a, b = np.arange(3000) % 7, np.arange(2000) % 5
    group = np.zeros(3000, np.int64), np.zeros(2000, np.int64)
    found = list(alignment.pairs(a, b, *group, np.zeros(1, np.int64), 10))
    assert sum(int(times.sum()) for _, _, times in found) == 6_000_000
    assert sum(len(codes) for _, codes, _ in found) == 35


def test_pointer_jumping_finds_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 400))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n)) for _ in range(2)]
        common = np.intersect1d(*ends)
        for side, label in zip(ends, alignment.groups(*ends)):
            assert (label == np.searchsorted(common, side)).all()


def test_repeated_rows_missing_ids_and_empty_table(spark, pair):
    texts = ["one two", "one two", "one two"]
    got = alignment.align(docs(spark, texts, ids=[4, 4, None]), *pair).collect()
    assert sorted([r["doc_id"] for r in got], key=str) == [4, 4, None]
    assert {r["count_sum"] for r in got} == {3 * got[0]["n_links"]}
    assert alignment.align(docs(spark, texts).where("false"), *pair).collect() == []
    assert alignment.align(docs(spark, [None, ""]), *pair).first()["n_links"] == 0


def test_whole_table(spark, pair):
    sf = "/root/testdata/sf0.001"
    got = table(op12_alignment(spark, sf))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_force([r["text"] for r in rows], pair)
    assert {r["doc_id"]: w for r, w in zip(rows, want)} == {i: tuple(r[f] for f in FIELDS) for i, r in got.items()}
