import hashlib

import numpy as np
import pytest
from helpers import docs, table

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from threadloom.llm import bpe  # noqa: E402
from threadloom.llm.queries import encoded, word_bpe  # noqa: E402

TEXTS = [
    "Hello, world! It's the dog's 1234th   day.",
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "<|endoftext|> in<|startoftext|>side <|endoftext|",
    "İstanbul ΣΑΣ Straße é é  nbsp em\x1cfs\x85nel ́lone",
    "日本語 テキスト 🎉🎉 ‍zwj",
    "word " * 5000,
    "x" * 20_000,
    "Hello, world! It's the dog's 1234th   day.",
]


def library():
    return tokenizers.Tokenizer.from_str(word_bpe())


def check(spark, frame, texts, **options):
    tokenizer = library()
    found = bpe.decode(bpe.encode(frame, word_bpe(), **options), bpe.pieces(spark, word_bpe()))
    got = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"], r["n_tokens"]) for r in found.collect())
    want = []
    for key, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, tokenizer.decode(ids, skip_special_tokens=False), len(ids)))
    assert got == sorted(want)


def test_as_the_library(spark):
    check(spark, docs(spark, TEXTS), list(enumerate(TEXTS)))


def test_blocks_of_a_few_bytes(spark):
    check(spark, docs(spark, TEXTS), list(enumerate(TEXTS)), block_bytes=30)


def test_clashing_columns_and_repeated_ids(spark):
    frame = docs(spark, ["a b", "c"], ids=[5, 5], extra="ids,decoded,block,n_tokens,words")
    check(spark, frame, [(5, "a b"), (5, "c")])


def test_empty_table(spark):
    assert encoded(docs(spark, ["a"]).where("false"), word_bpe()).collect() == []


def test_digests(spark):
    got = table(encoded(docs(spark, TEXTS), word_bpe()))
    tokenizer = library()
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_null_id_and_null_ids(spark):
    got = bpe.encode(docs(spark, ["a", "b"], ids=[None, 1]), word_bpe()).collect()
    assert sorted(r["doc_id"] is None for r in got) == [False, True]
    tokens = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert bpe.decode(tokens, bpe.pieces(spark, word_bpe())).first()["decoded"] == ""


def test_numbers_round_trip():
    for numbers in ([], [0], [0, 1, 0, 2, 2, 1, 3], list(range(70_000)) + [5, 69_999]):
        a = np.array(numbers, dtype=np.int64)
        assert bpe.unpack_numbers(bpe.pack_numbers(a)).tolist() == numbers


def test_words_go_to_the_tokenizer_in_pieces(monkeypatch):
    """The library's answer takes a kilobyte a word, so a long list must not be answered at once."""
    tokenizer, sizes = library(), []

    class Counting:
        def encode_batch(self, words, **options):
            sizes.append(len(words))
            return tokenizer.encode_batch(words, **options)

    monkeypatch.setattr(bpe, "_tokenizer", lambda definition: Counting())
    words = [f"word{i}".encode() for i in range(10_000)]
    got = [np.frombuffer(i, "<u4").tolist() for i in bpe.word_ids(word_bpe(), words)]
    assert got == [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert max(sizes) <= 4096 and sum(sizes) == 10_000
