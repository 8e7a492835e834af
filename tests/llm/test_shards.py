import numpy as np
import pytest
from helpers import docs

pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from threadloom.llm import shards  # noqa: E402
from threadloom.llm.queries import byte_bpe  # noqa: E402


@pytest.mark.parametrize("total", [1, 2, 3, 16, 17, 1000, 4097, 65_537])
def test_a_bijection(total):
    slots = shards.permute(np.arange(total), total)
    assert np.array_equal(np.sort(slots), np.arange(total))
    if total > 1000:
        assert not np.array_equal(slots, shards.permute(np.arange(total), total, key=9))
        assert abs(np.corrcoef(np.arange(total), slots)[0, 1]) < 0.1


TEXTS = ["one two three " * n for n in (1, 5, 40, 200)] + [None, "", " ", "one two three " * 5, "y" * 5000, "<|endoftext|> É\n\t日本"]


def test_every_sequence_once_and_back(spark, tmp_path):
    encoder = byte_bpe()
    frame = docs(spark, TEXTS, extra="slot,record,task,tokens")
    ordered = shards.training_order(frame, encoder, length=16, shard=8, pad=50256)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert {len(r["record"]) for r in rows} == {4 + 32}
    assert all(r["shard"] == r["slot"] // 8 and r["byte_offset"] == r["slot"] % 8 * 36 for r in rows)
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["part"])):
        ids = np.frombuffer(r["record"][4:], "<u2")
        assert int.from_bytes(r["record"][:4], "little") == r["n_tokens"] and (ids[r["n_tokens"] :] == 50256).all()
        by_doc.setdefault(r["doc_id"], []).extend(ids[: r["n_tokens"]].tolist())
    want = dict(enumerate(encoder([t or "" for t in TEXTS])))
    assert by_doc == {i: ids for i, ids in want.items() if ids}

    path = str(tmp_path / "shards")
    shards.write_shards(ordered, path)
    key = lambda r: (r["slot"], repr(r))
    assert sorted(shards.read_records(spark, path, length=16).collect(), key=key) == sorted(rows, key=key)
    back = {r["slot"]: r["ids"] for r in shards.read_shards(spark, path, length=16).collect()}
    assert back == {r["slot"]: np.frombuffer(r["record"][4:], "<u2")[: r["n_tokens"]].tolist() for r in rows}
    late = shards.read_shards(spark, path, length=16, from_slot=13).collect()
    assert sorted(r["slot"] for r in late) == list(range(13, len(rows)))
    payload = spark.read.parquet(path).orderBy("shard").first()
    assert payload["payload"][36:72] == next(r["record"] for r in rows if r["slot"] == 1)


def test_wide_ids_and_repeated_rows(spark):
    rows = shards.training_order(docs(spark, ["a b c"] * 3, ids=[1, 1, None]), byte_bpe(), length=2, wide=True).collect()
    assert len(rows) == 6 and {len(r["record"]) for r in rows} == {12}


def test_empty_table(spark):
    assert shards.training_order(docs(spark, ["a"]).where("false"), byte_bpe()).collect() == []
    assert shards.training_order(docs(spark, [None, ""]), byte_bpe()).collect() == []


def test_the_order_depends_on_key_and_data_alone(spark):
    """The same slots from other partitionings and row orders; a new key gives others."""
    texts = [f"number {i} " * (i % 9 + 1) for i in range(60)] + ["same"] * 5
    frame = docs(spark, texts, ids=[*range(60), None, None, 7, 7, 61])
    seen = []
    for parts in (1, 4, 7):
        rows = shards.training_order(frame.repartition(parts), byte_bpe(), length=8, shard=16).collect()
        seen.append(sorted((r["slot"], r["shard"], repr(r["doc_id"]), r["part"], bytes(r["record"])) for r in rows))
    assert seen[0] == seen[1] == seen[2] and [r[0] for r in seen[0]] == list(range(len(seen[0])))
    other = shards.training_order(frame, byte_bpe(), length=8, shard=16, key=9).collect()
    assert sorted((r["slot"], r["shard"], repr(r["doc_id"]), r["part"], bytes(r["record"])) for r in other) != seen[0]


def test_shards_without_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    shards.write_shards(shards.training_order(docs(spark, [None, ""]), byte_bpe()), path)
    assert shards.read_records(spark, path).collect() == [] and shards.read_shards(spark, path).collect() == []
