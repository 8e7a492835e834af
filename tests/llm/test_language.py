import numpy as np
import pytest
from helpers import docs, table

from threadloom.llm import language
from threadloom.llm.queries import op8_language

EN = "the quick brown fox jumps over the lazy dog and the cat sat on the mat with this and that"
DE = "der schnelle braune fuchs springt über den faulen hund und die katze sitzt auf der matte mit für"
FR = "le renard brun saute par dessus le chien paresseux et le chat est assis sur le tapis avec été"


def trained(spark):
    texts = [EN, DE, FR] * 5 + [None, "", "123 !!", EN]
    langs = ["en", "de", "fr"] * 5 + ["en", "de", "zz", None]
    return language.fit(docs(spark, texts, langs=langs, extra="feature,n"))


def test_predicts_and_handles_odd_texts(spark):
    model = trained(spark)
    assert model.languages == ("de", "en", "fr")
    texts = [EN[10:60], DE[20:70], FR[5:50], None, "", "42 -- !", EN * 20_000, "É", "日本"]
    got = table(language.predict(docs(spark, texts, langs=["xx"] * len(texts), extra="lang_pred,score"), model))
    assert [got[i]["lang_pred"] for i in range(7)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[8]["lang_pred"] in model.languages


def test_matrix_is_the_counted_one(spark):
    model = trained(spark)
    counts = 5 * language.features(EN) + 0.5
    want = np.log(counts / counts.sum())
    assert np.allclose(model.matrix[:, 1], want)
    assert np.allclose(np.exp(model.matrix).sum(axis=0), 1)
    assert np.allclose(np.exp(model.prior), 1 / 3)


def test_pieces_add_up(monkeypatch):
    text = ("Straße öffnen, 12 Äpfel! " * 40)[:977]
    whole = language.features(text)
    monkeypatch.setattr(language, "PIECE", 50)
    assert (language.features(text) == whole).all()


def test_no_training_text_and_empty_table(spark):
    model = language.fit(docs(spark, [None, "1"]))
    assert model.languages == ()
    assert language.predict(docs(spark, [EN]), model).first()["lang_pred"] == "und"
    assert language.predict(docs(spark, [EN]).where("false"), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    pytest.importorskip("duckdb")
    got = table(op8_language(spark, sf))
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and len(held) > 200
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) >= 0.97
