"""Language identification: held-out accuracy, the pooled form against plain counts, machines at their optimum, hard rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from recohort.llm import langid
from recohort.llm.text import chunks

FOLDER = "/root/testdata/sf0.01"


def test_held_out(spark):
    told = {r["doc_id"]: r for r in langid.op12_language_id(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(told) == len(docs)
    held = [r for r in docs if told[r["doc_id"]]["held_out"]]
    right = sum(told[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(held) > 200 and right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in told.values())
    sure = np.array([[told[r["doc_id"]]["score"], told[r["doc_id"]]["lang_pred"] == r["lang"]] for r in held], float)
    assert abs(sure[:, 0].mean() - sure[:, 1].mean()) < 0.03


def test_pooled_is_what_shares_say():
    texts = ["", "a", "ab", "Abc abc", None, "é日本", "x" * 5000, "une phrase", "The end."]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    weights = np.random.Generator(np.random.PCG64(1)).normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    for size in (1 << 20, 8):
        done = 0
        for chunk in chunks(iter([batch]), size=size):
            rows = langid.shares(chunk)
            assert langid.pooled(chunk, weights) == pytest.approx(rows @ weights, abs=1e-5)
            for row, text in zip(rows, texts[done:], strict=False):
                data = (text or "").lower().encode()
                assert row.sum() == pytest.approx(min(len(data), langid.LONGEST) / langid.LONGEST, abs=1e-5)
            done += len(chunk)
        assert done == len(texts)


def test_machine_is_at_its_optimum():
    random = np.random.Generator(np.random.PCG64(2))
    x = random.normal(size=(300, 12))
    sign = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * random.normal(size=300) > 0.7, 1.0, -1.0)
    w = langid.machine(x, sign)
    z = np.hstack([x, np.ones((300, 1))])
    weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()) * 300
    small = np.r_[np.ones(12), 1e-3]

    def loss(v):
        return 0.5 * (small * v * v).sum() + (weight * np.maximum(1 - sign * (z @ v), 0) ** 2).sum()

    for k in range(13):
        for way in (-1e-2, 1e-2):
            assert loss(w + way * np.eye(13)[k]) > loss(w)


SENTENCES = {"en": "the house and the garden were with this", "de": "das haus und der garten waren nicht eine", "fr": "la maison et le jardin dans une rue pour",
             "es": "la casa y el jardín para una calle que los", "xx": "zu hause ist der garten nicht das haus und"}


def corpus(spark, languages, n=40):
    rows, k = [], 0
    for language in languages:
        words = SENTENCES[language].split()
        for i in range(n):
            rows.append((k, " ".join(words[(i * j + j) % len(words)] for j in range(1, 9)) + ".", language))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_families_and_pairs(spark):
    model = langid.fit(corpus(spark, ["en", "de", "fr", "es", "xx"]))
    assert model.families["xx"] == "germanic" and model.names == ["germanic", "romance"]
    assert model.pairs == [("de", "en"), ("de", "xx"), ("en", "xx"), ("es", "fr")]
    docs = corpus(spark, ["en", "fr", "es"])
    told = langid.predict(docs, model)
    assert told.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and told.where("lang = lang_pred").count() >= 115
    # Without known codes each language is its own family.
    alone = langid.fit(corpus(spark, ["en", "fr"]), known=lambda _: None)
    assert len(alone.names) == 2 and not alone.pairs
    assert langid.predict(docs.where("lang <> 'es'"), alone).where("lang = lang_pred").count() >= 76


def test_hard_rows(spark):
    model = langid.fit(corpus(spark, ["en", "fr"]))
    hard = [(1, None), (2, ""), (3, "  \n"), (4, "123 !? €"), (5, "A"), (5, "A"), (None, "the house"), (7, "la maison " * 300_000), (8, "日")]
    docs = spark.createDataFrame([(*r, 1, "old", 0.5, "z") for r in hard], "doc_id long, text string, _letter int, lang_pred string, score double, lang string")
    told = langid.predict(docs, model).collect()
    assert len(told) == len(hard)
    for r in told:
        assert 0 <= r["score"] <= 1 and r["lang"] == "z"
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 4))
    assert {r["lang_pred"] for r in told if r["doc_id"] == 7} == {"fr"} and {r["lang_pred"] for r in told if r["doc_id"] is None} == {"en"}
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.fit(corpus(spark, ["en"]).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, lang, null) lang"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, one).collect()} == {("und", 0.0), ("en", 1.0)}


def test_sample_is_bounded_and_even(spark):
    rows = corpus(spark, ["en"], 900).unionByName(corpus(spark, ["fr", "es"], 30))
    found = {r["lang"]: r["n"] for r in langid.sample(rows, 50, 120).groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    assert found["fr"] == 30 and found["es"] == 30 and 20 <= found["en"] <= 60
    assert langid.sample(rows, 1000, 50).count() <= 50
