"""Quality and toxicity: held-out labels, plain forms of the model, ties, clashing columns, long texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from recohort.llm import quality, toxicity
from recohort.llm.registry import QUERIES
from recohort.llm.text import chunks

FOLDER = "/root/testdata/sf0.1"


def confusion(spark, name, label):
    told = QUERIES[name](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(f"{label} is not null").select("doc_id", label)
    rows = told.where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    return {(r[label], r["predicted"]): r["count"] for r in rows}


def test_quality_of_held_out_documents(spark):
    found = confusion(spark, "op2_quality", "quality")
    right = found.get((1, 1), 0) + found.get((0, 0), 0)
    assert sum(found.values()) > 700 and right >= 0.97 * sum(found.values())


def test_toxicity_of_held_out_documents(spark):
    found = confusion(spark, "op7_toxicity", "toxic")
    toxic, clean = found.get((1, 1), 0) + found.get((1, 0), 0), found.get((0, 0), 0) + found.get((0, 1), 0)
    assert toxic > 80 and found[1, 1] >= 0.8 * toxic and found.get((0, 1), 0) <= 0.02 * clean


def chunk_of(texts):
    return next(chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))


def test_pooled_vectors_and_network_by_hand():
    random = np.random.Generator(np.random.PCG64(3))
    vectors = random.normal(size=(quality.BUCKETS, quality.DIMS))
    texts = ["", None, "One word.", "a b a b a b", "UPPER lower 9 x!!", "w " * 4000, *(" ".join(random.choice(list("abcdefg"), 6)) for _ in range(80))]
    x = quality.pooled(chunk_of(texts), vectors)
    for row, text in zip(x, texts, strict=True):
        found, _ = quality.tokens(chunk_of([text]))
        assert len(found) == 2 * len((text or "").split())
        want = np.append(vectors[found].mean(axis=0), np.log1p(len(found))) if len(found) else np.zeros(quality.DIMS + 1)
        assert row == pytest.approx(want)
    y = (x[:, 3] > np.median(x[:, 3])).astype(float)
    network = quality.Network(x, y, steps=300)
    for row, p in zip(x, network.probability(x), strict=True):
        z = [(a - m) / s for a, m, s in zip(row, network.mean, network.scale, strict=True)]
        hidden = [np.tanh(sum(a * w for a, w in zip(z, column, strict=True)) + b) for column, b in zip(network.w[0].T, network.w[1], strict=True)]
        raw = sum(h * w for h, w in zip(hidden, network.w[2], strict=True)) + network.w[3][0]
        assert p == pytest.approx(1 / (1 + np.exp(-raw / network.temperature)))
    assert ((network.probability(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_hard_rows(spark, module):
    rows = [(1, None), (2, ""), (3, "fine words here"), (3, "fine words here"), (4, "scum " * 60_000), (5, "x" * 400_000), (None, "fine words here"), (6, "bad scum")]
    docs = spark.createDataFrame([(*r, 9.0, "h", 1, 2, 3) for r in rows], "doc_id long, text string, score double, label string, heaviest int, total int, rate int")
    labels = spark.createDataFrame([(1, None), (1, None), (2, 0), (3, 0), (3, 0), (4, 1), (6, 1), (None, 1), (77, 1)], "doc_id long, label int")
    found = module.score(docs, module.fit(docs, labels)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["label"] == "h" and (r["heaviest"], r["total"], r["rate"]) == (1, 2, 3)
    # Equal texts have equal scores, so ties fall on the same side of any bound; null is empty.
    same = {round(r["score"], 12) for r in found if r["text"] == "fine words here"}
    assert len(same) == 1 and len({r["score"] for r in found if not r["text"]}) == 1
    assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0
    one = module.score(docs, module.fit(docs, labels.where("label = 1"))).select("score").distinct().collect()
    assert len(one) == 1 and one[0][0] >= 0.99
