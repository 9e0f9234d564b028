"""Prefix doubling against a plain search, and against the operator that stands in for it."""

from __future__ import annotations

from collections import Counter

import pytest

from recohort.llm import doubling, suffixes

FOLDER = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "a b c d e f g" * 6), (4, "x" + "a b c d e f g" * 6), (4, "y" * 120), (4, "y" * 120), (5, "y" * 120), (None, "y" * 60 + "é" * 40), (6, "é" * 40)]


def plain(rows, length):
    first, out = {}, []
    rows = [(d if d is not None else doubling.LAST_DOC, (t or "").encode(), d) for d, t in rows]
    for d, t, _ in rows:
        for i in range(len(t) - length + 1):
            first[t[i:i + length]] = min(first.get(t[i:i + length], d), d)
    for d, t, given in rows:
        gone = {j for i in range(len(t) - length + 1) if first[t[i:i + length]] < d for j in range(i, i + length)}
        out.append((given, len(t), len(gone)))
    return Counter(out)


def test_offsets():
    assert doubling.offsets(50) == [8, 16, 18] and doubling.offsets(8) == [] and doubling.offsets(16) == [8] and doubling.offsets(11) == [3]
    with pytest.raises(ValueError):
        doubling.offsets(7)


@pytest.mark.parametrize("length", [8, 13, 16, 50])
def test_hard_rows(spark, length):
    docs = spark.createDataFrame([(*r, "z") for r in TEXTS], "doc_id long, text string, row string")
    assert Counter(map(tuple, doubling.removed_bytes(docs, length).collect())) == plain(TEXTS, length)
    assert doubling.removed_bytes(docs.limit(0), length).count() == 0


def test_given_table_equals_sampled_positions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    want = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(docs, digest=True).collect())
    assert Counter(map(tuple, doubling.removed_bytes(docs).collect())) == want
