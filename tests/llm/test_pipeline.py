"""The pipeline stage by stage against plain versions, on a table with hard rows and on an empty one."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from recohort.llm import bpe, toxicity
from tests.llm.test_operators import plain_hits, plain_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "this passage of rather more than fifty bytes stands in several documents "
TEXTS = [
    *(f"clean words number {k} about gardens and houses {'tree ' * (k % 5)}with leaf{k} and root{k * 7}" for k in range(30)),
    *(f"scumbag{'!' * (k % 3)} you vilest idiots number {k} and thing{k}" for k in range(20)),
    None, "", "   ", "one", "é" * 500, "word " * 3000,
    "near copy of a text with many words in it so that only one of them differs from all the others here today",
    "near copy of a text with many words in it so that only one of them differs from all the others here tomorrow",
    "exact copy of another", "exact copy of another", "first " + PASSAGE + "end one", "second " + PASSAGE + "end two",
    "before the benchmark asks what is the tallest tower in the old town today and after it", "<|endoftext|> and   odd ́ signs\x00"]
ITEMS = [(1, "What is the tallest tower in the old town today"), (2, ""), (None, "x"), (4, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)] + [(None, "no id at all", None, None, None), (3, TEXTS[3], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(k, None, int(30 <= k < 50)) for k in range(50)] + [(1, 1, 0), (None, 1, 1), (999, 0, 1), (50, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def table(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        result = pipeline.pin(stage(spark, docs, folder), name)
        out.append((name, docs, result))
        docs = result
    return out


def test_names_and_columns(steps):
    assert [name for name, _, _ in steps] == ["toxicity", "near_duplicates", "repeated_strings", "benchmark", "tokens"]
    for _, _, result in steps[:-1]:
        assert [f"{n} {t}" for n, t in result.dtypes] == [c.strip().replace(" long", " bigint") for c in SCHEMA.split(",")]


def test_toxic_documents_go(steps):
    _, docs, kept = steps[0]
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & set(range(30, 50)) and left >= {*range(30), *range(50, len(TEXTS)), None}
    assert set(table(kept)) <= set(table(docs)) and kept.count() == docs.count() - 20


def test_one_of_near_duplicates_stays(steps):
    _, docs, kept = steps[1]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = plain_near([(d, t) for d, t in rows if d is not None])
    want = sorted((r for r in table(docs) if r[0] is None or found[r[0]][2]), key=str)
    assert table(kept) == want and kept.count() < docs.count()


def test_repeated_strings_go(steps):
    _, docs, kept = steps[2]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first: dict[bytes, float] = {}
    number = lambda d: 2**62 if d is None else d
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            first[data[i:i + 50]] = min(first.get(data[i:i + 50], 2**63), number(d))
    want = []
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first[data[i:i + 50]] < number(d):
                gone[i:i + 50] = True
        left = bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
        want.append((d, None if t is None else left, None if t is None else len(left)))
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()), key=str)
    assert got == sorted(want, key=str) and any(len(a or "") < len(t or "") for (_, a, _), (_, t) in zip(sorted(want, key=str), sorted(rows, key=str), strict=True))


def test_benchmark_passages_go(spark, steps):
    _, docs, kept = steps[3]
    before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in kept.collect()}
    hits = plain_hits(list(before.items()), [(i, t) for i, t in ITEMS if i is not None])
    assert before.keys() == after.keys()
    assert {d for d in before if before[d] != after[d]} == {d for d, h in hits.items() if h[4]} != set()
    assert after[TEXTS.index(TEXTS[-2])] == "before the benchmark asks  and after it"


def test_tokens_are_the_librarys(steps):
    _, docs, encoded = steps[4]
    library = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    assert encoded.count() == docs.count() and encoded.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]
    for r in encoded.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["round_trip"]


def test_run_is_the_stages(spark, folder, steps):
    assert table(pipeline.run(spark, folder)) == table(steps[-1][2])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-3:] == ["ids", "n_tokens", "round_trip"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        # No labels and no benchmark: nothing is toxic, nothing leaked.
        count = stage(spark, docs, str(tmp_path)).count()
        assert count == docs.count() if name != "near_duplicates" else count < docs.count()


def plain_lexicon_hits(folded, weights, phrases):
    found = {}
    for term, weight in weights.items():
        at = folded.find(term)
        while at >= 0:
            found[at] = max(weight, found.get(at, 0.0))
            at = folded.find(term, at + 1)
    for phrase in phrases:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            for place in [p for p in found if at <= p < at + len(phrase) + 1]:
                del found[place]
            at = folded.find(f" {phrase} ", at + 1)
    return found


def test_lexicon_against_plain_search():
    random = np.random.Generator(np.random.PCG64(6))
    words = ["ab", "abc", "abcd", "abcde", "bcd", "cd", "x", "abx", "dab"]
    for _ in range(300):
        weights = {f" {w}{' ' * int(random.integers(2))}": float(random.integers(1, 9)) for w in random.choice(words, 4)}
        phrases = [" ".join(random.choice(words, 2)) for _ in range(3)]
        folded = toxicity.fold(" ".join(random.choice(words, 12)))
        lexicon = toxicity.Lexicon(weights, phrases)
        assert lexicon.hits(folded) == plain_lexicon_hits(folded, weights, phrases)
        values = plain_lexicon_hits(folded, weights, phrases).values()
        assert lexicon.features(folded)[0] == max(values, default=0.0)
        assert lexicon.features(folded)[1:] == pytest.approx([np.log1p(sum(values)), np.log1p(100 * sum(values) / (folded.count(" ") + 1))])
    assert toxicity.Lexicon({}, ["a b"]).hits(" a b ") == {}
