"""The operators against plain versions on small tables, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recohort.llm import decontaminate, minhash, neighbours, ngrams, quality, suffixes, toxicity

FOLDER = "/root/testdata/sf0.001"
N = ngrams


def pairs(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(*columns).collect()]


LAST = 2**62  # Stands for a null doc_id, which comes after all others.


def lowered(text) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def blank_words(text) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))


def letter_words(text) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_repeats(docs):
    """Rows of op3 by looking up every 50-byte string."""
    texts = [(LAST if doc_id is None else doc_id, (text or "").encode()) for doc_id, text in docs]
    first: dict[bytes, int] = {}
    for doc_id, text in texts:
        for i in range(len(text) - 49):
            string = text[i:i + 50]
            first[string] = min(first.get(string, doc_id), doc_id)
    rows = []
    for doc_id, text in texts:
        removed = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if first[text[i:i + 50]] < doc_id:
                removed[i:i + 50] = True
        spans = int((removed & ~np.append(False, removed[:-1])).sum()) if len(text) else 0
        kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
        rows.append((None if doc_id == LAST else doc_id, len(text), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def plain_near(docs):
    """{doc_id: (n_shingles, component_id, kept)} by counting shared shingles of all pairs that share one."""
    sets = {}
    for doc_id, text in docs:
        words = blank_words(text)
        sets[doc_id] = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    having = defaultdict(list)
    for doc_id, own in sets.items():
        for shingle in own:
            having[shingle].append(doc_id)
    shared = Counter(pair for ids in having.values() for pair in itertools.combinations(sorted(ids), 2))
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (one, two), both in shared.items():
        if 100 * both >= 75 * (len(sets[one]) + len(sets[two]) - both):
            low, high = sorted((root(one), root(two)))
            parent[high] = low
    return {doc_id: (len(own), root(doc_id), root(doc_id) == doc_id) for doc_id, own in sets.items()}


def plain_hits(docs, items):
    """{doc_id: the other columns of op8} by looking up every run of words."""
    windows: dict[tuple, set[str]] = {}
    for item_id, text in items:
        words = letter_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i:i + 10]), set()).add(str(item_id))
    sizes = sorted({len(window) for window in windows})
    out = {}
    for doc_id, text in docs:
        words, hit, found = letter_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i:i + size]))
                if owners:
                    found |= owners
                    hit |= set(range(i, i + size))
        out[doc_id] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def plain_scores(docs):
    """{doc_id: the other columns of op9} from the formulas of interpolated modified Kneser-Ney."""
    end, start = 0, 1
    texts = {doc_id: [*blank_words(text), end] for doc_id, text in docs}
    held_out = {doc_id: zlib.crc32(str(doc_id).encode()) % 7 == 2 for doc_id in texts}
    words, bigrams = Counter(), Counter()
    for doc_id, own in texts.items():
        if not held_out[doc_id]:
            words.update(own)
            bigrams.update(zip([start, *own], own, strict=False))
    total, kinds = sum(words.values()), len(words)
    of_count = Counter(bigrams.values())
    higher = N.discounts(*[of_count[k] for k in (1, 2, 3, 4)])
    context, preceding = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (before, word), n in bigrams.items():
        context[before][0] += n
        context[before][min(n, 3)] += 1
        preceding[word] += 1
    of_preceding = Counter(preceding.values())
    lower = N.discounts(*[of_preceding[k] for k in (1, 2, 3, 4)])
    lost = lower[1] * of_preceding[1] + lower[2] * of_preceding[2] + lower[3] * (len(preceding) - of_preceding[1] - of_preceding[2])
    rest = lost / len(bigrams) / (kinds + 1)

    def probability(before, word):
        q = (max(preceding[word] - lower[min(preceding[word], 3)], 0) / len(bigrams) if word in preceding else 0) + rest
        if before not in context:
            return q
        n, one, two, more = context[before]
        count = bigrams.get((before, word), 0)
        return max(count - higher[min(count, 3)], 0) / n + (higher[1] * one + higher[2] * two + higher[3] * more) / n * q

    return {doc_id: (held_out[doc_id], len(own), sum(words[w] > 0 for w in own), total,
                     sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in own),
                     sum(math.log10(probability(a, c)) for a, c in zip([start, *own], own, strict=False))) for doc_id, own in texts.items()}


HARD = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "A b c d e f g"), (4, "A b c d e f g"), (5, "one"), (6, "x" * 400), (7, "y" + "x" * 90), (None, "x" * 120)]


def test_repeats(spark):
    hard = spark.createDataFrame(HARD, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.remove_repeats(hard, digest=True).collect()), key=str) == plain_repeats(HARD)
    whole = suffixes.remove_repeats(spark.createDataFrame([(*r, "z") for r in HARD], "doc_id long, text string, payload string"))
    assert whole.columns == ["doc_id", "text", "payload"] and whole.count() == len(HARD)
    assert sorted(map(tuple, suffixes.op3_suffix_dedup(spark, FOLDER).collect()), key=str) == plain_repeats(pairs(spark, "documents", "doc_id", "text"))


def test_near_duplicates(spark):
    found = {r[0]: tuple(r)[1:] for r in minhash.op4_minhash(spark, FOLDER).collect()}
    assert found == plain_near(pairs(spark, "documents", "doc_id", "text"))
    hard = minhash.near_duplicates(spark.createDataFrame(HARD, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in hard} >= {(1, 1), (2, 2), (3, 3), (4, 3), (5, 5)}


def near(spark, rows, schema="doc_id long, text string"):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_near_duplicates_of_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, z = " ".join(words), " ".join([*words, "more"]), "something that is quite unlike all the other texts"
    # The rows of document 1 are not alike; 2 is near one of them.
    assert near(spark, [(1, a), (1, z), (2, b)]) == [(1, 5, 1, True), (1, 56, 1, True), (2, 57, 1, False)]
    # Document 4 stands and falls as a whole, and what is only linked through it is one component.
    assert near(spark, [(2, a), (4, z), (4, a), (9, z), (5, "alone"), (None, z), (None, "x y")]) == sorted(
        [(2, 56, 2, True), (4, 5, 2, False), (4, 56, 2, False), (9, 5, 2, False), (5, 1, 5, True), (None, 5, 2, False), (None, 1, None, True)], key=str)


def test_near_duplicates_of_hard_tables(spark):
    hard = [(1, "tab\tand\x0bblank  A B c", "x", 5, 1), (2, "TAB and\nblank a b C", "y", 6, 2), (3, "é " * 30000 + "end", "z", 7, 3), (4, "é " * 30001 + "end", "z", 7, 3)]
    schema = "doc_id long, text string, kept string, n_shingles int, component long"
    assert near(spark, hard, schema) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True), (4, 2, 3, False)]
    assert near(spark, [], schema) == [] and near(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_decontamination(spark):
    found = {r[0]: tuple(r)[1:] for r in decontaminate.op8_decontaminate(spark, FOLDER).collect()}
    assert found == plain_hits(pairs(spark, "documents", "doc_id", "text"), pairs(spark, "benchmark", "item_id", "text"))
    docs = spark.createDataFrame([(1, "The a b c d e f g h i j the x"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "THE"), (2, "a b c d e f g h i j a"), (3, ""), (4, None), (None, "x")], "item_id long, text string")
    once, split = decontaminate.find_items(docs, items), decontaminate.find_items(docs, items, group_bytes=8)
    assert sorted(map(str, once.collect())) == sorted(map(str, split.collect()))
    assert [r["text"] for r in decontaminate.cut_spans(once).orderBy("doc_id").collect()] == [" x", None, ""]


def test_model(spark):
    found = {r[0]: tuple(r)[1:] for r in ngrams.op9_ngrams(spark, FOLDER).collect()}
    want = plain_scores(pairs(spark, "documents", "doc_id", "text"))
    assert found.keys() == want.keys()
    for k, w in want.items():
        assert found[k][:4] == w[:4]
        assert found[k][4:] == pytest.approx(w[4:], abs=1e-5)


def test_model_of_hard_tables(spark):
    rows = [(1, None, 2), (2, "", 3), (3, "one two one two one", 4), (3, "one two one two one", 4), (None, "Two", 5), (5, "never seen", 6), (6, "x" * 100_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    learnt = docs.where("doc_id <= 3")
    found = ngrams.score(docs, ngrams.train(learnt, 3)).collect()
    # Learnt are four ends and ten words, of three kinds in all.
    want = {None: (2, 2), 1: (1, 1), 2: (1, 1), 3: (6, 6), 5: (3, 1), 6: (2, 1)}
    assert len(found) == len(rows) and all((r["n_tokens"], r["n_known"]) == want[r["doc_id"]] and r["score"] < 0 for r in found)
    assert next(r["base_score"] for r in found if r["doc_id"] == 1) == pytest.approx(math.log10(5 / (14 + 3 + 1)))
    # Nothing learnt: every token has probability 1 / (0 + 1).
    none = ngrams.train(docs.limit(0), 2)
    assert {(r["score"], r["base_score"], r["n_known"]) for r in ngrams.score(docs, none).collect()} == {(0.0, 0.0, 0)}
    assert none.train_tokens == 0 and ngrams.score(docs.limit(0), none).count() == 0 and ngrams.score(docs.limit(0), ngrams.train(learnt, 3)).count() == 0


def test_neighbours(spark):
    rows = [(int(i), v) for i, v in pairs(spark, "embeddings", "vec_id", "embedding")]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = defaultdict(list)
    for r in neighbours.op5_neighbours(spark, FOLDER).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in ids[ids % 50 == 0]:
        c = neighbours.cosines(vectors[ids == q][0], vectors)
        c[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -c))[:5]]) & set(found[q]))
    assert hits >= 0.9 * 5 * len(found)


def test_neighbours_of_many_queries(spark, monkeypatch):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    broadcast = sorted(map(tuple, neighbours.op5_neighbours(spark, FOLDER).collect()))
    monkeypatch.setattr(neighbours, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, neighbours.op5_neighbours(spark, FOLDER).collect())) == broadcast
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


HARD_VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [2.0, 0.1]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [4.0, 0.2]),
                (7, [float("inf"), 1.0]), (8, [1e-200, 1e-200]), (9, []), (10, [0.0, -3.0]), (11, [0.5]), (50, [7.0]), (100, [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("limit", [1_280_000, 0])
def test_neighbours_of_hard_rows(spark, monkeypatch, limit):
    """Repeated ids, equal vectors and cosines, unsound vectors, several lengths: every row's results are its own."""
    monkeypatch.setattr(neighbours, "BROADCAST_NUMBERS", limit)
    hard = spark.createDataFrame([(*r, 1, "x") for r in HARD_VECTORS], "vec_id long, embedding array<double>, block int, asked string")
    found = Counter(tuple(r) for r in neighbours.nearest(hard, F.col("vec_id") % 50 == 0, 3).selectExpr("query_id", "rank", "vec_id", "round(score, 12)").collect())
    near = round(2 / math.sqrt(4.01), 12)
    # Both rows with id 0 have the other one first, then the equal cosines of 3 and 6 by id.
    assert found == Counter({(0, 1, 0, 1.0): 2, (0, 2, 3, near): 2, (0, 3, 6, near): 2, (50, 1, 5, 1.0): 1, (50, 2, 11, 1.0): 1})
    tiny = neighbours.nearest(hard.where("vec_id in (8, 10)"), F.col("vec_id") == 8).first()
    assert tiny["vec_id"] == 10 and tiny["score"] == pytest.approx(-math.sqrt(0.5))
    assert neighbours.nearest(hard.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(hard, F.lit(None).cast("boolean")).count() == 0


def test_neighbour_search_counts_collisions():
    """Recall against brute force, few vectors verified, and the same with and without a bound or a sample."""
    random = np.random.Generator(np.random.PCG64(9))
    vectors = random.normal(size=(6000, 64))
    ids = np.arange(6000)
    block = neighbours.Block(ids, vectors)
    asked = ids[::100]
    limits = neighbours.bounds(asked, vectors[asked], (ids[:3000], vectors[:3000]), 5)
    found, scores, verified = block.search(vectors[asked], asked, 5, limits)
    alone = block.search(vectors[asked], asked, 5)[0]
    hits = other = 0
    for j, q in enumerate(asked):
        c = neighbours.cosines(vectors[q], vectors)
        c[q] = -9
        want = set(np.argsort(-c)[:5].tolist())
        hits += len(want & set(found[j].tolist()))
        other += len(want & set(alone[j].tolist()))
        assert scores[j].tolist() == c[found[j]].tolist() and limits[j] >= math.sqrt(2 - 2 * np.sort(c)[-5])
    assert hits >= 0.93 * 5 * len(asked) and other >= 0.93 * 5 * len(asked)
    assert verified.mean() < 0.1 * len(ids)
    # A window's bounds and the counted ranks say the same as the projections themselves.
    heights = vectors / np.linalg.norm(vectors, axis=1)[:, None] @ block.lines
    low, size = block.windows(heights[:3], np.full(3, 0.7))
    for j in range(3):
        assert (block.collisions(low[j], size[j]) == (np.abs(heights - heights[j]) <= 0.7).sum(axis=1)).mean() > 0.999


def test_classifiers_take_hard_rows(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (6, None), (1, 1)], "doc_id long, label int")
    for module in (toxicity, quality):
        found = module.score(docs, module.fit(docs, labels)).collect()
        assert len(found) == len(HARD) and all(0 <= r["score"] <= 1 for r in found)
        none = module.score(docs, module.fit(docs, labels.limit(0)))
        assert none.count() == len(HARD)


def test_signs_and_digits_for_letters():
    lexicon = toxicity.Lexicon({toxicity.fold(w): 1.0 for w in ("scum", "idiot", "asshole", "kill", "ass")}, [])
    for word in ("scum", "SCUM!!", "scum!", "scum$$$", "scum|", "|scum|", "!!scum!!", "SCUM!!,", "$cum", "s\u0441um!", "id1ot", "idi0t", "!d!ot", "id|ot!!",
                 "assho1e", "a$$ho|e", "ki11", "k!ll!", "as$", "a$$", "\u0456diot", "scum$", "sc\u00fam!!"):
        assert lexicon.hits(toxicity.fold(f"x {word} y")), word
    for word in ("scummy", "as", "skill", "a !! b", "| |"):
        assert not lexicon.hits(toxicity.fold(f"x {word} y")), word


def test_only_copies_are_learnt_from_once(spark):
    # All texts share their long words; only the first two rows are copies, and the third has another label.
    texts = [(1, "Common opening statement a1"), (2, " common  opening statement A1"), (3, "common opening statement a1"),
             *((i, f"common opening statement b{i} c{i}") for i in range(4, 24)), (30, None), (31, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i, _ in texts], "doc_id long, label int")
    sample = toxicity._sample(docs, labels, 100).collect()
    assert len(sample) == 23 and sum(r["label"] for r in sample) == 1
