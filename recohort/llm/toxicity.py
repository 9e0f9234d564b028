"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes accents off, turns letters of other scripts that look like Latin ones into those, undoes digit
and sign substitutions, and leaves words between single blanks. '1', '!' and '|' stand for i and for l, so i and l are one
letter here, in texts and in terms. Signs that end a word are punctuation, as are '|' and '!!' before one; one or two '$'
at its end may also be letters ('as$'), so the word is there with and without them. The lexicon is learnt: whole words and beginnings of words
that mark labelled toxic texts, weighted by their log odds. Where a word beside a hit makes it harmless more often than not
among the labelled texts, the two words are an exception phrase, and the hit does not count. What the hits weigh, also in
proportion to the length of the text, gives the probability through a logistic curve fitted to the same rows.

Bounds, all parameters: at most MAX_LABELLED labelled rows are learnt from (those first by a hash of doc_id, one of rows
with the same words and label), the lexicon has at most MAX_TERMS terms and MAX_PHRASES phrases; so the model that goes to all
tasks is bounded. Every text is scored whole.

Defined results: null and empty texts have no hits and get the score of a text without hits; a null label is not learnt
from; a doc_id labelled more than once counts as often; without labels of both kinds every score is the share of toxic
rows, or 0 without any; an empty table gives no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recohort.llm.text import giving_back, small_batches

MAX_LABELLED = 12_000
MAX_TERMS = 3_000
MAX_PHRASES = 1_000
#: Terms a task counts before it passes them on to be added up.
HELD_TERMS = 150_000
#: A term must be in this share of the toxic rows, and so much more often there than elsewhere.
MIN_SHARE, MIN_ROWS, MIN_ODDS = 0.015, 4, 3.0
#: Lengths of beginnings of words that can be terms.
STEMS = (4, 5, 6, 7)
TOXIC_FROM = 0.3

# Letters that look like the Latin letter below them, and signs written for letters; l is also i.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁɡһαβγεικνορτυχωiℓ013457@$!|€",
    "abekmhopctyxljsdghabyelknoptyxwlloleastaslle")
_MARKS = {c: None for c in range(0x300, 0x370)} | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_ASCII_FOLD = bytes(LOOKALIKES.get(b, b) for b in range(128)) + bytes(range(128, 256))
_GAPS = re.compile(r"[\W_]+")
_MAYBE_S = re.compile(r"(?<![^\W_])(?<![!|$@€])((?:[^\W_]|[!|$@€])*[^\W_])(\$\$?)(?![^\W_]|[!|$@€])")
_EDGES = re.compile(r"[!|$@€]++(?![^\W_])|(?<![^\W_])(?<![!|$@€])(?:\||!!)[!|]*+")


def fold(text: str | None) -> str:
    """The folded words between single blanks, with a blank at both ends."""
    text = (text or "").lower()
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKD", text).translate(_MARKS)
    if "$" in text:
        text = _MAYBE_S.sub(lambda m: f"{m[1]} {m[1]}{'s' * len(m[2])}", text)
    text = _EDGES.sub(" ", text)
    if plain:
        text = text.encode("ascii").translate(_ASCII_FOLD).decode("ascii")
    else:
        text = text.translate(LOOKALIKES)
    return f" {_GAPS.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """Whole words as ' word ', beginnings of words as ' begin'."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    """Weights of terms and the exception phrases, ready for matching."""

    def __init__(self, weights: dict[str, float], phrases: list[str]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not weights
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """The weight of each word that is hit, by its place; nested terms count once, by the heaviest."""
        found: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        if self.empty:
            return found
        for end, (length, weight) in self.automaton.iter(folded):
            begin = end - length + 1
            if weight is None:
                excepted.append((begin, end))
            elif weight > found.get(begin, 0.0):
                found[begin] = weight
        for begin, end in excepted:
            for place in [p for p in found if begin <= p < end]:
                del found[place]
        return found

    def features(self, folded: str) -> tuple[float, float, float]:
        weights = self.hits(folded).values()
        total = sum(weights)
        return max(weights, default=0.0), float(np.log1p(total)), float(np.log1p(100.0 * total / (folded.count(" ") + 1)))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, label): a bounded number of labelled rows; the labels, so bounded, go to the tasks that read the texts."""
    chosen = labels.where("doc_id is not null and label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    # One of rows with the same words and label is enough to learn from.
    words = F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), 256)
    return rows.withColumn("key", F.struct(words, "label")).groupBy("key").agg(F.min_by("text", "doc_id").alias("text"), F.first("label").alias("label")).select("text", "label")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        every = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[t] for t in every], pa.int64()), pa.array([clean[t] for t in every], pa.int64())],
                                         names=["term", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (toxic if label else clean).update(terms_of(fold(text)))
            if len(clean) + len(toxic) > HELD_TERMS:
                yield counted()
    yield counted()


def _log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return float(np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly penalised logistic curve, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.01] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -4, 4)
        if abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], list[str], list[float]]:
    """Lexicon, exception phrases and curve, learnt from labels (doc_id, label 0 or 1)."""
    from recohort.session import pin

    small_batches(docs.sparkSession)
    sample = pin(_sample(docs, labels, max_labelled), "toxic-sample")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return {}, [], [0.0, 0.0, 0.0, 30.0 if toxic else -30.0]
    counts = sample.mapInArrow(giving_back(_count_terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    kept = counts.where((F.col("toxic") >= max(MIN_ROWS, MIN_SHARE * toxic)) & (odds >= MIN_ODDS))
    kept = kept.orderBy((odds * F.col("toxic")).desc(), "term").limit(MAX_TERMS)
    weights = {r["term"]: _log_odds(r["toxic"], r["clean"], toxic, clean) for r in kept.collect()}
    lexicon = Lexicon(weights, [])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded, phrases = fold(text), set()
                for place in lexicon.hits(folded):
                    before = folded[:place].rsplit(" ", 1)[-1]
                    word, _, rest = folded[place + 1:].partition(" ")
                    after = rest.partition(" ")[0]
                    phrases |= {f"{before} {word}"} if before else set()
                    phrases |= {f"{word} {after}"} if after else set()
                (bad if label else good).update(phrases)
        every = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([bad[t] for t in every], pa.int64()), pa.array([good[t] for t in every], pa.int64())],
                                         names=["phrase", "toxic", "clean"])

    found = sample.mapInArrow(giving_back(beside), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = found.where("clean >= 2 and clean > toxic").orderBy(F.col("clean").desc(), "phrase").limit(MAX_PHRASES)
    phrases = [r["phrase"] for r in found.collect()]
    features = _measure(sample, weights, phrases).select("label", "heaviest", "total", "rate").toPandas().to_numpy(float)
    curve = _fit_curve(features[:, 1:], features[:, 0])
    return weights, phrases, curve.tolist()


def _measure(rows: DataFrame, weights: dict[str, float], phrases: list[str]) -> DataFrame:
    """The rows with what the hits of their texts weigh: heaviest, total, rate."""
    from pyspark.sql import types as T

    names = ["heaviest", "total", "rate"]
    rows = rows.drop(*names)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights, phrases)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            values = [lexicon.features(fold(t.as_py())) for t in texts]
            columns = [pa.array(c, pa.float64()) for c in zip(*values, strict=True)] if values else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.mapInArrow(giving_back(run), schema)


def score(docs: DataFrame, model: tuple[dict[str, float], list[str], list[float]], name: str = "score") -> DataFrame:
    """All columns of docs and the probability that the text is toxic. A column of docs with that name is replaced."""
    weights, phrases, curve = model
    columns = [c for c in docs.columns if c != name]
    held = docs.select(F.col("text"), F.struct(*columns).alias("row"))
    measured = _measure(held, weights, phrases)
    line = F.col("heaviest") * curve[0] + F.col("total") * curve[1] + F.col("rate") * curve[2] + curve[3]
    return measured.select("row.*", (1 / (1 + F.exp(-line))).alias(name))


def remainder(doc_id, by: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
