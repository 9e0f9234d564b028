"""Language identification by hierarchical discrimination: first the family, then the languages within it.

A text is the share that each hashed byte n-gram (1 to 4 bytes, A-Z lower-cased) has in it, over the square root of the mean
share, so that rare n-grams count as well as common ones. One linear support vector machine for each family against all
others tells the family; within a family, one for each pair of its languages votes, and the language with the most votes
wins. All machines are linear and the shares are means over n-grams, so a text is scored in one pass: each n-gram adds the
numbers kept for its bucket, one for each machine, and whole texts of any length need no vector of their own.

The machines (squared hinge, Newton steps) learn from a bounded sample: up to PER_LANGUAGE rows of each language, up to
MAX_LABELLED in all, chosen by a hash of doc_id and text over all rows; a fifth of them is held back to calibrate the
probabilities. Families are given by language code (FAMILIES); a language that is not in the list joins the family of the
most similar learnt language that is, or, if there is none, is its own.

Defined results: lang_pred is `und` and the score 0 where the text is null or has no letter, or if nothing was learnt; with
one learnt language every other text gets it with score 1. Null languages are not learnt from, texts without a letter
neither; an empty language is a language. Votes that tie are settled by the sum of margins, then by the smaller language
name. Repeated rows are scored each on its own; an empty table gives no row; other columns are ignored, or kept by predict().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recohort.llm.text import Chunk, chunks, small_batches
from recohort.llm.toxicity import remainder
from recohort.session import pin

BUCKET_BITS, LONGEST = 12, 4
BUCKETS = 1 << BUCKET_BITS
PER_LANGUAGE, MAX_LABELLED = 1000, 4000
#: Weight of a badly told row against the size of the weights.
COST = 1.0
UNKNOWN = "und"
#: ISO 639-1 codes of written languages by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
    "austronesian": "id ms tl jv",
}


def family_of(language: str) -> str | None:
    code = language.strip().lower().replace("_", "-").split("-")[0]
    return next((family for family, codes in FAMILIES.items() if code in codes.split()), None)


def buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of 1, 2, ... bytes; the k-th starts at byte k, over the border of texts too."""
    codes = data.astype(np.uint32) + np.uint32(1)
    held = codes
    for size in range(1, LONGEST + 1):
        if size > 1:
            held = held[:-1] * np.uint32(0x01000193) + codes[size - 1:]
        if not len(held):
            return
        yield ((held * np.uint32(0x9E3779B1)) ^ (held >> np.uint32(15)) * np.uint32(size)) >> np.uint32(32 - BUCKET_BITS)


def _parts(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the texts that have n-grams, the buckets of the chunk, and where each text's first is and behind its last."""
    offsets = chunk.offsets
    for size, found in enumerate(buckets(chunk.lowered().data), 1):
        full = np.flatnonzero(np.diff(offsets) >= size)
        if len(full):
            yield full, found, np.stack([offsets[full], offsets[full + 1] - size + 1])


def shares(chunk: Chunk) -> np.ndarray:
    """Rows x BUCKETS: the mean over n of the shares of the n-grams of each text."""
    out = np.zeros((len(chunk), BUCKETS), np.float32)
    for full, found, (begin, end) in _parts(chunk):
        for row, b, e in zip(full, begin, end, strict=True):
            out[row] += np.bincount(found[b:e], minlength=BUCKETS) / ((e - b) * LONGEST)
    return out


def pooled(chunk: Chunk, weights: np.ndarray) -> np.ndarray:
    """shares(chunk) @ weights, without the shares."""
    out = np.zeros((len(chunk), weights.shape[1]))
    for full, found, (begin, end) in _parts(chunk):
        for k in range(weights.shape[1]):
            numbers = weights[:, k][found]
            # What lies between two texts is summed as a part of its own and left out.
            sums = np.add.reduceat(np.append(numbers, 0.0), np.stack([begin, end], axis=1).ravel())[::2]
            out[full, k] += sums / ((end - begin) * LONGEST)
    return out


def machine(x: np.ndarray, sign: np.ndarray, cost: float = COST) -> np.ndarray:
    """A linear support vector machine: weights and, last, the bias. Rows with sign 0 are left out; both signs weigh the same in all."""
    weight = cost * np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), np.where(sign < 0, 0.5 / max(1, (sign < 0).sum()), 0)) * (sign != 0).sum()
    w = np.zeros(x.shape[1] + 1)
    small = np.ones(len(w))
    small[-1] = 1e-3

    # The matrix is used as it is: no copy with a column of ones, of chosen rows or in another precision is made.
    def ahead(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1].astype(x.dtype) + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(r.astype(x.dtype) @ x, r.sum())

    def loss(v: np.ndarray) -> float:
        return 0.5 * (small * v * v).sum() + (weight * np.maximum(1 - sign * ahead(v), 0) ** 2).sum()

    for _ in range(20):
        short = 1 - sign * ahead(w)
        c = weight * (short > 0)
        gradient = small * w - 2 * back(c * sign * short)
        if np.linalg.norm(gradient) < 1e-4 * (1 + np.linalg.norm(w)):
            break
        # Conjugate gradients for the Newton step.
        step, left = np.zeros_like(w), -gradient
        way, size = left.copy(), left @ left
        for _ in range(30):
            bent = small * way + 2 * back(c * ahead(way))
            length = size / (way @ bent)
            step += length * way
            left -= length * bent
            before, size = size, left @ left
            if size < 1e-6 * (gradient @ gradient):
                break
            way = left + size / before * way
        now, part = loss(w), 1.0
        while loss(w + part * step) > now and part > 1e-3:
            part /= 2
        w = w + part * step
    return w


class Model:
    """Families, machines and how sharply their margins tell."""

    def __init__(self, x: np.ndarray, languages: np.ndarray, known=family_of):
        """x: shares, float32, which are scaled in place."""
        self.languages = sorted(set(languages.tolist()))
        scale = (1 / np.sqrt(x.mean(axis=0) + 1e-6) if len(x) else np.ones(BUCKETS)).astype(np.float32)
        x *= scale
        self.families = self._families(x, languages, known)
        self.names = sorted(set(self.families.values()))
        self.pairs = [p for p in combinations(self.languages, 2) if self.families[p[0]] == self.families[p[1]]]
        family = np.array([self.families[v] for v in languages.tolist()], object)
        side = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
        learn = ~side
        made = [machine(x, np.where(family == f, 1.0, -1.0) * learn) for f in self.names] if len(self.names) > 1 else []
        for a, b in self.pairs:
            made.append(machine(x, ((languages == a) * 1.0 - (languages == b)) * learn))
        table = np.stack(made, axis=1) if made else np.zeros((BUCKETS + 1, 0))
        self.bias = table[-1]
        self.weights = (table[:-1] * scale[:, None]).astype(np.float32)
        self.sharp = 1.0
        if side.any() and made:
            margins = x[side] @ table[:-1].astype(np.float32) + self.bias
            own = np.array([self.languages.index(v) for v in languages[side].tolist()])
            losses = {}
            for sharp in np.geomspace(0.25, 32, 22):
                self.sharp = float(sharp)
                losses[self.sharp] = -np.log(np.maximum(self.probabilities(margins)[np.arange(len(own)), own], 1e-9)).mean()
            self.sharp = min(losses, key=losses.get)

    def _families(self, x, languages, known) -> dict[str, str]:
        given = {v: known(v) for v in self.languages}
        middle = {v: (lambda m: m / max(np.linalg.norm(m), 1e-12))(x[languages == v].mean(axis=0)) for v in self.languages}
        told = [v for v in self.languages if given[v]]
        return {v: given[v] or (given[max(told, key=lambda t: (middle[v] @ middle[t], t))] if told else f"like {v}") for v in self.languages}

    def _families_of(self, margins: np.ndarray) -> np.ndarray:
        """How likely each family is, rows x families."""
        if len(self.names) < 2:
            return np.ones((len(margins), len(self.names)))
        own = margins[:, :len(self.names)] * self.sharp
        e = np.exp(own - own.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _votes(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per language: won pairs, sum of margins, and mean chance against the others of its family."""
        n, k = len(margins), len(self.languages)
        won, sums, chance, met = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k)), np.zeros(k)
        first = len(self.names) if len(self.names) > 1 else 0
        for at, (a, b) in enumerate(self.pairs):
            i, j, margin = self.languages.index(a), self.languages.index(b), margins[:, first + at]
            p = 1 / (1 + np.exp(-np.clip(margin * self.sharp, -700, 700)))
            won[:, i] += margin >= 0
            won[:, j] += margin < 0
            sums[:, i] += margin
            sums[:, j] -= margin
            chance[:, i] += p
            chance[:, j] += 1 - p
            met[[i, j]] += 1
        return won, sums, np.where(met > 0, chance / np.maximum(met, 1), 1.0)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Rows x languages."""
        family, chance = self._families_of(margins), self._votes(margins)[2]
        out = np.zeros_like(chance)
        for f, name in enumerate(self.names):
            own = [i for i, v in enumerate(self.languages) if self.families[v] == name]
            out[:, own] = family[:, [f]] * chance[:, own] / chance[:, own].sum(axis=1, keepdims=True)
        return out

    def tell(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language of each row, and its score."""
        family = self._families_of(margins).argmax(axis=1)
        won, sums, _ = self._votes(margins)
        inside = np.array([[self.families[v] == name for v in self.languages] for name in self.names])[family]
        most = np.where(inside, won, -1).max(axis=1, keepdims=True)
        pick = np.where(inside & (won == most), sums, -np.inf).argmax(axis=1)
        return pick, np.clip(self.probabilities(margins)[np.arange(len(pick)), pick], 0, 1)


def _has_letter(text) -> F.Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MAX_LABELLED) -> DataFrame:
    """(lang, text): rows of each language, first by a hash over all rows; about per_language of each, at most `most` in all."""
    rows = labelled.where(F.col("lang").isNotNull() & _has_letter("text")).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("lot"))
    counts = pin(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    kinds = counts.count()
    # As many of each language, so that the whole keeps its bound however many languages there are.
    each = min(per_language, max(1, most // max(1, kinds)))
    chosen = rows.join(F.broadcast(counts) if kinds <= most else counts, "lang").where((F.col("lot") / 2.0**64 + 0.5) * F.col("n") <= F.lit(float(each)))
    return chosen.orderBy("lot", "doc_id", "lang").limit(most).select("lot", "lang", "text")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = MAX_LABELLED, known=family_of) -> Model:
    """A model from rows (doc_id, text, lang)."""
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("lot"), chunk.column("lang"), pa.array([row.tobytes() for row in shares(chunk)], pa.binary())],
                                             names=["lot", "lang", "x"])

    chosen = sample(labelled, per_language, most).repartition(labelled.sparkSession.sparkContext.defaultParallelism, "lot")
    x, labels = np.zeros((most, BUCKETS), np.float32), []
    for row in chosen.mapInArrow(run, "lot long, lang string, x binary").toLocalIterator():
        x[len(labels)] = np.frombuffer(row["x"], np.float32)
        labels.append((row["lot"], row["lang"]))
    # The same order however the rows came.
    x, languages = x[:len(labels)], np.array([lang for _, lang in labels], object)
    order = sorted(range(len(labels)), key=labels.__getitem__)
    return Model(x[order], languages[order], known)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, lang_pred and score. Columns of docs with these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "_letter")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            letter = np.asarray(chunk.column("_letter").to_numpy(zero_copy_only=False), bool)
            told, score = np.full(len(chunk), UNKNOWN, object), np.zeros(len(chunk))
            if len(names):
                pick, sure = model.tell(pooled(chunk, model.weights) + model.bias)
                told, score = np.where(letter, names[pick], UNKNOWN), np.where(letter, sure, 0.0)
            kept = chunk.batch.drop_columns(["_letter"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(told.tolist(), pa.string()), pa.array(score)], names=schema.names)

    return docs.withColumn("_letter", _has_letter("text")).mapInArrow(run, schema)


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    lot = remainder(F.col("doc_id"), 4)
    model = fit(docs.where(lot != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (lot == 2).alias("held_out"), "lang_pred", "score")
