"""Text quality: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

A word is met as two tokens: what it says (its lower-cased bytes) and how it is written (case, length, what it ends with,
whether the pair of words has been in the text before). Tokens fall into BUCKETS; each bucket has a sparse random index
vector, and its word vector is that plus the normed sum of the index vectors of its neighbours over all documents. So what
is gathered from the corpus has a fixed size, while every document counts. A document is the mean of its tokens' vectors.

The network (one hidden layer) learns from at most MAX_LABELLED labelled rows, those first by a hash of doc_id; a fifth of
them is held back to calibrate the probabilities by a temperature. Every text is scored whole.

Defined results: null and empty texts are the zero vector before scaling and get its score; a null label is not learnt from;
without labels of both kinds the score is the share of label 1 (0.5 without any); an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recohort.llm.text import NOT_SPACE, Chunk, chunks, mix, small_batches
from recohort.llm.toxicity import remainder

BUCKETS, DIMS, NONZERO = 4096, 64, 6
SHAPES = 512
HIDDEN = 32
MAX_LABELLED = 20_000
GOOD_FROM = 0.3
_SEED = 11


def index_vectors() -> np.ndarray:
    """Sparse vectors of -1, 0 and 1, one for each bucket."""
    random = np.random.Generator(np.random.PCG64(_SEED))
    vectors = np.zeros((BUCKETS, DIMS))
    for row in vectors:
        row[random.choice(DIMS, NONZERO, replace=False)] = random.choice([-1.0, 1.0], NONZERO)
    return vectors


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens in order (two for a word), and the number of tokens before each text."""
    starts, ends, before = chunk.words(NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), before
    low = chunk.lowered().hash_spans(starts, ends)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    length = ends - starts
    first, last = chunk.data[starts], chunk.data[ends - 1]
    second = chunk.data[np.minimum(starts + 1, ends - 1)]
    upper = lambda b: ((b >= 0x41) & (b <= 0x5A)).astype(np.int64)
    sign = np.where((last >= 0x30) & (last <= 0x39), 1, np.where((last | 0x20 >= 0x61) & (last | 0x20 <= 0x7A) | (last >= 0x80), 0, last))
    doubled = (length > 1) & (last == chunk.data[np.maximum(ends - 2, 0)]) & (sign > 1)
    pair = mix(low[:-1] ^ (low[1:] * np.uint64(3)) ^ doc[1:].astype(np.uint64) << np.uint64(40)) if len(low) > 1 else np.zeros(0, np.uint64)
    again = np.ones(len(low), bool)
    # A pair across two texts is none, so what stands before a text does not matter.
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    again[1 + inside[np.unique(pair[inside], return_index=True)[1]]] = False
    again[before[:-1][before[:-1] < before[1:]]] = False
    shape = upper(first) | upper(second) << 1 | doubled.astype(np.int64) << 2 | again.astype(np.int64) << 3 | np.minimum(np.log2(length).astype(np.int64), 5) << 4 | sign.astype(np.int64) << 8
    out = np.empty(2 * len(low), np.int64)
    out[0::2] = (low % np.uint64(BUCKETS - SHAPES)).astype(np.int64)
    out[1::2] = BUCKETS - SHAPES + (mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    return out, 2 * before


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each bucket stands near each other, times the index vectors."""
    index, pairs = index_vectors(), np.zeros(BUCKETS * BUCKETS, np.int32)
    held: list[np.ndarray] = []
    seen = np.zeros(BUCKETS, np.int64)

    def flush():
        np.add(pairs, np.bincount(np.concatenate(held), minlength=len(pairs)), out=pairs, casting="unsafe")
        held.clear()

    for chunk in chunks(batches):
        found, before = tokens(chunk)
        doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
        seen += np.bincount(found, minlength=BUCKETS)
        for gap in (1, 2):
            inside = doc[gap:] == doc[:-gap]
            held.append(found[:-gap][inside] * BUCKETS + found[gap:][inside])
        if sum(map(len, held)) > 4_000_000:
            flush()
    if seen.any():
        if held:
            flush()
        table = pairs.reshape(BUCKETS, BUCKETS)
        near = np.empty((BUCKETS, DIMS))
        for at in range(0, BUCKETS, 512):
            near[at:at + 512] = table[at:at + 512].astype(np.float32) @ index + table[:, at:at + 512].T.astype(np.float32) @ index
        kept = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(seen[kept]), pa.array(list(near[kept]), pa.list_(pa.float64()))], names=["bucket", "n", "near"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One vector for each bucket, from all documents: BUCKETS x DIMS numbers, whatever the size of the corpus."""
    parts = docs.select("text").mapInArrow(_neighbours, "bucket long, n long, near array<double>")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("near")[k]).alias(f"v{k}") for k in range(DIMS)))
    vectors = index_vectors()
    rows = sums.toPandas().to_numpy(float)
    if len(rows):
        bucket, n, near = rows[:, 0].astype(int), rows[:, 1], rows[:, 2:]
        mean = near / n[:, None]
        mean -= np.average(mean, axis=0, weights=n)
        vectors[bucket] += mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9) * np.sqrt(NONZERO)
    return vectors


def pooled(chunk: Chunk, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text, its length (log) and its share of seen pairs through their tokens."""
    found, before = tokens(chunk)
    out = np.zeros((len(chunk), DIMS + 1))
    counts = np.diff(before)
    full = np.flatnonzero(counts)
    if len(full):
        for at in range(0, len(full), 64):
            some = full[at:at + 64]
            begin, end = before[some[0]], before[some[-1] + 1]
            out[some, :DIMS] = np.add.reduceat(vectors[found[begin:end]], before[some] - begin, axis=0)
        out[full, :DIMS] /= counts[full, None]
        out[full, DIMS] = np.log1p(counts[full])
    return out


class Network:
    """Two layers; scaled inputs, tanh, one output, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 256):
        random = np.random.Generator(np.random.PCG64(_SEED))
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        order = random.permutation(len(x))
        x, y = x[order], y[order]
        # Copies must not stand on both sides: rows with the same inputs go to the side of the first.
        side = (mix(np.ascontiguousarray(x[:, 0]).view(np.uint64)) % np.uint64(5) == 0)
        if len(set(y[side].tolist())) < 2 or len(set(y[~side].tolist())) < 2:
            side = np.arange(len(x)) % 5 == 0
        self.mean, self.scale = x[~side].mean(0), x[~side].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        learn, target = z[~side], y[~side]
        self.w = [random.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            take = random.integers(0, len(learn), batch)
            a = learn[take]
            h = np.tanh(a @ self.w[0] + self.w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - target[take]) / batch
            dh = d[:, None] * self.w[2] * (1 - h * h)
            for k, g in enumerate((a.T @ dh + 1e-4 * self.w[0], dh.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] = self.w[k] - 0.01 * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        raw, held = self.raw(x[side]), y[side]
        losses = {t: np.mean(np.logaddexp(0, raw / t) - held * raw / t) for t in np.geomspace(0.2, 20, 60)}
        self.temperature = float(min(losses, key=losses.get))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors from all docs, and the network from a bounded number of labels (doc_id, label 0 or 1)."""
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    chosen = labels.where("doc_id is not null and label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column("label").cast(pa.float64()), pa.array(list(pooled(chunk, vectors)), pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.mapInArrow(run, "label double, x array<double>").toPandas()
    if not len(found):
        return vectors, Network(np.zeros((0, DIMS + 1)), np.zeros(0))
    x, y = np.stack(found["x"].to_numpy()), found["label"].to_numpy()
    order = np.lexsort([*x.T[::-1], y])
    return vectors, Network(x[order], y[order])


def score(docs: DataFrame, model: tuple[np.ndarray, Network], name: str = "score") -> DataFrame:
    """All columns of docs and the probability of label 1. A column of docs with that name is replaced."""
    vectors, network = model
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([*chunk.batch.columns, pa.array(network.probability(pooled(chunk, vectors)))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
