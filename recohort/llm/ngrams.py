"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped into memory by workers.

Counting. Tasks reduce their texts to distinct bigrams with counts, as packed arrays dealt by the first word and a salt of the
second, so that the followers of a very common word are spread over SALTS places. A merge sorts each bucket, writes it as a
file of sorted 64-bit hashes and counts, and passes on what single words need: how many followers of each count a word has
(Ns of its context) and how many words precede it (its continuation count). A second merge, dealt by word, adds those up with
the words' own counts and writes the vocabulary's files. Only file names, counts of counts and totals go to the driver.

Scoring. Workers map the files of the shared folder into memory (a folder that is no local path is read file by file instead)
and look up the distinct words and bigrams of a few megabytes of text at a time, in sorted order.

    p(c | b) = max(n(bc) - D(n(bc)), 0) / n(b) + (D1 N1(b) + D2 N2(b) + D3 N3+(b)) / n(b) * q(c)
    q(c)     = max(k(c) - E(k(c)), 0) / K + (E1 M1 + E2 M2 + E3 M3+) / K / (V + 1)

k(c) is the continuation count, K its sum, M counts words by it, D and E are the discounts of both orders. A text is preceded
by a start that is no token and followed by an end that is one.

Defined results: a null text is empty and is its end alone; without texts to learn from every token has probability 1 / (V + 1);
repeated rows each count; an empty table gives no row; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recohort.llm.frames import open_folder
from recohort.llm.text import NOT_SPACE, Chunk, chunks, mix, small_batches
from recohort.llm.toxicity import remainder
from recohort.session import new_folder, pin

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
SALTS = 16
#: Tokens that a task reduces or scores at a time.
TOKENS = 1 << 21


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, text) of every token, the end of each text included."""
    own = chunk.lowered()
    starts, ends, before = own.words(NOT_SPACE)
    n = len(chunk)
    word = np.empty(len(starts) + n, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(before) + 1)
    last = before[1:] + np.arange(n)
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[last] = END
    word[inner] = own.hash_spans(starts, ends)
    previous = np.empty_like(word)
    previous[1:] = word[:-1]
    previous[before[:-1] + np.arange(n)] = START
    return previous, word, doc


def bigram_bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(first + (second % np.uint64(SALTS)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def bigram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + mix(second))


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word ^ np.uint64(0x77)) % np.uint64(buckets)).astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed piece; unpacked() needs their types."""
    return zstandard.ZstdCompressor(level=1).compress(np.uint64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns))


def unpacked(pieces, *types: str) -> list[np.ndarray]:
    """The columns of all pieces, one piece after another."""
    out: list[list] = [[] for _ in types]
    for piece in pieces:
        raw = zstandard.ZstdDecompressor().decompress(piece)
        n, at = int(np.frombuffer(raw, "u8", 1)[0]), 8
        for held, kind in zip(out, types, strict=True):
            held.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(held) if held else np.zeros(0, kind) for held, kind in zip(out, types, strict=True)]


def _parts(kind: str, bucket: np.ndarray, *columns: np.ndarray) -> list[tuple[str, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    numbers, begins = np.unique(bucket[order], return_index=True)
    ends = np.append(begins[1:], len(bucket))[:len(begins)]
    return [(kind, int(k), packed(*(c[order[a:b]] for c in columns))) for k, a, b in zip(numbers, begins, ends, strict=True)]


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and each value added up by key."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[begins], *(np.add.reduceat(v[order], begins, dtype=v.dtype) for v in values)]


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            first, second = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, at, n = np.unique(bigram_hash(first, second), return_index=True, return_counts=True)
            words, counts = np.unique(second, return_counts=True)
            first, second = first[at], second[at]
            order = np.argsort(first, kind="stable")
            first, second, n = first[order], second[order], n[order]
            rows = _parts("bigram", bigram_bucket(first, second, buckets), first, second, n.astype(np.uint32))
            rows += _parts("word", word_bucket(words, buckets), words, counts.astype(np.uint32))
            kinds, numbers, pieces = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(numbers, pa.int32()), pa.array(pieces, pa.binary())], names=["kind", "bucket", "piece"])

        size = 0
        for chunk in chunks(batches):
            first, second, _ = tokens(chunk)
            held.append((first, second))
            size += len(second)
            if size >= TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _write(folder: str, name: str, *columns: np.ndarray) -> str:
    """Columns side by side in a file of its own; how many rows it has is in its name's row."""
    system, place = open_folder(folder)
    system.create_dir(place, recursive=True)
    path = f"{place}/{name}-{uuid.uuid4().hex}.bin"
    with system.open_output_stream(path, compression=None) as sink:
        for column in columns:
            sink.write(column.tobytes())
    return path


BIGRAM_TYPES = ("u8", "u4")
WORD_TYPES = ("u8", "u8", "u4", "u4", "u4", "u4")


def _merge_parts(folder: str, buckets: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = key
        if kind == "word":
            words, n = unpacked(rows["piece"], "u8", "u4")
            out = [("word", int(bucket), packed(*_summed(words, n.astype(np.uint64))))]
        else:
            first, second, n = unpacked(rows["piece"], "u8", "u8", "u4")
            name = bigram_hash(first, second)
            order = np.argsort(name, kind="stable")
            name = name[order]
            begins = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            n = np.add.reduceat(n[order].astype(np.uint64), begins)
            name, first, second = name[begins], first[order[begins]], second[order[begins]]
            path = _write(folder, "bigrams", name, np.minimum(n, 0xFFFFFFFF).astype(np.uint32))
            of = [(n == k).astype(np.uint32) for k in (1, 2)] + [(n > 2).astype(np.uint32)]
            context, *ns = _summed(first, *of)
            follower, preceding = _summed(second, np.ones(len(second), np.uint32))
            out = _parts("context", word_bucket(context, buckets), context, *ns)
            out += _parts("preceded", word_bucket(follower, buckets), follower, preceding)
            counted = np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], np.uint64)
            out.append(("file", int(bucket), f"{path}\n{bucket}\n{' '.join(map(str, counted))}".encode()))
        return pd.DataFrame(out, columns=["kind", "bucket", "piece"])

    return run


def _merge_words(folder: str):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pieces = {kind: some["piece"] for kind, some in rows.groupby("kind")}
        out = [("bigrams", *_line(p)) for p in pieces.get("file", [])]
        words, n = unpacked(pieces.get("word", []), "u8", "u8")
        context, *ns = unpacked(pieces.get("context", []), "u8", "u4", "u4", "u4")
        follower, preceding = unpacked(pieces.get("preceded", []), "u8", "u4")
        zeros = lambda k, kind: np.zeros(len(k), kind)
        every = np.concatenate([words, context, follower])
        columns = [np.concatenate([n, zeros(context, "u8"), zeros(follower, "u8")])]
        columns += [np.concatenate([zeros(words, "u4"), x, zeros(follower, "u4")]) for x in ns]
        columns.append(np.concatenate([zeros(words, "u4"), zeros(context, "u4"), preceding]))
        every, count, n1, n2, n3, before = _summed(every, *columns)
        if len(every):
            path = _write(folder, "words", every, count, n1, n2, n3, before)
            seen = before > 0
            totals = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int(before.sum()), int(seen.sum()), int(count.sum()), int((count > 0).sum())]
            out.append(("words", path, int(key[0]), len(every), [float(t) for t in totals]))
        return pd.DataFrame(out, columns=["kind", "path", "bucket", "n", "totals"])

    def _line(piece: bytes) -> tuple:
        path, bucket, counted = piece.decode().split("\n")
        numbers = [float(x) for x in counted.split()]
        return path, int(bucket), int(numbers[-1]), numbers

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """D0 to D3+ from counts of counts; where a small corpus leaves one out of range, half the count is taken off at most."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    found = [0.0]
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if low else 0.0
        found.append(d if 0 < d < k else 0.5 * k)
    return np.array(found)


class Arrays:
    """One file of sorted hashes and their columns, mapped into memory."""

    def __init__(self, folder: str, path: str, n: int, types: tuple[str, ...]):
        from pyarrow import fs

        system, _ = open_folder(folder)
        if isinstance(system, fs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, "r")
        else:
            with system.open_input_file(path) as source:
                raw = np.frombuffer(source.read(), np.uint8)
        at, self.columns = 0, []
        for kind in types:
            size = n * np.dtype(kind).itemsize
            self.columns.append(raw[at:at + size].view(kind))
            at += size

    def look_up(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the sorted names stand, and whether they do."""
        keys = self.columns[0]
        at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
        return at, keys[at] == names


class Model:
    """The totals of a counted corpus and the names of its files. Workers open the files when they first need them."""

    def __init__(self, folder: str, buckets: int, files: list):
        self.folder, self.buckets = folder, buckets
        self.paths = {(r["kind"], r["bucket"]): (r["path"], r["n"]) for r in files}
        total = {kind: np.sum([r["totals"] for r in files if r["kind"] == kind] or [[0.0] * 8], axis=0) for kind in ("bigrams", "words")}
        self.higher, self.lower = discounts(*total["bigrams"][:4]), discounts(*total["words"][:4])
        m1, m2 = total["words"][:2]
        self.preceding, types, self.train_tokens, self.train_types = total["words"][4:8]
        lost = self.lower[1] * m1 + self.lower[2] * m2 + self.lower[3] * (types - m1 - m2)
        self.rest = (lost / self.preceding if self.preceding else 1.0) / (self.train_types + 1)

    def opened(self, kind: str, bucket: int) -> Arrays | None:
        if not hasattr(self, "_open"):
            self._open = {}
        if (kind, bucket) not in self.paths:
            return None
        if (kind, bucket) not in self._open:
            self._open[kind, bucket] = Arrays(self.folder, *self.paths[kind, bucket], BIGRAM_TYPES if kind == "bigrams" else WORD_TYPES)
        return self._open[kind, bucket]

    def _columns(self, kind: str, names: np.ndarray, bucket: np.ndarray, columns: list[int]) -> list[np.ndarray]:
        out = [np.zeros(len(names)) for _ in columns]
        order = np.argsort(bucket, kind="stable")
        numbers, begins = np.unique(bucket[order], return_index=True)
        for k, a, b in zip(numbers, begins, np.append(begins[1:], len(bucket))[:len(begins)], strict=True):
            arrays = self.opened(kind, int(k))
            if arrays is not None:
                some = order[a:b]
                at, known = arrays.look_up(names[some])
                for held, c in zip(out, columns, strict=True):
                    held[some[known]] = arrays.columns[c][at[known]]
        return out

    def logs(self, previous: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its log10 probability, its log10 base probability, and whether it was learnt."""
        words, place = np.unique(np.concatenate([previous, word]), return_inverse=True)
        count, n1, n2, n3, before = self._columns("words", words, word_bucket(words, self.buckets), [1, 2, 3, 4, 5])
        # The start is no token: it precedes as many first words as there are ends.
        context = count.copy()
        start = np.searchsorted(words, START)
        if start < len(words) and words[start] == START:
            end = np.searchsorted(words, END)
            context[start] = count[end] if end < len(words) and words[end] == END else self._ends()
        a, c = place[:len(previous)], place[len(previous):]
        near = np.maximum(before - self.lower[np.minimum(before, 3).astype(int)], 0)
        q = (near / self.preceding if self.preceding else near) + self.rest
        kept = np.where(context > 0, (self.higher[1] * n1 + self.higher[2] * n2 + self.higher[3] * n3) / np.maximum(context, 1), 1.0)
        names, which = np.unique(bigram_hash(previous, word), return_index=True)
        inverse = np.searchsorted(names, bigram_hash(previous, word))
        n, = self._columns("bigrams", names, bigram_bucket(previous[which], word[which], self.buckets), [1])
        n = n[inverse]
        p = np.maximum(n - self.higher[np.minimum(n, 3).astype(int)], 0) / np.maximum(context[a], 1) + kept[a] * q[c]
        base = (count[c] + 1) / (self.train_tokens + self.train_types + 1)
        return np.log10(p), np.log10(base), count[c] > 0

    def _ends(self) -> float:
        return float(self._columns("words", np.array([END]), word_bucket(np.array([END]), self.buckets), [1])[0][0])


def train(docs: DataFrame, buckets: int) -> Model:
    """The model of the texts of docs; its files lie in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "ngrams")
    parts = docs.select("text").mapInArrow(_counter(buckets), "kind string, bucket int, piece binary")
    merged = parts.groupBy("kind", "bucket").applyInPandas(_merge_parts(folder, buckets), "kind string, bucket int, piece binary")
    files = merged.groupBy("bucket").applyInPandas(_merge_words(folder), "kind string, path string, bucket int, n long, totals array<double>")
    # One row per file and kind.
    return Model(folder, buckets, pin(files, "files").collect())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Chunk] = []

        def flush():
            found = [tokens(c) for c in held]
            shift = np.concatenate([[0], np.cumsum([len(c) for c in held])])
            previous, word = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            doc = np.concatenate([f[2] + s for f, s in zip(found, shift, strict=False)])
            logs, base, known = model.logs(previous, word)
            n = int(shift[-1])
            ids = pa.concat_arrays([c.column("doc_id") for c in held])
            held.clear()
            return pa.RecordBatch.from_arrays([
                ids, pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[known], minlength=n)),
                pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, logs, n))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        size = 0
        for chunk in chunks(batches):
            held.append(chunk)
            size += len(chunk.data) // 6
            if size >= TOKENS // 2:
                yield flush()
                size = 0
        if held:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op9_ngrams(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held_out), max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                                     F.lit(int(model.train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
