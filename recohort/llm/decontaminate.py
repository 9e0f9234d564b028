"""Benchmark decontamination with an FM-index over each shard of training texts.

A shard is some megabytes of documents. Its words become numbers of the benchmark's vocabulary; stretches of such words that
are long enough to hold a window are the indexed text (a word that no item has cannot be part of an occurrence). Its suffixes
are sorted by prefix doubling, the transform before them is kept as a wavelet matrix, and all windows are searched backwards
at once. Rows that match are walked back to sampled suffix positions, and the places found are merged into spans.

The benchmark is taken in groups of items of at most GROUP_BYTES, so what goes to the tasks is bounded; a larger benchmark
takes more passes, each of which adds its spans to those found before.

Defined results: null and empty texts have no words; items with a null id or without words take no part; repeated items and
documents each count; an item shorter than the window is one window; an empty table of items leaves all documents clean; an
empty table of documents gives no row. A column of docs named like one that is added is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recohort.llm.text import LETTERS, Chunk, chunks, each_range, giving_back, small_batches

WINDOW = 10
SHARD_BYTES = 2 << 20
GROUP_BYTES = 8 << 20
#: Every so many positions of a stretch have their place noted.
SAMPLED = 8


class Wavelet:
    """Ranks of symbols in a sequence, all in one go for many (symbol, end) pairs."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in reversed(range(bits)):
            bit = symbols >> level & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `end`."""
        begin = np.zeros_like(end)
        for level, ones, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            begin, end = (np.where(one, zeros + ones[x], x - ones[x]) for x in (begin, end))
        return end - begin


class ShardIndex:
    """FM-index of a text of numbers; 0 ends a stretch, and the last number must be 0."""

    def __init__(self, text: np.ndarray, bits: int):
        n = len(text)
        ends = text == 0
        # Each end is a symbol of its own, smaller than all others, so that no order reaches over it.
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        order = np.argsort(rank, kind="stable")
        span = 1
        while True:
            second = np.zeros(n, np.int64)
            second[:n - span] = rank[span:] + 1
            key = rank.astype(np.int64) * (int(rank.max()) + 2 if n else 1)
            key = key + np.minimum(second, int(rank.max()) + 1)
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            span *= 2
        before = np.where(order > 0, text[order - 1], 0)
        self.before = before
        self.wavelet = Wavelet(before, bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        place = np.arange(n)
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), place, 0))
        noted = (place - begin) % SAMPLED == 0
        self.noted, self.places = noted[order], order
        self.size = n

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with each pattern, [low, high). Patterns are rows, filled with 0 on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, column]
            go = symbol > 0
            some, symbol = alive[go], symbol[go]
            low[some] = self.smaller[symbol] + self.wavelet.rank(symbol, low[some])
            high[some] = self.smaller[symbol] + self.wavelet.rank(symbol, high[some])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes: steps back to the next noted one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.noted[rows])
        while len(walking):
            symbol = self.before[rows[walking]]
            rows[walking] = self.smaller[symbol] + self.wavelet.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.noted[rows[walking]]]
        return self.places[rows] + steps


class Windows:
    """All windows of some items as rows of word numbers, and the items that have each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        encoded = [t.encode("utf-8") for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
        chunk = Chunk(np.frombuffer(b"".join(encoded), np.uint8), offsets).lowered()
        starts, ends, before = chunk.words(LETTERS)
        hashes = chunk.hash_spans(starts, ends)
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes) + 1
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        known = np.zeros(1 << 20, bool)
        known[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.known = known
        found: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            words = numbers[before[k]:before[k + 1]].tolist()
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at:at + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for row, words in zip(self.rows, found, strict=True):
            row[window - len(words):] = words
        self.items = [sorted(i, key=str) for i in found.values()]
        self.least = int(self.lengths.min()) if len(found) else 0

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        likely = np.flatnonzero(self.known[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[likely]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[likely]
        out[likely[same]] = at[same] + 1
        return out


def occurrences(chunk: Chunk, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(first word, number of the window) of each occurrence in the shard, words before each text, and all words' bytes."""
    starts, ends, before = chunk.words(LETTERS)
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(windows.lengths):
        return none, none, before, (starts, ends)
    number = windows.word_numbers(chunk.hash_spans(starts, ends))
    known = number > 0
    cut = np.zeros(len(number) + 1, bool)
    cut[before[:-1]] = True
    cut[-1] = True
    first = known & (cut[:-1] | np.concatenate([[True], ~known[:-1]]))
    last = known & (cut[1:] | np.concatenate([~known[1:], [True]]))
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - begin >= windows.least
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return none, none, before, (starts, ends)
    # Each stretch is followed by a 0, which stands at the place after its last word.
    places = each_range(begin, size + 1)
    text = number[np.minimum(places, len(number) - 1)]
    text[np.cumsum(size + 1) - 1] = 0
    index = ShardIndex(text, windows.bits)
    low, high = index.find(windows.rows)
    rows = each_range(low, high - low)
    window = np.repeat(np.arange(len(low)), high - low)
    return places[index.locate(rows)], window, before, (starts, ends)


_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", _SPANS), ("items", T.ArrayType(T.StringType()))]


def _search(docs: DataFrame, windows: Windows) -> DataFrame:
    names = [n for n, _ in _ADDED]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in _ADDED)])
    earlier = "spans" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size=SHARD_BYTES):
            own = chunk.lowered()
            place, window, before, (starts, ends) = occurrences(own, windows)
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, place, 1)
            np.add.at(depth, place + windows.lengths[window] if len(place) else place, -1)
            hit = np.cumsum(depth[:-1]) > 0
            doc = np.searchsorted(before, place, "right") - 1
            found: list[set] = [set() for _ in range(len(chunk))]
            for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                found[d].update(map(str, windows.items[w]))
            spans: list[list] = [[] for _ in range(len(chunk))]
            if earlier:
                # Bytes found in earlier passes: their words are hit too.
                for k, (was, items) in enumerate(zip(chunk.column("spans").to_pylist(), chunk.column("items").to_pylist(), strict=True)):
                    found[k].update(items)
                    for s in was:
                        inside = (starts >= s["begin"] + chunk.offsets[k]) & (ends <= s["end"] + chunk.offsets[k])
                        hit |= inside
            owner = np.repeat(np.arange(len(chunk)), np.diff(before))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(hit, owner + 1, 0), [0]])) != 0)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if hit[a]:
                    k = int(owner[a])
                    spans[k].append({"begin": int(starts[a] - chunk.offsets[k]), "end": int(ends[b - 1] - chunk.offsets[k])})
            counted = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays([
                *(chunk.column(f.name) for f in kept), pa.array(np.diff(before)), pa.array(counted[before[1:]] - counted[before[:-1]]),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(s) for s in found], pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(giving_back(run), schema)


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """All columns of docs, with n_words, n_hit, spans (merged, of bytes of the text) and items (ids as sorted strings)."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    docs = docs.drop(*(n for n, _ in _ADDED))
    for group in range(groups):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group) if groups > 1 else items
        docs = _search(docs, Windows([(r["item_id"], r["text"]) for r in some.collect()], window))
    return docs


def cut_spans(docs: DataFrame) -> DataFrame:
    """The columns of docs but for what find_items added, with the spans taken out of the texts."""
    names = [n for n, _ in _ADDED]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            texts, spans = get("text").to_pylist(), get("spans").to_pylist()
            for k, cut in enumerate(spans):
                if cut:
                    raw = texts[k].encode("utf-8")
                    at = [0, *(x for s in cut for x in (s["begin"], s["end"])), len(raw)]
                    texts[k] = b"".join(raw[at[i]:at[i + 1]] for i in range(0, len(at), 2)).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else get(n) for n in schema.names], names=schema.names)

    return docs.mapInArrow(giving_back(run), schema)





def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
