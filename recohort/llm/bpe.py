"""Byte-level BPE, encoded by numpy merge rounds over many words at once, and decoded again.

The bytes of all new words lie in one flat array of symbols. A round looks the pairs of neighbours up in the sorted keys of
the merge table (binary search), takes for each word the lowest rank, and merges every place of that pair from left to
right; words without a known pair are done. A worker keeps the ids of words that it has met, up to a bound, and then
starts anew, so its memory does not grow with the corpus.

Defined results: a null text is empty and has no ids; texts of any length are encoded whole; repeated rows give repeated
results; an empty table gives no row; other columns are ignored (`op10_bpe`) or kept (`round_trip`).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recohort.llm.text import each_range, giving_back, small_batches

#: How the vocabulary's words are cut out of a text (fixed value of byte-level BPE).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANKS_MEET = regex.compile(r"\s\s|^\s|\s$")
#: Pieces of texts a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Characters encoded at a time.
SLICE_CHARS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Merge table and vocabulary of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.none = len(order)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.hint = "<|" if all("<|" in s for s in self.special) else ""
        values = {letter: b for b, letter in letters.items()}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [bytes(values[c] for c in names[i]) if i in names and all(c in values for c in names[i]) else names.get(i, "").encode()
                  for i in range(max(names) + 1)]
        self.piece_lengths = np.array([len(p) for p in pieces])
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        encoded = [w.encode("utf-8") for w in words]
        symbols = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(e) for e in encoded])
        done_word, done_symbols = [], []
        at, rank = self._look_up(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(word)))
            lowest = np.minimum.reduceat(rank, begins)
            still = np.repeat(lowest < self.none, sizes)
            done_word.append(word[~still])
            done_symbols.append(symbols[~still])
            # In a run of one symbol neighbouring pairs overlap: the first, third, ... of a run of pairs are merged.
            places = np.flatnonzero((rank == np.repeat(lowest, sizes)) & still)
            run = np.append(True, np.diff(places) != 1)[:len(places)]
            first = places[np.flatnonzero(run)][np.cumsum(run) - 1] if len(places) else places
            places = places[(places - first) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = still
            keep[places + 1] = False
            moved = np.cumsum(keep)[places] - 1
            symbols, word, at, rank = symbols[keep], word[keep], at[keep], rank[keep]
            # Only the pairs beside a merge are new.
            fresh = np.concatenate([moved, moved[moved > 0] - 1])
            at[fresh], rank[fresh] = self._look_up(symbols, word, fresh)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _look_up(self, symbols: np.ndarray, word: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs that begin at the places: where the merge table has them, and their ranks."""
        after = np.minimum(places + 1, len(symbols) - 1)
        key = symbols[places] << 32 | symbols[after]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (word[places] == word[after]) & (after > places)
        return at, np.where(known, self.ranks[at], self.none)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that form no character become U+FFFD."""
        raw = self.piece_bytes[each_range(self.piece_starts[ids], self.piece_lengths[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")


class _Known(dict):
    """Number of each piece; a new piece is noted for the next merge."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Encodes texts, with the ids of pieces met before at hand.

    Where no two blanks meet, cutting at spaces cuts between words, and a piece is what stands between two spaces, encoded
    with the space before it. The first piece of a text has none, and a text in which blanks meet is one such piece.
    """

    def __init__(self, codec: Codec, remembered: int = REMEMBERED):
        self.codec, self.remembered = codec, remembered
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not self.known.new:
            return
        numbers, counts, words = [], [], _Known()
        for piece in self.known.new:
            found = WORDS.findall(piece[0] if isinstance(piece, tuple) else " " + piece)
            numbers.extend(map(words.__getitem__, found))
            counts.append(len(found))
        ids, lengths = self.codec.merge(words.new)
        number = np.array(numbers, np.int64)
        taken = each_range((np.cumsum(lengths) - lengths)[number], lengths[number])
        after = np.concatenate([[0], np.cumsum(lengths[number])])
        cuts = np.concatenate([[0], np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids[taken].astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, np.diff(after[cuts])])
        self.known.new = []

    def _pieces(self, text: str) -> list[int]:
        known = self.known
        if not text:
            return []
        if BLANKS_MEET.search(text):
            return [known[(text,)]]
        first, *rest = text.split(" ")
        return [*([known[(first,)]] if first else []), *map(known.__getitem__, rest)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.remembered:
            self._forget()
        numbers: list[int] = []
        ends, fixed = [], {}
        for text in texts:
            begin = 0
            if self.codec.splitter is not None and self.codec.hint in text:
                for found in self.codec.splitter.finditer(text):
                    numbers += self._pieces(text[begin:found.start()])
                    fixed[len(numbers)] = self.codec.special[found[0]]
                    numbers.append(0)
                    begin = found.end()
            numbers += self._pieces(text[begin:] if begin else text)
            ends.append(len(numbers))
        self._learn()
        number = np.array(numbers, np.int64)
        ordinary = np.ones(len(number), bool)
        ordinary[list(fixed)] = False
        starts = np.cumsum(self.lengths) - self.lengths
        lengths = np.ones(len(number), np.int64)
        lengths[ordinary] = self.lengths[number[ordinary]]
        after = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.empty(after[-1], np.uint32)
        whole = np.repeat(ordinary, lengths)
        ids[whole] = self.ids[each_range(starts[number[ordinary]], lengths[ordinary])]
        ids[~whole] = list(fixed.values())
        return np.split(ids, after[np.array(ends[:-1], np.int64)]) if texts else []


def slices(texts: list[str], size: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters."""
    held, chars = [], 0
    for text in texts:
        held.append(text or "")
        chars += len(held[-1]) + 1
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns, the ids as binary (little-endian unsigned 32-bit) and, if named, the decoded text.

    A column of docs with one of these names is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(ids, *([decoded] if decoded else []))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()),
                           *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        encoder = Encoder(codec)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            begin = 0
            for some in slices(texts.to_pylist()):
                found = encoder.encode(some)
                part = batch.slice(begin, len(some))
                begin += len(some)
                columns = [pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())]
                if decoded:
                    columns.append(pa.array([codec.decode(x).decode("utf-8") for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return docs.mapInArrow(giving_back(run), schema)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, text): encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        encoder = Encoder(codec)
        for batch in batches:
            begin = 0
            for some in slices(batch.column(1).to_pylist()):
                found = encoder.encode(some)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, len(some)), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in found])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                begin += len(some)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
