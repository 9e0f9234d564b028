"""Token ids as files of independent zstandard frames.

A file is a row of frames and ends with a seek table in a skippable frame, as in the public seekable format: for each frame
its compressed size, its size and a checksum (the low half of XXH64 of what it holds), then the number of frames, a flag
byte and a magic number. A reader takes the table from the end of the file and decompresses only the frames it wants. A
frame holds whole documents:

    number of documents (uint32), width of an id in bytes (uint32), then for all documents doc_id (int64), whether it has
    one (uint8), position of its first id in the file (int64), number of ids (int64), then the ids.

The table of files, written beside them, gives each file's number and how many ids all files before it hold.

Files are written by tasks into the shared folder under names of their own; a task that runs twice writes twice, and only
the file that its committed row names is read. Documents are dealt to files by ranges of doc_id, so the order of the files
is the order of the corpus. Only one row per file meets in one task.

Defined results: a null text is empty and has only the end id; null doc_ids come first, equal ones in the order of the hash
of their text; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recohort.llm.bpe import slices, vocabulary
from recohort.llm.text import each_range, small_batches
from recohort.session import new_folder, pin

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: A frame is closed when it holds this many ids.
FRAME_IDS = 1 << 17
#: Words, and characters in them, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 1 << 25
#: New words that the library is given at once.
JOINED = 1000
END_ID = 1


def open_folder(folder: str):
    """The filesystem of a shared folder, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class FrameWriter:
    """Writes documents into an open file and ends it with the seek table."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS):
        self.sink, self.frame_ids, self.table = sink, frame_ids, []
        self.packer = zstandard.ZstdCompressor(level=3)
        self._clear()

    def _clear(self) -> None:
        self.docs: list[tuple[int | None, int]] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, start: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, start))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        ids = np.concatenate(self.ids)
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        content = b"".join([
            struct.pack("<II", len(self.docs), width), np.array([d or 0 for d, _ in self.docs], "<i8").tobytes(),
            np.array([d is not None for d, _ in self.docs], "u1").tobytes(),
            np.array([s for _, s in self.docs], "<i8").tobytes(), np.array([len(i) for i in self.ids], "<i8").tobytes(),
            ids.astype(f"<u{width}").tobytes()])
        packed = self.packer.compress(content)
        self.sink.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._clear()

    def close(self) -> None:
        self.flush()
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        end = rows + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(end)) + end)


class FrameReader:
    """Reads single frames of a file; `source` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, os.SEEK_END)
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("the file does not end with a seek table")
        source.seek(size - 9 - 12 * count)
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.cumsum(self.table[:, 0]) - self.table[:, 0]

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, number: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of the documents of one frame, which alone is read and checked."""
        packed, size, checksum = self.table[number].tolist()
        self.source.seek(int(self.starts[number]))
        content = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        count, width = struct.unpack_from("<II", content)
        doc_ids = np.frombuffer(content, "<i8", count, 8)
        has = np.frombuffer(content, "u1", count, 8 + 8 * count)
        starts, lengths = np.frombuffer(content, "<i8", 2 * count, 8 + 9 * count).reshape(2, count)
        ids = np.frombuffer(content, f"<u{width}", offset=8 + 25 * count)
        begin = 0
        for k in range(count):
            yield (int(doc_ids[k]) if has[k] else None), int(starts[k]), ids[begin:begin + lengths[k]]
            begin += lengths[k]

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Documents with first <= doc_id <= last: frames are found by halving, and only theirs are decompressed."""
        low, high = 0, len(self)
        while low < high:
            middle = (low + high) // 2
            last_id = max((d for d, _, _ in self.frame(middle) if d is not None), default=None)
            low, high = (middle + 1, high) if last_id is None or last_id < first else (low, middle)
        for number in range(low, len(self)):
            for doc_id, start, ids in self.frame(number):
                if doc_id is not None and doc_id > last:
                    return
                if doc_id is not None and doc_id >= first:
                    yield doc_id, start, ids


class _Numbers(dict):
    """Numbers words as they are first asked for, and keeps the new ones in order."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class LibraryEncoder:
    """Ids by the tokenizers library. Where the vocabulary drops blanks before words are cut, which is tried out on the
    library itself, a text is encoded blank by blank and words met before are remembered; otherwise whole.

    New words go to the library many at a time, with a special token between them that the library cuts out before anything
    else, so that its ids fall apart where the token's id stands."""

    def __init__(self, path: str, end_id: int = END_ID, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end, self.remembered = np.array([end_id], np.uint32), remembered
        added = self.library.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.between = next(((i, t.content) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        whole = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.by_words = all(whole(f"{one}{blank}{two}") == whole(one) + whole(two) for blank in " \n\t" for one in ("", "a", "it's", "9.", ",") for two in ("", "b", "'s", "9", "."))
        self._forget()

    def _forget(self) -> None:
        self.number, self.chars = _Numbers(), 0
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _apart(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and the number of ids of each."""
        if self.between:
            number, token = self.between
            joined = token.join(words)
            if sum(joined.count(t) for t in self.specials) == len(words) - 1:
                ids = np.array(self._apart([joined])[0], np.uint32)
                cuts = np.concatenate([[-1], np.flatnonzero(ids == number), [len(ids)]])
                if len(cuts) == len(words) + 1:
                    return ids[ids != number], np.diff(cuts) - 1
        found = self._apart(words)
        return np.array([i for own in found for i in own], np.uint32), np.array([len(own) for own in found])

    def _learn(self) -> None:
        words, self.number.new = self.number.new, []
        self.chars += sum(map(len, words))
        parts = [self._found(words[at:at + JOINED]) for at in range(0, len(words), JOINED)]
        ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        used = int(self.starts[-1])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + 2 * len(ids), np.uint32)])
        self.ids[used:used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, used + np.cumsum(lengths)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.append(np.array(ids, np.uint32), self.end) for ids in self._apart(texts)]
        if len(self.number) > self.remembered or self.chars > REMEMBERED_CHARS:
            self._forget()
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += text.replace("\n", " ").replace("\t", " ").split(" ")
            ends.append(len(words))
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            self._learn()
        lengths = self.starts[number + 1] - self.starts[number]
        ids = self.ids[each_range(self.starts[number], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])[ends].tolist()
        return [np.concatenate([ids[i:j], self.end]) for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> LibraryEncoder:
    """The encoder of a worker, which later tasks of the worker use on: at most `remembered` words are kept."""
    return LibraryEncoder(path)


_WRITTEN = pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_files(docs: DataFrame, path: str, folder: str, files: int) -> DataFrame:
    """Encodes the whole texts of docs with the vocabulary at path and writes them into at most so many files.

    The texts are shuffled once, as they are; ids never are. A task encodes the documents of one range of doc_id in ascending
    order and writes them as it goes, so it holds one frame. Rows of one doc_id are dealt by the hash of their text and
    their number in the input, so that repeated rows do not meet in one task; texts themselves never serve as range bounds.
    Returns (file, first_start, path, n_docs, n_ids), one row per file, in the order of the corpus by file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, docs_written, at = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, place = open_folder(folder)
                system.create_dir(place, recursive=True)
                number = batch.column(0)[0].as_py()
                name = f"{place}/ids-{number:06d}-{uuid.uuid4().hex}.zst"
                sink = system.open_output_stream(name, compression=None)
                writer, encoder = FrameWriter(sink), _encoder(path)
            doc_ids, begin = batch.column(1).to_pylist(), 0
            for some in slices(batch.column(2).to_pylist()):
                for doc_id, ids in zip(doc_ids[begin:begin + len(some)], encoder.encode(some), strict=True):
                    writer.add(doc_id, at, ids)
                    at += len(ids)
                begin += len(some)
            docs_written += begin
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": number, "path": name, "n_docs": docs_written, "n_ids": at}], schema=_WRITTEN)

    small_batches(docs.sparkSession)
    order = ["doc_id", "tie", "row"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("file"), "doc_id", "text")
    written = pin(dealt.mapInArrow(write, "file int, path string, n_docs long, n_ids long"), "files")
    # One row per file meets in one task and is broadcast: bounded by the number of files, a parameter.
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    first = written.select("file", F.coalesce(before, F.lit(0)).alias("first_start"))
    return written.join(F.broadcast(first), "file").select("file", "first_start", "path", "n_docs", "n_ids")


def read_files(written: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that the rows name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for first, path in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with system.open_input_file(path) as source:
                    reader = FrameReader(source)
                    for number in range(len(reader)):
                        rows = [(d, first + s, len(i), zlib.crc32(i.astype("<u4").tobytes())) for d, s, i in reader.frame(number)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.select("first_start", "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "token-files")
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_files(write_files(docs, vocabulary("word_bpe_49k.json"), folder, files), folder)
