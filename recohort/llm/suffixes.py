"""Removal of repeated 50-byte strings by hashes at sampled positions, which replace prefix doubling.

Which bytes of a document are covered by a string of SPAN bytes that also starts in a document with a smaller id? No ranks
are made here, and no name is built from names at an offset: three fixed rounds compare hashes of SEED, 37 and SPAN bytes.
They run over a sample of positions that depends on content only: a position is in the sample if the hash of its SEED bytes
is the least in some SPAN-byte string around it. Every string of SPAN bytes holds such a position, at the same place in each
copy. Hashes have 64 bits and more; only the verdicts go back.

1. Positions are named by their SEED bytes and by all the bytes that any SPAN-byte string with that position can reach. Equal
   reach: all strings around it are equal, so one verdict holds for all. Only positions whose seed stands in several reaches
   go on, one for each reach, with its smallest document.
2. Those are named by HALF bytes that end with the seed and HALF that begin with it; sides that are alone are left out.
3. The strings of SPAN bytes on the sides left are named and ranked with their smallest document.

In each round tasks send the distinct names of a block of documents, packed in arrays and dealt by the name, and get back bits
in the order of what they sent; a name that stands a million times in a block is sent once. The blocks lie in a bucketed table,
so the verdicts are joined to them without moving a text.

Defined results: null and empty texts have no bytes; matches never cross documents; a null doc_id counts as larger than all
others (rows without id do not match each other); rows that share a doc_id are one document's texts and do not match each
other; an empty table gives no row. Other columns are kept by remove_repeats().
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recohort.llm.text import CHUNK_BYTES, Chunk, chunks, each_range, giving_back, small_batches
from recohort.session import pin

SPAN, SEED = 50, 24
#: Places a sampled position can have in a string around it, and the length of the names between SEED and SPAN.
PLACES = SPAN - SEED + 1
HALF = SEED + PLACES // 2
#: Bytes of texts in a block.
BLOCK_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max


def _slide(x: np.ndarray, n: int, least: Callable) -> np.ndarray:
    """least() of every n neighbours."""
    span = 1
    while span < n:
        step = min(span, n - span)
        x = least(x[:len(x) - step], x[step:])
        span += step
    return x


def sampled(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Sampled positions, the names of their seeds and reaches, and their texts."""
    none = np.zeros(0, np.int64)
    seeds = chunk.hash_windows(SEED)
    if len(seeds) < PLACES:
        return none, none.astype(np.uint64), none.astype(np.uint64), none
    high = (seeds >> np.uint64(32)).astype(np.uint32)
    pad = np.zeros(PLACES - 1, np.uint32)
    lowest = _slide(high, PLACES, np.minimum)
    lowest = _slide(np.concatenate([pad, lowest, pad]), PLACES, np.maximum)
    at = np.flatnonzero(lowest[:len(high)] == high)
    doc = np.searchsorted(chunk.offsets, at, "right") - 1
    begin, end = chunk.offsets[doc], chunk.offsets[doc + 1]
    good = (at + SEED <= end) & (end - begin >= SPAN)
    at, doc, begin, end = at[good], doc[good], begin[good], end[good]
    first, last = np.maximum(at - (PLACES - 1), begin), np.minimum(at + SPAN, end)
    return at, seeds[at], chunk.hash_spans(first, last) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), doc


class Block:
    """Some documents with their sampled positions. The reaches are numbered in the order of their names."""

    def __init__(self, payload: bytes):
        self.batch = pa.ipc.open_stream(io.BytesIO(payload)).read_next_batch()
        whole = next(chunks(iter([self.batch]), "text", 1 << 62))
        self.data, self.offsets = whole.data, whole.offsets
        ids = self.batch.column(self.batch.schema.get_field_index("doc_id"))
        self.ids = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.parts: list[tuple[int, Chunk]] = []
        found = []
        begin = 0
        while begin < len(self.ids):
            end = max(begin + 1, int(np.searchsorted(self.offsets, self.offsets[begin] + CHUNK_BYTES, "right")) - 1)
            a, b = self.offsets[begin], self.offsets[end]
            chunk = Chunk(self.data[a:b], self.offsets[begin:end + 1] - a)
            at, seed, reach, doc = sampled(chunk)
            found.append((at + a, seed, reach, doc + begin))
            begin = end
        self.at, seed, reach, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))
        owner = self.ids[self.doc]
        order = np.argsort(owner, kind="stable")
        order = order[np.argsort(reach[order], kind="stable")]
        self.first = order[np.flatnonzero(np.append(True, np.diff(reach[order]) != 0))] if len(order) else order
        self.reach, self.seed, self.least = reach[self.first], seed[self.first], owner[self.first]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(np.append(True, np.diff(reach[order]) != 0))[:len(order)] - 1
        self.number, self.owner = number, owner

    def names(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[begin:end], piece by piece, so that prefix sums stay small."""
        out = np.zeros(len(begin), np.uint64)
        step = CHUNK_BYTES
        piece = begin // step
        order = np.argsort(piece, kind="stable")
        numbers, starts = np.unique(piece[order], return_index=True)
        for k, a, b in zip(numbers.tolist(), starts, np.append(starts[1:], len(order))[:len(starts)], strict=True):
            some = order[a:b]
            base = k * step
            data = self.data[base:base + step + 2 * SPAN]
            out[some] = Chunk(data, np.array([0, len(data)])).hash_spans(begin[some] - base, end[some] - base)
        return out

    # Round 1 is known from here on: whether a smaller document has the reach, and whether its seed has several reaches.
    def decide(self, verdicts: list[np.ndarray]) -> None:
        smaller, several = verdicts
        #: Occurrences all of whose strings start in a smaller document.
        self.whole = smaller[self.number] | (self.owner > self.least[self.number])
        self.open = several & ~smaller

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, whether several reaches of this block have it) of distinct halves, and the name's number for each open
        reach and side, -1 where the half does not fit into the document."""
        some = np.flatnonzero(self.open)
        at, doc = self.at[self.first[some]], self.doc[self.first[some]]
        sides = []
        for side, (begin, end) in enumerate(((at - (HALF - SEED), at + SEED), (at, at + HALF))):
            fits = (begin >= self.offsets[doc]) & (end <= self.offsets[doc + 1])
            name = np.zeros(len(some), np.uint64)
            name[fits] = (self.names(begin[fits], end[fits]) << np.uint64(1)) | np.uint64(side)
            sides.append((name, fits))
        names, number, count = np.unique(np.concatenate([n[f] for n, f in sides]), return_inverse=True, return_counts=True)
        out = np.full((len(some), 2), -1)
        split = int(sides[0][1].sum())
        out[sides[0][1], 0], out[sides[1][1], 1] = number[:split], number[split:]
        return names, count > 1, out

    def strings(self, shared: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of strings on sides that are shared with their smallest documents, then start and number of all."""
        side = np.zeros((len(self.reach), 2), bool)
        side[np.flatnonzero(self.open)] = (number >= 0) & shared[np.maximum(number, 0)] if len(shared) else False
        occurrence = np.flatnonzero(~self.whole & side[self.number].any(axis=1))
        at, doc, own = self.at[occurrence], self.doc[occurrence], side[self.number[occurrence]]
        middle = HALF - SEED
        low = np.where(own[:, 0], at - (PLACES - 1), at - middle)
        high = np.where(own[:, 1], at, at - middle)
        low, high = np.maximum(low, self.offsets[doc]), np.minimum(high, self.offsets[doc + 1] - SPAN)
        size = np.maximum(high - low + 1, 0)
        start = each_range(low, size)
        owner = np.repeat(self.owner[occurrence], size)
        name = self.names(start, start + SPAN)
        order = np.argsort(owner, kind="stable")
        order = order[np.argsort(name[order], kind="stable")]
        new = np.append(True, np.diff(name[order]) != 0)[:len(order)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return name[order][new], owner[order][new], start, number

    def removed(self, smaller: np.ndarray, least: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        depth = np.zeros(len(self.data) + 1, np.int32)
        at, doc = self.at[self.whole], self.doc[self.whole]
        low, high = np.maximum(at - (PLACES - 1), self.offsets[doc]), np.minimum(at, self.offsets[doc + 1] - SPAN)
        np.add.at(depth, low[low <= high], 1)
        np.add.at(depth, high[low <= high] + SPAN, -1)
        owner = self.ids[np.searchsorted(self.offsets, start, "right") - 1] if len(start) else start
        gone = start[smaller[number] | (owner > least[number])] if len(start) else start
        np.add.at(depth, gone, 1)
        np.add.at(depth, gone + SPAN, -1)
        return np.cumsum(depth[:-1]) > 0


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents, all columns, as packed blocks in a table bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, count = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block():
            nonlocal count
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(whole)
            count += 1
            return pa.RecordBatch.from_arrays([pa.array([(partition << 32) + count], pa.int64()), pa.array([sink.getvalue()], pa.binary())], names=["block", "payload"])

        size = 0
        for chunk in chunks(batches):
            held.append(chunk.batch)
            size += len(chunk.data)
            if size >= BLOCK_BYTES:
                yield block()
                size = 0
        if held:
            yield block()

    name = f"recohort_blocks_{uuid.uuid4().hex}"
    packed = docs.mapInArrow(giving_back(run), "block long, payload binary")
    packed.write.bucketBy(buckets, "block").format("parquet").option("compression", "none").saveAsTable(name)
    return docs.sparkSession.table(name)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns side by side, compressed; document ids (int64) byte by byte, as their high bytes are mostly equal."""
    flat = [c.view(np.uint8).reshape(-1, 8).T.tobytes() if c.dtype == np.int64 else c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(flat))


def _unpack(piece: bytes, n: int, types: tuple[str, ...]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(piece), 0, []
    for kind in types:
        if kind == "i8":
            out.append(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(np.int64).ravel())
        else:
            out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _send(block: int, names: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, block, n, piece): the columns, dealt by name, in their order."""
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    numbers, begins = np.unique(bucket[order], return_index=True)
    rows = []
    for k, a, b in zip(numbers.tolist(), begins, np.append(begins[1:], len(order))[:len(begins)], strict=True):
        some = order[a:b]
        rows.append((k, block, len(some), _pack(*(np.ascontiguousarray(c[some]) for c in columns))))
    cells = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "n", "piece"])


def _received(names: np.ndarray, buckets: int, replies: list | None, bits: int) -> list[np.ndarray]:
    """The verdicts on the names, in the order in which they were sent."""
    out = np.zeros((bits, len(names)), bool)
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    numbers, begins = np.unique(bucket[order], return_index=True)
    spans = dict(zip(numbers.tolist(), zip(begins.tolist(), np.append(begins[1:], len(order))[:len(begins)].tolist(), strict=True), strict=True))
    for reply in replies or []:
        a, b = spans[reply["bucket"]]
        out[:, order[a:b]] = np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=bits * (b - a)).reshape(bits, b - a)
    return list(out)


def _judge(sent: DataFrame, types: tuple[str, ...], verdict: Callable) -> DataFrame:
    """(block, replies): the rows of each bucket are judged together, and each block gets its bits back."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [_unpack(piece, n, types) for n, piece in zip(rows["n"], rows["piece"], strict=True)]
        bits = verdict(*(np.concatenate(c) for c in zip(*pieces, strict=True)))
        cuts = np.concatenate([[0], np.cumsum(rows["n"])])
        replies = [np.packbits(np.concatenate([b[a:z] for b in bits])).tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "bits": replies})

    back = sent.groupBy("bucket").applyInPandas(run, "block long, bucket int, bits binary")
    # A block gets one reply from each bucket it has sent to: bits for its own names.
    return pin(back.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies")), "verdicts")


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the keys (the last one first), and the number of the group of equal keys of each such row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.cumsum(new)


def _smallest(group: np.ndarray, order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another row of the group has a smaller document; order sorts the rows by group."""
    begins = np.flatnonzero(np.append(True, np.diff(group) != 0))
    least = np.minimum.reduceat(doc[order], begins)
    out = np.empty(len(order), bool)
    out[order] = doc[order] > least[group - group[0]]
    return out


def _judge_reaches(seed: np.ndarray, reach: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    order, group = _groups(seed, reach)
    of_seed = np.concatenate([[0], np.cumsum(np.diff(seed[order]) != 0)])
    several = np.empty(len(order), bool)
    heads = np.bincount(of_seed[np.flatnonzero(np.append(True, np.diff(group) != 0))])
    several[order] = heads[of_seed] > 1
    return [_smallest(group, order, doc), several]


def _judge_halves(name: np.ndarray, doubled: np.ndarray) -> list[np.ndarray]:
    order, group = _groups(name)
    count = np.bincount(group)
    own = np.empty(len(order), bool)
    own[order] = count[group] > 1
    return [own | doubled.astype(bool)]


def _judge_strings(name: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    order, group = _groups(name)
    return [_smallest(group, order, doc)]


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """All columns of docs with the repeated bytes taken out of `text` (and of characters cut by that, the rest).

    digest: instead (doc_id, n_bytes, n_removed, n_spans, kept_sha256).
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = _blocks(docs, buckets)
    message = "bucket int, block long, n long, piece binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, list]]:
        for batch in batches:
            for k in range(batch.num_rows):
                replies = [batch.column(c)[k].as_py() for c in range(2, batch.num_columns)]
                block = Block(batch.column(1)[k].as_py())
                if replies:
                    block.decide(_received(block.seed, buckets, replies[0], 2))
                yield batch.column(0)[k].as_py(), block, replies

    def send_reaches(batches):
        for number, block, _ in each(batches):
            # What a bucket tells apart of a seed, besides the bucket: 32 bits, and the reach is compared as well.
            yield _send(number, block.seed, buckets, (block.seed // np.uint64(buckets)).astype(np.uint32), block.reach, block.least)

    def send_halves(batches):
        for number, block, _ in each(batches):
            names, doubled, _ = block.halves()
            yield _send(number, names, buckets, names, doubled.astype(np.uint8))

    def strings(block, replies):
        names, _, number = block.halves()
        shared, = _received(names, buckets, replies[1], 1)
        return block.strings(shared, number)

    def send_strings(batches):
        for number, block, replies in each(batches):
            names, least, _, _ = strings(block, replies)
            yield _send(number, names, buckets, names, least)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]) if digest else docs.schema

    def finish(batches):
        for _, block, replies in each(batches):
            names, least, start, number = strings(block, replies)
            smaller, = _received(names, buckets, replies[2], 1)
            gone = block.removed(smaller, least, start, number)
            texts = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            get = lambda n: block.batch.column(block.batch.schema.get_field_index(n))  # noqa: B023, E731
            if digest:
                count = np.concatenate([[0], np.cumsum(gone)])
                edge = gone & ~np.concatenate([[False], gone[:-1]])
                begins = block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]
                edge[begins] = gone[begins]
                runs = np.concatenate([[0], np.cumsum(edge)])
                a, b = block.offsets[:-1], block.offsets[1:]
                columns = [get("doc_id").cast(pa.int64()), pa.array(b - a), pa.array(count[b] - count[a]), pa.array(runs[b] - runs[a]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            else:
                valid = get("text").is_valid().to_pylist()
                new = pa.array([t.decode("utf-8", "ignore") if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                columns = [new if n == "text" else get(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    first = _judge(blocks.mapInArrow(giving_back(send_reaches), message), ("u4", "u8", "i8"), _judge_reaches)
    told = blocks.join(first.withColumnRenamed("replies", "first"), "block", "left")
    second = _judge(told.mapInArrow(giving_back(send_halves), message), ("u8", "u1"), _judge_halves)
    told = told.join(second.withColumnRenamed("replies", "second"), "block", "left")
    third = _judge(told.mapInArrow(giving_back(send_strings), message), ("u8", "i8"), _judge_strings)
    told = told.join(third.withColumnRenamed("replies", "third"), "block", "left")
    return told.mapInArrow(giving_back(finish), schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True)
