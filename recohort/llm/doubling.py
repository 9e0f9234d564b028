"""Repeated strings by distributed prefix doubling: Spark sorts pairs of ranks at growing offsets.

Every position of every text starts with the number of its first eight bytes as its rank. A round gives each position the
pair (rank here, rank at the offset), sorts the distinct pairs that occur more than once, and makes their places in that
order the new ranks; a position whose pair is alone drops out, as nothing that starts there can be repeated. Offsets grow
8, 16, and the last round overlaps, so that the ranks end at exactly the wanted length. What is left are the positions whose
string occurs again, with the smallest document that has it.

This is the method in its plain form, exact and without hashes. It moves some tens of bytes for every byte of text, which is
why `suffixes.py` compares hashes at sampled positions instead; README has the figures of both.

Defined results: as in `suffixes.py`: null texts are empty, rows of one doc_id do not take from each other, null doc_ids come last,
repeated rows each count, an empty table gives no row; texts shorter than the length have no position left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recohort.llm.text import chunks, small_batches
from recohort.operators.ranking import positions
from recohort.session import pin

FIRST = 8
LAST_DOC = (1 << 63) - 1


def offsets(length: int) -> list[int]:
    """By how much each round looks ahead: doubling, and at last the overlap that ends at the length."""
    if length < FIRST:
        raise ValueError(f"strings have at least {FIRST} bytes")
    out, size = [], FIRST
    while 2 * size <= length:
        out.append(size)
        size *= 2
    return out + ([length - size] if size < length else [])


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        lengths = np.diff(chunk.offsets)
        places = np.concatenate([np.arange(max(0, n - FIRST + 1)) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(chunk)), np.maximum(lengths - FIRST + 1, 0))
        at = chunk.offsets[rows] + places
        rank = np.zeros(len(at), np.uint64)
        for k in range(FIRST):
            rank = rank << np.uint64(8) | chunk.data[at + k].astype(np.uint64)
        keep = pa.array(rows)
        yield pa.RecordBatch.from_arrays([chunk.column("row").take(keep), chunk.column("doc").take(keep), pa.array(places.astype(np.int32)), pa.array(rank.view(np.int64))],
                                         names=["row", "doc", "place", "rank"])


def repeated_positions(docs: DataFrame, length: int = 50) -> DataFrame:
    """(row, place, doc, first): the positions whose string of that length also starts in a document before their own.

    docs: (row, doc, text) with distinct rows; first is the smallest doc that has the string.
    """
    small_batches(docs.sparkSession)
    live = pin(docs.select("row", "doc", "text").mapInArrow(_first_ranks, "row long, doc long, place int, rank long"), "ranks")
    for ahead in offsets(length):
        behind = live.select("row", (F.col("place") - ahead).alias("place"), F.col("rank").alias("next"))
        pairs = pin(live.join(behind, ["row", "place"]), "pairs")
        several = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
        named = positions(several.drop("n"), [F.asc("rank"), F.asc("next")]).select("rank", "next", F.col("position").alias("name"))
        live = pin(pairs.join(named, ["rank", "next"]).select("row", "doc", "place", F.col("name").alias("rank")), "ranks")
    first = live.groupBy("rank").agg(F.min("doc").alias("first"))
    return live.join(first, "rank").where("first < doc").select("row", "place", "doc", "first")


def removed_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed) of every row of docs (doc_id, text)."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    numbered = pin(numbered.withColumn("doc", F.coalesce("doc_id", F.lit(LAST_DOC))), "numbered")
    found = repeated_positions(numbered, length)
    # Starts closer than the length share bytes: each adds what lies before the next one, at most the length.
    from pyspark.sql import Window

    gap = F.least(F.coalesce(F.lead("place").over(Window.partitionBy("row").orderBy("place")) - F.col("place"), F.lit(length)), F.lit(length))
    sums = found.select("row", gap.cast("long").alias("gap")).groupBy("row").agg(F.sum("gap").alias("n_removed"))
    sized = numbered.select("row", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.join(sums, "row", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"))
