"""External exports, result sinks and file digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from recohort.functions.scalars import fold, git_blob_digest
from recohort.sources.headed import read_headed_csv

STREAMED_ABOVE = 256 << 20  # Bytes of a file that may be one row.
PIECE = 4 << 20


def read_external_export(spark: SparkSession, path, required: tuple[str, ...], key: str) -> DataFrame:
    """An export as text with normalized names and key; every file is read by its own header.

    A line that does not fit its header has a null key, which the key gate reports.
    """
    rows = read_headed_csv(spark, path, required).select(*required)
    return rows.withColumn(key, fold(F.col(key)))


def export_key_faults(export: DataFrame, key: str) -> DataFrame:
    """Missing or repeated keys of an export after trimming and case-folding."""
    folded = export.groupBy(F.coalesce(fold(F.col(key).cast("string")), F.lit("")).alias(key)).agg(F.count("*").alias("copies"))
    return folded.filter((F.col("copies") > 1) | (F.col(key) == ""))


def write_results(rows: DataFrame, path: str, kind: str = "parquet", order: list[str] | None = None,
                  partition: list[str] | None = None, compression: str | None = None) -> None:
    """Parquet, CSV or JSON output; global order comes from range partitions, not from one task.

    Partitioned output is rebalanced by its partition columns: few files each, and a large
    partition is split over several tasks.
    """
    if order:
        rows = rows.orderBy(*order)
    elif partition:
        rows = rows.hint("rebalance", *partition)
    writer = rows.write.mode("errorifexists")
    if partition:
        writer = writer.partitionBy(*partition)
    if compression:
        writer = writer.option("compression", compression)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def file_digest_manifest(spark: SparkSession, path, pattern: str = "*", streamed_above: int = STREAMED_ABOVE) -> DataFrame:
    """Bytes, SHA-256 and Git blob SHA-1 of each file, whatever its size; Spark lists no empty files.

    Small files are digested as rows; a file above the bound, which may not fit in a row (2 GiB) or in
    memory, is opened by its task and digested a few megabytes at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small = content_digests(files.filter(F.col("length") <= streamed_above).select(F.col("path").alias("file"), "content"))
    # Without the column of contents, the listing reads no content.
    large = files.filter(F.col("length") > streamed_above).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    return small.unionByName(large.repartition("file").mapInArrow(_streamed_digests, "file string, bytes long, sha256 string, git_sha1 string"))


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file.startswith("file:"):
                system, place = fs.LocalFileSystem(), "/" + file.removeprefix("file:").lstrip("/")
            else:
                system, place = fs.FileSystem.from_uri(quote(file, safe=":/@"))
            sha, git, seen = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % size), 0
            with system.open_input_stream(place) as source:
                while piece := source.read(PIECE):
                    sha.update(piece)
                    git.update(piece)
                    seen += len(piece)
            if seen != size:
                raise ValueError(f"{file} changed while it was read")
            rows.append({"file": file, "bytes": size, "sha256": sha.hexdigest(), "git_sha1": git.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("git_sha1", pa.string())]))


def content_digests(contents: DataFrame) -> DataFrame:
    """Digests of (file, content) rows."""
    return contents.select("file", F.octet_length("content").cast("long").alias("bytes"),
                           F.sha2("content", 256).alias("sha256"), git_blob_digest(F.col("content")).alias("git_sha1"))


def manifest_faults(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared files (file, bytes, sha256) that are missing, extra or different."""
    want = declared.select("file", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha256"))
    both = found.select("file", "bytes", "sha256").join(want, "file", "full_outer")
    rule = (F.when(F.col("sha256").isNull(), "missing").when(F.col("want_sha256").isNull(), "undeclared")
            .when((F.col("bytes") != F.col("want_bytes")) | (F.col("sha256") != F.col("want_sha256")), "changed"))
    return both.select("file", rule.alias("rule")).filter("rule IS NOT NULL")
