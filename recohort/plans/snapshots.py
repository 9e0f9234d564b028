"""From response pages to a published snapshot, and back: every gate stands between two steps.

Pages are checked, normalized and checked again as rows before anything is written; a published
snapshot has a manifest with its row count and the digest of each file, and is read again only if both
still hold.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recohort.contracts import EVENT_FIELDS, utc
from recohort.functions.times import iso
from recohort.operators import gates
from recohort.session import pin, prepare
from recohort.sources import files, pages as pages_in
from recohort.sources.events import read_event_text, type_events
from recohort.sources.headed import plain_path

SCHEMA_VERSION = 1


def normalize_pages(pages: DataFrame, chain_id: int, low: datetime, high: datetime, cursors: DataFrame | None = None) -> DataFrame:
    """Contract text rows of checked pages (page, actions, fault); any fault refuses them all.

    ``cursors`` (page, cursor) says after which id each page was asked for; ids must increase from there.
    """
    prepare(pages.sparkSession)
    pages = pin(pages, "pages")
    gates.enforce(pages_in.page_faults(pages))
    if cursors is not None:
        rows = pages_in.page_records(pages).select("page", "pos", "id").join(cursors, "page")
        gates.enforce(gates.strictly_increasing_ids(rows))
    executed, created = pages_in.ingest_action_pages(pages, low, high), pages_in.page_creations(pages)
    # Only creations of executed orders matter, and each of those must be the only one.
    created = pin(created.join(executed.select(F.col("orderKey").alias("order_key")).distinct(), "order_key", "left_semi"), "creations")
    gates.enforce(gates.validate_page_creations(created))
    rows = pin(pages_in.normalize_execution(executed, created, chain_id), "normalized")
    gates.enforce(rows.filter(F.size("faults") > 0).select("tx_hash", "log_index", "faults"))
    rows = rows.drop("faults")
    gates.enforce(gates.validate_rows(rows, chain_id, low, high))
    gates.enforce(gates.validate_unique_events(rows))
    return rows


def publish_snapshot(rows: DataFrame, path: str, coverage: tuple[datetime, datetime], source_url: str, synthetic: bool) -> DataFrame:
    """Write text rows as CSV files in event order, and what a reader has to find there as a manifest beside them."""
    spark = rows.sparkSession
    files.write_results(rows.select(*EVENT_FIELDS), f"{path}/events", kind="csv", order=["timestamp", "tx_hash", "log_index"])
    digests = files.file_digest_manifest(spark, f"{path}/events", "*.csv").select(plain_path(F.col("file")).alias("file"), "bytes", "sha256")
    listed = F.sort_array(F.collect_list(F.struct(F.element_at(F.split("file", "/"), -1).alias("file"), "bytes", "sha256")))
    manifest = digests.agg(listed.alias("files")).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(source_url).alias("source_url"), F.lit(synthetic).alias("is_synthetic"),
        *[iso(F.lit(value).cast("timestamp_ntz")).alias(name) for name, value in zip(("coverage_start", "coverage_end"), coverage, strict=True)],
        F.lit(True).alias("complete"), F.lit(rows.count()).alias("row_count"), "files")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = ("schema_version int, source_url string, is_synthetic boolean, coverage_start string, coverage_end string, complete boolean, "
              "row_count long, files array<struct<file: string, bytes: long, sha256: string>>")
    return spark.read.schema(schema).json(f"{path}/manifest")


def _combined(digests: Column) -> Column:
    """One checksum of the digests of all files, by name."""
    return F.sha2(F.to_json(F.sort_array(digests)), 256)


def load_snapshot(spark: SparkSession, path: str, chain_id: int, size_type: str = "double") -> tuple[DataFrame, dict]:
    """Typed events of a published snapshot and its manifest; refused unless files, rows and every gate agree with it."""
    prepare(spark)
    manifest = pin(read_manifest(spark, path), "manifest")
    declared_files = manifest.select(F.explode("files").alias("f")).select("f.*")
    found = files.file_digest_manifest(spark, f"{path}/events", "*.csv")
    found = pin(found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "bytes", "sha256"), "digests")
    gates.enforce(files.manifest_faults(found, declared_files))
    raw = pin(read_event_text(spark, f"{path}/events"), "raw")
    names = F.array(*[F.lit(name) for name in raw.columns])
    seen = raw.agg(F.count("*").alias("row_count")).select(
        F.lit(path).alias("path"), "row_count", found.agg(_combined(F.collect_list(F.struct("file", "bytes", "sha256")))).scalar().alias("sha256"), names.alias("columns"))
    stated = manifest.select(
        F.lit(path).alias("path"), "schema_version", "complete", "is_synthetic", "row_count", _combined(F.col("files")).alias("sha256"),
        *[F.try_to_timestamp(F.col(name)).cast("timestamp_ntz").alias(name) for name in ("coverage_start", "coverage_end")])
    gates.enforce(gates.validate_manifest(stated, seen))
    row = json.loads(manifest.toJSON().first())
    coverage = utc(row["coverage_start"]), utc(row["coverage_end"])
    gates.enforce(gates.validate_rows(raw, chain_id, *coverage, size_type=size_type))
    trades = pin(type_events(raw, size_type), "events")
    gates.enforce(gates.validate_unique_events(trades))
    return trades, row
