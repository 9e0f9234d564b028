"""Merge of weekly part files into one snapshot, published only after every gate has passed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from recohort.contracts import EVENT_FIELDS, utc
from recohort.functions.times import instant
from recohort.operators import gates, partitions as pt
from recohort.session import pin, prepare
from recohort.sources.events import type_events
from recohort.sources.headed import plain_path, read_headed_csv

_MANIFEST = "part string, part_start timestamp_ntz, part_end timestamp_ntz, row_count long, complete boolean, source_url string, is_synthetic boolean, version int"


def manifest_table(spark: SparkSession, parts: list[tuple[str, dict]]) -> DataFrame:
    """One row per part from its path and manifest."""
    rows = [(path, utc(m["coverage_start"]), utc(m["coverage_end"]), m.get("row_count"), m.get("complete"), m.get("source_url"), m.get("is_synthetic"),
             m.get("normalization_version")) for path, m in parts]
    return spark.createDataFrame(rows, _MANIFEST).withColumn("place", F.rtrim(plain_path(F.col("part")), F.lit("/")))


def part_faults(manifests: DataFrame, source_url: str, synthetic: bool, version: int) -> DataFrame:
    """Parts that must not be merged, by their manifests alone."""
    rules = F.array_compact(F.array(
        F.when(~F.col("complete").eqNullSafe(True), "incomplete part"),
        F.when(~(F.col("source_url").eqNullSafe(source_url) & F.col("is_synthetic").eqNullSafe(synthetic)), "provenance is not that of the request"),
        F.when(~F.col("version").eqNullSafe(version), "normalization is not that of the request")))
    return manifests.select("part", F.explode(rules).alias("rule"))


def with_part(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows with ``file`` beside the manifest row of their part, which is that file or a folder above it."""
    files = rows.select("file").distinct().withColumn("place", plain_path(F.col("file")))
    depth = F.size(F.split("place", "/"))
    above = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("place", "/"), F.lit(1), n), "/"))
    found = files.select("file", F.explode(above).alias("place")).join(manifests, "place").drop("place")
    return rows.join(found, "file", "left")


def merge_history(spark: SparkSession, parts: list[tuple[str, dict]], coverage: tuple[datetime, datetime],
                  chain_id: int, source_url: str, synthetic: bool, version: int) -> DataFrame:
    """Typed events of all parts (path, manifest); raises when a part or the whole does not hold.

    All parts are one read: each row knows its file, the file its part, and the gates and counts are grouped by
    part, so the work does not depend on how many parts there are. Text and typed rows are written once.
    """
    if not parts:
        raise ValueError("empty history: no parts are given")
    prepare(spark)
    manifests = pin(manifest_table(spark, parts), "manifests")
    gates.enforce(part_faults(manifests, source_url, synthetic, version))
    whole = manifests.select(F.lit(0).alias("snapshot"), "part_start", "part_end")
    bounds = manifests.limit(1).select(F.lit(0).alias("snapshot"), instant(coverage[0]).alias("coverage_start"), instant(coverage[1]).alias("coverage_end"))
    gates.enforce(pt.partition_contiguity(whole, bounds))
    raw = pin(with_part(read_headed_csv(spark, [path for path, _ in parts], EVENT_FIELDS), manifests), "parts")
    counts = raw.groupBy("part").agg(F.count("*").alias("found"))
    wrong = manifests.join(counts, "part", "left").filter(~F.col("row_count").eqNullSafe(F.coalesce("found", F.lit(0).cast("long"))))
    gates.enforce(wrong.select("part", F.lit("row count differs from the manifest").alias("rule"), "row_count", "found"))
    gates.enforce(gates.validate_rows(raw, chain_id, F.col("part_start"), F.col("part_end")))
    typed = pin(type_events(raw.select(*EVENT_FIELDS, "part"), keep=("part",)), "events")
    gates.enforce(gates.cross_part_uniqueness(typed, "part"))
    return typed.drop("part")


def publish(merged: DataFrame, path: str) -> None:
    """Write a checked snapshot to a new folder; an existing snapshot is never touched."""
    merged.write.mode("errorifexists").parquet(path)
