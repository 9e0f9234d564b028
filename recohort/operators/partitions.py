"""Snapshot parts: planning, contiguity, shared provenance and the guarded merge."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F


def weekly_partition_plan(coverage: DataFrame) -> DataFrame:
    """Contiguous seven-day parts of each coverage row (coverage_start, coverage_end), last one short."""
    last = F.col("coverage_end") - F.expr("INTERVAL '1' MICROSECOND")
    starts = F.explode(F.sequence("coverage_start", last, F.expr("INTERVAL '7' DAY")))
    return coverage.filter("coverage_start < coverage_end").select(starts.alias("part_start"), "coverage_end").select(
        "part_start", F.least(F.col("part_start") + F.expr("INTERVAL '7' DAY"), F.col("coverage_end")).alias("part_end"))


def weekly_parts(start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """The same plan for parameters."""
    if start >= end:
        raise ValueError("invalid history coverage")
    out = []
    while start < end:
        stop = min(start + timedelta(days=7), end)
        out.append((start, stop))
        start = stop
    return out


def partition_contiguity(parts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Gaps, overlaps and uncovered ends of each snapshot's parts.

    ``parts`` holds one manifest row per part (snapshot, part_start, part_end); ``coverage`` one row
    per snapshot (snapshot, coverage_start, coverage_end).
    """
    chain = Window.partitionBy("snapshot").orderBy("part_start", "part_end")
    placed = parts.join(coverage, "snapshot").withColumns({
        "previous_end": F.lag("part_end").over(chain), "next_start": F.lead("part_start").over(chain)})
    rules = F.array_compact(F.array(
        F.when(F.col("part_start") > F.coalesce("previous_end", "coverage_start"), "gap"),
        F.when(F.col("part_start") < F.coalesce("previous_end", "coverage_start"), "overlap"),
        F.when(F.col("next_start").isNull() & (F.col("part_end") != F.col("coverage_end")), "does not reach the end")))
    return placed.select("snapshot", "part_start", "part_end", F.explode(rules).alias("rule"))


def snapshot_provenance(parts: DataFrame) -> DataFrame:
    """Per snapshot: whether its parts share source, synthetic flag and version, and their row total.

    Parts (snapshot, source_url, is_synthetic, normalization_version, row_count) are manifest rows.
    """
    def single(name):
        return (F.min(name).eqNullSafe(F.max(name)) & (F.count(name) == F.count("*"))).alias(f"same_{name}")

    return parts.groupBy("snapshot").agg(
        F.count("*").alias("parts"), single("source_url"),
        (F.min(F.col("is_synthetic").cast("int")).eqNullSafe(F.max(F.col("is_synthetic").cast("int")))
         & (F.count("is_synthetic") == F.count("*"))).alias("same_is_synthetic"),
        single("normalization_version"), F.sum("row_count").alias("row_count"))


def merge_partitions(rows: DataFrame, parts: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows with the part (part_start, part_end) that each belongs to; what no part wants is left out.

    One pass over the rows for any number of parts: a row meets the parts that touch its day, which are few
    because parts do not overlap once the gates above have passed; the first one that holds it wins.
    """
    days = F.explode(F.sequence(F.to_date("part_start"), F.to_date("part_end"))).alias("_day")
    touching = (parts.filter("part_start < part_end").select(F.struct("part_start", "part_end").alias("_p"), days)
                .groupBy("_day").agg(F.sort_array(F.collect_list("_p")).alias("_parts")))
    mine = F.filter("_parts", lambda p: (p["part_start"] <= F.col(time)) & (F.col(time) < p["part_end"]))
    placed = rows.withColumn("_day", F.to_date(time)).join(touching, "_day").withColumn("_part", F.get(mine, F.lit(0)))
    return placed.filter("_part IS NOT NULL").select("*", "_part.part_start", "_part.part_end").drop("_day", "_part", "_parts")
