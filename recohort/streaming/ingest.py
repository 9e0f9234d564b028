"""Incremental ingest: new part files once, event keys de-duplicated, accepted events kept by day.

No event is dropped for its age: parts may arrive in any order and in any number of batches. A
micro-batch is freed of repeats, compared with the keys already accepted on the days that it touches,
and what is new is appended to those days. Nothing accepted is ever rewritten, so a batch that runs
again, after a failure at any point, finds its own rows and adds only what is missing. Reading the
accepted events needs no shuffle, and a bounded span of days reads only their files.

A key belongs to one day, that of its time. Of repeated rows of a key on a day the first accepted one
stays, inside a batch the smallest; the same key on two days is two conflicting events, which stay and
are named by ``conflicting_keys``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

DAY = "accepted_day"


def new_parts(spark: SparkSession, path: str, schema, file_format: str = "parquet", pattern: str | None = None,
              files_per_batch: int = 100) -> DataFrame:
    """File-source stream of part files."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with equal keys the smallest."""
    others = [name for name in rows.columns if name not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*others)).alias("r")).select(*key, "r.*")


def _stored(spark: SparkSession, accepted: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(DAY, DateType())])).parquet(accepted)


def _on_days(rows: DataFrame, days: list) -> DataFrame:
    known = [day for day in days if day is not None]
    return rows.filter(F.col(DAY).isin(known) | (F.col(DAY).isNull() if None in days else F.lit(False)))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[name].eqNullSafe(right[name]) for name in names])


def new_events(batch: DataFrame, accepted: DataFrame, key: list[str], time: str) -> DataFrame:
    """Rows of a batch whose keys are not accepted yet on their day; only files of the batch's days are read."""
    dated = batch.withColumn(DAY, F.to_date(time))
    days = [row[DAY] for row in dated.select(DAY).distinct().collect()]  # one row per calendar day
    rows = _once(dated, [*key, DAY])
    known = _on_days(accepted, days).select(*key, DAY)
    return rows.join(known, _same(rows, known, [*key, DAY]), "left_anti")


def incremental_ingest(parts: DataFrame, key: list[str], accepted: str, checkpoint: str, time: str) -> None:
    """Process all files not seen yet, then stop; run again to pick up later files."""
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The folder must be there before it is read for the first time.
        batch.limit(0).withColumn(DAY, F.to_date(time)).write.mode("append").partitionBy(DAY).parquet(accepted)
        fresh = new_events(batch, _stored(spark, accepted, parts.schema), key, time).select(*parts.columns, DAY)
        fresh.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(accepted)

    query = (parts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def accepted_events(spark: SparkSession, accepted: str, schema, first_day=None, end_day=None) -> DataFrame:
    """Every accepted event once, of the days in [first_day, end_day) if they are given."""
    rows = _stored(spark, accepted, schema)
    rows = rows if first_day is None else rows.filter(F.col(DAY) >= F.lit(first_day))
    return rows if end_day is None else rows.filter(F.col(DAY) < F.lit(end_day))


def daily_counts(events: DataFrame) -> DataFrame:
    """Accepted events by day, from the folders' days and the rows' number alone."""
    return events.groupBy(F.col(DAY).alias("day")).agg(F.count("*").alias("rows"))


def conflicting_keys(events: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were accepted on more than one day; a whole-table check, run when it is wanted."""
    return events.groupBy(*key).agg(F.count("*").alias("days")).filter("days > 1")
