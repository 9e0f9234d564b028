"""Execution events: header CSV as text, strict typing, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recohort.contracts import EVENT_FIELDS
from recohort.functions.times import iso, utc_instant
from recohort.sources.headed import read_headed_csv

def read_event_text(spark: SparkSession, path) -> DataFrame:
    """Every column as text in contract order, whatever the order in each file's header; missing ones are refused.

    A line that does not fit its file's header stays as a row of nulls, which the row gate calls malformed.
    """
    return read_headed_csv(spark, path, EVENT_FIELDS).select(*EVENT_FIELDS)


def type_events(raw: DataFrame, size_type: str = "double", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed events from text; identifiers are lower-cased and unusable values become null.

    The gates run on the text, so a null here is never silently a value. ``size_type`` may be a
    decimal when sums must not depend on the order of rows.
    """
    return raw.select(
        F.col("chain_id").try_cast("int").alias("chain_id"), F.lower("tx_hash").alias("tx_hash"),
        F.col("log_index").try_cast("int").alias("log_index"), F.lower("account").alias("account"),
        F.lower("order_key").alias("order_key"), F.lower("market").alias("market"),
        utc_instant(F.col("timestamp")).alias("timestamp"), "action",
        F.col("success").try_cast("boolean").alias("success"),
        F.col("size_delta_usd").try_cast(size_type).alias("size_delta_usd"),
        F.col("position_fee_usd").try_cast("decimal(38,12)").alias("position_fee_usd"),
        utc_instant(F.col("order_created_at")).alias("order_created_at"), *keep)


def event_text(trades: DataFrame) -> DataFrame:
    """Typed events back to contract text, for exports."""
    texts = {"timestamp": iso(F.col("timestamp")), "order_created_at": iso(F.col("order_created_at"))}
    return trades.select(*[texts.get(n, F.col(n).cast("string")).alias(n) for n in EVENT_FIELDS])


def scan_events(spark: SparkSession, path, size_type: str = "double") -> DataFrame:
    return type_events(read_event_text(spark, path), size_type)
