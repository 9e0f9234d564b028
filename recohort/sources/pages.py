"""Cached API response pages: nested JSON to normalized execution rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recohort.contracts import DECREASE_CODES, INCREASE_CODES, LIQUIDATION_CODE
from recohort.functions.exact import fee_fault, net_fee, scale_usd
from recohort.functions.scalars import after_last, before_last
from recohort.functions.times import from_epoch_seconds, iso

ACTION_SCHEMA = ("id string, eventName string, orderKey string, orderType int, account string, "
                 "marketAddress string, sizeDeltaUsd string, timestamp bigint, transactionHash string, "
                 "positionFeeAmount string, collateralTokenPriceMin string, traderDiscountAmount string")
PAGE_SCHEMA = f"data struct<tradeActions: array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ACTION_SCHEMA.split(', '))}>>>"


_CORRUPT = "_corrupt"


def read_pages(spark: SparkSession, path) -> DataFrame:
    """One row per page file: page, actions and ``fault``, which is null for a readable page."""
    rows = (spark.read.schema(f"{PAGE_SCHEMA}, {_CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _CORRUPT).json(path))
    actions = F.col("data.tradeActions")
    return rows.select(F.col("_metadata.file_path").alias("page"), actions.alias("actions"), _page_fault(F.col(_CORRUPT).isNotNull(), actions))


def parse_pages(texts: DataFrame) -> DataFrame:
    """The same from (page, text) rows, as of pages that are lines of a file."""
    parsed = F.from_json("text", f"{PAGE_SCHEMA}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = texts.select("page", parsed.alias("p"))
    actions = F.col("p.data.tradeActions")
    return rows.select("page", actions.alias("actions"), _page_fault(F.col(f"p.{_CORRUPT}").isNotNull(), actions))


def _page_fault(corrupt: Column, actions: Column) -> Column:
    return F.when(corrupt, "unreadable page").when(actions.isNull(), "page without a list of actions").alias("fault")


def page_faults(pages: DataFrame) -> DataFrame:
    """Pages that cannot be used, to be enforced before their records are."""
    return pages.filter(F.col("fault").isNotNull()).select("page", F.col("fault").alias("rule"))


def page_records(pages: DataFrame) -> DataFrame:
    """One row per record, with its page and position.

    The outer form keeps the optimizer from adding a size filter, which would parse each page twice.
    """
    return (pages.select("page", F.posexplode_outer("actions").alias("pos", "a")).filter("pos IS NOT NULL")
            .select("page", "pos", "a.*"))


def ingest_action_pages(pages: DataFrame, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
    """Executions of perpetual orders, inside the requested seconds if bounds are given."""
    seconds = F.col("timestamp")
    kinds = (*INCREASE_CODES, *DECREASE_CODES, LIQUIDATION_CODE)
    # Bounds are UTC; epoch seconds need no session zone.
    first, last = (v and int((v - datetime(1970, 1, 1)).total_seconds()) for v in (low, high))
    found = page_records(pages).filter((F.col("eventName") == "OrderExecuted") & F.col("orderType").isin(*kinds))
    found = found if first is None else found.filter(seconds >= first)
    return found if last is None else found.filter(seconds < last)


def page_creations(pages: DataFrame) -> DataFrame:
    """Creation records: order key, account and time."""
    return page_records(pages).filter(F.col("eventName") == "OrderCreated").select(
        F.col("orderKey").alias("order_key"), "account", "timestamp")


def normalize_execution(records: DataFrame, creations: DataFrame, chain_id: int) -> DataFrame:
    """Contract text rows plus ``faults``: what makes a record unusable (empty when fine).

    ``creations`` holds at most one row per order key; the gate for that runs before.
    """
    from recohort.operators.classify import classify_action

    made = creations.select(F.col("order_key").alias("orderKey"), F.col("account").alias("made_by"),
                            F.col("timestamp").alias("made_at"))
    rows = records.join(made, "orderKey", "left")
    tx, index = before_last(F.col("id"), ":"), after_last(F.col("id"), ":")
    size = scale_usd(F.col("sizeDeltaUsd"))
    parts = F.col("positionFeeAmount"), F.col("traderDiscountAmount"), F.col("collateralTokenPriceMin")
    action = classify_action(F.col("orderType"), F.when(size == "0", 0).otherwise(1))
    wrong_id = ~F.coalesce((F.lower(tx) == F.lower("transactionHash")) & index.rlike("^[0-9]+$"), F.lit(False))
    wrong_account = F.coalesce(F.lower("made_by") != F.lower("account"), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(action.isNull(), "unrecognized order type"),
        F.when(wrong_id, "cannot derive log index from id"),
        F.when(wrong_account, "order account differs from execution account"),
        F.when(size.isNull(), "size is not a raw integer"), fee_fault(*parts)))
    return rows.select(
        F.lit(str(chain_id)).alias("chain_id"), F.lower("transactionHash").alias("tx_hash"), index.alias("log_index"),
        F.lower("account").alias("account"), F.lower("orderKey").alias("order_key"),
        F.lower(F.coalesce("marketAddress", F.lit(""))).alias("market"),
        iso(from_epoch_seconds(F.col("timestamp"))).alias("timestamp"), action.alias("action"),
        F.lit("true").alias("success"), size.alias("size_delta_usd"), net_fee(*parts).alias("position_fee_usd"),
        iso(from_epoch_seconds(F.col("made_at"))).alias("order_created_at"), faults.alias("faults"))
