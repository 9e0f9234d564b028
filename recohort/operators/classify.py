"""Row-level flags and classification of execution events."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import Column, DataFrame, functions as F

from recohort.contracts import (
    DECREASE_CODES, DECREASE_TYPES, INCREASE_CODES, INCREASE_TYPES, LIQUIDATION_CODE,
    LIQUIDATION_TYPE, SWAP_TYPES, Campaign,
)
from recohort.functions.times import instant, within


def opening(action: str = "action", success: str = "success", size: str = "size_delta_usd") -> Column:
    """A successful increase of positive size."""
    return F.col(success) & (F.col(action) == "increase") & (F.col(size) > 0)


def participation(action: str = "action", success: str = "success", size: str = "size_delta_usd") -> Column:
    """A successful increase or decrease of positive size."""
    return F.col(success) & F.col(action).isin("increase", "decrease") & (F.col(size) > 0)


def action_flags(trades: DataFrame) -> DataFrame:
    return trades.withColumns({"is_increase": opening(), "is_open_or_decrease": participation()})


def scan_openings(trades: DataFrame) -> DataFrame:
    """Openings only, projected to what the event-time features need."""
    return trades.filter(opening()).select(
        "account", "market", "timestamp", F.col("size_delta_usd").alias("size_usd"),
        F.col("position_fee_usd").alias("fee_usd"))


def classify_action(code: Column, size: Column) -> Column:
    """Action name from the numeric order type; null when the type is not a perpetual order."""
    kind = (F.when(code.isin(*INCREASE_CODES), "increase")
            .when(code.isin(*DECREASE_CODES), "decrease")
            .when(code == LIQUIDATION_CODE, "liquidation"))
    return F.when(kind.isNotNull() & (size == 0) & (code != LIQUIDATION_CODE), "collateral").otherwise(kind)


def allowed_position_type(source_action: Column, order_type: Column) -> Column:
    """Whether an order type can produce a position event of the given source."""
    return (((source_action == "increase") & order_type.isin(*INCREASE_TYPES))
            | ((source_action == "decrease") & order_type.isin(*DECREASE_TYPES, LIQUIDATION_TYPE)))


def comparable(position: Column, execution: Column, source_action: Column, order_type: Column) -> Column:
    """Both sides present, and the position's order type fits its source."""
    return position.isNotNull() & execution.isNotNull() & allowed_position_type(source_action, order_type)


def perpetual_type(order_type: Column) -> Column:
    return order_type.isin(*INCREASE_TYPES, *DECREASE_TYPES, LIQUIDATION_TYPE)


def swap_type(order_type: Column) -> Column:
    return order_type.isin(*SWAP_TYPES)


def emitter_filter(events: DataFrame, address_hex: str, column: str = "contract_address") -> DataFrame:
    """Rows of one emitter, compared as bytes so that the literal reaches the scan."""
    return events.filter(F.col(column) == F.lit(bytes.fromhex(address_hex)))


def scan_decoded_events(events: DataFrame, first_day, end_day, address_hex: str) -> DataFrame:
    """Date- and time-bounded scan of one emitter.

    Both predicates stay: the date prunes partitions, the time is exact.
    """
    low, high = datetime.combine(first_day, time()), datetime.combine(end_day, time())
    bounded = events.filter((F.col("block_date") >= F.lit(first_day)) & (F.col("block_date") < F.lit(end_day))
                            & within(F.col("block_time"), low, high))
    return emitter_filter(bounded, address_hex)


def union_positions(increases: DataFrame, decreases: DataFrame) -> DataFrame:
    """Both position sources with a source tag; duplicates are kept."""
    return (increases.withColumn("source_action", F.lit("increase"))
            .unionByName(decreases.withColumn("source_action", F.lit("decrease"))))


def history_kind(first_trade: Column, campaign: Campaign, history_complete: bool = False) -> Column:
    """Whether an account's first activity falls inside the campaign or before it."""
    fresh = "new_v2" if history_complete else "first_observed_in_campaign"
    return F.when(first_trade >= instant(campaign.start), fresh).otherwise("observed_existing")


def withhold_metric(value: Column, withheld: Column) -> Column:
    """Null when the evidence for a metric is missing."""
    return F.when(~withheld, value)
