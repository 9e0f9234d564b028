"""Data-quality profiles: one aggregate each, distinct accounts exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recohort.functions.scalars import rate
from recohort.functions.times import instant
from recohort.operators.classify import opening


def event_quality_profile(trades: DataFrame) -> DataFrame:
    """Rows, accounts, openings, and how many openings have a known creation and fee.

    Accounts are merged before the global row, so no task holds all of them.
    """
    opened = opening()
    per_account = trades.groupBy(F.lower(F.col("account").cast("string")).alias("account")).agg(
        F.count("*").alias("n"), F.count_if(opened).alias("inc"),
        F.count_if(opened & F.col("order_created_at").isNotNull()).alias("made"),
        F.count_if(opened & F.col("position_fee_usd").isNotNull()).alias("fees"))
    zero = F.lit(0).cast("long")
    totals = per_account.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"), F.count("*").alias("unique_accounts"),
        F.coalesce(F.sum("inc"), zero).alias("qualifying_increases"),
        F.coalesce(F.sum("made"), zero).alias("known_order_creations"),
        F.coalesce(F.sum("fees"), zero).alias("known_position_fees"))
    return totals.withColumns({
        "order_created_coverage": rate(F.col("known_order_creations"), F.col("qualifying_increases")),
        "position_fee_coverage": rate(F.col("known_position_fees"), F.col("qualifying_increases"))})


def _gaps() -> dict[str, Column]:
    return {"fee_missing": F.col("position_fee_usd").isNull(),
            "created_missing": F.col("order_created_at").isNull(),
            "zero_size": F.col("size_delta_usd") == 0}


def daily_quality(trades: DataFrame) -> DataFrame:
    """Per UTC day: rows, distinct accounts, rows by action, unknown fees and creations, zero sizes."""
    actions = ("increase", "decrease", "liquidation", "collateral")
    per_account = trades.groupBy(F.to_date("timestamp").alias("day"), "account").agg(
        F.count("*").alias("rows"), *[F.count_if(F.col("action") == name).alias(name) for name in actions],
        *[F.count_if(cond).alias(name) for name, cond in _gaps().items()])
    sums = ("rows", *actions, *_gaps())
    return (per_account.groupBy("day").agg(*[F.sum(name).alias(name) for name in sums], F.count("*").alias("accounts"))
            .select("day", "rows", "accounts", *actions, *_gaps()))


def missing_by_action(trades: DataFrame) -> DataFrame:
    return trades.groupBy("action").agg(F.count("*").alias("rows"),
                                        *[F.count_if(cond).alias(name) for name, cond in _gaps().items()])


def partition_profile(events: DataFrame) -> DataFrame:
    """Rows, accounts, and accounts with exactly one or two events."""
    per = events.groupBy("account").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("unique_accounts"),
                   F.count_if(F.col("n") == 1).alias("single_event_accounts"),
                   F.count_if(F.col("n") == 2).alias("two_event_accounts"))


def day_type_matrix(events: DataFrame, kind: str, kinds: list) -> DataFrame:
    """Rows by day and kind, one column per kind; ``kinds`` is fixed so no extra pass finds them."""
    counts = [F.count_if(F.col(kind) == value).alias(f"type_{value}") for value in kinds]
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(*counts)


def partition_overlap(part: DataFrame, cohort: DataFrame) -> DataFrame:
    """Accounts of one part, and how many of them are in a later cohort."""
    accounts = part.select("account").distinct()
    marked = accounts.join(cohort.select("account").withColumn("_in", F.lit(True)), "account", "left")
    return marked.agg(F.count("*").alias("accounts"), F.count("_in").alias("cohort_accounts"))


def date_coverage_diff(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Days missing from an export and days it should not have."""
    have, want = found.select("day").distinct(), expected.select("day").distinct()
    missing = want.join(have, "day", "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(want, "day", "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def enrich_creation_time(executions: DataFrame, creations: DataFrame) -> DataFrame:
    """Creation time of each execution's order; a different account is reported, not joined away."""
    made = creations.select(F.col("order_key"), F.col("account").alias("creation_account"),
                            F.col("timestamp").alias("order_created_at"))
    return executions.join(made, "order_key", "left").withColumn(
        "account_mismatch", F.coalesce(F.lower(F.col("creation_account").cast("string"))
                                       != F.lower(F.col("account").cast("string")), F.lit(False)))


def campaign_timeline(programmes: DataFrame, low, high) -> DataFrame:
    """Offset and length of each programme as fractions of the covered span."""
    span = F.lit(max((high - low).total_seconds(), 1.0))

    def seconds(later, earlier):
        return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / 1e6

    return programmes.select("name", "start", "end",
                             (seconds(F.col("start"), instant(low)) / span).alias("offset"),
                             (seconds(F.col("end"), F.col("start")) / span).alias("length"))
