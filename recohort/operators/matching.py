"""Matched-event audit of positions, executions and order creations.

Join multiplication is a result here, so duplicates are never removed. Equal rows are counted
first and a joined pair carries the product of its counts: every counter is exact, while a key
that repeats a billion times is one row on each side of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recohort.contracts import AUDIT_FIELDS, DAILY_FIELDS, DECREASE_TYPES, INCREASE_TYPES, LIQUIDATION_TYPE
from recohort.functions.times import distinct_days, instant, within
from recohort.operators.classify import allowed_position_type, comparable, perpetual_type, swap_type
from recohort.session import pin

MATCH_KEY = ("block_date", "tx_hash", "order_key", "account")


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows by key in that many parts, if their number is known; else Spark's setting decides, whatever the number of rows."""
    return rows.repartition(parts, *keys) if parts else rows


def date_grid(events: DataFrame, column: str = "timestamp") -> DataFrame:
    """Every date between the first and last event, present even with no rows."""
    ends = events.agg(F.to_date(F.min(column)).alias("a"), F.to_date(F.max(column)).alias("b"))
    return ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL '1' DAY"))).alias("day"))


def dates_between(spark, first_day, end_day) -> DataFrame:
    """Every date in [first_day, end_day)."""
    days = F.sequence(F.lit(first_day), F.date_sub(F.lit(end_day), 1), F.expr("INTERVAL '1' DAY"))
    return spark.range(1).select(F.explode(days).alias("day"))


def creation_per_order(creations: DataFrame, upper=None) -> DataFrame:
    """One row per order key; ``creation_rows`` keeps duplicates and conflicts visible."""
    if upper is not None:
        creations = creations.filter(F.col("block_time") < F.lit(upper))
    return creations.groupBy("order_key").agg(
        F.min("account").alias("creation_account"), F.min("block_time").alias("created_at"),
        F.count("*").alias("creation_rows"), F.max("order_type").alias("created_order_type"))


def semi_relevant_creations(creations: DataFrame, keyed: DataFrame, parts: int | None = None) -> DataFrame:
    """Creations whose key occurs among the given rows, before any grouping; ``parts`` as in ``full_outer_match``."""
    keys = _dealt(keyed.select("order_key"), parts, "order_key").distinct()
    return _dealt(creations, parts, "order_key").join(keys, "order_key", "left_semi")


def semi_matched_positions(positions: DataFrame, executions: DataFrame, parts: int | None = None) -> DataFrame:
    """Positions with an execution of the same date, transaction, order and account; ``parts`` as in ``full_outer_match``."""
    keys = _dealt(executions.select(*MATCH_KEY), parts, *MATCH_KEY).distinct()
    return _dealt(positions, parts, *MATCH_KEY).join(keys, list(MATCH_KEY), "left_semi")


def anti_orphans(positions: DataFrame, executions: DataFrame) -> DataFrame:
    """Match keys found on one side only, with the side and row count."""
    left = positions.groupBy(*MATCH_KEY).agg(F.count("*").alias("n"))
    right = executions.groupBy(*MATCH_KEY).agg(F.count("*").alias("n"))
    only_left = left.join(right, list(MATCH_KEY), "left_anti").withColumn("side", F.lit("position"))
    only_right = right.join(left, list(MATCH_KEY), "left_anti").withColumn("side", F.lit("execution"))
    return only_left.unionByName(only_right)


def full_outer_match(positions: DataFrame, executions: DataFrame, rows: Column | None = None, parts: int | None = None) -> DataFrame:
    """Full outer match of both sources; equal pairs share a row and are counted in ``pair_rows``.

    ``rows`` says how many equal rows a row of either source stands for, if not for itself; ``parts`` into how many
    parts either source is dealt by the match key.
    """
    rows = F.lit(1) if rows is None else rows
    positions, executions = _dealt(positions, parts, *MATCH_KEY), _dealt(executions, parts, *MATCH_KEY)
    p = positions.groupBy(*MATCH_KEY, F.col("block_time").alias("p_time"), "order_type", "source_action",
                          F.signum("size_delta_usd").cast("int").alias("size_sign"),
                          F.col("position_index").isNotNull().alias("p_indexed")).agg(F.sum(rows).alias("p_rows"))
    e = executions.groupBy(*MATCH_KEY, F.col("block_time").alias("e_time"), "secondary_order_type",
                           F.col("execution_index").isNotNull().alias("e_indexed")).agg(F.sum(rows).alias("e_rows"))
    both = p.join(e, list(MATCH_KEY), "full_outer")
    return both.select(*MATCH_KEY, F.coalesce("p_time", "e_time").alias("block_time"), "order_type", "source_action",
                       "size_sign", "secondary_order_type",
                       F.coalesce("p_indexed", F.lit(False)).alias("has_position"),
                       F.coalesce("e_indexed", F.lit(False)).alias("has_execution"),
                       (F.coalesce("p_rows", F.lit(1)) * F.coalesce("e_rows", F.lit(1))).alias("pair_rows"))


def join_creation_any_side(matched: DataFrame, creations: DataFrame, parts: int | None = None) -> DataFrame:
    """Attach the grouped creation by the order key of whichever side is present; ``parts`` says into how many parts rows are dealt."""
    if parts:
        matched, creations = matched.repartition(parts, "order_key"), creations.repartition(parts, "order_key").hint("merge")
    return matched.join(creations, "order_key", "left")


def comparable_flag(joined: DataFrame) -> DataFrame:
    present = F.when(F.col("has_position"), 1), F.when(F.col("has_execution"), 1)
    fits = comparable(*present, F.col("source_action"), F.col("order_type"))
    return joined.withColumn("comparable", fits)


def duplicate_event_counts(events: DataFrame, index: str, rows: Column | None = None, parts: int | None = None) -> DataFrame:
    """Rows, and rows beyond the first of each (transaction, index), per day; ``rows`` and ``parts`` as in ``full_outer_match``."""
    per_event = _dealt(events, parts, "tx_hash").groupBy("block_date", "tx_hash", index).agg(F.sum(F.lit(1) if rows is None else rows).alias("n"))
    return per_event.groupBy("block_date").agg(
        F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("duplicate_events"))


def _counters(zero_account: Column) -> dict[str, Column]:
    """Condition of each daily counter over joined pairs."""
    present, executed = F.col("has_position"), F.col("has_execution")
    kind, made = F.col("order_type"), F.col("created_order_type")
    sign, fits = F.col("size_sign"), F.coalesce(F.col("comparable"), F.lit(False))
    account, once = F.col("account"), F.col("creation_rows") == 1
    known = once & (F.col("creation_account") == account)
    lone = ~present & executed
    return {
        "rows": fits,
        "increase": fits & kind.isin(*INCREASE_TYPES) & (sign > 0),
        "decrease": fits & kind.isin(*DECREASE_TYPES) & (sign > 0),
        "liquidation": fits & (kind == LIQUIDATION_TYPE),
        "collateral": fits & (kind != LIQUIDATION_TYPE) & (sign == 0),
        "zero_size": fits & (sign == 0),
        "joined_position_rows": present,
        "joined_execution_rows": executed,
        "unmatched_position_rows": present & ~executed,
        "unmatched_execution_rows": lone & known & perpetual_type(made),
        "out_of_scope_execution_rows": lone & known & swap_type(made),
        "unclassified_execution_rows": lone & ~F.coalesce(
            known & (perpetual_type(made) | swap_type(made)), F.lit(False)),
        "unexpected_order_type_rows": present & kind.isNotNull() & ~allowed_position_type(F.col("source_action"), kind),
        "invalid_account_rows": account.isNull() | (account == zero_account),
        "missing_size_rows": present & sign.isNull(),
        "negative_size_rows": present & (sign < 0),
        "missing_order_type_rows": present & kind.isNull(),
        "adl_rows": fits & (F.col("secondary_order_type") == 1),
        "unknown_secondary_type_rows": fits & F.col("secondary_order_type").isNull(),
        "created_missing": fits & F.col("created_at").isNull(),
        "creation_nonunique": fits & (F.col("creation_rows") != 1),
        "creation_account_mismatch": fits & once & (F.col("creation_account") != account),
        "creation_after_execution": fits & (F.col("created_at") > F.col("block_time")),
    }


def daily_join_audit(joined: DataFrame, zero_account: Column, parts: int | None = None) -> DataFrame:
    """All counters per day in one pass; accounts are merged first so the distinct count is exact.

    ``parts`` says into how many parts the pairs are dealt by day and account, which are narrower than their counters.
    """
    flagged = comparable_flag(_dealt(joined, parts, "block_date", "account"))
    conditions = _counters(zero_account)
    per_account = flagged.groupBy("block_date", "account").agg(*[
        F.coalesce(F.sum(F.when(cond, F.col("pair_rows"))), F.lit(0)).alias(name)
        for name, cond in conditions.items()])
    named = F.when(F.col("account").isNotNull() & (F.col("rows") > 0), 1)
    return per_account.groupBy("block_date").agg(
        *[F.sum(name).alias(name) for name in conditions], F.count(named).alias("accounts"))


def join_extra_rows(audit: DataFrame, position_daily: DataFrame, execution_daily: DataFrame) -> DataFrame:
    """Joined rows minus source rows per day: how far the join multiplied each source."""
    p = position_daily.select("block_date", F.col("rows").alias("position_rows"))
    e = execution_daily.select("block_date", F.col("rows").alias("execution_rows"))
    zero = F.lit(0).cast("long")
    out = audit.join(p, "block_date", "full_outer").join(e, "block_date", "full_outer")
    return out.select("block_date",
                      (F.coalesce("joined_position_rows", zero) - F.coalesce("position_rows", zero)).alias("position_join_extra_rows"),
                      (F.coalesce("joined_execution_rows", zero) - F.coalesce("execution_rows", zero)).alias("execution_join_extra_rows"))


def densify_dates(days: DataFrame, audit: DataFrame, position_daily: DataFrame,
                  execution_daily: DataFrame) -> DataFrame:
    """One row per date with explicit zeros: daily counts and the 21 audit counters."""
    p = position_daily.select(F.col("block_date").alias("day"), F.col("rows").alias("position_rows"),
                              F.col("duplicate_events").alias("duplicate_position_events"))
    e = execution_daily.select(F.col("block_date").alias("day"), F.col("rows").alias("execution_rows"),
                               F.col("duplicate_events").alias("duplicate_execution_events"))
    wide = reduce(lambda left, right: left.join(right, "day", "left"),
                  [audit.withColumnRenamed("block_date", "day"), p, e], days)
    filled = wide.na.fill(0, [name for name in wide.columns if name != "day"])
    filled = filled.withColumns({
        "position_join_extra_rows": F.col("joined_position_rows") - F.col("position_rows"),
        "execution_join_extra_rows": F.col("joined_execution_rows") - F.col("execution_rows")})
    return filled.select("day", *DAILY_FIELDS, *AUDIT_FIELDS)


def matched_events(positions: DataFrame, executions: DataFrame, creations: DataFrame, upper=None,
                   parts: int | None = None, rows: Column | None = None) -> DataFrame:
    """Full outer match with the grouped creation of each order."""
    relevant = semi_relevant_creations(creations, executions, parts)
    return join_creation_any_side(full_outer_match(positions, executions, rows, parts), creation_per_order(relevant, upper), parts)


def _counted(events: DataFrame, index: str) -> DataFrame:
    """Equal rows of a side as one, with their number ``_rows``; of sizes only the sign is kept."""
    sized = events.withColumn("size_delta_usd", F.signum("size_delta_usd")) if "size_delta_usd" in events.columns else events
    kept = [name for name in ("block_time", "order_type", "source_action", "size_delta_usd", "secondary_order_type") if name in events.columns]
    return sized.groupBy(*MATCH_KEY, *kept, index).agg(F.count("*").alias("_rows"))


def daily_audit(days: DataFrame | None, positions: DataFrame, executions: DataFrame, creations: DataFrame,
                zero_account: Column, upper=None, parts: int | None = None) -> DataFrame:
    """The whole daily audit. Both sides are written once, so that matching, grouping and counting read each source once.

    Without ``days``, the grid spans every date of either side.
    """
    positions, executions, rows = pin(_counted(positions, "position_index"), "positions"), pin(_counted(executions, "execution_index"), "executions"), F.col("_rows")
    if days is None:
        days = date_grid(positions.select("block_time").unionByName(executions.select("block_time")), "block_time")
    audit = daily_join_audit(matched_events(positions, executions, creations, upper, parts, rows), zero_account, parts)
    return densify_dates(days, audit, duplicate_event_counts(positions, "position_index", rows, parts),
                         duplicate_event_counts(executions, "execution_index", rows, parts))


def matched_retention(increases: DataFrame, executions: DataFrame, creations: DataFrame, campaign,
                      zero_account: Column, upper=None, parts: int | None = None) -> DataFrame:
    """Return flags per cohort account from matched opening positions only; ``parts`` as in ``full_outer_match``.

    A creation is unknown when missing, repeated, of another account, or later than the execution.
    """
    opened = pin(semi_matched_positions(
        increases.filter(F.col("order_type").isin(*INCREASE_TYPES) & (F.col("size_delta_usd") > 0)
                         & F.col("account").isNotNull() & (F.col("account") != zero_account)), executions, parts), "opened")
    late, anywhere, second = (campaign.window(o) for o in (campaign.late, campaign.any_time, campaign.second))
    ts = F.col("block_time")
    in_late = within(ts, *late)
    # Creations only matter to late openings; the others keep their keys out of this join.
    late_rows = opened.filter(in_late)
    made = creation_per_order(semi_relevant_creations(creations, late_rows, parts), upper)
    sound = ((F.col("creation_rows") == 1) & (F.col("creation_account") == F.col("account"))
             & (F.col("created_at") <= ts))
    strict = (_dealt(late_rows, parts, "order_key").groupBy("account", "order_key", "block_time").agg(F.count("*").alias("n"))
              .join(made, "order_key", "left").groupBy("account").agg(
                  (F.count_if(sound & (F.col("created_at") >= instant(campaign.end))) > 0).alias("strict_r30"),
                  F.coalesce(F.sum(F.when(~F.coalesce(sound, F.lit(False)), F.col("n"))), F.lit(0)).alias("strict_unknown_events")))
    flags = opened.groupBy("account").agg(
        F.count_if(within(ts, campaign.start, campaign.end)).alias("entered"),
        (F.count_if(in_late) > 0).alias("r30"), (F.count_if(within(ts, *anywhere)) > 0).alias("cumulative30"),
        (distinct_days(in_late, F.to_date(ts), *late) >= 2).alias("sustained30"),
        (F.count_if(within(ts, *second)) > 0).alias("r60")).filter("entered > 0").drop("entered")
    return flags.join(strict, "account", "left").withColumns({
        "strict_r30": F.coalesce("strict_r30", F.lit(False)),
        "strict_unknown_events": F.coalesce("strict_unknown_events", F.lit(0).cast("long"))})
