"""Reward ledgers with exact integers of any width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recohort.functions.exact import (
    carry_limbs, compare_text, is_integer_text, merge_limbs, scale_token_units, strip_zeros, subtract_text, sum_limbs,
)
from recohort.functions.scalars import is_address


def reward_faults(documents: DataFrame, token: str, type_id: int) -> DataFrame:
    """Document-level faults: unreadable JSON (also a repeated key), wrong token, type or id."""
    v = F.col("payload")

    def text(path):
        return F.try_variant_get(v, path, "string")

    def kind(path):
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    kind_of_amounts = kind("$.amounts")
    rules = F.array_compact(F.array(
        F.when(v.isNull(), "unreadable document"),
        F.when(v.isNotNull() & ~F.coalesce(F.lower(text("$.token")) == token, F.lit(False)), "unexpected token"),
        F.when(v.isNotNull() & ~F.coalesce((kind("$.distributionTypeId") == "BIGINT")
                                           & (text("$.distributionTypeId") == str(type_id)), F.lit(False)), "unexpected distribution type"),
        F.when(v.isNotNull() & ~F.coalesce(text("$.id") == F.concat(F.col("epoch_start"), F.lit(f"_{type_id}")),
                                           F.lit(False)), "unexpected epoch id"),
        F.when(v.isNotNull() & ~F.coalesce(kind_of_amounts.startswith("OBJECT") & (kind_of_amounts != "OBJECT<>"),
                                           F.lit(False)), "missing recipient allocations")))
    return documents.select("file", F.explode(rules).alias("rule"))


def reward_row_faults(allocations: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Row-level faults: address shape, amount text, repeated recipients, absent override targets."""
    shaped = F.coalesce(is_address(F.col("recipient")), F.lit(False))
    amount_ok = F.coalesce((F.col("amount_kind") == "STRING") & is_integer_text(F.col("amount_raw")), F.lit(False))
    rules = F.array_compact(F.array(F.when(~shaped, "invalid recipient"), F.when(~amount_ok, "invalid amount")))
    single = allocations.select("file", "recipient", F.explode(rules).alias("rule"))
    repeated = (allocations.groupBy("file", F.lower("recipient").alias("recipient")).agg(F.count("*").alias("n"))
                .filter("n > 1").select("file", "recipient", F.lit("repeated recipient").alias("rule")))
    out = single.unionByName(repeated)
    if overrides is None:
        return out
    known = allocations.select("file", F.lower("recipient").alias("receiver")).distinct()
    given = overrides.filter("original IS NOT NULL").select("file", F.lower("receiver").alias("receiver"),
                                                            F.lower("original").alias("original"))
    absent = given.join(known.hint("merge"), ["file", "receiver"], "left_anti").select(
        "file", F.col("receiver").alias("recipient"), F.lit("absent override recipient").alias("rule"))
    twice = (given.groupBy("file", "original").agg(F.count("*").alias("n")).filter("n > 1")
             .select("file", F.col("original").alias("recipient"), F.lit("repeated override source").alias("rule")))
    return out.unionByName(absent).unionByName(twice)


def batch_total_faults(allocations: DataFrame, batches: DataFrame) -> DataFrame:
    """Files whose exact allocation sum differs from the declared batch total (file, total_raw)."""
    usable = F.when(is_integer_text(F.col("amount_raw")), F.col("amount_raw"))
    sums = allocations.groupBy("file").agg(sum_limbs(usable).alias("limbs")).select(
        "file", carry_limbs(F.col("limbs")).alias("sum_raw"))
    return (batches.join(sums.hint("merge"), "file", "left").filter(~F.col("sum_raw").eqNullSafe(strip_zeros(F.col("total_raw"))))
            .select("file", F.lit("allocation sum differs from batch total").alias("rule"), "sum_raw", "total_raw"))


def validate_rewards(allocations: DataFrame, batches: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """All row and total faults as (file, rule, detail)."""
    rows = reward_row_faults(allocations, overrides).select("file", "rule", F.col("recipient").alias("detail"))
    totals = batch_total_faults(allocations, batches).select("file", "rule", F.col("sum_raw").alias("detail"))
    return rows.unionByName(totals)


def reward_ledger(allocations: DataFrame, overrides: DataFrame, token: str) -> DataFrame:
    """Recipient by epoch with exact amounts and what is known about receiver overrides.

    A missing override map is unknown; it is not the same as an empty one.
    """
    # Sizes of parsed documents are guessed far too low, so no side of these joins may be sent to every task.
    recorded = overrides.groupBy("file").agg(F.max(F.col("recorded").cast("int")).alias("recorded"))
    destinations = (overrides.filter("receiver IS NOT NULL")
                    .select("file", F.lower("receiver").alias("recipient")).distinct().withColumn("_to", F.lit(True)))
    evidence = (F.when(F.coalesce("recorded", F.lit(0)) == 0, "unrecorded")
                .when(F.col("_to"), "recorded_destination").otherwise("not_in_recorded_overrides"))
    rows = allocations.withColumn("recipient", F.lower("recipient"))
    return (rows.join(recorded.hint("merge"), "file", "left").join(destinations.hint("merge"), ["file", "recipient"], "left")
            .select("file", "epoch_start", "recipient", F.lit(token).alias("token"), "amount_raw",
                    scale_token_units(F.col("amount_raw")).alias("amount_units"), evidence.alias("override_evidence")))


def reward_epoch_summary(ledger: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Recipients, exact total and recorded overrides per epoch.

    Recipients are merged first: an epoch's rows never meet in one task before they are summed.
    """
    per = ledger.groupBy("epoch_start", "recipient").agg(sum_limbs(F.col("amount_raw")).alias("limbs"))
    out = per.groupBy("epoch_start").agg(F.count("*").alias("recipient_count"), merge_limbs("limbs").alias("limbs"))
    out = out.select("epoch_start", F.date_format(F.date_add(F.to_date("epoch_start"), 7), "yyyy-MM-dd").alias("epoch_end_exclusive"),
                     "recipient_count", carry_limbs(F.col("limbs")).alias("amount_raw"))
    out = out.withColumn("amount_units", scale_token_units(F.col("amount_raw")))
    if overrides is None:
        return out
    known = overrides.groupBy("epoch_start").agg(
        (F.max(F.col("recorded").cast("int")) == 1).alias("overrides_recorded"),
        F.count("original").alias("n"))
    return (out.join(known, "epoch_start", "left")
            .withColumn("overrides_recorded", F.coalesce("overrides_recorded", F.lit(False)))
            .withColumn("recorded_override_count", F.when(F.col("overrides_recorded"), F.col("n"))).drop("n"))


def reward_totals(ledger: DataFrame) -> DataFrame:
    """Exact grand total and distinct recipients."""
    per = ledger.groupBy("recipient").agg(F.count("*").alias("n"), sum_limbs(F.col("amount_raw")).alias("limbs"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recipient_epoch_rows"), F.count("*").alias("unique_recipients"),
                  merge_limbs("limbs").alias("limbs"))
    total = carry_limbs(F.col("limbs"))
    return out.select("recipient_epoch_rows", "unique_recipients", total.alias("total_amount_raw"),
                      scale_token_units(total).alias("total_amount_units"))


def published_raw(figure: Column, places: int = 18) -> Column:
    """Raw integer text of a published decimal figure such as 224976.96."""
    whole = F.substring_index(figure, ".", 1)
    fraction = F.when(figure.contains("."), F.substring_index(figure, ".", -1)).otherwise("")
    return strip_zeros(F.concat(whole, F.rpad(fraction, places, "0")))


def signed_difference(left: Column, right: Column) -> Column:
    """``left - right`` as signed integer text."""
    order = compare_text(left, right)
    return F.when(order >= 0, subtract_text(left, right)).otherwise(F.concat(F.lit("-"), subtract_text(right, left)))


def reward_report_reconcile(totals: DataFrame, raw: str, figure: str) -> DataFrame:
    """Exact total minus a rounded published figure, in token units."""
    gap = signed_difference(F.col(raw), published_raw(F.col(figure)))
    return totals.withColumn("exact_minus_published", scale_token_units(gap))

