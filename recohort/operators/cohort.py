"""Fixed campaign cohort and its return windows.

Everything here is keyed by account and merges map-side. ``retention_profile`` folds first
activity, cohort entry and every return window into one conditional aggregate: one scan, one
shuffle, no join, and a hot account costs one partial row per map task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from recohort.contracts import Campaign, midnight
from recohort.functions.scalars import rate
from recohort.functions.times import WORD_DAYS, distinct_days, entry_week, instant, within
from recohort.operators.classify import history_kind, opening, participation, withhold_metric
from recohort.session import pin

RETURN_FLAGS = ("r30", "cumulative30", "sustained30", "open_or_decrease30", "voluntary30", "strict_r30", "r60")

_TS = "timestamp"


def first_seen(trades: DataFrame) -> DataFrame:
    """First open-or-decrease per account, over the whole history."""
    return trades.filter(participation()).groupBy("account").agg(F.min(_TS).alias("first_trade"))


def campaign_cohort(trades: DataFrame, campaign: Campaign) -> DataFrame:
    """Accounts that opened inside the campaign; this denominator never changes afterwards."""
    return (trades.filter(opening() & within(F.col(_TS), campaign.start, campaign.end))
            .groupBy("account")
            .agg(F.min(_TS).alias("first_qualifying"), F.sum("size_delta_usd").alias("campaign_volume_usd")))


def join_first_seen(entered: DataFrame, seen: DataFrame) -> DataFrame:
    """Attach first activity and the Monday of entry; both sides hold one row per account."""
    return entered.join(seen, "account").withColumn("entry_week", entry_week(F.col("first_qualifying")))


def _days_active(flag: Column, low: datetime, high: datetime) -> Column:
    """Aggregate: exact number of distinct UTC dates with such a row in a window of any length."""
    return distinct_days(flag & within(F.col(_TS), low, high), F.to_date(_TS), low, high)


def return_days(trades: DataFrame, campaign: Campaign, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """For each account of the cohort, on how many distinct days it opened in each span of days after the campaign."""
    ts, opened = F.col(_TS), opening()
    windows = {name: campaign.window(span) for name, span in spans.items()}
    entered = opened & within(ts, campaign.start, campaign.end)
    high = max([campaign.end, *(high for _, high in windows.values())])
    return (trades.filter(opened & within(ts, campaign.start, high)).groupBy("account")
            .agg(F.count_if(entered).alias("entered"), *[_days_active(opened, *window).alias(name) for name, window in windows.items()])
            .filter("entered > 0").drop("entered"))


def _outcome_columns(campaign: Campaign) -> dict[str, Column]:
    ts, opened, took_part = F.col(_TS), opening(), participation()
    late, anywhere, second = (campaign.window(o) for o in (campaign.late, campaign.any_time, campaign.second))
    in_late = within(ts, *late)
    return {
        "r30": F.count_if(opened & in_late) > 0,
        "cumulative30": F.count_if(opened & within(ts, *anywhere)) > 0,
        "sustained30": _days_active(opened, *late) >= 2,
        "open_or_decrease30": F.count_if(took_part & in_late) > 0,
        "voluntary30": F.count_if(took_part & in_late) > 0,
        "strict_r30": F.count_if(opened & in_late & (F.col("order_created_at") >= instant(campaign.end))) > 0,
        "strict_missing": F.count_if(opened & in_late & F.col("order_created_at").isNull()),
        "r60": F.count_if(opened & within(ts, *second)) > 0,
    }


def window_outcomes(trades: DataFrame, campaign: Campaign) -> DataFrame:
    """Return flags of every account with activity in a return window."""
    relevant = trades.filter(participation() & within(F.col(_TS), campaign.anchor, campaign.last_needed))
    return relevant.groupBy("account").agg(*[c.alias(n) for n, c in _outcome_columns(campaign).items()])


def join_outcomes(cohort: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Keep accounts that never return, with false flags and zero unknown creations."""
    filled = {name: F.coalesce(F.col(name), F.lit(False)) for name in RETURN_FLAGS}
    filled["strict_missing"] = F.coalesce(F.col("strict_missing"), F.lit(0).cast("long"))
    return cohort.join(outcomes, "account", "left").withColumns(filled)


def retention_profile(trades: DataFrame, campaign: Campaign) -> DataFrame:
    """Cohort, first activity and all outcomes per account in one aggregate."""
    ts = F.col(_TS)
    entering = opening() & within(ts, campaign.start, campaign.end)
    return (trades.filter(participation())
            .groupBy("account")
            .agg(F.min(F.when(entering, ts)).alias("first_qualifying"),
                 F.sum(F.when(entering, F.col("size_delta_usd"))).alias("campaign_volume_usd"),
                 F.min(ts).alias("first_trade"),
                 *[c.alias(n) for n, c in _outcome_columns(campaign).items()])
            .filter(F.col("first_qualifying").isNotNull())
            .withColumn("entry_week", entry_week(F.col("first_qualifying")))
            .select("account", "first_qualifying", "campaign_volume_usd", "first_trade", "entry_week",
                    "r30", "cumulative30", "sustained30", "open_or_decrease30", "voluntary30",
                    "strict_r30", "strict_missing", "r60"))


def summary_row(profile: DataFrame, *, coverage_end: datetime | None = None,
                campaign: Campaign | None = None, decreases_verified: bool = True) -> DataFrame:
    """One row of totals; a metric without evidence is null for the whole report.

    r60 needs coverage through its window, voluntary return needs verified decreases and strict
    return needs every relevant creation time.
    """
    long_enough = (coverage_end is None or campaign is None
                   or coverage_end >= campaign.anchor + timedelta(days=campaign.second[1]))
    totals = profile.agg(F.count("*").alias("cohort_size"),
                         *[F.count_if(F.col(name)).alias(name) for name in RETURN_FLAGS],
                         F.coalesce(F.sum("strict_missing"), F.lit(0)).alias("strict_missing"))
    withheld = {"strict_r30": F.col("strict_missing") > 0, "r60": F.lit(not long_enough),
                "voluntary30": F.lit(not decreases_verified)}
    return totals.select("cohort_size", "strict_missing", *[
        withhold_metric(F.col(name), withheld.get(name, F.lit(False))).alias(name) for name in RETURN_FLAGS])


def _long(totals: DataFrame, metrics) -> DataFrame:
    pairs = ", ".join(f"'{name}', {name}" for name in metrics)
    return totals.selectExpr("cohort_size", "strict_missing", f"stack({len(metrics)}, {pairs}) AS (metric, n)")


def retention_summary(profile: DataFrame, **evidence) -> DataFrame:
    """metric, n, cohort_size and rate; n and rate are null when withheld, rate also when the cohort is empty."""
    rows = _long(summary_row(profile, **evidence), RETURN_FLAGS)
    return rows.select("metric", F.col("n"), F.col("cohort_size").alias("cohort_size"),
                       rate(F.col("n"), F.col("cohort_size")).alias("rate"))


def retention_metrics_long(outcomes: DataFrame) -> DataFrame:
    """The five reconciled metrics, one row each, with the count of unknown creations.

    ``outcomes`` holds the flags and ``strict_unknown_events`` per account.
    """
    metrics = ("r30", "cumulative30", "sustained30", "strict_r30", "r60")
    totals = outcomes.agg(F.count("*").alias("cohort_size"),
                          *[F.count_if(F.col(name)).alias(name) for name in metrics],
                          F.coalesce(F.sum("strict_unknown_events"), F.lit(0)).alias("strict_missing"))
    totals = totals.withColumn("strict_r30", F.when(F.col("strict_missing") == 0, F.col("strict_r30")))
    return _long(totals, metrics).select(
        "metric", F.col("n").alias("numerator"), F.col("cohort_size").alias("denominator"),
        rate(F.col("n"), F.col("cohort_size")).alias("rate"),
        F.col("strict_missing").alias("strict_unknown_events"))


def measurement_windows(campaign: Campaign) -> list[tuple[str, datetime, datetime]]:
    """Metric name and its half-open window."""
    late, anywhere, second = (campaign.window(o) for o in (campaign.late, campaign.any_time, campaign.second))
    return [("r30", *late), ("cumulative30", *anywhere), ("sustained30", *late),
            ("open_or_decrease30", *late), ("voluntary30", *late), ("strict_r30", *late), ("r60", *second)]


def window_table(campaign: Campaign) -> Column:
    """The measurement windows as one array literal, to explode beside rows instead of joining."""
    return F.array(*[F.struct(F.lit(name).alias("metric"), instant(low).alias("window_start"),
                              instant(high).alias("window_end"))
                     for name, low, high in measurement_windows(campaign)])


def events_per_window(trades: DataFrame, campaign: Campaign) -> DataFrame:
    """Openings and accounts inside each measurement window."""
    rows = trades.filter(opening() & within(F.col(_TS), campaign.anchor, campaign.last_needed))
    hits = F.filter(window_table(campaign), lambda w: (F.col(_TS) >= w["window_start"]) & (F.col(_TS) < w["window_end"]))
    per_account = (rows.select("account", F.explode(hits).alias("w"))
                   .groupBy("w", "account").agg(F.count("*").alias("n")))
    return (per_account.groupBy("w").agg(F.sum("n").alias("openings"), F.count("*").alias("accounts"))
            .select("w.metric", "w.window_start", "w.window_end", "openings", "accounts"))


def entry_cohorts(profile: DataFrame, campaign: Campaign, history_complete: bool = False) -> DataFrame:
    """Size and late return by entry week and history kind."""
    return (profile.groupBy("entry_week", history_kind(F.col("first_trade"), campaign, history_complete).alias("kind"))
            .agg(F.count("*").alias("size"), F.count_if("r30").alias("r30_n"))
            .withColumn("r30_rate", rate(F.col("r30_n"), F.col("size"))))


def history_groups(profile: DataFrame, campaign: Campaign, history_complete: bool = False) -> DataFrame:
    """Size and late return by history kind."""
    return (profile.groupBy(history_kind(F.col("first_trade"), campaign, history_complete).alias("kind"))
            .agg(F.count("*").alias("cohort_size"), F.count_if("r30").alias("r30_n"))
            .withColumn("rate", rate(F.col("r30_n"), F.col("cohort_size"))))


def post_weeks(campaign: Campaign, coverage_end: datetime) -> int:
    """Number of whole post-campaign weeks the coverage allows."""
    return max(0, (coverage_end - campaign.anchor).days // 7)


def weekly_profile(trades: DataFrame, campaign: Campaign, weeks: int) -> DataFrame:
    """Per account of the cohort its entry week and, sorted, the post weeks in which it opened again.

    Weeks are bits that merge map-side, in as many words as there are, so one scan and one shuffle of
    accounts answer every question about weeks.
    """
    ts = F.col(_TS)
    high = max(campaign.end, campaign.anchor + timedelta(days=7 * weeks))
    entering, after = within(ts, campaign.start, campaign.end), within(ts, campaign.anchor, high)
    place = F.floor(F.datediff(F.to_date(_TS), F.lit(campaign.anchor.date())) / 7)
    words = []
    for first in range(0, weeks, WORD_DAYS):
        here = after & (place >= first) & (place < first + WORD_DAYS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place - first).cast("int"))
        words.append(F.coalesce(F.bit_or(F.when(here, bit)), F.lit(0).cast("long")).alias(f"_w{first // WORD_DAYS}"))
    found = (trades.filter(opening() & within(ts, campaign.start, high)).groupBy("account")
             .agg(F.min(F.when(entering, ts)).alias("first_qualifying"), *words).filter("first_qualifying IS NOT NULL"))
    returned = F.array().cast("array<int>")
    if weeks:
        bits = F.array(*[F.col(f"_w{k}") for k in range(len(words))])
        returned = F.filter(F.sequence(F.lit(1), F.lit(weeks)), lambda w: F.call_function(
            "shiftright", F.get(bits, F.floor((w - 1) / WORD_DAYS).cast("int")), ((w - 1) % WORD_DAYS).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return found.select("account", entry_week(F.col("first_qualifying")).alias("entry_week"), returned.alias("returned"))


def _week_grid(sized: DataFrame, weeks: int) -> DataFrame:
    # sequence(1, 0) would count down.
    return sized.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks)))).filter("week > 0")


def weekly_repeat(trades: DataFrame, campaign: Campaign, coverage_end: datetime, profile: DataFrame | None = None) -> DataFrame:
    """Distinct returning accounts in each post week over the fixed denominator, zeros kept."""
    weeks = post_weeks(campaign, coverage_end)
    profile = pin(weekly_profile(trades, campaign, weeks), "weeks") if profile is None else profile
    hits = profile.select(F.explode("returned").alias("week")).groupBy("week").agg(F.count("*").alias("n"))
    grid = _week_grid(profile.agg(F.count("*").alias("cohort_size")), weeks)
    start = instant(campaign.anchor) + F.make_dt_interval(days=(F.col("week") - 1) * 7)
    return (grid.join(hits, "week", "left")
            .select("week", start.alias("start"), (start + F.expr("INTERVAL '7' DAY")).alias("end"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n"), "cohort_size")
            .withColumn("rate", rate(F.col("n"), F.col("cohort_size"))))


def cohort_heatmap(trades: DataFrame, campaign: Campaign, coverage_end: datetime, profile: DataFrame | None = None) -> DataFrame:
    """Entry week by post week: distinct returners and rate, zero cells kept."""
    weeks = post_weeks(campaign, coverage_end)
    profile = pin(weekly_profile(trades, campaign, weeks), "weeks") if profile is None else profile
    hits = profile.select("entry_week", F.explode("returned").alias("week")).groupBy("entry_week", "week").agg(F.count("*").alias("n"))
    grid = _week_grid(profile.groupBy("entry_week").agg(F.count("*").alias("size")), weeks)
    return (grid.join(hits, ["entry_week", "week"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
            .withColumn("rate", rate(F.col("n"), F.col("size")))
            .select("entry_week", "size", "week", "n", "rate"))


def wallet_daily(trades: DataFrame) -> DataFrame:
    """Per account and UTC day: counts, known fees and the number of missing ones."""
    opened = opening()
    return (trades.groupBy("account", F.to_date(_TS).alias("day"))
            .agg(F.count_if(opened).alias("increases"),
                 F.count_if(participation()).alias("open_or_decrease_trades"),
                 F.sum(F.when(opened, F.col("position_fee_usd"))).alias("position_fee_usd"),
                 F.count_if(opened & F.col("position_fee_usd").isNull()).alias("missing_fees")))


def mature_accounts(cohort: DataFrame, campaign: Campaign, days: int = 30) -> DataFrame:
    """Cohort accounts already active a full window before the campaign's last midnight."""
    cut = midnight(campaign.end) - timedelta(days=days)
    return cohort.filter(F.col("first_trade") < instant(cut)).select("account")


def activity_mature_join(daily: DataFrame, mature: DataFrame) -> DataFrame:
    """Daily facts of mature accounts; both sides are keyed by account."""
    return daily.join(mature, "account")


def activity_intensity(daily: DataFrame, cohort: DataFrame, campaign: Campaign,
                       coverage_start: datetime, days: int = 30) -> DataFrame:
    """Active account-days and fees before the end and after the anchor, per eligible account-day.

    A window's fee is null when any of its fees is unknown. The denominator counts every mature
    account, active or not. Without coverage of the earlier window, only the eligible count is known.
    """
    mature = mature_accounts(cohort, campaign, days)
    close = midnight(campaign.end)
    spans = {"pre": (close - timedelta(days=days), close),
             "post": (campaign.anchor, campaign.anchor + timedelta(days=days))}
    covered = F.lit(coverage_start <= spans["pre"][0])
    day = F.col("day")
    inside = {name: (day >= F.lit(low.date())) & (day < F.lit(high.date())) for name, (low, high) in spans.items()}
    measures = []
    for name, cond in inside.items():
        measures += [F.count_if(cond & (F.col("increases") > 0)).alias(f"{name}_days"),
                     F.sum(F.when(cond, F.col("position_fee_usd"))).alias(f"{name}_fees"),
                     F.coalesce(F.sum(F.when(cond, F.col("missing_fees"))), F.lit(0)).alias(f"{name}_missing")]
    facts = activity_mature_join(daily.filter(inside["pre"] | inside["post"]), mature).agg(*measures)
    row = facts.withColumn("eligible", mature.agg(F.count("*")).scalar())
    divisor = (F.col("eligible") * days).cast("double")
    out = [F.col("eligible").alias("eligible_n")]
    for name in spans:
        fee = F.when(F.col(f"{name}_missing") == 0,
                     F.coalesce(F.col(f"{name}_fees").cast("double"), F.lit(0.0)))
        out += [F.when(covered, F.col(f"{name}_days")).alias(f"{name}_active_days"),
                F.when(covered, rate(F.col(f"{name}_days"), divisor)).alias(f"{name}_activity_rate"),
                F.when(covered, fee).alias(f"{name}_fee_usd"),
                F.when(covered, rate(fee, divisor)).alias(f"{name}_fee_per_day")]
    return row.select(*out).withColumns({
        "activity_ratio": rate(F.col("post_activity_rate"), F.col("pre_activity_rate")),
        "fee_ratio": rate(F.col("post_fee_per_day"), F.col("pre_fee_per_day"))})


def distinct_cohort(trades: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """Distinct accounts opening in a window."""
    return trades.filter(opening() & within(F.col(_TS), low, high)).select("account").distinct()


def cohort_intersection(trades: DataFrame, campaign: Campaign) -> DataFrame:
    """Independent recount: cohort set against the set of accounts seen in each window.

    Each set is reduced to one row per account (and metric) before the semi join.
    """
    ts, opened, took_part = F.col(_TS), opening(), participation()
    cohort = distinct_cohort(trades, campaign.start, campaign.end)
    late, anywhere, second = (campaign.window(o) for o in (campaign.late, campaign.any_time, campaign.second))
    in_late = within(ts, *late)
    marks = F.array_compact(F.array(
        F.when(opened & in_late, "r30"), F.when(opened & within(ts, *anywhere), "cumulative30"),
        F.when(took_part & in_late, "open_or_decrease30"),
        F.when(opened & in_late & (F.col("order_created_at") >= instant(campaign.end)), "strict_r30"),
        F.when(opened & within(ts, *second), "r60")))
    rows = trades.filter(took_part & within(ts, campaign.anchor, campaign.last_needed))
    observed = rows.select("account", F.explode(marks).alias("metric")).distinct()
    twice = (rows.filter(opened & in_late).select("account", F.to_date(_TS).alias("day")).distinct()
             .groupBy("account").agg(F.count("*").alias("days")).filter("days >= 2")
             .select("account", F.lit("sustained30").alias("metric")))
    hits = (observed.unionByName(twice).join(cohort, "account", "left_semi")
            .groupBy("metric").agg(F.count("*").alias("n")))
    names = F.array(*[F.lit(m) for m in ("r30", "cumulative30", "open_or_decrease30", "strict_r30", "r60", "sustained30")])
    grid = cohort.agg(F.count("*").alias("cohort_size")).withColumn("metric", F.explode(names))
    return grid.join(hits, "metric", "left").select("metric", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "cohort_size")
