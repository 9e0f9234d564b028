"""The descriptive case: gates, cohort, outcomes and every summary, as lazily planned tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from recohort.contracts import Campaign
from recohort.operators import cohort as co, gates, quality, ranking
from recohort.session import pin, prepare
from recohort.sources.events import read_event_text, type_events
from recohort.sources.files import write_results


def load_checked(spark, path, chain_id: int, coverage: tuple[datetime, datetime], size_type: str = "double") -> DataFrame:
    """Typed events of a CSV snapshot; any broken row or repeated event refuses the whole snapshot."""
    raw = pin(read_event_text(prepare(spark), path), "raw")
    gates.enforce(gates.validate_rows(raw, chain_id, *coverage, size_type=size_type))
    # Typed once: every table of a case reads these rows again.
    trades = pin(type_events(raw, size_type), "events")
    gates.enforce(gates.validate_unique_events(trades))
    return trades


def describe_campaign(trades: DataFrame, campaign: Campaign, coverage: tuple[datetime, datetime], *,
                      history_complete: bool = False, decreases_verified: bool = True) -> dict[str, DataFrame]:
    """All tables of the case. The account profile and the daily facts are written once and shared."""
    prepare(trades.sparkSession)
    gates.check_case_boundaries(campaign, *coverage)
    profile = pin(co.retention_profile(trades, campaign), "profile")
    daily = pin(co.wallet_daily(trades), "daily")
    weeks = pin(co.weekly_profile(trades, campaign, co.post_weeks(campaign, coverage[1])), "weeks")
    evidence = {"coverage_end": coverage[1], "campaign": campaign, "decreases_verified": decreases_verified}
    return {
        "wallet_cohorts": profile, "wallet_daily": daily,
        "summary": co.retention_summary(profile, **evidence),
        "cohorts": co.entry_cohorts(profile, campaign, history_complete),
        "history": co.history_groups(profile, campaign, history_complete),
        "weekly": co.weekly_repeat(trades, campaign, coverage[1], weeks),
        "heatmap": co.cohort_heatmap(trades, campaign, coverage[1], weeks),
        "segments": ranking.exclude_top_percent(profile),
        "activity": co.activity_intensity(daily, profile, campaign, coverage[0]),
        "quality": quality.event_quality_profile(trades),
    }


def write_case(tables: dict[str, DataFrame], path: str) -> None:
    """Account tables as Parquet, daily facts by day, summaries as CSV."""
    for name, rows in tables.items():
        if name == "wallet_daily":
            write_results(rows, f"{path}/{name}", partition=["day"])
        elif name == "wallet_cohorts":
            write_results(rows, f"{path}/{name}", order=["account"])
        else:
            write_results(rows, f"{path}/{name}", kind="csv")
