"""Two independent computations of the same numbers, and whether they agree."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from recohort.contracts import Campaign
from recohort.operators import cohort as co, matching, quality, reconcile as rc


def recount_differences(trades: DataFrame, campaign: Campaign) -> DataFrame:
    """Metrics on which the set-based recount and the profile disagree; empty when they agree."""
    recount = co.cohort_intersection(trades, campaign)
    summary = co.retention_summary(co.retention_profile(trades, campaign)).filter("n IS NOT NULL")
    shared = recount.join(summary.select("metric"), "metric", "left_semi")
    return rc.compare_tables(summary.join(recount.select("metric"), "metric", "left_semi").select("metric", "n", "cohort_size"),
                             shared, ["metric"])


def reconcile_exports(daily: DataFrame, metrics: DataFrame, local_daily: DataFrame, local_metrics: DataFrame,
                      coverage: tuple[datetime, datetime], synthetic: bool) -> dict[str, DataFrame]:
    """Daily and metric exports of another system against the local ones."""
    days = matching.dates_between(daily.sparkSession, coverage[0].date(), coverage[1].date())
    gaps = quality.date_coverage_diff(daily, days).unionByName(quality.date_coverage_diff(local_daily, days))
    differences, issues = rc.reconcile_daily(daily, local_daily), rc.daily_grain_identities(daily)
    compared = rc.reconcile_metrics(metrics, local_metrics)
    return {"coverage": gaps, "daily_differences": differences, "daily_issues": issues, "metrics": compared,
            "status": rc.reconcile_status(compared, differences, issues, gaps, synthetic),
            "audit_totals": rc.audit_totals(daily)}
