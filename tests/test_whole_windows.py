"""Distinct days in windows of any length, and audits that read each source once."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recohort.contracts import Campaign
from recohort.functions.times import days_long, distinct_days
from recohort.operators import cohort as co, matching as m
from recohort.suite import tables as t

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.mark.parametrize("low, days", [(START, 1), (START, 62), (START, 63), (START, 64), (START, 65), (START, 129), (START, 400),
                                       (datetime(2024, 3, 5, 13, 30), 90)])
def test_distinct_days(spark, low, days):
    random.seed(days)
    high = low + timedelta(days=days)
    # Both edges of the window and of every word, and rows outside.
    offsets = [0, days - 1, days, -1] + [64 * k + e for k in range(1, days // 64 + 1) for e in (-1, 0)] + [random.randrange(days) for _ in range(60)]
    rows = [(k % 3, low + timedelta(days=o, seconds=random.randrange(60))) for k, o in enumerate(offsets * 2)]
    frame = spark.createDataFrame(rows, "account int, ts timestamp_ntz").repartition(5)
    inside = (F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))
    found = {r["account"]: r["n"] for r in frame.groupBy("account").agg(distinct_days(inside, F.to_date("ts"), low, high).alias("n")).collect()}
    want = defaultdict(set)
    for account, ts in rows:
        want[account] |= {ts.date()} if low <= ts < high else set()
    assert found == {a: len(d) for a, d in want.items()}


def test_distinct_days_of_an_empty_window_and_null_flags(spark):
    frame = spark.createDataFrame([(START,), (None,)], "ts timestamp_ntz")
    row = frame.agg(distinct_days(F.lit(True), F.to_date("ts"), START, START).alias("a"),
                    distinct_days(F.lit(None).cast("boolean"), F.to_date("ts"), START, START + timedelta(days=9)).alias("b"),
                    distinct_days(F.lit(True), F.to_date("ts"), START, START + timedelta(days=9)).alias("c")).first()
    assert tuple(row) == (0, 0, 1) and days_long(START, START) == 0


@pytest.mark.parametrize("late", [(23, 30), (30, 120), (0, 400)])
def test_sustained_return_in_long_windows(spark, late):
    campaign = Campaign(START, START + timedelta(days=10), late=late)
    low, high = campaign.window(late)
    # Days 0 and 64 of the window are two days; so are its first and last; one day twice is one.
    returns = {1: [0, min(64, days_long(low, high) - 1)], 2: [0, days_long(low, high) - 1], 3: [1, 1], 4: [], 5: [days_long(low, high)]}
    rows = [(a, START + timedelta(days=1), "increase") for a in returns]
    rows += [(a, low + timedelta(days=d, hours=h), "increase") for a, days in returns.items() for h, d in enumerate(days)]
    trades = spark.createDataFrame(rows, "account long, timestamp timestamp_ntz, action string").withColumns({
        "success": F.lit(True), "size_delta_usd": F.lit(2.0), "order_created_at": F.col("timestamp")})
    found = {r["account"]: r["sustained30"] for r in co.retention_profile(trades, campaign).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False, 5: False}
    days = {r["account"]: r["d"] for r in co.return_days(trades, campaign, {"d": late}).collect()}
    assert days == {1: 2, 2: 2, 3: 1, 4: 0, 5: 0}
    # The matched form answers the same.
    events = trades.select(F.to_date("timestamp").alias("block_date"), F.col("timestamp").alias("block_time"), F.hash("timestamp").alias("tx_hash"),
                           F.hash("timestamp").alias("order_key"), "account", "size_delta_usd", F.lit("MarketIncrease").alias("order_type"))
    made = events.select("order_key", "account", "block_time", "order_type")
    matched = m.matched_retention(events, events, made, campaign, F.lit(0).cast("long"))
    assert {r["account"]: r["sustained30"] for r in matched.collect()} == found


def scans(frame) -> list[str]:
    """Files that the plan of a frame reads, by leaf."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Relation " in line]


def test_audit_reads_each_source_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(m, "pin", lambda frame, name: written.append((name, len(scans(frame)))) or frame)
    m.daily_audit(m.dates_between(spark, START.date(), START.date() + timedelta(days=2)), t.positions(spark, FOLDER), t.executions(spark, FOLDER),
                  t.creations(spark, FOLDER), F.lit(0).cast("long"))
    # Each side is lineitem with orders, written once and read from there.
    assert written == [("positions", 2), ("executions", 2)]


def test_matching_covers_every_line(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert t.positions(spark, FOLDER).count() == lines.filter("l_orderkey % 50 <> 0").count()
    assert t.executions(spark, FOLDER).count() == lines.filter("l_orderkey % 40 <> 0").count()


@pytest.mark.parametrize("weeks", [0, 1, 63, 64, 65, 130])
def test_weeks_of_any_number(spark, weeks):
    campaign = Campaign(START, START + timedelta(days=10))
    random.seed(weeks)
    rows = [(a, START + timedelta(days=a % 9)) for a in range(12)]
    rows += [(a % 14, campaign.anchor + timedelta(days=random.randrange(-3, 7 * weeks + 9), hours=random.randrange(24))) for a in range(200)]
    trades = spark.createDataFrame(rows, "account long, timestamp timestamp_ntz").withColumns({
        "action": F.lit("increase"), "success": F.lit(True), "size_delta_usd": F.lit(2.0)})
    entered = {a: min(ts for b, ts in rows if b == a) for a in range(14) if any(b == a and START <= ts < campaign.end for b, ts in rows)}
    want = {a: set() for a in entered}
    for a, ts in rows:
        week = (ts.date() - campaign.anchor.date()).days // 7 + 1
        if a in want and ts >= campaign.anchor and 1 <= week <= weeks:
            want[a].add(week)
    assert {r.account: r.returned for r in co.weekly_profile(trades, campaign, weeks).collect()} == {a: sorted(w) for a, w in want.items()}
    end = campaign.anchor + timedelta(days=7 * weeks + 3)
    repeat = {r.week: r.n for r in co.weekly_repeat(trades, campaign, end).collect()}
    assert repeat == {w: sum(w in found for found in want.values()) for w in range(1, weeks + 1)}
    cells = co.cohort_heatmap(trades, campaign, end)
    assert sum(r.n for r in cells.collect()) == sum(repeat.values())
