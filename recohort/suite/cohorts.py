"""Campaign cohort, outcomes and activity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recohort.operators import classify, cohort as co, quality
from recohort.suite import tables as t
from recohort.suite.registry import query, rounded

C, E = t.ORDER_CAMPAIGN, t.EVENT_CAMPAIGN
IN_CAMPAIGN = t.inside_sql("ts", C.start, C.end)
FLAGS = co.RETURN_FLAGS


def _profile(spark, d):
    return co.retention_profile(t.order_trades(spark, d), C)


def _event_profile(spark, d):
    return co.retention_profile(t.event_trades(spark, d), E)


@query("first_seen", f"WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL} "
                     "SELECT account, min(ts) AS first_trade FROM flagged WHERE took_part GROUP BY account")
def _first_seen(spark, d):
    return co.first_seen(t.event_trades(spark, d))


@query("campaign_cohort", f"""WITH {t.order_trades_sql()}, {t.FLAGS_SQL}
SELECT account, min(ts) AS first_qualifying, CAST(sum(size) AS DOUBLE) AS campaign_volume_usd
FROM flagged WHERE opened AND {IN_CAMPAIGN} GROUP BY account""")
def _campaign_cohort(spark, d):
    return co.campaign_cohort(t.order_trades(spark, d), C)


@query("join_first_seen", t.ORDER_CASE_SQL + """
SELECT account, first_qualifying, campaign_volume_usd, first_trade, entry_week FROM profile""")
def _join_first_seen(spark, d):
    trades = t.order_trades(spark, d)
    return co.join_first_seen(co.campaign_cohort(trades, C), co.first_seen(trades))


_ALL_FLAGS = ", ".join((*FLAGS, "strict_missing"))


@query("join_outcomes", t.ORDER_CASE_SQL + f" SELECT account, {_ALL_FLAGS} FROM profile")
def _join_outcomes(spark, d):
    trades = t.order_trades(spark, d)
    entered = co.campaign_cohort(trades, C).select("account")
    return co.join_outcomes(entered, co.window_outcomes(trades, C))


@query("retention_outcomes", t.EVENT_CASE_SQL + f"""
SELECT account, first_qualifying, campaign_volume_usd, first_trade, entry_week, {_ALL_FLAGS} FROM profile""")
def _retention_outcomes(spark, d):
    return _event_profile(spark, d)


@query("sustained_return", t.EVENT_CASE_SQL + " SELECT account, sustained30 FROM profile")
def _sustained(spark, d):
    return _event_profile(spark, d).select("account", "sustained30")


# Windows of one, three and thirteen months: one word of days is not enough for the longer ones.
SPANS = {"days_30": (1, 31), "days_90": (30, 120), "days_400": (0, 400)}


@query("return_days", f"""WITH {t.order_trades_sql()}, {t.FLAGS_SQL}
SELECT account, """ + ", ".join(f"count(DISTINCT CASE WHEN {t.inside_sql('ts', *C.window(span))} THEN CAST(ts AS DATE) END) AS {name}" for name, span in SPANS.items())
       + f" FROM flagged WHERE opened GROUP BY account HAVING bool_or({IN_CAMPAIGN})")
def _return_days(spark, d):
    return co.return_days(t.order_trades(spark, d), C, SPANS)


@query("strict_return", t.EVENT_CASE_SQL + " SELECT account, strict_r30, strict_missing FROM profile")
def _strict(spark, d):
    return _event_profile(spark, d).select("account", "strict_r30", "strict_missing")


def _summary_sql(case: str, withheld: dict[str, str] | None = None) -> str:
    withheld = {"strict_r30": "sum(strict_missing) > 0", **(withheld or {})}
    rows = []
    for name in FLAGS:
        hidden = withheld.get(name, "FALSE")
        rows.append(f"SELECT '{name}' AS metric, CASE WHEN NOT coalesce({hidden}, FALSE) THEN count(CASE WHEN {name} THEN 1 END) END AS n, "
                    f"count(*) AS N FROM profile")
    return (case + ", counted AS (" + " UNION ALL ".join(rows) + """)
SELECT metric, n, N AS "N", round(CAST(n AS DOUBLE) / nullif(N, 0), 9) AS rate FROM counted""").replace(
        'count(*) AS N ', 'count(*) AS total ').replace('N AS "N"', 'total AS cohort_size').replace("nullif(N, 0)", "nullif(total, 0)")


@query("retention_summary", _summary_sql(t.ORDER_CASE_SQL))
def _summary(spark, d):
    rows = co.retention_summary(_profile(spark, d), coverage_end=t.ORDER_COVERAGE[1], campaign=C)
    return rounded(rows, "rate")


@query("withhold_metric", _summary_sql(
    t.campaign_sql(C, t.order_trades_sql(7)), {"voluntary30": "TRUE", "r60": "TRUE"}))
def _withheld(spark, d):
    profile = co.retention_profile(t.order_trades(spark, d, unknown_every=7), C)
    rows = co.retention_summary(profile, coverage_end=C.anchor + timedelta(days=30), campaign=C, decreases_verified=False)
    return rounded(rows, "rate")


@query("entry_week", """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS entry_week FROM orders""")
def _entry_week(spark, d):
    from recohort.functions.times import entry_week
    return t.table(spark, d, "orders").select("o_orderkey", entry_week(F.col("o_orderdate")).alias("entry_week"))


@query("half_open_window", f"""WITH {t.order_trades_sql()}
SELECT tx_hash, account, ts AS "timestamp" FROM trades WHERE {IN_CAMPAIGN}""")
def _window(spark, d):
    from recohort.functions.times import within
    return t.order_trades(spark, d).filter(within(F.col("timestamp"), C.start, C.end)).select("tx_hash", "account", "timestamp")


_KIND_SQL = f"CASE WHEN first_trade >= TIMESTAMP '{C.start}' THEN 'first_observed_in_campaign' ELSE 'observed_existing' END"


@query("history_kind", t.ORDER_CASE_SQL + f" SELECT account, {_KIND_SQL} AS kind FROM profile")
def _history_kind(spark, d):
    return _profile(spark, d).select("account", classify.history_kind(F.col("first_trade"), C).alias("kind"))


@query("entry_cohorts", t.ORDER_CASE_SQL + f"""
SELECT entry_week, {_KIND_SQL} AS kind, count(*) AS size, count(CASE WHEN r30 THEN 1 END) AS r30_n,
       round(count(CASE WHEN r30 THEN 1 END)::DOUBLE / count(*), 9) AS r30_rate
FROM profile GROUP BY 1, 2""")
def _entry_cohorts(spark, d):
    return rounded(co.entry_cohorts(_profile(spark, d), C), "r30_rate")


@query("history_groups", t.ORDER_CASE_SQL + f"""
SELECT {_KIND_SQL} AS kind, count(*) AS cohort_size, count(CASE WHEN r30 THEN 1 END) AS r30_n,
       round(count(CASE WHEN r30 THEN 1 END)::DOUBLE / count(*), 9) AS rate FROM profile GROUP BY 1""")
def _history_groups(spark, d):
    return rounded(co.history_groups(_profile(spark, d), C), "rate")


_WEEKLY_SQL = t.ORDER_CASE_SQL + """,
hits AS (SELECT DISTINCT f.account, p.entry_week, CAST(date_diff('day', TIMESTAMP '1998-01-01', f.ts) // 7 + 1 AS BIGINT) AS week
         FROM flagged f JOIN profile p ON p.account = f.account
         WHERE f.opened AND f.ts >= TIMESTAMP '1998-01-01' AND f.ts < TIMESTAMP '2001-08-02')"""


@query("weekly_repeat", _WEEKLY_SQL + """
SELECT w.week, TIMESTAMP '1998-01-01' + to_days(CAST((w.week - 1) * 7 AS INTEGER)) AS start,
       TIMESTAMP '1998-01-01' + to_days(CAST(w.week * 7 AS INTEGER)) AS "end",
       (SELECT count(*) FROM hits h WHERE h.week = w.week) AS n, (SELECT count(*) FROM profile) AS cohort_size,
       round((SELECT count(*) FROM hits h WHERE h.week = w.week)::DOUBLE / nullif((SELECT count(*) FROM profile), 0), 9) AS rate
FROM (SELECT CAST(range AS BIGINT) AS week FROM range(1, 188)) w""")
def _weekly(spark, d):
    return rounded(co.weekly_repeat(t.order_trades(spark, d), C, t.ORDER_COVERAGE[1]), "rate")


@query("cohort_heatmap", _WEEKLY_SQL + """
SELECT g.entry_week, g.size, w.week, count(h.account) AS n, round(count(h.account)::DOUBLE / g.size, 9) AS rate
FROM (SELECT entry_week, count(*) AS size FROM profile GROUP BY 1) g
JOIN (SELECT CAST(range AS BIGINT) AS week FROM range(1, 188)) w ON TRUE
LEFT JOIN hits h ON h.entry_week = g.entry_week AND h.week = w.week GROUP BY 1, 2, 3""")
def _heatmap(spark, d):
    return rounded(co.cohort_heatmap(t.order_trades(spark, d), C, t.ORDER_COVERAGE[1]), "rate")


_DAILY_SQL = """daily AS (
  SELECT account, CAST(ts AS DATE) AS day, count(CASE WHEN opened THEN 1 END) AS increases,
         count(CASE WHEN took_part THEN 1 END) AS open_or_decrease_trades,
         CAST(sum(CASE WHEN opened THEN fee END) AS DOUBLE) AS position_fee_usd,
         count(CASE WHEN opened AND fee IS NULL THEN 1 END) AS missing_fees
  FROM flagged GROUP BY 1, 2)"""


@query("wallet_daily", f"WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL}, {_DAILY_SQL} SELECT * FROM daily")
def _wallet_daily(spark, d):
    return co.wallet_daily(t.event_trades(spark, d))


@query("activity_mature_join", t.ORDER_CASE_SQL + f""", {_DAILY_SQL}
SELECT d.* FROM daily d JOIN profile p ON p.account = d.account WHERE p.first_trade < TIMESTAMP '1997-12-02'""")
def _mature(spark, d):
    trades = t.order_trades(spark, d)
    return co.activity_mature_join(co.wallet_daily(trades), co.mature_accounts(_profile(spark, d), C))


@query("activity_intensity", t.ORDER_CASE_SQL + f""", {_DAILY_SQL},
mature AS (SELECT account FROM profile WHERE first_trade < TIMESTAMP '1997-12-02'),
facts AS (SELECT (SELECT count(*) FROM mature) AS eligible_n,
  count(CASE WHEN day < DATE '1998-01-01' AND increases > 0 THEN 1 END) AS pre_active_days,
  count(CASE WHEN day >= DATE '1998-01-01' AND increases > 0 THEN 1 END) AS post_active_days,
  CASE WHEN coalesce(sum(CASE WHEN day < DATE '1998-01-01' THEN missing_fees END), 0) = 0
       THEN round(coalesce(sum(CASE WHEN day < DATE '1998-01-01' THEN position_fee_usd END), 0), 4) END AS pre_fee_usd,
  CASE WHEN coalesce(sum(CASE WHEN day >= DATE '1998-01-01' THEN missing_fees END), 0) = 0
       THEN round(coalesce(sum(CASE WHEN day >= DATE '1998-01-01' THEN position_fee_usd END), 0), 4) END AS post_fee_usd
  FROM daily JOIN mature USING (account) WHERE day >= DATE '1997-12-02' AND day < DATE '1998-01-31')
SELECT *, round(pre_active_days::DOUBLE / nullif(30 * eligible_n, 0), 9) AS pre_activity_rate,
  round(post_active_days::DOUBLE / nullif(30 * eligible_n, 0), 9) AS post_activity_rate,
  round(pre_fee_usd / nullif(30 * eligible_n, 0), 6) AS pre_fee_per_day,
  round(post_fee_usd / nullif(30 * eligible_n, 0), 6) AS post_fee_per_day,
  round(post_active_days::DOUBLE / nullif(pre_active_days, 0), 9) AS activity_ratio,
  round(post_fee_usd / nullif(pre_fee_usd, 0), 6) AS fee_ratio FROM facts""")
def _activity(spark, d):
    trades = t.order_trades(spark, d)
    out = co.activity_intensity(co.wallet_daily(trades), _profile(spark, d), C, t.ORDER_COVERAGE[0])
    out = rounded(out, "pre_fee_usd", "post_fee_usd", digits=4)
    out = rounded(out, "pre_fee_per_day", "post_fee_per_day", "fee_ratio", digits=6)
    return rounded(out, "pre_activity_rate", "post_activity_rate", "activity_ratio")


@query("distinct_cohort", f"""WITH {t.order_trades_sql()}, {t.FLAGS_SQL}
SELECT DISTINCT account FROM flagged WHERE opened AND {IN_CAMPAIGN}""")
def _distinct_cohort(spark, d):
    return co.distinct_cohort(t.order_trades(spark, d), C.start, C.end)


@query("cohort_intersection", t.EVENT_CASE_SQL + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count(CASE WHEN {m} THEN 1 END) AS n, count(*) AS cohort_size FROM profile"
    for m in ("r30", "cumulative30", "open_or_decrease30", "strict_r30", "r60", "sustained30")))
def _intersection(spark, d):
    return co.cohort_intersection(t.event_trades(spark, d), E)


def _window_rows_sql() -> str:
    rows = ", ".join(f"('{m}', TIMESTAMP '{lo}', TIMESTAMP '{hi}')" for m, lo, hi in co.measurement_windows(E))
    return f"""WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL}, w(metric, window_start, window_end) AS (VALUES {rows})
SELECT metric, window_start, window_end, count(*) AS openings, count(DISTINCT account) AS accounts
FROM w JOIN flagged f ON f.opened AND f.ts >= window_start AND f.ts < window_end GROUP BY 1, 2, 3"""


@query("measurement_windows", _window_rows_sql())
def _windows(spark, d):
    return co.events_per_window(t.event_trades(spark, d), E)


_PROGRAMMES_SQL = """programmes AS (SELECT o_orderpriority AS name, min(o_orderdate) AS start, max(o_orderdate) AS "end"
  FROM orders GROUP BY 1)"""


@query("campaign_timeline", f"""WITH {_PROGRAMMES_SQL}
SELECT name, start, "end", round(epoch(start - TIMESTAMP '1995-01-01') / epoch(TIMESTAMP '2001-08-02' - TIMESTAMP '1995-01-01'), 9) AS "offset",
       round(epoch("end" - start) / epoch(TIMESTAMP '2001-08-02' - TIMESTAMP '1995-01-01'), 9) AS length FROM programmes""")
def _timeline(spark, d):
    programmes = t.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return rounded(quality.campaign_timeline(programmes, *t.ORDER_COVERAGE), "offset", "length")


_WEEK = (datetime(1997, 3, 3), datetime(1997, 3, 10))


@query("partition_overlap", t.ORDER_CASE_SQL + f""", part AS (
  SELECT DISTINCT account FROM trades WHERE {t.inside_sql('ts', *_WEEK)})
SELECT count(*) AS accounts, count(p.account) AS cohort_accounts FROM part LEFT JOIN profile p ON p.account = part.account""")
def _overlap(spark, d):
    from recohort.functions.times import within
    trades = t.order_trades(spark, d)
    return quality.partition_overlap(trades.filter(within(F.col("timestamp"), *_WEEK)), co.campaign_cohort(trades, C))
