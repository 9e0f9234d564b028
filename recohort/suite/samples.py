"""Event-time samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recohort.contracts import FEATURES
from recohort.operators import classify, landmarks as lm
from recohort.suite import tables as t
from recohort.suite.registry import query, rounded

_SHARE = "top_market_share_30d"


def study_openings(spark, d):
    """Dealt by account, so that later groupings by account, cutoff and market move nothing more."""
    return t.dealt(classify.scan_openings(t.order_trades(spark, d)), t.table(spark, d, "orders"), "account")


def event_openings(spark, d):
    return t.dealt(classify.scan_openings(t.event_trades(spark, d)), t.table(spark, d, "events"), "account")


def study_samples(spark, d):
    return lm.landmark_samples(study_openings(spark, d), t.STUDY_MARKS, t.STUDY_START)


@query("scan_openings", f"""WITH {t.EVENT_TRADES_SQL}
SELECT account, market, ts AS "timestamp", CAST(size AS DOUBLE) AS size_usd, CAST(fee AS DOUBLE) AS fee_usd
FROM trades WHERE success AND action = 'increase' AND size > 0""")
def _openings(spark, d):
    return classify.scan_openings(t.event_trades(spark, d))


@query("landmark_table", t.STUDY_SQL + """
SELECT m.as_of, m.split, m.label_start, m.label_end, count(x.account) AS accounts
FROM marks m LEFT JOIN members x ON x.as_of = m.as_of GROUP BY 1, 2, 3, 4""")
def _table(spark, d):
    members = lm.join_landmarks(study_openings(spark, d), t.STUDY_MARKS, t.STUDY_START).groupBy("as_of").agg(
        F.count("*").alias("accounts"))
    return lm.landmark_table(spark, t.STUDY_MARKS).join(members, "as_of", "left").withColumn(
        "accounts", F.coalesce("accounts", F.lit(0)))


@query("join_landmarks", t.STUDY_SQL + " SELECT as_of, split, label_start, label_end, account FROM members")
def _landmarks(spark, d):
    return lm.join_landmarks(study_openings(spark, d), t.STUDY_MARKS, t.STUDY_START)


@query("join_history", t.STUDY_SQL + """
SELECT m.as_of, m.account, o.ts AS "timestamp", CAST(o.size AS DOUBLE) AS size_usd
FROM members m JOIN openings o ON o.account = m.account AND o.ts < m.as_of""")
def _history(spark, d):
    rows = study_openings(spark, d)
    return lm.join_history(lm.join_landmarks(rows, t.STUDY_MARKS, t.STUDY_START), rows).select(
        "as_of", "account", "timestamp", "size_usd")


@query("join_trailing_window", t.STUDY_SQL + """
SELECT m.as_of, m.account, o.market, o.ts AS "timestamp"
FROM members m JOIN openings o ON o.account = m.account AND o.ts < m.as_of AND o.ts >= m.as_of - INTERVAL '30 days'""")
def _trailing(spark, d):
    rows = study_openings(spark, d)
    return lm.join_trailing_window(lm.join_landmarks(rows, t.STUDY_MARKS, t.STUDY_START), rows, t.STUDY_MARKS).select(
        "as_of", "account", "market", "timestamp")


@query("label_exists", t.STUDY_SQL + """
SELECT m.as_of, m.split, m.account, CAST(CASE WHEN EXISTS (SELECT 1 FROM openings o WHERE o.account = m.account
  AND o.ts >= m.label_start AND o.ts < m.label_end) THEN 1 ELSE 0 END AS BIGINT) AS label FROM members m""")
def _label(spark, d):
    rows = study_openings(spark, d)
    return lm.label_exists(lm.join_landmarks(rows, t.STUDY_MARKS, t.STUDY_START), rows, t.STUDY_MARKS).select(
        "as_of", "split", "account", "label")


_EVENT_SAMPLES = t.EVENT_STUDY_SQL + ", " + t.samples_sql(t.EVENT_START)
_WINDOW_NAMES = [n for n in FEATURES if n[-1] == "d" and n[-2].isdigit() and not n.startswith(("market", "top"))]


@query("trailing_window_features", _EVENT_SAMPLES + f" SELECT as_of, account, {', '.join(_WINDOW_NAMES)} FROM past")
def _windows(spark, d):
    return lm.trailing_window_features(event_openings(spark, d), t.EVENT_MARKS, t.EVENT_START)


@query("recency_features", _EVENT_SAMPLES + """
SELECT as_of, account, days_since_first_observed_opening, days_since_last_opening, pre_campaign_opening FROM past""")
def _recency(spark, d):
    return lm.recency_features(event_openings(spark, d), t.EVENT_MARKS, t.EVENT_START)


@query("market_concentration", _EVENT_SAMPLES + " SELECT * FROM spread")
def _markets(spark, d):
    return rounded(lm.market_concentration(event_openings(spark, d), t.EVENT_MARKS, t.EVENT_START), _SHARE)


_STUDY_SAMPLES = t.STUDY_SQL + ", " + t.samples_sql(t.STUDY_START)


@query("join_market_features", _STUDY_SAMPLES + " SELECT as_of, account, market_count_30d, top_market_share_30d FROM samples")
def _join_markets(spark, d):
    rows = study_openings(spark, d)
    members = lm.join_landmarks(rows, t.STUDY_MARKS, t.STUDY_START).select("as_of", "account")
    return rounded(lm.join_market_features(members, lm.market_concentration(rows, t.STUDY_MARKS, t.STUDY_START)), _SHARE)


@query("landmark_samples", _STUDY_SAMPLES + f" SELECT account, as_of, split, label, {', '.join(FEATURES)} FROM samples")
def _samples(spark, d):
    return rounded(study_samples(spark, d), _SHARE)


@query("split_summary", _STUDY_SAMPLES + """
SELECT m.split, m.as_of, m.label_start, m.label_end, count(s.account) AS n, CAST(coalesce(sum(s.label), 0) AS BIGINT) AS positive,
       count(DISTINCT s.account) AS unique_accounts
FROM marks m LEFT JOIN samples s ON s.as_of = m.as_of GROUP BY 1, 2, 3, 4""")
def _split(spark, d):
    return lm.split_summary(study_samples(spark, d), t.STUDY_MARKS)


@query("feature_shift", _STUDY_SAMPLES + """
SELECT as_of, split, count(*) AS n, count(CASE WHEN opening_count_30d = 0 THEN 1 END) AS no_opening_30d,
       CAST(coalesce(sum(CASE WHEN opening_count_30d = 0 THEN label END), 0) AS BIGINT) AS returns_among_inactive,
       CAST(median(days_since_last_opening) AS DOUBLE) AS median_days_since_last_opening,
       CAST(median(opening_count_30d) AS DOUBLE) AS median_opening_count_30d FROM samples GROUP BY 1, 2""")
def _shift(spark, d):
    return lm.feature_shift(study_samples(spark, d))


@query("seen_in_training_flag", _STUDY_SAMPLES + """
SELECT account, as_of, label, CAST(CASE WHEN account IN (SELECT account FROM samples WHERE split = 'train') THEN 1 ELSE 0 END AS BIGINT) AS seen_in_training
FROM samples WHERE split = 'test'""")
def _seen(spark, d):
    rows = study_samples(spark, d).select("account", "as_of", "split", "label")
    return lm.seen_in_training_flag(rows.filter("split = 'test'"), rows.filter("split = 'train'")).drop("split")


@query("validate_fee_presence", t.EVENT_STUDY_SQL + """
SELECT m.as_of, m.account, count(*) AS missing_fees FROM members m JOIN openings o ON o.account = m.account AND o.ts < m.as_of
WHERE o.fee IS NULL GROUP BY 1, 2""")
def _fees(spark, d):
    return lm.validate_fee_presence(event_openings(spark, d), t.EVENT_MARKS, t.EVENT_START)


@query("validate_features", _EVENT_SAMPLES + """
SELECT 'not finite and non-negative' AS rule, 'opening_fee_usd_30d' AS feature, account, as_of FROM samples WHERE opening_fee_usd_30d - 300 < 0
UNION ALL SELECT 'share above one', 'top_market_share_30d', account, as_of FROM samples WHERE top_market_share_30d * 4 > 1
UNION ALL SELECT 'flag is not binary', 'pre_campaign_opening', account, as_of FROM samples WHERE pre_campaign_opening = 1""")
def _features(spark, d):
    # Shifted values, so that every rule meets rows that break it.
    rows = lm.landmark_samples(event_openings(spark, d), t.EVENT_MARKS, t.EVENT_START).withColumns({
        "opening_fee_usd_30d": F.col("opening_fee_usd_30d") - 300, "top_market_share_30d": F.round("top_market_share_30d", 9) * 4,
        "pre_campaign_opening": F.col("pre_campaign_opening") / 2})
    return lm.validate_features(rows)


@query("expected_counts", _STUDY_SAMPLES + """,
found AS (SELECT as_of, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM samples GROUP BY 1),
frozen AS (SELECT as_of, CASE WHEN month(as_of) = 7 THEN n + 1 ELSE n END AS expected_n, positive AS expected_positive FROM found)
SELECT f.as_of, f.n, z.expected_n, f.positive, z.expected_positive FROM frozen z JOIN found f ON f.as_of = z.as_of WHERE f.n <> z.expected_n""")
def _expected(spark, d):
    summary = lm.split_summary(study_samples(spark, d), t.STUDY_MARKS)
    frozen = summary.select("as_of", F.when(F.month("as_of") == 7, F.col("n") + 1).otherwise(F.col("n")).alias("n"), "positive")
    return lm.expected_counts(summary, frozen)


@query("validate_cutoffs", """WITH a AS (
  SELECT o_orderpriority AS campaign, date_trunc('quarter', o_orderdate) + to_hours(CASE WHEN quarter(o_orderdate) = 4 THEN 6 ELSE 0 END) AS as_of,
         CASE WHEN year(o_orderdate) < 1999 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'validation' ELSE 'test' END AS split
  FROM orders GROUP BY 1, 2, 3),
b AS (SELECT campaign, as_of + CASE WHEN split = 'train' AND as_of >= TIMESTAMP '1998-10-01' THEN to_days(80) ELSE to_days(0) END AS as_of, split FROM a),
c AS (SELECT *, lead(as_of) OVER (PARTITION BY campaign ORDER BY as_of) AS nx, lead(split) OVER (PARTITION BY campaign ORDER BY as_of) AS ns FROM b)
SELECT campaign, as_of, split, 'not at midnight' AS rule FROM c WHERE date_trunc('day', as_of) <> as_of
UNION ALL SELECT campaign, as_of, split, 'labels mature too late' FROM c WHERE ns <> split AND as_of + INTERVAL '30 days' > nx""")
def _cutoffs(spark, d):
    day = F.col("o_orderdate")
    late = F.make_dt_interval(hours=F.when(F.quarter(day) == 4, 6).otherwise(0))
    year = F.year(day)
    anchors = t.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("campaign"), (F.date_trunc("quarter", day).cast("timestamp_ntz") + late).alias("as_of"),
        F.when(year < 1999, "train").when(year < 2000, "validation").otherwise("test").alias("split")).distinct()
    crowded = (F.col("split") == "train") & (F.col("as_of") >= F.lit(datetime(1998, 10, 1).isoformat(sep=" ")).cast("timestamp_ntz"))
    moved = F.col("as_of") + F.make_dt_interval(days=F.when(crowded, 80).otherwise(0))
    return lm.validate_cutoffs(anchors.withColumn("as_of", moved))
