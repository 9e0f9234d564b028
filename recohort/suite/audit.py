"""Matched-event audit queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from recohort.contracts import Campaign, AUDIT_FIELDS, DAILY_FIELDS
from recohort.operators import classify, cohort as co, matching as m, quality
from recohort.session import new_folder
from recohort.sources.files import write_results
from recohort.suite import tables as t
from recohort.suite.registry import query, rounded



def _zero():
    return F.lit(0).cast("bigint")


# The campaign and its return windows lie in one year of the lines; creations count up to its end.
LINE_CAMPAIGN = Campaign(datetime(1997, 1, 15), datetime(1997, 9, 1))
UPPER = datetime(1998, 1, 1)


def _sides(spark, d):
    return t.positions(spark, d), t.executions(spark, d)


def _matched(spark, d):
    return m.matched_events(*_sides(spark, d), t.creations(spark, d), parts=t.line_parts(spark, d))


@query("date_grid", """SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL '1 day')) AS DATE) AS day FROM events""")
def _grid(spark, d):
    return m.date_grid(t.event_trades(spark, d))


@query("scan_decoded_events", """SELECT event_id, CAST(ts AS DATE) AS block_date, ts AS block_time, user_id AS account
FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def _decoded(spark, d):
    # Stored by day, so that the bounds on the day leave whole folders unread.
    path = new_folder(spark, "decoded")
    write_results(_decoded_rows(spark, d), path, partition=["block_date"])
    return classify.scan_decoded_events(spark.read.parquet(path), date(2024, 1, 5), date(2024, 1, 20), t.EMITTER).select(
        "event_id", "block_date", "block_time", "account")


def _decoded_rows(spark, d):
    other = "cd" * 20
    emitter = F.when(F.col("event_type").isin("view", "click"), F.unhex(F.lit(t.EMITTER))).otherwise(F.unhex(F.lit(other)))
    return t.table(spark, d, "events").select("event_id", F.to_date("ts").alias("block_date"), F.col("ts").alias("block_time"),
                                              F.col("user_id").alias("account"), "event_type", emitter.alias("contract_address"))


@query("emitter_filter", """SELECT event_type, count(*) AS rows FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def _emitter(spark, d):
    return classify.emitter_filter(_decoded_rows(spark, d), t.EMITTER).groupBy("event_type").agg(F.count("*").alias("rows"))


@query("union_positions", t.MATCH_SQL + """
SELECT block_date, order_key, position_index, account, source_action FROM positions""")
def _union(spark, d):
    p = t.positions(spark, d)
    inc = p.filter("source_action = 'increase'").drop("source_action")
    dec = p.filter("source_action = 'decrease'").drop("source_action")
    return classify.union_positions(inc, dec).select("block_date", "order_key", "position_index", "account", "source_action")


@query("semi_matched_positions", t.MATCH_SQL + """
SELECT p.block_date, p.order_key, p.position_index, p.account FROM positions p
WHERE EXISTS (SELECT 1 FROM executions e WHERE e.block_date = p.block_date AND e.tx_hash = p.tx_hash
              AND e.order_key = p.order_key AND e.account = p.account)""")
def _semi(spark, d):
    return m.semi_matched_positions(*_sides(spark, d), t.line_parts(spark, d)).select("block_date", "order_key", "position_index", "account")


@query("semi_relevant_creations", t.MATCH_SQL + """
SELECT order_key, account, block_time, order_type FROM creations WHERE order_key IN (SELECT order_key FROM executions)""")
def _relevant(spark, d):
    return m.semi_relevant_creations(t.creations(spark, d), t.executions(spark, d), t.line_parts(spark, d)).select(
        "order_key", "account", "block_time", "order_type")


@query("creation_per_order", t.MATCH_SQL + " SELECT * FROM made")
def _per_order(spark, d):
    return m.creation_per_order(m.semi_relevant_creations(t.creations(spark, d), t.executions(spark, d), t.line_parts(spark, d)))


_PAIR = ("block_date, tx_hash, order_key, account, block_time, order_type, source_action, "
         "CAST(sign(size) AS BIGINT) AS size_sign, CAST(secondary_order_type AS BIGINT) AS secondary_order_type, has_position, has_execution")


@query("full_outer_match", t.MATCH_SQL + f" SELECT {_PAIR}, count(*) AS pair_rows FROM joined GROUP BY ALL")
def _full(spark, d):
    return m.full_outer_match(*_sides(spark, d), parts=t.line_parts(spark, d))


@query("join_creation_any_side", t.MATCH_SQL + f"""
SELECT {_PAIR}, creation_account, created_at, creation_rows, created_order_type, count(*) AS pair_rows FROM full_rows GROUP BY ALL""")
def _any_side(spark, d):
    return _matched(spark, d)


@query("comparable_flag", t.MATCH_SQL + """
SELECT coalesce(fits, FALSE) AS comparable, has_position, has_execution, count(*) AS rows FROM full_rows GROUP BY 1, 2, 3""")
def _comparable(spark, d):
    matched = m.comparable_flag(_matched(spark, d))
    return matched.groupBy(F.coalesce("comparable", F.lit(False)).alias("comparable"), "has_position", "has_execution").agg(
        F.sum("pair_rows").alias("rows"))


@query("anti_orphans", t.MATCH_SQL + """
SELECT block_date, tx_hash, order_key, account, 'position' AS side, count(*) AS n FROM positions p
WHERE NOT EXISTS (SELECT 1 FROM executions e WHERE e.block_date = p.block_date AND e.order_key = p.order_key AND e.account = p.account AND e.tx_hash = p.tx_hash)
GROUP BY 1, 2, 3, 4
UNION ALL
SELECT block_date, tx_hash, order_key, account, 'execution', count(*) FROM executions e
WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE e.block_date = p.block_date AND e.order_key = p.order_key AND e.account = p.account AND e.tx_hash = p.tx_hash)
GROUP BY 1, 2, 3, 4""")
def _orphans(spark, d):
    return m.anti_orphans(*_sides(spark, d))


@query("duplicate_event_counts", t.MATCH_SQL + """
SELECT block_date, count(*) AS rows, count(*) - count(DISTINCT (tx_hash, position_index)) AS duplicate_events
FROM positions GROUP BY 1""")
def _duplicates(spark, d):
    return m.duplicate_event_counts(t.positions(spark, d), "position_index")


_PERP = "('MarketIncrease', 'LimitIncrease', 'MarketDecrease', 'LimitDecrease', 'StopLossDecrease', 'Liquidation')"
_KNOWN = "creation_rows = 1 AND creation_account = account"
_LONE = "NOT has_position AND has_execution"
# Name and condition of each counter over the joined rows.
_CONDITIONS = {
    "rows": "fits",
    "increase": "fits AND order_type IN ('MarketIncrease', 'LimitIncrease') AND size > 0",
    "decrease": "fits AND order_type IN ('MarketDecrease', 'LimitDecrease', 'StopLossDecrease') AND size > 0",
    "liquidation": "fits AND order_type = 'Liquidation'",
    "collateral": "fits AND order_type <> 'Liquidation' AND size = 0",
    "zero_size": "fits AND size = 0",
    "joined_position_rows": "has_position",
    "joined_execution_rows": "has_execution",
    "unmatched_position_rows": "has_position AND NOT has_execution",
    "unmatched_execution_rows": f"{_LONE} AND {_KNOWN} AND created_order_type IN {_PERP}",
    "out_of_scope_execution_rows": f"{_LONE} AND {_KNOWN} AND created_order_type IN ('MarketSwap', 'LimitSwap')",
    "unclassified_execution_rows": f"{_LONE} AND ({_KNOWN} AND (created_order_type IN {_PERP} OR created_order_type IN ('MarketSwap', 'LimitSwap'))) IS NOT TRUE",
    "unexpected_order_type_rows": "has_position AND order_type IS NOT NULL AND (fits OR (source_action = 'increase' AND order_type IN ('MarketIncrease', 'LimitIncrease')) OR (source_action = 'decrease' AND order_type IN ('MarketDecrease', 'LimitDecrease', 'StopLossDecrease', 'Liquidation'))) IS NOT TRUE",
    "invalid_account_rows": "account IS NULL OR account = 0",
    "missing_size_rows": "has_position AND size IS NULL",
    "negative_size_rows": "has_position AND size < 0",
    "missing_order_type_rows": "has_position AND order_type IS NULL",
    "adl_rows": "fits AND secondary_order_type = 1",
    "unknown_secondary_type_rows": "fits AND secondary_order_type IS NULL",
    "created_missing": "fits AND created_at IS NULL",
    "creation_nonunique": "fits AND creation_rows <> 1",
    "creation_account_mismatch": "fits AND creation_rows = 1 AND creation_account <> account",
    "creation_after_execution": "fits AND created_at > block_time",
}
_COUNTED = ", ".join(f'count(CASE WHEN {cond} THEN 1 END) AS "{name}"' for name, cond in _CONDITIONS.items())
_AUDIT_SQL = t.MATCH_SQL + f""",
audit AS (SELECT block_date, {_COUNTED}, count(DISTINCT CASE WHEN fits THEN account END) AS accounts
          FROM full_rows GROUP BY block_date)"""


@query("daily_join_audit", _AUDIT_SQL + " SELECT * FROM audit")
def _audit(spark, d):
    return m.daily_join_audit(_matched(spark, d), _zero(), t.line_parts(spark, d))


_DENSE_SQL = _AUDIT_SQL + """,
pd AS (SELECT block_date, count(*) AS n, count(*) - count(DISTINCT (tx_hash, position_index)) AS dup FROM positions GROUP BY 1),
ed AS (SELECT block_date, count(*) AS n, count(*) - count(DISTINCT (tx_hash, execution_index)) AS dup FROM executions GROUP BY 1),
wide AS (
  SELECT g.day, a.*, coalesce(pd.n, 0) AS position_rows, coalesce(pd.dup, 0) AS duplicate_position_events,
         coalesce(ed.n, 0) AS execution_rows, coalesce(ed.dup, 0) AS duplicate_execution_events,
         coalesce(a.joined_position_rows, 0) - coalesce(pd.n, 0) AS position_join_extra_rows,
         coalesce(a.joined_execution_rows, 0) - coalesce(ed.n, 0) AS execution_join_extra_rows
  FROM (SELECT CAST(unnest(generate_series(min(block_date), max(block_date), INTERVAL '1 day')) AS DATE) AS day
        FROM (SELECT block_date FROM positions UNION ALL SELECT block_date FROM executions)) g
  LEFT JOIN audit a ON a.block_date = g.day LEFT JOIN pd ON pd.block_date = g.day LEFT JOIN ed ON ed.block_date = g.day)"""


def _dense(spark, d):
    return m.daily_audit(None, *_sides(spark, d), t.creations(spark, d), _zero(), parts=t.line_parts(spark, d))


@query("densify_dates", _DENSE_SQL + " SELECT day, " + ", ".join(
    f'CAST(coalesce("{n}", 0) AS BIGINT) AS "{n}"' for n in (*DAILY_FIELDS, *AUDIT_FIELDS)) + " FROM wide")
def _densify(spark, d):
    return _dense(spark, d)


@query("join_extra_rows", t.MATCH_SQL + """,
j AS (SELECT block_date, count(CASE WHEN has_position THEN 1 END) AS p, count(CASE WHEN has_execution THEN 1 END) AS e FROM joined GROUP BY 1),
pd AS (SELECT block_date, count(*) AS n FROM positions GROUP BY 1), ed AS (SELECT block_date, count(*) AS n FROM executions GROUP BY 1)
SELECT j.block_date, p - coalesce(pd.n, 0) AS position_join_extra_rows, e - coalesce(ed.n, 0) AS execution_join_extra_rows
FROM j LEFT JOIN pd ON pd.block_date = j.block_date LEFT JOIN ed ON ed.block_date = j.block_date""")
def _extra(spark, d):
    p, e = _sides(spark, d)
    audit = m.daily_join_audit(_matched(spark, d), _zero(), t.line_parts(spark, d))
    return m.join_extra_rows(audit, m.duplicate_event_counts(p, "position_index"), m.duplicate_event_counts(e, "execution_index"))


def _matched_retention_sql() -> str:
    c = LINE_CAMPAIGN
    late, anywhere, second = (t.inside_sql("i.block_time", *c.window(o)) for o in (c.late, c.any_time, c.second))
    sound = "coalesce(m.creation_rows = 1 AND m.creation_account = i.account AND m.created_at <= i.block_time, FALSE)"
    names = ("r30", "cumulative30", "sustained30", "strict_r30", "r60")
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS metric, " + ("CASE WHEN sum(unknown) = 0 THEN count(CASE WHEN strict_r30 THEN 1 END) END" if n == "strict_r30"
                                       else f"count(CASE WHEN {n} THEN 1 END)")
        + " AS numerator, count(*) AS denominator, CAST(sum(unknown) AS BIGINT) AS strict_unknown_events FROM flags" for n in names)
    return t.MATCH_SQL + f""",
incs AS (SELECT p.* FROM positions p WHERE p.source_action = 'increase' AND p.order_type IN ('MarketIncrease', 'LimitIncrease') AND p.size > 0 AND p.account <> 0
         AND EXISTS (SELECT 1 FROM executions e WHERE e.block_date = p.block_date AND e.tx_hash = p.tx_hash AND e.order_key = p.order_key AND e.account = p.account)),
incmade AS (SELECT order_key, min(account) AS creation_account, min(block_time) AS created_at, count(*) AS creation_rows
            FROM creations WHERE block_time < TIMESTAMP '1998-01-01' GROUP BY order_key),
flags AS (SELECT i.account, bool_or({late}) AS r30, bool_or({anywhere}) AS cumulative30,
  count(DISTINCT CASE WHEN {late} THEN i.block_date END) >= 2 AS sustained30,
  bool_or({late} AND {sound} AND m.created_at >= TIMESTAMP '{c.end}') AS strict_r30,
  sum(CASE WHEN {late} AND NOT {sound} THEN 1 ELSE 0 END) AS unknown, bool_or({second}) AS r60
  FROM incs i LEFT JOIN incmade m ON m.order_key = i.order_key
  GROUP BY i.account HAVING bool_or({t.inside_sql('i.block_time', c.start, c.end)})),
long AS ({rows})
SELECT metric, numerator, denominator, round(numerator::DOUBLE / nullif(denominator, 0), 9) AS rate, strict_unknown_events FROM long"""


def matched_metrics(spark, d):
    increases = t.positions(spark, d).filter("source_action = 'increase'")
    flags = m.matched_retention(increases, t.executions(spark, d), t.creations(spark, d), LINE_CAMPAIGN, _zero(), UPPER, t.line_parts(spark, d))
    return co.retention_metrics_long(flags)


@query("retention_metrics_long", _matched_retention_sql())
def _metrics(spark, d):
    return rounded(matched_metrics(spark, d), "rate")


@query("enrich_creation_time", t.MATCH_SQL + """,
single AS (SELECT order_key, min(account) AS account, min(block_time) AS ts FROM creations GROUP BY 1)
SELECT e.order_key, e.execution_index, e.block_date, s.ts AS order_created_at, coalesce(s.account <> e.account, FALSE) AS account_mismatch
FROM executions e LEFT JOIN single s ON s.order_key = e.order_key""")
def _enrich(spark, d):
    single = m.creation_per_order(t.creations(spark, d)).select(
        "order_key", F.col("creation_account").alias("account"), F.col("created_at").alias("timestamp"))
    return quality.enrich_creation_time(t.executions(spark, d), single).select(
        "order_key", "execution_index", "block_date", "order_created_at", "account_mismatch")


# Days on which something was shipped, against the days from the first order to the last one.
@query("date_coverage_diff", """WITH found AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
want AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(o_orderdate)), date_trunc('day', max(o_orderdate)), INTERVAL '1 day')) AS DATE) AS day FROM orders)
SELECT day, 'missing' AS problem FROM want WHERE day NOT IN (SELECT day FROM found)
UNION ALL SELECT day, 'unexpected' FROM found WHERE day NOT IN (SELECT day FROM want)""")
def _coverage(spark, d):
    shipped = t.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return quality.date_coverage_diff(shipped, m.date_grid(t.table(spark, d, "orders"), "o_orderdate"))
