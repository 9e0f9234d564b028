"""Gates, reconciliation and reward ledgers."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recohort.contracts import AUDIT_FIELDS, DAILY_FIELDS, EVENT_FIELDS, MUST_BE_ZERO
from recohort.operators import cohort as co, gates, matching as m, quality, reconcile as rc, rewards as rw
from recohort.session import pin
from recohort.sources import rewards as sr
from recohort.suite import audit as au, tables as t
from recohort.suite.ingest import event_text_rows
from recohort.suite.registry import query, rounded

# Each rule is broken by the orders whose key has the given remainder.
_BREAKS = {
    "unexpected chain": ("chain_id", 101, "'1'"), "invalid log index": ("log_index", 103, "'-1'"),
    "invalid account": ("account", 107, "'0x0000000000000000000000000000000000000000'"),
    "invalid transaction hash": ("tx_hash", 109, "'0xzz'"), "invalid order key": ("order_key", 113, "'key'"),
    "invalid market": ("market", 127, "'0x1'"), "unknown action": ("action", 131, "'open'"),
    "unknown success value": ("success", 137, "'yes'"), "size is not finite and non-negative": ("size_delta_usd", 139, "'NaN'"),
    "fee is not finite and non-negative": ("position_fee_usd", 149, "'-1'"),
    "time has no zone or is invalid": ("timestamp", 151, "'1997-01-01T00:00:00'"),
    "creation follows execution": ("order_created_at", 157, "'2009-01-01T00:00:00Z'"),
    "malformed row": ("market", 163, "CAST(NULL AS STRING)"),
}
_LATE = datetime(2001, 7, 1)


def _broken_rows(spark, d):
    rows = event_text_rows(spark, d).withColumn("k", F.regexp_extract("order_key", "^0x0*([0-9]+)$", 1).cast("bigint"))
    rows = rows.withColumns({name: F.nullif(F.col(name), F.lit("")) for name in ("position_fee_usd", "order_created_at")})
    for column, modulus, value in _BREAKS.values():
        rows = rows.withColumn(column, F.when(F.col("k") % modulus == 7, F.expr(value)).otherwise(F.col(column)))
    return rows


def _rows_sql() -> str:
    parts = [f"SELECT '{rule}' AS rule, o_orderkey AS k FROM orders WHERE o_orderkey % {m} = 7" for rule, (_, m, _) in _BREAKS.items()
             if rule not in ("invalid market", "creation follows execution")]
    parts.append("SELECT 'invalid market', o_orderkey FROM orders WHERE o_orderkey % 127 = 7 OR o_orderkey % 163 = 7")
    parts.append("SELECT 'creation follows execution', o_orderkey FROM orders WHERE o_orderkey % 157 = 7 AND o_orderkey % 151 <> 7")
    parts.append(f"SELECT 'event outside coverage', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{_LATE}' AND o_orderkey % 151 <> 7")
    return f"WITH v AS ({' UNION ALL '.join(parts)}) SELECT rule, count(*) AS rows FROM v GROUP BY 1"


@query("validate_rows", _rows_sql())
def _rows(spark, d):
    found = gates.validate_rows(_broken_rows(spark, d), 42161, t.ORDER_COVERAGE[0], _LATE)
    return found.groupBy("rule").agg(F.count("*").alias("rows"))


@query("validate_coverage", f"""WITH {t.EVENT_TRADES_SQL}
SELECT 'event outside coverage' AS rule, tx_hash, CAST(log_index AS BIGINT) AS log_index, ts AS "timestamp" FROM trades
WHERE ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-28 06:00:00'""")
def _coverage(spark, d):
    return gates.validate_coverage(t.event_trades(spark, d), datetime(2024, 1, 3), datetime(2024, 1, 28, 6))


@query("validate_unique_events", """SELECT 1::BIGINT AS chain_id, CAST(l_orderkey AS VARCHAR) AS tx_hash, l_linenumber::BIGINT AS log_index, count(*) AS copies
FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _unique(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.lit(1).alias("chain_id"), F.col("l_orderkey").alias("tx_hash"), F.col("l_linenumber").alias("log_index"))
    return gates.validate_unique_events(rows)


@query("validate_manifest", """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS path, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders GROUP BY 1, 2, 3)
SELECT path, 'row count differs' AS rule FROM o WHERE m = 3 UNION ALL SELECT path, 'checksum differs' FROM o WHERE m = 4
UNION ALL SELECT path, 'incomplete extraction' FROM o WHERE m = 5 UNION ALL SELECT path, 'unsupported schema version' FROM o WHERE m = 6
UNION ALL SELECT path, 'synthetic flag missing' FROM o WHERE m = 7 UNION ALL SELECT path, 'invalid coverage interval' FROM o WHERE m = 8
UNION ALL SELECT path, 'missing required columns' FROM o WHERE m = 9""")
def _manifest(spark, d):
    month = F.month("start")
    seen = t.table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("start")).agg(
        F.count("*").alias("row_count"), F.sum("o_orderkey").alias("s")).select(
        F.date_format("start", "yyyy-MM").alias("path"), "start", "row_count", F.sha2(F.col("s").cast("string"), 256).alias("sha256"))
    fields = F.array(*[F.lit(n) for n in EVENT_FIELDS])
    observed = seen.select("path", "row_count", "sha256", F.when(month == 9, F.slice(fields, 1, 5)).otherwise(fields).alias("columns"))
    declared = seen.select(
        "path", F.when(month == 6, 2).otherwise(1).alias("schema_version"), (month != 5).alias("complete"),
        F.when(month != 7, False).alias("is_synthetic"), F.col("start").alias("coverage_start"),
        (F.col("start") + F.make_dt_interval(days=F.when(month == 8, 0).otherwise(7))).alias("coverage_end"),
        (F.col("row_count") + F.when(month == 3, 1).otherwise(0)).alias("row_count"),
        F.when(month == 4, "x").otherwise(F.col("sha256")).alias("sha256"))
    return gates.validate_manifest(declared, observed)


# Reconciliation of the daily audit with an altered copy, and of metrics with a recount.

_EXPORT_CHANGE = {"rows": 5, "increase": 7, "zero_size": 11}


def _altered(rows):
    day = F.dayofmonth("day")
    return rows.withColumns({n: F.col(n) + F.when(day == k, 1).otherwise(0) for n, k in _EXPORT_CHANGE.items()})


@query("reconcile_daily", au._DENSE_SQL + " " + " UNION ALL ".join(
    f"""SELECT day, '{n}' AS field, CAST(coalesce("{n}", 0) + 1 AS BIGINT) AS exported, CAST(coalesce("{n}", 0) AS BIGINT) AS "local" FROM wide WHERE day(day) = {k}"""
    for n, k in _EXPORT_CHANGE.items()))
def _daily(spark, d):
    local = pin(au._dense(spark, d), "daily-audit")
    return rc.reconcile_daily(_altered(local), local)


_ID_SQL = ", dense AS (SELECT day, " + ", ".join(f'CAST(coalesce("{n}", 0) AS BIGINT) AS "{n}"' for n in (*DAILY_FIELDS, *AUDIT_FIELDS)) + " FROM wide)"


@query("daily_grain_identities", au._DENSE_SQL + _ID_SQL + """
SELECT day, 'invalid_daily_counts' AS reason, NULL::VARCHAR AS field, NULL::BIGINT AS "count" FROM dense
WHERE accounts > "rows" OR increase + decrease + liquidation + collateral <> "rows" OR zero_size > "rows"
UNION ALL SELECT day, 'invalid_source_grain', NULL, NULL FROM dense WHERE position_rows <> "rows" OR execution_rows <> "rows" + out_of_scope_execution_rows
""" + " ".join(f"UNION ALL SELECT day, 'source_quality_failure', '{n}', {n} FROM dense WHERE {n} <> 0" for n in MUST_BE_ZERO))
def _identities(spark, d):
    return rc.daily_grain_identities(au._dense(spark, d))


def _local_metrics(spark, d):
    """Recount from position events alone, so that it can disagree with the matched metrics."""
    trades = t.positions(spark, d).filter("source_action = 'increase'").select(
        "account", F.col("block_time").alias("timestamp"), F.lit("increase").alias("action"), F.lit(True).alias("success"), "size_delta_usd",
        F.col("block_time").alias("order_created_at"))
    return co.retention_summary(co.retention_profile(trades, au.LINE_CAMPAIGN))


def _local_sql() -> str:
    c = au.LINE_CAMPAIGN
    late, anywhere, second = (t.inside_sql("block_time", *c.window(o)) for o in (c.late, c.any_time, c.second))
    return f""", mine AS (SELECT account, bool_or({late}) AS r30, bool_or({anywhere}) AS cumulative30,
  count(DISTINCT CASE WHEN {late} THEN block_date END) >= 2 AS sustained30, bool_or({late}) AS strict_r30, bool_or({second}) AS r60
  FROM positions WHERE source_action = 'increase' AND size > 0 GROUP BY account HAVING bool_or({t.inside_sql('block_time', c.start, c.end)})),
local AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(CASE WHEN {n} THEN 1 END) AS n, count(*) AS size FROM mine"
                                   for n in ("r30", "cumulative30", "sustained30", "strict_r30", "r60")) + """),
theirs AS (SELECT metric, numerator, denominator, numerator::DOUBLE / nullif(denominator, 0) AS rate, strict_unknown_events FROM long),
spread AS (SELECT min(denominator) <> max(denominator) AS dd FROM theirs),
compared AS (SELECT x.metric, x.numerator AS n, x.denominator AS cohort_size,
  CASE WHEN x.metric = 'strict_r30' AND strict_unknown_events > 0 THEN 'withheld' WHEN x.numerator = l.n AND x.denominator = l.size THEN 'agreement' ELSE 'difference' END AS status,
  x.denominator <> l.size OR (NOT (x.metric = 'strict_r30' AND strict_unknown_events > 0) AND (x.numerator <> l.n)) AS differs,
  CASE WHEN x.metric = 'strict_r30' AND strict_unknown_events > 0 THEN 'strict_creation_unknown' ELSE '' END AS issues
  FROM theirs x JOIN local l ON l.metric = x.metric)"""


_METRICS_SQL = au._matched_retention_sql().rsplit("SELECT metric, numerator", 1)[0].rstrip() + _local_sql()


@query("reconcile_metrics", _METRICS_SQL + " SELECT * FROM compared")
def _metrics(spark, d):
    out = rc.reconcile_metrics(au.matched_metrics(spark, d), _local_metrics(spark, d))
    return out.withColumn("issues", F.array_join("issues", ","))


# What else the comparison found, one kind of fault at a time; each kind meets days that have it.
_STATUS_CASES = ("metrics_only", "daily_differences", "daily_issues", "coverage_issues")


@query("reconcile_status", au._DENSE_SQL + _ID_SQL + _METRICS_SQL[len(t.MATCH_SQL):] + f""",
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
ordered AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(o_orderdate)), date_trunc('day', max(o_orderdate)), INTERVAL '1 day')) AS DATE) AS day FROM orders),
found AS (SELECT {' + '.join(f"count(CASE WHEN day(day) = {k} THEN 1 END)" for k in _EXPORT_CHANGE.values())} AS differences FROM dense),
broken AS (SELECT count(CASE WHEN accounts > "rows" OR increase + decrease + liquidation + collateral <> "rows" OR zero_size > "rows" THEN 1 END)
  + count(CASE WHEN position_rows <> "rows" OR execution_rows <> "rows" + out_of_scope_execution_rows THEN 1 END)
  + {' + '.join(f'count(CASE WHEN {n} <> 0 THEN 1 END)' for n in MUST_BE_ZERO)} AS issues FROM dense),
gaps AS (SELECT (SELECT count(*) FROM ordered WHERE day NOT IN (SELECT day FROM days)) + (SELECT count(*) FROM days WHERE day NOT IN (SELECT day FROM ordered)) AS n),
cases(kind, daily, other) AS (SELECT 'metrics_only', 0, 0 UNION ALL SELECT 'daily_differences', differences, 0 FROM found
  UNION ALL SELECT 'daily_issues', 0, issues FROM broken UNION ALL SELECT 'coverage_issues', 0, n FROM gaps),
m AS (SELECT count(CASE WHEN issues <> '' THEN 1 END) AS issues, count(CASE WHEN issues NOT IN ('', 'strict_creation_unknown') THEN 1 END) AS hard,
  count(CASE WHEN differs THEN 1 END) AS differences, count(CASE WHEN differs AND metric <> 'strict_r30' THEN 1 END) AS open_differences FROM compared)
SELECT kind AS "case", daily AS daily_differences, other AS other_issues,
  CASE WHEN issues + other > 0 THEN 'invalid_or_incomplete' WHEN differences + daily > 0 THEN 'differences' ELSE 'agreement' END AS comparison_status,
  CASE WHEN hard + other > 0 THEN 'invalid_or_incomplete' WHEN open_differences + daily > 0 THEN 'differences' ELSE 'agreement' END AS opening_retention_status,
  FALSE AS validated, FALSE AS opening_retention_validated FROM cases, m""")
def _status(spark, d):
    """The verdict on the metrics alone, and beside each other kind of finding."""
    metrics = pin(rc.reconcile_metrics(au.matched_metrics(spark, d), _local_metrics(spark, d)), "metrics")
    local = pin(au._dense(spark, d), "daily-audit")
    differences, issues = pin(rc.reconcile_daily(_altered(local), local), "differences"), pin(rc.daily_grain_identities(local), "issues")
    gaps = pin(quality.date_coverage_diff(t.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")),
                                          m.date_grid(t.table(spark, d, "orders"), "o_orderdate")), "gaps")

    def case(name):
        parts = [rows if name == kind else rows.limit(0) for kind, rows in zip(_STATUS_CASES[1:], (differences, issues, gaps), strict=True)]
        counts = [rows.agg(F.count("*")).scalar() for rows in parts]
        return rc.reconcile_status(metrics, *parts, synthetic=True).withColumns(
            {"case": F.lit(name), "daily_differences": counts[0], "other_issues": counts[1] + counts[2]})

    return reduce(DataFrame.unionByName, [case(name) for name in _STATUS_CASES])


_COPY_SQL = """WITH o AS (SELECT * FROM orders),
c AS (SELECT o_orderkey, o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 1e-13 ELSE 0 END) + CASE WHEN o_orderkey % 100 = 1 THEN 1 ELSE 0 END AS price,
  CASE WHEN o_orderkey % 70 = 2 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 90 <> 3)"""


@query("compare_tables", _COPY_SQL + """
SELECT o_orderkey, 'o_totalprice' AS field,
  CASE WHEN o.o_totalprice <> c.price AND abs(o.o_totalprice - c.price) <= 1e-12 * greatest(o.o_totalprice, c.price) THEN 'drift' ELSE 'difference' END AS kind
FROM o JOIN c USING (o_orderkey) WHERE o.o_totalprice <> c.price
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'difference' FROM o JOIN c USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM c.status
UNION ALL SELECT o_orderkey, 'row', 'missing_from_right' FROM o WHERE o_orderkey % 90 = 3""")
def _tables(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    left = t.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    right = left.filter(key % 90 != 3).withColumns({
        "o_totalprice": price * (1 + F.when(key % 50 == 0, 1e-13).otherwise(0.0)) + F.when(key % 100 == 1, 1).otherwise(0),
        "o_orderstatus": F.when(key % 70 != 2, F.col("o_orderstatus"))})
    changes = rc.compare_tables(left, right, ["o_orderkey"], tolerance=1e-12, numeric=("o_totalprice",))
    return changes.select("o_orderkey", "field", "kind")


@query("compare_results", """SELECT o_custkey AS k, '$.n' AS path, CAST(count(*) AS VARCHAR) AS left_value, CAST(count(*) + 1 AS VARCHAR) AS right_value, 'difference' AS kind
FROM orders WHERE o_custkey % 10 = 1 GROUP BY 1
UNION ALL SELECT o_custkey, '$.span[1]', CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR), NULL, 'missing_from_right' FROM orders WHERE o_custkey % 10 = 2 GROUP BY 1""")
def _results(spark, d):
    grouped = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))

    def nested(n, span):
        return F.struct(n.alias("n"), span.alias("span"), F.struct(F.col("a").alias("first")).alias("inner")).alias("result")

    left = grouped.select("k", nested(F.col("n"), F.array("a", "b")))
    right = grouped.select("k", nested(F.when(F.col("k") % 10 == 1, F.col("n") + 1).otherwise(F.col("n")),
                                       F.when(F.col("k") % 10 == 2, F.array("a")).otherwise(F.array("a", "b"))))
    return rc.compare_results(left, right, "k", "result")


def _ingested(spark, d):
    """Allocations and overrides of documents that are parsed and written once."""
    documents = pin(sr.distribution_documents(t.distribution_texts(spark, d)), "documents")
    return sr.ingest_reward_files(documents), sr.ingest_override_maps(documents)


def _ledger(spark, d):
    return rw.reward_ledger(*_ingested(spark, d), t.TOKEN)


@query("reward_ledger", t.REWARD_SQL + f"""
SELECT file, epoch_start, recipient, '{t.TOKEN}' AS token, amount_raw, amount_units,
  CASE WHEN k % 3 = 2 THEN 'unrecorded' WHEN k % 3 = 0 AND recipient = (SELECT main FROM files f WHERE f.k = u.k) THEN 'recorded_destination' ELSE 'not_in_recorded_overrides' END AS override_evidence
FROM units u""")
def _reward_ledger(spark, d):
    return _ledger(spark, d)


_EPOCH_SQL = t.REWARD_SQL + f""", sums AS (
  SELECT epoch_start, count(DISTINCT recipient) AS recipient_count, CAST(sum(CAST(amount_raw AS HUGEINT)) AS VARCHAR) AS amount_raw,
         bool_or(k % 3 <> 2) AS overrides_recorded FROM allocations GROUP BY 1),
over AS (SELECT epoch_start, count(CASE WHEN k % 3 = 0 THEN 1 END) AS n FROM files GROUP BY 1)"""


@query("reward_epoch_summary", _EPOCH_SQL + f"""
SELECT s.epoch_start, strftime(CAST(s.epoch_start AS DATE) + 7, '%Y-%m-%d') AS epoch_end_exclusive, recipient_count, amount_raw,
  {t.units_sql('amount_raw')} AS amount_units, overrides_recorded, CASE WHEN overrides_recorded THEN n END AS recorded_override_count
FROM sums s JOIN over o ON o.epoch_start = s.epoch_start""")
def _epochs(spark, d):
    allocations, overrides = _ingested(spark, d)
    return rw.reward_epoch_summary(rw.reward_ledger(allocations, overrides, t.TOKEN), overrides)


@query("reward_report_reconcile", t.REWARD_SQL + f""", s AS (
  SELECT count(*) AS recipient_epoch_rows, count(DISTINCT recipient) AS unique_recipients, sum(CAST(amount_raw AS HUGEINT)) AS total FROM allocations),
g AS (SELECT *, total - CAST('70000000000000000000000' AS HUGEINT) AS gap FROM s)
SELECT recipient_epoch_rows, unique_recipients, CAST(total AS VARCHAR) AS total_amount_raw, {t.units_sql('CAST(total AS VARCHAR)')} AS total_amount_units,
  '70000.00' AS published, CASE WHEN gap < 0 THEN '-' ELSE '' END || {t.units_sql('CAST(abs(gap) AS VARCHAR)')} AS exact_minus_published FROM g""")
def _report(spark, d):
    totals = rw.reward_totals(_ledger(spark, d)).withColumn("published", F.lit("70000.00"))
    return rw.reward_report_reconcile(totals, "total_amount_raw", "published")


@query("validate_rewards", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS file,
  '0x' || lpad(CAST(o_custkey + 1 AS VARCHAR), 40, '0') AS main, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS raw FROM orders)
SELECT file, 'invalid amount' AS rule, main AS detail FROM o WHERE k % 40 = 1
UNION ALL SELECT file, 'invalid recipient', '0x0000000000000000000000000000000000000000' FROM o WHERE k % 40 = 2
UNION ALL SELECT file, 'absent override recipient', main FROM o WHERE k % 40 = 2 AND k % 3 = 0
UNION ALL SELECT file, 'repeated recipient', main FROM o WHERE k % 40 = 3
UNION ALL SELECT file, 'allocation sum differs from batch total', CAST(CAST(raw AS HUGEINT) + k + CASE WHEN k % 40 = 3 THEN CAST(raw AS HUGEINT) ELSE 0 END AS VARCHAR) FROM o WHERE k % 40 IN (3, 4)""")
def _validate(spark, d):
    allocations, overrides = _ingested(spark, d)
    rows = allocations.withColumn("k", F.col("file").cast("bigint"))
    main = F.length("amount_raw") > 16
    rows = rows.withColumns({
        "amount_kind": F.when(main & (F.col("k") % 40 == 1), "BIGINT").otherwise(F.col("amount_kind")),
        "recipient": F.when(main & (F.col("k") % 40 == 2), "0x" + "0" * 40).otherwise(F.col("recipient"))})
    again = rows.filter(main & (F.col("k") % 40 == 3)).withColumn("recipient", F.concat(F.lit("0x"), F.upper(F.substring("recipient", 3, 40))))
    batches = t.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("file"),
        (t._raw_amount().cast("decimal(38,0)") + F.col("o_orderkey") + F.when(F.col("o_orderkey") % 40 == 4, 1).otherwise(0)).cast("string").alias("total_raw"))
    return rw.validate_rewards(rows.unionByName(again), batches, overrides)
