"""How the given tables stand in for executions, decoded events, pages and reward files.

Each binding has a Spark form and the same expression as a SQL common table expression.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from recohort.contracts import Campaign, landmarks

ORDER_CAMPAIGN = Campaign(datetime(1997, 1, 1, 0, 0, 1), datetime(1998, 1, 1))
ORDER_COVERAGE = (datetime(1995, 1, 1), datetime(2001, 8, 2))
EVENT_CAMPAIGN = Campaign(datetime(2024, 1, 1), datetime(2024, 1, 15, 12), late=(7, 9), any_time=(0, 10), second=(12, 14))
EVENT_COVERAGE = (datetime(2024, 1, 1), datetime(2024, 1, 31))

STUDY_START = datetime(1996, 1, 1)
STUDY_MARKS = landmarks(STUDY_START, datetime(1999, 1, 1),
                        [datetime(1996, 7, 1), datetime(1997, 1, 1), datetime(1997, 7, 1)],
                        datetime(1998, 1, 1), datetime(1999, 1, 1))
EVENT_START = datetime(2024, 1, 3)
EVENT_MARKS = landmarks(EVENT_START, datetime(2024, 1, 24), [datetime(2024, 1, 8)], datetime(2024, 1, 16),
                        datetime(2024, 1, 24), label_offset=(3, 5))
EMITTER = "ab" * 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(rows: DataFrame, most: int) -> int:
    """Into how many parts a given table is dealt so that a part has about ``most`` rows, whatever their number."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def dealt(rows: DataFrame, source: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Rows of a large given table by key, in parts of about ``most`` rows; those of a small one stay as they are read.

    A file is read in about as many parts as there are cores, so what a part holds would grow with the file.
    """
    count = parts(source, most)
    return rows.repartition(count, key) if count > rows.sparkSession.sparkContext.defaultParallelism else rows


def order_trades(spark: SparkSession, folder: str, unknown_every: int = 997) -> DataFrame:
    key = F.col("o_orderkey")
    known = key % unknown_every != 0
    size = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, folder, "orders").select(
        F.lit(1).alias("chain_id"), key.alias("tx_hash"), (key % 3).cast("int").alias("log_index"),
        F.col("o_custkey").alias("account"), key.alias("order_key"), F.col("o_orderpriority").alias("market"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "O", "decrease").otherwise("increase").alias("action"),
        F.lit(True).alias("success"), size.alias("size_delta_usd"),
        F.when(known, size.cast("decimal(38,12)")).alias("position_fee_usd"),
        F.when(known, F.col("o_orderdate") - F.make_dt_interval(days=(key % 60).cast("int"))).alias("order_created_at"))


def order_trades_sql(unknown_every: int = 997) -> str:
    return f"""trades AS (
  SELECT o_orderkey AS tx_hash, CAST(o_orderkey % 3 AS INTEGER) AS log_index, o_custkey AS account,
         o_orderkey AS order_key, o_orderpriority AS market, o_orderdate AS ts,
         CASE WHEN o_orderstatus = 'O' THEN 'decrease' ELSE 'increase' END AS action, TRUE AS success,
         CAST(o_totalprice AS DECIMAL(18,2)) AS size,
         CASE WHEN o_orderkey % {unknown_every} <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS fee,
         CASE WHEN o_orderkey % {unknown_every} <> 0
              THEN o_orderdate - to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS created
  FROM orders)"""


def event_trades(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    kind = F.col("event_type")
    size = F.when(kind == "signup", F.lit(0).cast("decimal(18,2)")).otherwise(F.col("value").cast("decimal(18,2)"))
    return table(spark, folder, "events").select(
        F.lit(1).alias("chain_id"), key.alias("tx_hash"), (key % 5).cast("int").alias("log_index"),
        F.col("user_id").alias("account"), key.alias("order_key"), (F.col("user_id") % 7 + key % 4).cast("string").alias("market"),
        F.col("ts").alias("timestamp"),
        F.when(kind.isin("purchase", "view"), "increase").when(kind == "click", "decrease")
        .when(kind == "error", "liquidation").otherwise("collateral").alias("action"),
        (key % 50 != 0).alias("success"), size.alias("size_delta_usd"),
        F.when(key % 97 != 0, size.cast("decimal(38,12)")).alias("position_fee_usd"),
        F.when(key % 89 != 0, F.col("ts") - F.make_dt_interval(hours=(key % 72).cast("int"))).alias("order_created_at"))


EVENT_TRADES_SQL = """trades AS (
  SELECT event_id AS tx_hash, CAST(event_id % 5 AS INTEGER) AS log_index, user_id AS account, event_id AS order_key,
         CAST(user_id % 7 + event_id % 4 AS VARCHAR) AS market, ts,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'increase' WHEN event_type = 'click' THEN 'decrease'
              WHEN event_type = 'error' THEN 'liquidation' ELSE 'collateral' END AS action,
         event_id % 50 <> 0 AS success,
         CASE WHEN event_type = 'signup' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS size,
         CASE WHEN event_id % 97 <> 0 THEN CASE WHEN event_type = 'signup' THEN CAST(0 AS DECIMAL(18,2))
              ELSE CAST(value AS DECIMAL(18,2)) END END AS fee,
         CASE WHEN event_id % 89 <> 0 THEN ts - to_hours(CAST(event_id % 72 AS INTEGER)) END AS created
  FROM events)"""

FLAGS_SQL = """flagged AS (
  SELECT *, success AND action = 'increase' AND size > 0 AS opened,
         success AND action IN ('increase', 'decrease') AND size > 0 AS took_part
  FROM trades)"""


def _sql_time(value: datetime) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def inside_sql(column: str, low: datetime, high: datetime) -> str:
    return f"({column} >= {_sql_time(low)} AND {column} < {_sql_time(high)})"


def profile_sql(campaign: Campaign) -> str:
    """The account profile of a campaign, from ``flagged``."""
    late, anywhere, second = (inside_sql("ts", *campaign.window(o))
                              for o in (campaign.late, campaign.any_time, campaign.second))
    entering = inside_sql("ts", campaign.start, campaign.end)
    return f"""profile AS (
  SELECT account,
         min(CASE WHEN opened AND {entering} THEN ts END) AS first_qualifying,
         CAST(sum(CASE WHEN opened AND {entering} THEN size END) AS DOUBLE) AS campaign_volume_usd,
         min(ts) AS first_trade,
         CAST(date_trunc('week', min(CASE WHEN opened AND {entering} THEN ts END)) AS DATE) AS entry_week,
         bool_or(opened AND {late}) AS r30,
         bool_or(opened AND {anywhere}) AS cumulative30,
         count(DISTINCT CASE WHEN opened AND {late} THEN CAST(ts AS DATE) END) >= 2 AS sustained30,
         bool_or({late}) AS open_or_decrease30,
         bool_or({late}) AS voluntary30,
         bool_or(opened AND {late} AND coalesce(created >= {_sql_time(campaign.end)}, FALSE)) AS strict_r30,
         CAST(sum(CASE WHEN opened AND {late} AND created IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS strict_missing,
         bool_or(opened AND {second}) AS r60
  FROM flagged WHERE took_part GROUP BY account
  HAVING min(CASE WHEN opened AND {entering} THEN ts END) IS NOT NULL)"""


def campaign_sql(campaign: Campaign, trades_sql: str) -> str:
    return f"WITH {trades_sql}, {FLAGS_SQL}, {profile_sql(campaign)}"


ORDER_CASE_SQL = campaign_sql(ORDER_CAMPAIGN, order_trades_sql())
EVENT_CASE_SQL = campaign_sql(EVENT_CAMPAIGN, EVENT_TRADES_SQL)


def marks_sql(marks, start: datetime, trades_sql: str) -> str:
    rows = ", ".join(f"({_sql_time(m.as_of)}, '{m.split}', {_sql_time(m.label_start)}, {_sql_time(m.label_end)})" for m in marks)
    return f"""WITH {trades_sql},
openings AS (SELECT account, market, ts, size, fee FROM trades WHERE success AND action = 'increase' AND size > 0),
marks(as_of, split, label_start, label_end) AS (VALUES {rows}),
members AS (SELECT DISTINCT m.as_of, m.split, m.label_start, m.label_end, o.account FROM marks m
            JOIN openings o ON o.ts >= {_sql_time(start)} AND o.ts < m.as_of)"""


STUDY_SQL = marks_sql(STUDY_MARKS, STUDY_START, order_trades_sql())
EVENT_STUDY_SQL = marks_sql(EVENT_MARKS, EVENT_START, EVENT_TRADES_SQL)


def samples_sql(start: datetime) -> str:
    """All features per member, from ``members`` and ``openings``."""
    windows = []
    for d in (7, 30, 60):
        near = f"o.ts >= m.as_of - INTERVAL '{d} days'"
        windows.append(f"""
         CAST(count(CASE WHEN {near} THEN 1 END) AS DOUBLE) AS opening_count_{d}d,
         CAST(count(DISTINCT CASE WHEN {near} THEN CAST(o.ts AS DATE) END) AS DOUBLE) AS active_days_{d}d,
         CAST(coalesce(sum(CASE WHEN {near} THEN o.size END), 0) AS DOUBLE) AS opening_size_usd_{d}d,
         CAST(coalesce(sum(CASE WHEN {near} THEN o.fee END), 0) AS DOUBLE) AS opening_fee_usd_{d}d,""")
    return f"""past AS (
  SELECT m.as_of, m.split, m.account, {''.join(windows)}
         CAST(epoch_us(m.as_of) - epoch_us(min(o.ts)) AS DOUBLE) / 86400000000.0::DOUBLE AS days_since_first_observed_opening,
         CAST(epoch_us(m.as_of) - epoch_us(max(o.ts)) AS DOUBLE) / 86400000000.0::DOUBLE AS days_since_last_opening,
         CAST(CASE WHEN min(o.ts) < {_sql_time(start)} THEN 1 ELSE 0 END AS DOUBLE) AS pre_campaign_opening
  FROM members m JOIN openings o ON o.account = m.account AND o.ts < m.as_of GROUP BY m.as_of, m.split, m.account),
spread AS (
  SELECT as_of, account, CAST(count(*) AS DOUBLE) AS market_count_30d,
         round(CAST(max(v) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 9) AS top_market_share_30d
  FROM (SELECT m.as_of, m.account, o.market, sum(o.size) AS v FROM members m JOIN openings o
        ON o.account = m.account AND o.ts < m.as_of AND o.ts >= m.as_of - INTERVAL '30 days'
        GROUP BY m.as_of, m.account, o.market) GROUP BY as_of, account),
labelled AS (
  SELECT m.as_of, m.account, CAST(max(CASE WHEN o.account IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS label
  FROM members m LEFT JOIN openings o ON o.account = m.account AND o.ts >= m.label_start AND o.ts < m.label_end
  GROUP BY m.as_of, m.account),
samples AS (
  SELECT p.*, l.label, coalesce(s.market_count_30d, 0.0::DOUBLE) AS market_count_30d,
         coalesce(s.top_market_share_30d, 0.0::DOUBLE) AS top_market_share_30d
  FROM past p JOIN labelled l ON l.as_of = p.as_of AND l.account = p.account
  LEFT JOIN spread s ON s.as_of = p.as_of AND s.account = p.account)"""


# Matched events: every line with its order.

def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides are dealt into as many parts as the lines need, which later steps by order or match key keep.

    Merged, because a broadcast of all orders grows with the tables.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    count = line_parts(spark, folder)
    return lines.repartition(count, "l_orderkey").join(orders.repartition(count, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def line_parts(spark: SparkSession, folder: str) -> int:
    return parts(table(spark, folder, "lineitem"), 500_000)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    sold = F.col("l_returnflag") == "R"
    kind = F.when(part % 101 == 0, None).when(
        sold, F.element_at(F.array(*[F.lit(k) for k in (
            "MarketDecrease", "LimitDecrease", "StopLossDecrease", "Liquidation", "MarketIncrease")]), (part % 5 + 1).cast("int"))
    ).otherwise(F.element_at(F.array(*[F.lit(k) for k in (
        "LimitIncrease", "MarketIncrease", "MarketIncrease", "MarketIncrease", "MarketSwap")]), (part % 5 + 1).cast("int")))
    size = (F.when(supp % 41 == 0, F.lit(0).cast("decimal(18,2)")).when(supp % 43 == 0, F.lit(-1).cast("decimal(18,2)"))
            .when(supp % 47 == 0, None).otherwise(F.col("l_extendedprice").cast("decimal(18,2)")))
    return _lines(spark, folder).filter(F.col("l_orderkey") % 50 != 0).select(
        F.to_date("l_shipdate").alias("block_date"), F.col("l_shipdate").alias("block_time"),
        F.col("l_orderkey").alias("tx_hash"), F.col("l_linenumber").cast("bigint").alias("position_index"),
        F.when(part % 211 == 0, F.lit(0).cast("bigint")).otherwise(F.col("o_custkey")).alias("account"),
        F.col("l_orderkey").alias("order_key"), kind.alias("order_type"), size.alias("size_delta_usd"),
        F.when(sold, "decrease").otherwise("increase").alias("source_action"))


def executions(spark: SparkSession, folder: str) -> DataFrame:
    second = F.when(F.col("l_suppkey") % 10 == 0, 1).when(F.col("l_suppkey") % 10 == 1, None).otherwise(0)
    return _lines(spark, folder).filter(F.col("l_orderkey") % 40 != 0).select(
        F.to_date("l_shipdate").alias("block_date"), F.col("l_shipdate").alias("block_time"),
        F.col("l_orderkey").alias("tx_hash"), (F.col("l_linenumber") + 100).cast("bigint").alias("execution_index"),
        F.col("l_orderkey").alias("order_key"), F.col("o_custkey").alias("account"), second.cast("int").alias("secondary_order_type"))


def creations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    copies = F.when(key % 19 == 0, 0).when(key % 23 == 0, 2).otherwise(1)
    kinds = F.array(*[F.lit(k) for k in ("MarketIncrease", "LimitDecrease", "MarketSwap", "LimitSwap", "Deposit")])
    return table(spark, folder, "orders").withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(
        key.alias("order_key"),
        F.when(key % 17 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("account"),
        F.col("o_orderdate").alias("block_time"), F.element_at(kinds, (key % 5 + 1).cast("int")).alias("order_type"))


MATCH_SQL = """WITH lines AS (
  SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
positions AS (
  SELECT CAST(l_shipdate AS DATE) AS block_date, l_shipdate AS block_time, l_orderkey AS tx_hash,
         CAST(l_linenumber AS BIGINT) AS position_index,
         CASE WHEN l_partkey % 211 = 0 THEN 0 ELSE o_custkey END AS account, l_orderkey AS order_key,
         CASE WHEN l_partkey % 101 = 0 THEN NULL
              WHEN l_returnflag = 'R' THEN list_extract(['MarketDecrease', 'LimitDecrease', 'StopLossDecrease', 'Liquidation', 'MarketIncrease'], l_partkey % 5 + 1)
              ELSE list_extract(['LimitIncrease', 'MarketIncrease', 'MarketIncrease', 'MarketIncrease', 'MarketSwap'], l_partkey % 5 + 1) END AS order_type,
         CASE WHEN l_suppkey % 41 = 0 THEN 0 WHEN l_suppkey % 43 = 0 THEN -1 WHEN l_suppkey % 47 = 0 THEN NULL
              ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS size,
         CASE WHEN l_returnflag = 'R' THEN 'decrease' ELSE 'increase' END AS source_action
  FROM lines WHERE l_orderkey % 50 <> 0),
executions AS (
  SELECT CAST(l_shipdate AS DATE) AS block_date, l_shipdate AS block_time, l_orderkey AS tx_hash,
         CAST(l_linenumber + 100 AS BIGINT) AS execution_index, l_orderkey AS order_key, o_custkey AS account,
         CASE WHEN l_suppkey % 10 = 0 THEN 1 WHEN l_suppkey % 10 = 1 THEN NULL ELSE 0 END AS secondary_order_type
  FROM lines WHERE l_orderkey % 40 <> 0),
creations AS (
  SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS account,
         o_orderdate AS block_time,
         list_extract(['MarketIncrease', 'LimitDecrease', 'MarketSwap', 'LimitSwap', 'Deposit'], o_orderkey % 5 + 1) AS order_type
  FROM orders, range(CASE WHEN o_orderkey % 19 = 0 THEN 0 WHEN o_orderkey % 23 = 0 THEN 2 ELSE 1 END)),
made AS (
  SELECT order_key, min(account) AS creation_account, min(block_time) AS created_at, count(*) AS creation_rows,
         max(order_type) AS created_order_type
  FROM creations WHERE order_key IN (SELECT order_key FROM executions) GROUP BY order_key),
joined AS (
  SELECT coalesce(p.block_date, e.block_date) AS block_date, coalesce(p.tx_hash, e.tx_hash) AS tx_hash,
         coalesce(p.order_key, e.order_key) AS order_key, coalesce(p.account, e.account) AS account,
         coalesce(p.block_time, e.block_time) AS block_time, p.order_type, p.source_action, p.size,
         e.secondary_order_type, p.position_index IS NOT NULL AS has_position,
         e.execution_index IS NOT NULL AS has_execution
  FROM positions p FULL OUTER JOIN executions e
    ON p.block_date = e.block_date AND p.tx_hash = e.tx_hash AND p.order_key = e.order_key AND p.account = e.account),
full_rows AS (
  SELECT j.*, m.creation_account, m.created_at, m.creation_rows, m.created_order_type,
         has_position AND has_execution AND (
           (source_action = 'increase' AND order_type IN ('MarketIncrease', 'LimitIncrease'))
           OR (source_action = 'decrease' AND order_type IN ('MarketDecrease', 'LimitDecrease', 'StopLossDecrease', 'Liquidation'))) AS fits
  FROM joined j LEFT JOIN made m ON m.order_key = j.order_key)"""


# Reward files: one small distribution per order.

TOKEN = "0x" + "7" * 40
REWARD_TYPE = 1003


def _address(number):
    return F.concat(F.lit("0x"), F.lpad((number + 1).cast("string"), 40, "0"))


def _raw_amount():
    """Cents, padded to 24 digits or more and unlike any rounding."""
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    return F.concat(cents.cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0"))


def distribution_texts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    epoch = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd")
    main, other = _address(F.col("o_custkey")), _address(F.col("o_custkey") + 5_000_000)
    amounts = F.create_map(main, _raw_amount(), other, key.cast("string"))
    overrides = F.when(key % 3 == 0, F.create_map(_address(F.col("o_custkey") + 9_000_000), main)).when(
        key % 3 == 1, F.create_map().cast("map<string,string>"))
    body = F.struct(F.lit(TOKEN).alias("token"), F.lit(REWARD_TYPE).alias("distributionTypeId"),
                    F.concat(epoch, F.lit(f"_{REWARD_TYPE}")).alias("id"), amounts.alias("amounts"),
                    overrides.alias("appliedOverrides"))
    return table(spark, folder, "orders").select(key.cast("string").alias("file"), epoch.alias("epoch_start"),
                                                 F.to_json(body).alias("text"))


REWARD_SQL = """WITH files AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS file, o_orderkey AS k,
         strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS epoch_start,
         '0x' || lpad(CAST(o_custkey + 1 AS VARCHAR), 40, '0') AS main,
         '0x' || lpad(CAST(o_custkey + 5000001 AS VARCHAR), 40, '0') AS other,
         '0x' || lpad(CAST(o_custkey + 9000001 AS VARCHAR), 40, '0') AS origin,
         CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS raw
  FROM orders),
allocations AS (
  SELECT file, epoch_start, main AS recipient, raw AS amount_raw, k FROM files
  UNION ALL SELECT file, epoch_start, other, CAST(k AS VARCHAR), k FROM files),
units AS (
  SELECT *, CASE WHEN length(amount_raw) > 18 THEN left(amount_raw, length(amount_raw) - 18) ELSE '0' END || '.'
         || right(lpad(amount_raw, CAST(greatest(length(amount_raw), 18) AS INTEGER), '0'), 18) AS amount_units FROM allocations)"""


def units_sql(raw: str) -> str:
    """Eighteen-place text of a non-negative integer column given as text."""
    return (f"(CASE WHEN length({raw}) > 18 THEN left({raw}, length({raw}) - 18) ELSE '0' END || '.' || "
            f"right(lpad({raw}, CAST(greatest(length({raw}), 18) AS INTEGER), '0'), 18))")
