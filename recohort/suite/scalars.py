"""Scalar functions and exact arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from recohort.functions import exact, scalars as sc, times
from recohort.suite import tables as t
from recohort.suite.ingest import trim_sql
from recohort.suite.registry import query, rounded


def _raw_usd():
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").cast("string")
    return F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("0"), cents)).when(
        F.col("o_orderkey") % 9 == 1, F.lit("1.5")).otherwise(F.concat(cents, F.lpad((F.col("o_orderkey") * 10).cast("string"), 26, "0")))


_CENTS = "CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR)"


@query("scale_usd", f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN {_CENTS} WHEN o_orderkey % 9 = 1 THEN NULL
  ELSE {_CENTS} || lpad(CAST(o_orderkey * 10 AS VARCHAR), 26, '0') END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN raw IS NOT NULL THEN {trim_sql('raw')} END AS usd FROM r""")
def _usd(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", exact.scale_usd(_raw_usd()).alias("usd"))


@query("scale_token_units", f"""WITH r AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS neg,
  CASE WHEN o_orderkey % 5 = 0 THEN {_CENTS} ELSE {_CENTS} || lpad(CAST(o_orderkey AS VARCHAR), 31, '0') END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN neg THEN '-' ELSE '' END || {t.units_sql('raw')} AS units FROM r""")
def _units(spark, d):
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").cast("string")
    raw = F.when(F.col("o_orderkey") % 5 == 0, cents).otherwise(F.concat(cents, F.lpad(F.col("o_orderkey").cast("string"), 31, "0")))
    signed = F.concat(F.when(F.col("o_orderkey") % 2 == 1, "-").otherwise(""), raw)
    return t.table(spark, d, "orders").select("o_orderkey", exact.scale_token_units(signed).alias("units"))


_PRODUCT = "CAST((c - o_orderkey % 1000) * (o_orderkey + 1)::HUGEINT AS VARCHAR) || repeat('0', 24)"


@query("net_position_fee", f"""WITH r AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 1000 <= c AND o_orderkey % 17 <> 0 THEN {trim_sql(_PRODUCT)} END AS fee_usd,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 1000 > c THEN 'discount exceeds fee' WHEN o_orderkey % 17 = 0 THEN 'price is not positive' END AS fault FROM r""")
def _fee(spark, d):
    key = F.col("o_orderkey")
    fee = F.when(key % 11 != 0, (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").cast("string"))
    discount = (key % 1000).cast("string")
    price = F.when(key % 17 == 0, "0").otherwise(F.concat((key + 1).cast("string"), F.lit("0" * 24)))
    return t.table(spark, d, "orders").select("o_orderkey", fee.alias("f"), discount.alias("c"), price.alias("p")).select(
        "o_orderkey", exact.net_fee(F.col("f"), F.col("c"), F.col("p")).alias("fee_usd"),
        exact.fee_fault(F.col("f"), F.col("c"), F.col("p")).alias("fault"))


@query("utc_instant", """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN ts END AS instant, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM events""")
def _instant(spark, d):
    key, ts = F.col("event_id"), F.col("ts")
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = (F.when(key % 3 == 0, F.concat(F.date_format(ts, pattern), F.lit("Z")))
            .when(key % 3 == 1, F.concat(F.date_format(ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), pattern), F.lit("+05:30")))
            .otherwise(F.date_format(ts, pattern)))
    return t.table(spark, d, "events").select("event_id", times.utc_instant(text).alias("instant"), times.iso(ts).alias("text"))


@query("post_anchor", """WITH e AS (SELECT o_orderkey, o_orderdate + to_seconds(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 86400 END) AS ended FROM orders)
SELECT o_orderkey, CASE WHEN date_trunc('day', ended) = ended THEN ended ELSE date_trunc('day', ended) + INTERVAL '1 day' END AS anchor FROM e""")
def _anchor(spark, d):
    seconds = F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_orderkey") % 86400)
    ended = F.col("o_orderdate") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return t.table(spark, d, "orders").select("o_orderkey", times.post_anchor(ended).alias("anchor"))


@query("scalar_text", """SELECT page_id, lower(trim(' ' || url || ' ')) AS folded, regexp_extract(url, '[^/]*$') AS tail,
  regexp_replace(url, '/[^/]*$', '') AS head, lpad(CAST(page_id AS VARCHAR), 12, '0') AS padded,
  regexp_full_match('0x' || lpad(CAST(page_id AS VARCHAR), 40, '0'), '0x[0-9a-fA-F]{40}') AND page_id <> 0 AS is_address,
  FALSE AS is_hash FROM pages""")
def _text(spark, d):
    url = F.col("url")
    address = F.concat(F.lit("0x"), F.lpad(F.col("page_id").cast("string"), 40, "0"))
    return t.table(spark, d, "pages").select(
        "page_id", sc.fold(F.concat(F.lit(" "), url, F.lit(" "))).alias("folded"), sc.after_last(url, "/").alias("tail"),
        sc.before_last(url, "/").alias("head"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("padded"),
        sc.is_address(address).alias("is_address"), sc.is_hash(address).alias("is_hash"))


@query("scalar_time", """SELECT event_id, date_trunc('day', ts) AS day_start, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS day,
  ts + INTERVAL '23 days' AS later, CAST(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) AS DOUBLE) / 86400000000.0::DOUBLE AS days_to_end, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def _time(spark, d):
    ts = F.col("ts")
    end = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return t.table(spark, d, "events").select(
        "event_id", F.date_trunc("day", ts).cast("timestamp_ntz").alias("day_start"), times.entry_week(ts).alias("week"),
        F.to_date(ts).alias("day"), (ts + F.expr("INTERVAL '23' DAY")).alias("later"),
        times.fractional_days(end, ts).alias("days_to_end"), F.unix_seconds(ts.cast("timestamp")).alias("seconds"))


@query("scalar_math", """SELECT o_orderkey, CAST(ceil(o_totalprice * 0.01::DOUBLE) AS BIGINT) AS up, CAST(floor(o_totalprice) AS BIGINT) AS down,
  round(ln(1 + o_totalprice), 9) AS logged, round(sqrt(o_totalprice), 9) AS rooted,
  round(o_totalprice / nullif(CAST(o_orderkey % 10 AS DOUBLE), 0), 6) AS ratio, TRUE AS finite,
  abs(o_totalprice - (o_totalprice + o_orderkey % 3)) <= 0.00001 * (o_totalprice + o_orderkey % 3) AS near FROM orders""")
def _math(spark, d):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    out = t.table(spark, d, "orders").select(
        "o_orderkey", F.ceil(price * F.lit(0.01)).alias("up"), F.floor(price).alias("down"), F.log1p(price).alias("logged"),
        F.sqrt(price).alias("rooted"), sc.rate(price, key % 10).alias("ratio"), sc.is_finite(price).alias("finite"),
        sc.is_close(price, price + key % 3, 1e-5).alias("near"))
    return rounded(rounded(out, "logged", "rooted"), "ratio", digits=6)


@query("scalar_hash", """SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents""")
def _hash(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@query("scalar_null", f"""WITH {t.EVENT_TRADES_SQL}
SELECT action, count(CASE WHEN fee IS NULL THEN 1 END) AS unknown_fees, CAST(sum(coalesce(fee, 0)) AS DOUBLE) AS known_fees,
  count(CASE WHEN NOT coalesce(created >= TIMESTAMP '2024-01-15', FALSE) THEN 1 END) AS not_proven_late,
  count(CASE WHEN nullif(size, 0) IS NULL THEN 1 END) AS empty_size FROM trades GROUP BY 1""")
def _null(spark, d):
    late = F.col("order_created_at") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return t.event_trades(spark, d).groupBy("action").agg(
        F.count_if(F.col("position_fee_usd").isNull()).alias("unknown_fees"),
        F.sum(F.coalesce("position_fee_usd", F.lit(0))).alias("known_fees"),
        F.count_if(~F.coalesce(late, F.lit(False))).alias("not_proven_late"),
        F.count_if(F.nullif("size_delta_usd", F.lit(0)).isNull()).alias("empty_size"))


@query("json_map", """SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'BIGINT' AS kind FROM events""")
def _map(spark, d):
    entries = F.explode(F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>")).alias("key", "v")
    return t.table(spark, d, "events").select("event_id", entries).select(
        "event_id", "key", F.try_variant_get("v", "$", "string").alias("value"), F.schema_of_variant("v").alias("kind"))
