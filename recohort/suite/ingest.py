"""Sources, sinks, normalization and the stream, over rows derived from the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recohort.operators import classify, gates, partitions as pt, quality
from recohort.plans.reward_report import reward_report
from recohort.session import new_folder, pin
from recohort.sources import events as se, files as sf, pages as sp, rewards as sr
from recohort.streaming import ingest as stream
from recohort.suite import tables as t
from recohort.suite.registry import query


def event_text_rows(spark, d):
    """Contract text rows from orders: mixed case, both zones, empty unknowns."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    made = F.date_format(F.col("o_orderdate") - F.make_dt_interval(days=(key % 60).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    known = key % 997 != 0
    size = F.col("o_totalprice").cast("decimal(18,2)").cast("string")

    def padded(value, width):
        return F.concat(F.lit("0x"), F.lpad(value, width, "0"))

    return t.table(spark, d, "orders").select(
        F.lit("42161").alias("chain_id"), padded(F.concat(key.cast("string"), F.lit("AB")), 64).alias("tx_hash"),
        (key % 3).cast("string").alias("log_index"), padded(F.concat((F.col("o_custkey") + 1).cast("string"), F.lit("cD")), 40).alias("account"),
        padded(key.cast("string"), 64).alias("order_key"), padded(F.lit("F1"), 40).alias("market"),
        F.concat(day, F.when(key % 2 == 0, "T00:00:00Z").otherwise("T08:00:00+08:00")).alias("timestamp"),
        F.when(F.col("o_orderstatus") == "O", "decrease").otherwise("increase").alias("action"),
        F.when(key % 50 == 0, "false").otherwise("true").alias("success"), size.alias("size_delta_usd"),
        F.when(known, size).otherwise("").alias("position_fee_usd"), F.when(known, made).otherwise("").alias("order_created_at"))


@query("scan_events", """SELECT CAST(42161 AS BIGINT) AS chain_id, '0x' || lpad(CAST(o_orderkey AS VARCHAR) || 'ab', 64, '0') AS tx_hash,
  o_orderkey % 3 AS log_index, '0x' || lpad(CAST(o_custkey + 1 AS VARCHAR) || 'cd', 40, '0') AS account,
  '0x' || lpad(CAST(o_orderkey AS VARCHAR), 64, '0') AS order_key, '0x' || lpad('f1', 40, '0') AS market, o_orderdate AS "timestamp",
  CASE WHEN o_orderstatus = 'O' THEN 'decrease' ELSE 'increase' END AS action, o_orderkey % 50 <> 0 AS success, o_totalprice AS size_delta_usd,
  CASE WHEN o_orderkey % 997 <> 0 THEN o_totalprice END AS position_fee_usd,
  CASE WHEN o_orderkey % 997 <> 0 THEN o_orderdate - to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS order_created_at FROM orders""")
def _scan(spark, d):
    return se.type_events(se.read_event_text(spark, landed_events(spark, d)))


def landed_events(spark, d) -> str:
    """Event CSV in two sets of parts whose columns stand in different orders."""
    path, rows = new_folder(spark, "landed-events"), event_text_rows(spark, d)
    odd = F.col("tx_hash").substr(-3, 1).isin(*"13579")
    sf.write_results(rows.filter(~odd), f"{path}/one", kind="csv")
    sf.write_results(rows.filter(odd).select(*reversed(rows.columns)), f"{path}/two", kind="csv")
    return f"{path}/*"


def page_texts(spark, d, orders=None):
    """One page per order: its execution, its creation, and a swap execution that is out of scope.

    Columns of ``orders`` that are no columns of the table stay beside the page.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tx = F.concat(F.lit("0x"), F.lpad(key.cast("string"), 64, "0"))
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    raw = F.when(key % 31 == 0, F.lit("0")).otherwise(F.concat(cents.cast("string"), F.lit("0" * 21), F.lpad((key % 10 ** 7).cast("string"), 7, "0")))
    account = F.concat(F.lit("0xAB"), F.lpad(cust.cast("string"), 38, "0"))

    def record(name, suffix, kind, at):
        return F.struct(F.concat(tx, F.lit(f":{suffix}")).alias("id"), F.lit(name).alias("eventName"), tx.alias("orderKey"),
                        kind.cast("int").alias("orderType"), account.alias("account"), F.lit("0x" + "1" * 40).alias("marketAddress"),
                        raw.alias("sizeDeltaUsd"), at.alias("timestamp"), tx.alias("transactionHash"),
                        F.when(key % 13 != 0, (cents + 7).cast("string")).alias("positionFeeAmount"),
                        F.concat((key + 11).cast("string"), F.lit("0" * 15)).alias("collateralTokenPriceMin"),
                        F.lit("5").alias("traderDiscountAmount"))

    records = [record("OrderExecuted", 10, key % 6 + 2, seconds), record("OrderExecuted", 11, F.lit(0), seconds)]
    made = F.when(key % 19 != 0, record("OrderCreated", 9, key % 6 + 2, seconds - (key % 60) * 86400))
    actions = F.array_compact(F.array(*records, made))
    table = t.table(spark, d, "orders")
    rows = table if orders is None else orders
    beside = [name for name in rows.columns if name not in table.columns]
    return rows.select(*beside, key.cast("string").alias("page"),
                       F.to_json(F.struct(F.struct(actions.alias("tradeActions")).alias("data"))).alias("text"))


def landed_pages(spark, d, records: int = 1000) -> str:
    """Page files as they come from an interface: many records each, one file a page."""
    path = new_folder(spark, "landed-pages")
    head, tail = '{"data":{"tradeActions":[', "]}}"
    inner = F.substr(F.col("text"), F.lit(len(head) + 1), F.length("text") - (len(head) + len(tail)))
    # Orders are dealt before they become text, which is many times as long, and files are packed.
    orders = t.table(spark, d, "orders")
    orders = orders.withColumn("file", F.floor(F.col("o_orderkey") / records)).repartition(t.parts(orders, 50 * records), "file")
    several = page_texts(spark, d, orders).groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(inner)), ",").alias("records"))
    text = F.concat(F.lit(head), "records", F.lit(tail))
    several.select(F.col("file").alias("page"), text.alias("value")).write.partitionBy("page").text(path, compression="gzip")
    return path


_LOW, _HIGH = datetime(1996, 1, 1), datetime(1999, 1, 1)
_PAGE_SQL = """WITH p AS (SELECT o_orderkey AS k, '0x' || lpad(CAST(o_orderkey AS VARCHAR), 64, '0') AS tx,
  '0xab' || lpad(CAST(o_custkey AS VARCHAR), 38, '0') AS account, o_orderdate AS ts, o_orderkey % 6 + 2 AS kind,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders),
r AS (SELECT *, CASE WHEN k % 31 = 0 THEN '0' ELSE CAST(cents AS VARCHAR) || repeat('0', 21) || lpad(CAST(k % 10000000 AS VARCHAR), 7, '0') END AS raw FROM p)"""


@query("ingest_action_pages", _PAGE_SQL + """
SELECT tx || ':10' AS id, kind AS "orderType", '0xAB' || substr(account, 5) AS account, CAST(epoch(ts) AS BIGINT) AS "timestamp", raw AS "sizeDeltaUsd" FROM r WHERE """
       + t.inside_sql("ts", _LOW, _HIGH))
def _pages(spark, d):
    pages = pin(sp.read_pages(spark, landed_pages(spark, d)), "pages", compression="zstd")
    gates.enforce(sp.page_faults(pages))
    return sp.ingest_action_pages(pages, _LOW, _HIGH).select(
        "id", "orderType", "account", "timestamp", "sizeDeltaUsd")


def trim_sql(digits: str) -> str:
    """Integer text over 10^30 without trailing zeros."""
    padded = f"lpad({digits}, CAST(greatest(length({digits}), 31) AS INTEGER), '0')"
    whole, fraction = f"left({padded}, length({padded}) - 30)", f"rtrim(right({padded}, 30), '0')"
    return f"CASE WHEN {fraction} = '' THEN {whole} ELSE {whole} || '.' || {fraction} END"


_FEE = "CAST((CAST(cents AS HUGEINT) + 2) * (CAST(k AS HUGEINT) + 11) AS VARCHAR) || repeat('0', 15)"


@query("normalize_execution", _PAGE_SQL + f"""
SELECT '42161' AS chain_id, tx AS tx_hash, '10' AS log_index, account, tx AS order_key, '0x' || repeat('1', 40) AS market,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
  CASE WHEN kind = 7 THEN 'liquidation' WHEN raw = '0' THEN 'collateral' WHEN kind IN (2, 3) THEN 'increase' ELSE 'decrease' END AS action,
  'true' AS success, {trim_sql('raw')} AS size_delta_usd, CASE WHEN k % 13 <> 0 THEN {trim_sql(_FEE)} END AS position_fee_usd,
  CASE WHEN k % 19 <> 0 THEN strftime(ts - to_days(CAST(k % 60 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS order_created_at, 0::BIGINT AS faults FROM r""")
def _normalize(spark, d):
    # Executions and creations read the same pages, so they are parsed and written once.
    pages = pin(sp.parse_pages(page_texts(spark, d)), "pages")
    rows = sp.normalize_execution(sp.ingest_action_pages(pages), sp.page_creations(pages), 42161)
    return rows.withColumn("faults", F.size("faults"))


@query("validate_page_creations", t.MATCH_SQL + " SELECT order_key, count(*) AS creations FROM creations GROUP BY 1 HAVING count(*) > 1")
def _page_creations(spark, d):
    return gates.validate_page_creations(t.creations(spark, d))


@query("strictly_increasing_ids", """WITH r AS (SELECT o_orderkey // 500 AS page, o_orderkey % 500 AS pos,
  lpad(CAST(o_orderkey // 3 + o_custkey % 2 AS VARCHAR), 12, '0') AS id FROM orders),
l AS (SELECT page, pos, id, coalesce(lag(id) OVER (PARTITION BY page ORDER BY pos), '000000000000') AS prev FROM r)
SELECT page, pos, id, prev AS not_above FROM l WHERE id <= prev""")
def _increasing(spark, d):
    key = F.col("o_orderkey")
    rows = t.table(spark, d, "orders").select(F.floor(key / 500).alias("page"), (key % 500).alias("pos"),
                                              F.lpad((F.floor(key / 3) + F.col("o_custkey") % 2).cast("string"), 12, "0").alias("id"),
                                              F.lit("0" * 12).alias("cursor"))
    return gates.strictly_increasing_ids(rows)


@query("ingest_reward_files", t.REWARD_SQL + " SELECT file, epoch_start, recipient, amount_raw, 'STRING' AS amount_kind FROM allocations")
def _rewards(spark, d):
    return sr.ingest_reward_files(sr.distribution_documents(t.distribution_texts(spark, d)))


@query("ingest_override_maps", t.REWARD_SQL + """
SELECT file, epoch_start, k % 3 <> 2 AS recorded, CASE WHEN k % 3 = 0 THEN origin END AS original, CASE WHEN k % 3 = 0 THEN main END AS receiver FROM files""")
def _overrides(spark, d):
    return sr.ingest_override_maps(sr.distribution_documents(t.distribution_texts(spark, d)))


@query("weekly_partition_plan", """WITH c AS (SELECT o_orderpriority AS p, min(o_orderdate) AS a, max(o_orderdate) + INTERVAL '1 day' AS b FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series(a, b - INTERVAL '1 microsecond', INTERVAL '7 days')) AS part_start, b FROM c)
SELECT part_start, least(part_start + INTERVAL '7 days', b) AS part_end FROM s""")
def _plan(spark, d):
    coverage = t.table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.min("o_orderdate").alias("coverage_start"), (F.max("o_orderdate") + F.expr("INTERVAL '1' DAY")).alias("coverage_end"))
    return pt.weekly_partition_plan(coverage)


@query("merge_partitions", """WITH c AS (SELECT min(o_orderdate) AS a, max(o_orderdate) + INTERVAL '1 day' AS b FROM orders),
s AS (SELECT unnest(generate_series(a, b - INTERVAL '1 microsecond', INTERVAL '7 days')) AS part_start, b FROM c),
p AS (SELECT part_start, least(part_start + INTERVAL '7 days', b) AS part_end FROM s)
SELECT o_orderkey AS tx_hash, part_start, part_end FROM orders JOIN p ON o_orderdate >= part_start AND o_orderdate < part_end""")
def _merge(spark, d):
    """Every order in the week of its snapshot, as one pass over any number of weeks."""
    trades = t.order_trades(spark, d)
    coverage = trades.agg(F.min("timestamp").alias("coverage_start"), (F.max("timestamp") + F.expr("INTERVAL '1' DAY")).alias("coverage_end"))
    return pt.merge_partitions(trades, pt.weekly_partition_plan(coverage)).select("tx_hash", "part_start", "part_end")


_PARTS_SQL = """parts AS (SELECT o_orderpriority AS snapshot, date_trunc('month', o_orderdate) AS part_start, count(*) AS row_count,
  date_trunc('month', o_orderdate) + INTERVAL '1 month' - to_days(CASE WHEN date_trunc('month', o_orderdate) = TIMESTAMP '1996-05-01' THEN 2 ELSE 0 END)
  + to_days(CASE WHEN date_trunc('month', o_orderdate) = TIMESTAMP '1998-09-01' AND o_orderpriority = '5-LOW' THEN 3 ELSE 0 END) AS part_end,
  CASE WHEN o_orderpriority = '2-HIGH' AND date_trunc('month', o_orderdate) = TIMESTAMP '1997-03-01' THEN 'b' ELSE 'a' END AS source_url,
  CASE WHEN o_orderpriority = '1-URGENT' AND date_trunc('month', o_orderdate) = TIMESTAMP '1997-04-01' THEN NULL ELSE FALSE END AS is_synthetic,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND date_trunc('month', o_orderdate) = TIMESTAMP '1997-05-01' THEN 1 ELSE 2 END AS version
  FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate))"""


def manifest_parts(spark, d):
    month = F.col("part_start")

    def at(text):
        return month == F.lit(f"{text} 00:00:00").cast("timestamp_ntz")

    snap = F.col("snapshot")
    rows = t.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("snapshot"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("part_start")).agg(
        F.count("*").alias("row_count"))
    end = (month + F.expr("INTERVAL '1' MONTH") - F.make_dt_interval(days=F.when(at("1996-05-01"), 2).otherwise(0))
           + F.make_dt_interval(days=F.when(at("1998-09-01") & (snap == "5-LOW"), 3).otherwise(0)))
    return rows.withColumns({
        "part_end": end, "source_url": F.when((snap == "2-HIGH") & at("1997-03-01"), "b").otherwise("a"),
        "is_synthetic": F.when(~((snap == "1-URGENT") & at("1997-04-01")), F.lit(False)),
        "normalization_version": F.when((snap == "3-MEDIUM") & at("1997-05-01"), 1).otherwise(2)})


@query("partition_contiguity", f"""WITH {_PARTS_SQL},
c AS (SELECT *, lag(part_end) OVER (PARTITION BY snapshot ORDER BY part_start) AS prev, lead(part_start) OVER (PARTITION BY snapshot ORDER BY part_start) AS nx FROM parts),
e AS (SELECT *, coalesce(prev, TIMESTAMP '1995-01-01') AS due FROM c)
SELECT snapshot, part_start, part_end, 'gap' AS rule FROM e WHERE part_start > due
UNION ALL SELECT snapshot, part_start, part_end, 'overlap' FROM e WHERE part_start < due
UNION ALL SELECT snapshot, part_start, part_end, 'does not reach the end' FROM e WHERE nx IS NULL AND part_end <> TIMESTAMP '2001-08-02'""")
def _contiguity(spark, d):
    parts = manifest_parts(spark, d)
    coverage = parts.select("snapshot").distinct().withColumns({
        "coverage_start": F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), "coverage_end": F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")})
    return pt.partition_contiguity(parts.select("snapshot", "part_start", "part_end"), coverage)


@query("snapshot_provenance", f"""WITH {_PARTS_SQL}
SELECT snapshot, count(*) AS parts, count(DISTINCT source_url) = 1 AS same_source_url,
  count(DISTINCT is_synthetic) = 1 AND count(is_synthetic) = count(*) AS same_is_synthetic,
  count(DISTINCT version) = 1 AS same_normalization_version, CAST(sum(row_count) AS BIGINT) AS row_count FROM parts GROUP BY 1""")
def _provenance(spark, d):
    return pt.snapshot_provenance(manifest_parts(spark, d))


@query("cross_part_uniqueness", """SELECT 1::BIGINT AS chain_id, CAST(l_orderkey AS VARCHAR) AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index, count(*) AS copies,
  count(DISTINCT year(l_shipdate)) AS parts FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _cross(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.lit(1).alias("chain_id"), F.col("l_orderkey").alias("tx_hash"),
                                                F.col("l_linenumber").alias("log_index"), F.year("l_shipdate").alias("part"))
    return gates.cross_part_uniqueness(rows, "part")


@query("read_external_export", """SELECT 'e' || CAST(event_id % 4000 AS VARCHAR) AS day, count(*) AS copies FROM events GROUP BY 1 HAVING count(*) > 1""")
def _external(spark, d):
    key = F.concat(F.when(F.col("event_id") % 2 == 0, " E").otherwise("e"), (F.col("event_id") % 4000).cast("string"), F.lit(" "))
    export, path = t.table(spark, d, "events").select(key.alias(" Day"), F.col("event_type").alias("ROWS "), "event_id"), new_folder(spark, "export")
    sf.write_results(export.filter("event_id % 3 = 0").drop("event_id"), f"{path}/one", kind="csv")
    # Another run of the export had more columns, in another order, packed.
    sf.write_results(export.filter("event_id % 3 <> 0").select("ROWS ", "event_id", " Day"), f"{path}/two", kind="csv", compression="gzip")
    return sf.export_key_faults(sf.read_external_export(spark, f"{path}/*", ("day", "rows"), "day"), "day")


# Week, number of recipients and exact total of one distribution file a week.
@query("landed_distributions", """SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS epoch_start, count(DISTINCT o_custkey) AS recipients,
  CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS VARCHAR) AS total FROM orders GROUP BY 1""")
def _distributions(spark, d):
    """Distribution files are written, found by their path and checked before they are summed."""
    path, cents = new_folder(spark, "distributions"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    week = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd")
    per = t.table(spark, d, "orders").groupBy(week.alias("epoch"), t._address(F.col("o_custkey")).alias("who")).agg(F.sum(cents).cast("string").alias("raw"))
    amounts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("who", "raw"))))
    grouped = per.groupBy("epoch").agg(amounts.alias("amounts")).select("epoch", F.to_json(F.struct(
        F.lit(t.TOKEN).alias("token"), F.lit(t.REWARD_TYPE).alias("distributionTypeId"), F.concat("epoch", F.lit(f"_{t.REWARD_TYPE}")).alias("id"), "amounts")).alias("value"))
    grouped.repartition("epoch").write.partitionBy("epoch").text(path)
    found = reward_report(sr.read_distribution_texts(spark, f"{path}/*"), t.TOKEN, t.REWARD_TYPE)
    return found["epochs"].select("epoch_start", F.col("recipient_count").alias("recipients"), F.col("amount_raw").alias("total"))


@query("write_results", f"""WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL}
SELECT account, CAST(ts AS DATE) AS day, count(CASE WHEN opened THEN 1 END) AS increases FROM flagged GROUP BY 1, 2""")
def _write(spark, d):
    from recohort.operators.cohort import wallet_daily
    path = new_folder(spark, "wallet_daily")
    sf.write_results(wallet_daily(t.event_trades(spark, d)), path, partition=["day"])
    return spark.read.parquet(path).select("account", "day", "increases")


@query("file_digest_manifest", """SELECT CAST(doc_id AS VARCHAR) AS file, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256,
  sha1('blob ' || CAST(octet_length(encode(text)) AS VARCHAR) || chr(0) || text) AS git_sha1 FROM documents""")
def _digests(spark, d):
    return sf.content_digests(t.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"),
                                                                    F.col("text").cast("binary").alias("content")))


# One file a language: its length is that of its lines, each with its end.
@query("landed_file_digests", """SELECT coalesce(lang, '') AS lang, CAST(sum(octet_length(encode(sha256(text))) + 1) AS BIGINT) AS bytes,
  sha256(string_agg(sha256(text) || chr(10), '' ORDER BY doc_id)) AS sha256, TRUE AS same_when_streamed FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _file_digests(spark, d):
    """Files are written and digested as rows and, once more, a piece at a time."""
    path = new_folder(spark, "digested")
    lines = t.table(spark, d, "documents").filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", F.sha2("text", 256).alias("value"))
    lines.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    rows, streamed = sf.file_digest_manifest(spark, path, "*.txt"), sf.file_digest_manifest(spark, path, "*.txt", streamed_above=0)
    lang = F.regexp_extract("file", "/lang=([^/]*)/", 1)
    both = rows.join(streamed.select("file", F.struct("bytes", "sha256", "git_sha1").alias("again")), "file")
    return both.select(F.when(lang == "__HIVE_DEFAULT_PARTITION__", "").otherwise(lang).alias("lang"), "bytes", "sha256",
                       (F.struct("bytes", "sha256", "git_sha1") == F.col("again")).alias("same_when_streamed"))


@query("incremental_ingest", "SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1")
def _stream(spark, d):
    """Three parts that overlap, one after another, and in a second run a late one with the oldest days."""
    events = t.table(spark, d, "events")
    landed, accepted, state = (new_folder(spark, name) for name in ("landed", "accepted", "stream"))
    middle = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    late, key = F.col("ts") < middle, F.col("event_id") % 3

    def run():
        parts = stream.new_parts(spark, landed, events.schema, files_per_batch=2)
        stream.incremental_ingest(parts, ["event_id"], accepted, state, "ts")

    for k in range(3):
        # A fifth of every part stands in the next one as well.
        events.filter(~late & ((key == k) | ((key == (k + 1) % 3) & (F.col("event_id") % 5 == 0)))).write.mode("append").parquet(landed)
    run()
    events.filter(late | (F.col("event_id") % 7 == 0)).write.mode("append").parquet(landed)
    run()
    return stream.daily_counts(stream.accepted_events(spark, accepted, events.schema))


@query("classify_action", """SELECT l_linenumber::BIGINT AS code, CASE WHEN l_suppkey % 41 = 0 THEN 0 ELSE l_quantity END = 0 AS zero,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_suppkey % 41 = 0 AND l_linenumber <> 7 THEN 'collateral' WHEN l_linenumber IN (2, 3) THEN 'increase'
       WHEN l_linenumber IN (4, 5, 6) THEN 'decrease' ELSE 'liquidation' END AS action, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3""")
def _classify(spark, d):
    size = F.when(F.col("l_suppkey") % 41 == 0, 0.0).otherwise(F.col("l_quantity"))
    return t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("code"), (size == 0).alias("zero"),
                                                 classify.classify_action(F.col("l_linenumber"), size).alias("action")).agg(F.count("*").alias("rows"))


@query("action_flags", f"WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL} SELECT tx_hash, opened AS is_increase, took_part AS is_open_or_decrease FROM flagged")
def _flags(spark, d):
    return classify.action_flags(t.event_trades(spark, d)).select("tx_hash", "is_increase", "is_open_or_decrease")


@query("event_quality_profile", f"""WITH {t.EVENT_TRADES_SQL}, {t.FLAGS_SQL}
SELECT count(*) AS row_count, count(DISTINCT account) AS unique_accounts, count(CASE WHEN opened THEN 1 END) AS qualifying_increases,
  count(CASE WHEN opened AND created IS NOT NULL THEN 1 END) AS known_order_creations, count(CASE WHEN opened AND fee IS NOT NULL THEN 1 END) AS known_position_fees,
  round(count(CASE WHEN opened AND created IS NOT NULL THEN 1 END)::DOUBLE / count(CASE WHEN opened THEN 1 END), 9) AS order_created_coverage,
  round(count(CASE WHEN opened AND fee IS NOT NULL THEN 1 END)::DOUBLE / count(CASE WHEN opened THEN 1 END), 9) AS position_fee_coverage FROM flagged""")
def _quality(spark, d):
    from recohort.suite.registry import rounded
    return rounded(quality.event_quality_profile(t.event_trades(spark, d)), "order_created_coverage", "position_fee_coverage")


_GAPS = """count(CASE WHEN fee IS NULL THEN 1 END) AS fee_missing, count(CASE WHEN created IS NULL THEN 1 END) AS created_missing,
  count(CASE WHEN size = 0 THEN 1 END) AS zero_size"""


@query("daily_quality", f"""WITH {t.EVENT_TRADES_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS rows, count(DISTINCT account) AS accounts,
  {', '.join(f"count(CASE WHEN action = '{a}' THEN 1 END) AS {a}" for a in ('increase', 'decrease', 'liquidation', 'collateral'))}, {_GAPS} FROM trades GROUP BY 1""")
def _daily(spark, d):
    return quality.daily_quality(t.event_trades(spark, d))


@query("missing_by_action", f"WITH {t.EVENT_TRADES_SQL} SELECT action, count(*) AS rows, {_GAPS} FROM trades GROUP BY 1")
def _missing(spark, d):
    return quality.missing_by_action(t.event_trades(spark, d))
