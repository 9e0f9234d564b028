"""What must not grow with the tables: rows sent to every task, work per row, bytes moved, rows per task."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recohort.contracts import FEATURES
from recohort.operators import matching as m, models as mo, partitions as pt, rewards as rw
from recohort.sources import pages as sp, rewards as sr
from recohort.suite import audit, ingest, models, samples, tables as t


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reward_joins_are_not_broadcast(spark):
    """One row a file is as many rows as there are files, whatever parsed documents are guessed to hold."""
    body = '{"token":"0x7","amounts":{"0xA":"1","0xb":"2"},"appliedOverrides":{"0xc":"0xA"}}'
    texts = spark.range(50).select(F.col("id").cast("string").alias("file"), F.lit("2024-01-01").alias("epoch_start"), F.lit(body).alias("text"))
    documents = sr.distribution_documents(texts)
    allocations, overrides = sr.ingest_reward_files(documents), sr.ingest_override_maps(documents)
    ledger = rw.reward_ledger(allocations, overrides, "0x7")
    assert "Broadcast" not in plan(ledger)
    assert "Broadcast" not in plan(rw.reward_row_faults(allocations, overrides))
    batches = allocations.groupBy("file").agg(F.lit("3").alias("total_raw"))
    assert "Broadcast" not in plan(rw.batch_total_faults(allocations, batches))
    assert ledger.groupBy("recipient", "override_evidence").count().sort("recipient").collect() == [
        ("0xa", "recorded_destination", 50), ("0xb", "not_in_recorded_overrides", 50)]
    assert rw.batch_total_faults(allocations, batches).isEmpty()


def test_merge_meets_only_parts_of_the_day(spark):
    """Rows are not compared with every part; overlaps, empty parts, nulls and edges come out as before."""
    def at(*text):
        return [v and datetime.fromisoformat(v) for v in text]

    parts = spark.createDataFrame([at("2024-01-01", "2024-01-08"), at("2024-01-08", "2024-01-08T06:00"), at("2024-01-08T03:00", "2024-01-09"),
                                   at("2024-01-20", "2024-01-10"), at(None, "2024-02-01"), at("2024-01-12", None)], "part_start timestamp, part_end timestamp")
    times = ["2023-12-31T23:59:59", "2024-01-01", "2024-01-07T23:59:59", "2024-01-08", "2024-01-08T03:00", "2024-01-08T06:00", "2024-01-09", "2024-01-15", None]
    rows = spark.createDataFrame([(i, *at(v)) for i, v in enumerate(times)], "`a.b` int, timestamp timestamp")
    merged = pt.merge_partitions(rows, parts)
    assert merged.columns == ["a.b", "timestamp", "part_start", "part_end"]
    first, second, third = (tuple(at(*p)) for p in (("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-08T06:00"), ("2024-01-08T03:00", "2024-01-09")))
    assert sorted((r[0], r[2], r[3]) for r in merged.collect()) == [(1, *first), (2, *first), (3, *second), (4, *second), (5, *third)]
    assert "_day" in plan(merged)


def test_landed_pages_move_orders_and_not_text(spark, tmp_path):
    """Files are packed, and what is shuffled are the orders, once."""
    orders = spark.range(3000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(12.5).alias("o_totalprice"),
        F.lit(datetime(1997, 1, 1)).alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    path = ingest.landed_pages(spark, str(tmp_path))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
    assert len(files) == 3 and all(row.path.endswith(".gz") for row in files)
    assert sum(row.length for row in files) < 3000 * 200
    found = sp.read_pages(spark, path)
    assert sp.ingest_action_pages(found).count() == 3000
    assert sorted(r[0] for r in found.select(F.size("actions")).collect()) == sorted(
        sum(2 + (k % 19 != 0) for k in range(a, a + 1000)) for a in (0, 1000, 2000))


def _match_tables(spark, path, orders: int):
    """Orders with four lines each, of which two are equal."""
    key = F.col("id")
    spark.range(orders).select(
        key.alias("o_orderkey"), (key % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(12.5).alias("o_totalprice"),
        F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")).write.parquet(f"{path}/orders.parquet")
    line = F.explode(F.array(*[F.lit(n) for n in (1, 1, 2, 3)])).alias("l_linenumber")
    spark.range(orders).select(
        key.alias("l_orderkey"), (key % 50).alias("l_partkey"), (key % 40 + 1).alias("l_suppkey"), line, F.lit(1.0).alias("l_extendedprice"), F.lit("N").alias("l_returnflag"),
        F.lit(datetime(1997, 1, 2)).cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")


def test_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Twice the lines are twice the parts, and no side of the match is sent to every task."""
    _match_tables(spark, tmp_path, 100)
    monkeypatch.setattr(t, "parts", lambda rows, most: -(-rows.count() // 10))
    for frame in (t.positions(spark, str(tmp_path)), t.executions(spark, str(tmp_path))):
        assert "Broadcast" not in plan(frame)
        assert ", 40), REPARTITION_BY_NUM" in plan(frame)
    assert plan(audit._matched(spark, str(tmp_path))).count("hashpartitioning(order_key") >= 2


def test_audit_counts_rows_that_stand_for_several(spark, tmp_path):
    """Counted rows give the same matches and duplicates as the rows themselves."""
    _match_tables(spark, tmp_path, 30)
    sides = p, e = t.positions(spark, str(tmp_path)), t.executions(spark, str(tmp_path))
    counted = m._counted(p, "position_index"), m._counted(e, "execution_index")
    assert counted[0].count() < p.count()
    rows = F.col("_rows")
    key = ("block_date", "order_key", "account", "has_position", "has_execution", "pair_rows")
    assert sorted(m.full_outer_match(*counted, rows).select(*key).collect()) == sorted(m.full_outer_match(*sides).select(*key).collect())
    for one, few, index in zip(sides, counted, ("position_index", "execution_index")):
        assert m.duplicate_event_counts(few, index, rows).collect() == m.duplicate_event_counts(one, index).collect()
    out = m.daily_audit(None, *sides, t.creations(spark, str(tmp_path)), F.lit(0).cast("bigint"))
    assert out.select("day", "position_rows", "duplicate_position_events", "position_join_extra_rows").collect() == [
        (datetime(1997, 1, 2).date(), 29 * 4, 29, 29 * (4 * 4 - 4))]


def test_match_joins_are_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    """No join or grouping of lines is left to the session's fixed number of parts; only days are."""
    _match_tables(spark, tmp_path, 100)
    d, zero = str(tmp_path), F.lit(0).cast("bigint")
    monkeypatch.setattr(t, "parts", lambda rows, most: -(-rows.count() // 10))
    sides = t.positions(spark, d), t.executions(spark, d)
    count, fixed = t.line_parts(spark, d), f", {spark.conf.get('spark.sql.shuffle.partitions')}), ENSURE_REQUIREMENTS"
    matched = audit._matched(spark, d)
    for frame in (matched, m.full_outer_match(*sides, parts=count), m.semi_matched_positions(*sides, count), m.semi_relevant_creations(t.creations(spark, d), sides[1], count)):
        assert fixed not in plan(frame)
        assert f", {count}), REPARTITION_BY_NUM" in plan(frame)
    by_day = plan(m.daily_join_audit(matched, zero, count))
    assert "hashpartitioning(block_date" in by_day and by_day.count(fixed) == 1
    # The same rows as without parts.
    plain = m.matched_events(*sides, t.creations(spark, d))
    assert sorted(map(str, matched.collect())) == sorted(map(str, plain.collect()))
    assert m.daily_join_audit(matched, zero, count).collect() == m.daily_join_audit(plain, zero).collect()
    assert sorted(m.semi_matched_positions(*sides, count).collect()) == sorted(m.semi_matched_positions(*sides).collect())


def test_openings_of_large_tables_are_dealt_by_account(spark, tmp_path, monkeypatch):
    """Samples of many orders are built in parts whose number follows the orders, with the same rows; few orders move as before."""
    key, d = F.col("id"), str(tmp_path)
    spark.range(300).select(
        key.alias("o_orderkey"), (key % 40).alias("o_custkey"), F.when(key % 3 == 0, "O").otherwise("F").alias("o_orderstatus"), (key + 0.5).alias("o_totalprice"),
        F.lit(datetime(1996, 5, 1)).cast("timestamp_ntz").alias("o_orderdate") + F.make_dt_interval(days=(key * 7).cast("int")),
        (key % 3).cast("string").alias("o_orderpriority")).toDF("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.parquet(f"{d}/orders.parquet")
    few = samples.study_samples(spark, d)
    assert "REPARTITION_BY_NUM" not in plan(few)
    monkeypatch.setattr(t, "parts", lambda rows, most: -(-rows.count() // 10))
    many = samples.study_samples(spark, d)
    assert "hashpartitioning(account" in plan(many) and ", 30), REPARTITION_BY_NUM" in plan(many) and "ENSURE_REQUIREMENTS" not in plan(many)
    assert many.count() > 0 and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_networks_share_their_training_rows(spark, monkeypatch):
    """Training rows are kept once for all seeds, and given back."""
    key = F.col("id")
    rows = mo.with_vector(spark.range(60).select(
        key.alias("account"), F.lit("x").alias("as_of"), F.when(key % 3 == 0, "validation").otherwise("train").alias("split"), (key % 2).cast("int").alias("label"),
        *[((key * (i + 3)) % 7 / 7.0).alias(name) for i, name in enumerate(FEATURES)]))
    kept, original = [], mo._training
    monkeypatch.setattr(mo, "_training", lambda found: kept.append(original(found)) or kept[-1])
    fitted = mo.fit_networks(rows, (17, 42), (2, 3))
    assert len(kept) == 1 and not kept[0].storageLevel.useMemory
    alone = mo.fit_mlp(rows, 42, (2, 3))
    assert len(kept) == 2 and not kept[1].storageLevel.useMemory
    assert alone.setting == fitted[42].setting and mo.score_model(alone, rows).collect() == mo.score_model(fitted[42], rows).collect()


def test_kinds_of_models_are_fitted_at_once(spark, monkeypatch):
    """Each first fit waits until all three have begun."""
    met, done = threading.Barrier(3, timeout=20), []

    def fit(name):
        def run(session, folder):
            if name in done:
                raise LookupError("fitted")
            met.wait()
            done.append(name)
        return run

    names = ["_boosting_fit", "_logistic_fit", "_network_fits"]
    monkeypatch.setattr(models, "_prepared", lambda session, folder: None)
    for name in names:
        monkeypatch.setattr(models, name, fit(name))
    with pytest.raises(LookupError):
        models._scored_runs(spark, "")
    assert sorted(done) == names
