"""Incremental ingest over landed parts, and every registered query beside its SQL."""

import inspect
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from recohort.operators import classify
from recohort.session import new_folder
from recohort.sources.files import write_results
from recohort.streaming import ingest
from recohort.suite import ORACLES, QUERIES
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


def test_incremental_ingest(spark, tmp_path):
    landed, accepted, state = str(tmp_path / "landed"), new_folder(spark, "accepted"), new_folder(spark, "state")
    first = datetime(2024, 1, 1)
    part = spark.createDataFrame([(i, first + timedelta(hours=i)) for i in range(48)], "id long, ts timestamp_ntz")

    def run():
        ingest.incremental_ingest(ingest.new_parts(spark, landed, part.schema), ["id"], accepted, state, "ts")
        return {str(r.day): r.rows for r in ingest.daily_counts(ingest.accepted_events(spark, accepted, part.schema)).collect()}

    part.coalesce(1).write.mode("append").parquet(landed)
    assert run() == {"2024-01-01": 24, "2024-01-02": 24}
    assert run() == {"2024-01-01": 24, "2024-01-02": 24}
    # A later part repeats old keys and adds a day.
    later = spark.createDataFrame([(i, first + timedelta(hours=i)) for i in range(40, 72)], part.schema)
    later.coalesce(1).write.mode("append").parquet(landed)
    assert run() == {"2024-01-01": 24, "2024-01-02": 24, "2024-01-03": 24}
    # Reading needs no shuffle, and bounds on the day reach the folders.
    events = ingest.accepted_events(spark, accepted, part.schema, datetime(2024, 1, 2).date(), datetime(2024, 1, 3).date())
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert events.count() == 24 and "Exchange" not in plan
    assert "PartitionFilters: [isnotnull(accepted_day" in plan and "accepted_day" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


@pytest.mark.parametrize("runs", [1, 3])
def test_parts_out_of_order_lose_nothing(spark, tmp_path, runs):
    landed, accepted, state = str(tmp_path / "landed"), new_folder(spark, "accepted"), new_folder(spark, "state")
    schema = "id long, ts timestamp_ntz"
    for k, first in enumerate((datetime(2024, 3, 1), datetime(2024, 3, 2), datetime(2024, 1, 1))):
        part = spark.createDataFrame([(10 * k + i, first + timedelta(minutes=i)) for i in range(10)], schema)
        part.coalesce(1).write.mode("append").parquet(landed)
        if runs == 3 or k == 2:
            parts = ingest.new_parts(spark, landed, part.schema, files_per_batch=1)
            ingest.incremental_ingest(parts, ["id"], accepted, state, "ts")
    events = ingest.accepted_events(spark, accepted, part.schema)
    assert {str(r.day): r.rows for r in ingest.daily_counts(events).collect()} == {
        "2024-01-01": 10, "2024-03-01": 10, "2024-03-02": 10}


def test_a_batch_that_runs_again_adds_what_is_missing(spark, tmp_path):
    """Half of a batch was stored before it failed; keys and times may be null, keys may stand on two days."""
    accepted, schema = new_folder(spark, "accepted"), "id long, kind string, ts timestamp_ntz, v int"
    rows = [(1, "a", datetime(2024, 1, 1), 5), (1, "a", datetime(2024, 1, 1), 3), (1, None, datetime(2024, 1, 1), 1), (1, None, datetime(2024, 1, 1), 1),
            (2, "a", None, 1), (1, "a", datetime(2024, 1, 2), 9), (None, None, None, 4)]
    batch = spark.createDataFrame(rows, schema)
    stored = batch.filter("v = 3 or id = 2").withColumn(ingest.DAY, F.to_date("ts"))
    stored.write.partitionBy(ingest.DAY).parquet(accepted)
    for _ in range(2):
        fresh = ingest.new_events(batch, ingest._stored(spark, accepted, batch.schema), ["id", "kind"], "ts")
        fresh.select(*batch.columns, ingest.DAY).write.mode("append").partitionBy(ingest.DAY).parquet(accepted)
        found = ingest.accepted_events(spark, accepted, batch.schema)
        assert sorted(map(str, (tuple(r)[:4] for r in found.collect()))) == sorted(map(str, [
            (1, "a", datetime(2024, 1, 1), 3), (1, None, datetime(2024, 1, 1), 1), (2, "a", None, 1), (1, "a", datetime(2024, 1, 2), 9), (None, None, None, 4)]))
    assert [tuple(r) for r in ingest.conflicting_keys(found, ["id", "kind"]).collect()] == [(1, "a", 2)]


def test_scan_of_decoded_events_prunes_days(spark, tmp_path):
    path = str(tmp_path / "decoded")
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(start + timedelta(days=i), bytes([171] * 20)) for i in range(30)], "block_time timestamp_ntz, contract_address binary")
    write_results(rows.withColumn("block_date", F.to_date("block_time")), path, partition=["block_date"])
    found = classify.scan_decoded_events(spark.read.parquet(path), start.date(), (start + timedelta(days=3)).date(), "ab" * 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "block_date" in filters[0] and ">= 2024-01-01" in filters[0] and "< 2024-01-04" in filters[0]
    assert "contract_address" in filters[1] and "block_time" in filters[1]
    assert found.count() == 3
    # Days beyond the bounds are not opened: a broken file there does no harm.
    broken = next(p for p in (tmp_path / "decoded" / "block_date=2024-01-20").glob("*.parquet"))
    broken.write_bytes(b"no parquet")
    assert found.count() == 3


@pytest.fixture(scope="module")
def database():
    db = connect(FOLDER)
    yield db
    db.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert difference(spark, database, QUERIES[name], ORACLES[name], FOLDER) is None


def test_registry():
    import __spark_entry__ as driver
    assert set(driver.oracle_sql()) <= set(driver.queries()) and len(driver.queries()) >= 129


def test_entry(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).count() == 7


def test_registered_models_use_the_operators_settings(monkeypatch):
    from recohort.operators import models as mo
    from recohort.suite import models

    assert inspect.signature(mo.fit_boosting).parameters["rounds"].default == (100, 200)
    assert inspect.signature(mo.fit_networks).parameters["iterations"].default == (50, 100)
    assert inspect.signature(mo.fit_networks).parameters["seeds"].default == (17, 42, 73)
    given = []
    monkeypatch.setattr(models, "_prepared", lambda spark, d: "rows")
    for name in ("fit_logistic", "fit_boosting", "fit_networks"):
        monkeypatch.setattr(models.mo, name, lambda *args, name=name, **more: given.append((name, args, more)))
    for fit in (models._logistic_fit, models._boosting_fit, models._network_fits):
        fit.__wrapped__(None, "")
    assert given == [(name, ("rows",), {}) for name in ("fit_logistic", "fit_boosting", "fit_networks")]
