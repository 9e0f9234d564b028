"""Reconciliation: every kind of bad export changes the status."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from recohort.contracts import AUDIT_FIELDS, DAILY_FIELDS, RECONCILED_METRICS
from recohort.operators import matching, reconcile as rc
from recohort.plans import cross_check

COVERAGE = (datetime(2024, 1, 1), datetime(2024, 1, 3))
GOOD = {**dict.fromkeys((*DAILY_FIELDS, *AUDIT_FIELDS), 0), "rows": 3, "accounts": 2, "increase": 2, "decrease": 1,
        "position_rows": 3, "execution_rows": 3}


def daily(spark, *changes):
    rows = [(date(2024, 1, i + 1), *{**GOOD, **change}.values()) for i, change in enumerate(changes)]
    return spark.createDataFrame(rows, "day date, " + ", ".join(f"`{n}` bigint" for n in GOOD))


def metrics(spark, **changes):
    rows = []
    for name in RECONCILED_METRICS:
        row = {"numerator": 1, "denominator": 2, "rate": 0.5, "strict_unknown_events": 0, **changes.get("every", {}), **changes.get(name, {})}
        rows.append((name, row["numerator"], row["denominator"], row["rate"], row["strict_unknown_events"]))
    return spark.createDataFrame(rows, "metric string, numerator bigint, denominator bigint, rate double, strict_unknown_events bigint")


def status(spark, exported=None, measured=None, synthetic=True):
    local = daily(spark, {}, {})
    mine = spark.createDataFrame([(n, 1, 2) for n in RECONCILED_METRICS], "metric string, n bigint, cohort_size bigint")
    out = cross_check.reconcile_exports(exported if exported is not None else local, measured if measured is not None else metrics(spark),
                                        local, mine, COVERAGE, synthetic)
    row = out["status"].first()
    return row.comparison_status, row.opening_retention_status, row.validated, out


UNKNOWN = {"every": {"strict_unknown_events": 1}, "strict_r30": {"numerator": None, "rate": None}}


def test_agreement_validates_only_real_data(spark):
    assert status(spark)[:3] == ("agreement", "agreement", False)
    assert status(spark, synthetic=False)[:3] == ("agreement", "agreement", True)


def test_changed_exports(spark):
    assert status(spark, measured=metrics(spark, r30={"numerator": 0, "rate": 0.0}))[0] == "differences"
    assert status(spark, exported=daily(spark, {}))[0] == "invalid_or_incomplete"
    assert status(spark, exported=daily(spark, {"duplicate_execution_events": 1}, {}))[0] == "invalid_or_incomplete"
    assert status(spark, exported=daily(spark, {"zero_size": 1}, {}))[0] == "differences"
    found = status(spark, measured=metrics(spark, **UNKNOWN))
    assert found[:3] == ("invalid_or_incomplete", "agreement", False)
    assert {r.metric: r.status for r in found[3]["metrics"].collect()}["strict_r30"] == "withheld"


@pytest.mark.parametrize("change", [
    {**UNKNOWN, "r30": {"strict_unknown_events": 0}}, {**UNKNOWN, "strict_r30": {"numerator": 1, "rate": 0.5}},
    {**UNKNOWN, "strict_r30": {"numerator": None, "rate": None, "denominator": 3}}, {"strict_r30": {"rate": 0.6}}])
def test_bad_strict_exports(spark, change):
    assert status(spark, measured=metrics(spark, **change))[1] == "invalid_or_incomplete"


def test_table_comparison(spark):
    left = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "c")], "k int, x double, s string")
    right = spark.createDataFrame([(1, 1.0 + 1e-13, "a"), (2, 2.5, "b"), (4, 3.0, "c")], "k int, x double, s string")

    def kinds(**options):
        return sorted((r.k, r.field, r.kind) for r in rc.compare_tables(left, right, ["k"], **options).collect())

    lost = [(3, "row", "missing_from_right"), (4, "row", "missing_from_left")]
    assert kinds() == [(1, "x", "difference"), (2, "x", "difference"), *lost]
    assert kinds(tolerance=1e-12, numeric=("x",)) == [(1, "x", "drift"), (2, "x", "difference"), *lost]
    total = rc.difference_summary(rc.compare_tables(left, right, ["k"], 1e-12, ("x",))).first()
    assert (total.difference_count, total.accepted_float_drift_count, total.passed) == (3, 1, False)
    assert rc.difference_summary(rc.compare_tables(left, left, ["k"])).first().passed
    assert rc.compare_tables(left.unionByName(left), left, ["k"]).filter("kind = 'repeated_key'").count() == 3
    with pytest.raises(ValueError, match="columns"):
        rc.compare_tables(left.drop("s"), right, ["k"])


def test_nested_comparison(spark):
    def nested(x, values):
        return spark.createDataFrame([(1, ({"a": x}, values))], "k int, r struct<m: map<string,double>, v: array<int>>")

    def paths(right, **options):
        return sorted((r.path, r.kind) for r in rc.compare_results(nested(1.0, [1, 2]), right, "k", "r", **options).collect())

    assert paths(nested(1.0, [1, 2])) == []
    assert paths(nested(1.0 + 1e-13, [1, 2]), tolerance=1e-12) == [("$.m.a", "drift")]
    assert paths(nested(2.0, [1, 3, 4]), tolerance=1e-12) == [("$.m.a", "difference"), ("$.v[1]", "difference"), ("$.v[2]", "missing_from_left")]


EVENTS = [("a-entry", "a", "2023-11-20 10:00:00", "2023-09-01 10:00:00", "MarketIncrease", 10.0),
          ("b-entry", "b", "2023-11-20 10:00:01", "2023-11-20 09:00:00", "MarketIncrease", 10.0),
          ("a-return1", "a", "2024-04-19 10:00:00", "2024-03-26 10:00:00", "MarketIncrease", 10.0),
          ("a-return2", "a", "2024-04-20 10:00:00", "2024-04-20 09:00:00", "MarketIncrease", 10.0),
          ("a-r60", "a", "2024-05-19 10:00:00", "2024-05-19 09:00:00", "MarketIncrease", 10.0),
          ("swap", "a", "2024-04-19 11:00:00", "2024-04-19 09:00:00", "MarketSwap", 10.0),
          ("collateral", "a", "2024-04-19 12:00:00", "2024-04-19 09:00:00", "MarketIncrease", 0.0),
          ("liquidation", "a", "2024-04-19 13:00:00", "2024-04-19 09:00:00", "Liquidation", 0.0)]


@pytest.fixture(scope="module")
def matched(spark):
    base = spark.createDataFrame(EVENTS, "k string, account string, done string, made string, order_type string, size_delta_usd double").select(
        F.col("k").cast("binary").alias("order_key"), F.col("account").cast("binary").alias("account"),
        F.col("done").cast("timestamp_ntz").alias("block_time"), F.to_date("done").alias("block_date"),
        F.col("made").cast("timestamp_ntz").alias("made"), "order_type", "size_delta_usd").withColumn("tx_hash", F.col("order_key"))
    source = F.when(F.col("order_type").isin("MarketIncrease", "LimitIncrease"), "increase").otherwise("decrease")
    positions = base.filter("order_type <> 'MarketSwap'").withColumns({"source_action": source, "position_index": F.lit(10).cast("bigint")})
    executions = base.select("block_date", "block_time", "tx_hash", "order_key", "account", F.lit(11).cast("bigint").alias("execution_index"),
                             F.lit(0).alias("secondary_order_type"))
    creations = base.select("order_key", "account", F.col("made").alias("block_time"), "order_type")
    return positions.drop("made"), executions, creations


def audited(spark, positions, executions, creations, day):
    zero = F.lit(b"\0" * 20)
    out = matching.daily_audit(matching.dates_between(spark, date(2023, 9, 20), date(2024, 5, 29)), positions, executions, creations, zero,
                               datetime(2024, 5, 29)).collect()
    assert len(out) == 252
    return next(r for r in out if str(r.day) == day), out


def retained(positions, executions, creations):
    from recohort.contracts import Campaign
    from recohort.operators.cohort import retention_metrics_long
    campaign = Campaign(datetime(2023, 11, 15, 0, 0, 1), datetime(2024, 3, 27))
    flags = matching.matched_retention(positions.filter("source_action = 'increase'"), executions, creations, campaign,
                                       F.lit(b"\0" * 20), datetime(2024, 5, 29))
    return {r.metric: (r.numerator, r.denominator, r.rate, r.strict_unknown_events) for r in retention_metrics_long(flags).collect()}


def test_matched_audit(spark, matched):
    positions, executions, creations = matched
    row, out = audited(spark, *matched, "2024-04-19")
    assert (row.rows, row.execution_rows, row.out_of_scope_execution_rows) == (3, 4, 1)
    assert (row.increase, row.collateral, row.liquidation, row.zero_size) == (1, 1, 1, 2)
    assert sum(r.created_missing for r in out) == 0 and out[0].rows in (0, 1, 3)
    assert set(retained(*matched).values()) == {(1, 2, 0.5, 0)}
    key = F.col("order_key").cast("string")
    twice = positions.unionByName(positions.filter(key == "a-return1"))
    row, _ = audited(spark, twice, executions, creations, "2024-04-19")
    assert (row.duplicate_position_events, row.execution_join_extra_rows) == (1, 1)
    fewer = twice.filter(key != "a-return2")
    row, _ = audited(spark, fewer, executions, creations, "2024-04-20")
    assert row.unmatched_execution_rows == 1
    lost = creations.filter(key != "a-return1")
    strict = retained(fewer, executions, lost)["strict_r30"]
    assert strict[0] is None and strict[2] is None and strict[3] > 0
    again = lost.unionByName(creations.filter(key == "a-return1")).unionByName(
        creations.filter(key == "a-return1").withColumn("account", F.lit("conflicting").cast("binary")))
    strict = retained(fewer, executions, again)["strict_r30"]
    assert strict[0] is None and strict[3] > 0


def test_hot_key_is_counted_not_expanded(spark, matched):
    positions, executions, creations = matched
    key = F.col("order_key").cast("string")

    def repeated(rows, times):
        copies = F.when(key == "a-return1", times).otherwise(1)
        return rows.withColumn("_c", F.explode(F.array_repeat(F.lit(1), copies))).drop("_c")

    pairs = matching.full_outer_match(repeated(positions, 3000), repeated(executions, 2000))
    assert pairs.count() == 8
    assert pairs.filter(key == "a-return1").first().pair_rows == 6_000_000
    row, _ = audited(spark, repeated(positions, 3000), repeated(executions, 2000), creations, "2024-04-19")
    assert row.execution_join_extra_rows == 6_000_000 - 2000
