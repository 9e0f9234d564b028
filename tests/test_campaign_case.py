"""Golden numbers of the boundary universe, and gates that refuse bad input."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recohort.contracts import Campaign, utc
from recohort.operators import cohort as co, gates, ranking
from recohort.plans import campaign_case, cross_check
from recohort.sources import events as se
from tests.fixtures import boundary_fixture

CASE = Campaign(datetime(2023, 11, 15), datetime(2024, 3, 29))
COVERAGE = (datetime(2023, 9, 20), datetime(2024, 5, 29))


@pytest.fixture(scope="module")
def raw(spark):
    return boundary_fixture(spark, CASE.start, CASE.end).cache()


def changed(raw, index, column, value):
    """The row at a fixture position with one field replaced."""
    target = F.concat(F.lit("0x"), F.sha2(F.lit(f"event-{index}"), 256))
    return raw.withColumn(column, F.when(F.col("tx_hash") == target, F.lit(value)).otherwise(F.col(column)))


def summary(raw, campaign=CASE, **evidence):
    profile = co.retention_profile(se.type_events(raw), campaign)
    return {r.metric: r for r in co.retention_summary(profile, campaign=campaign, **evidence).collect()}


def test_boundary_universe(spark, raw):
    tables = campaign_case.describe_campaign(se.type_events(raw), CASE, COVERAGE)
    found = {r.metric: (r.n, r.cohort_size) for r in tables["summary"].collect()}
    assert found == {"r30": (3, 6), "cumulative30": (4, 6), "sustained30": (1, 6), "open_or_decrease30": (4, 6),
                     "voluntary30": (4, 6), "strict_r30": (2, 6), "r60": (2, 6)}
    segments = {r.label: (r.size, r.r30_n) for r in tables["segments"].collect()}
    assert segments == {"all": (6, 3), "excluding_top": (5, 2)}
    assert sum(r["size"] for r in tables["cohorts"].collect()) == 6
    activity = tables["activity"].first()
    assert (activity.eligible_n, activity.pre_active_days, activity.post_active_days) == (5, 0, 6)
    assert activity.post_activity_rate == pytest.approx(0.04) and activity.post_fee_usd == pytest.approx(7.5)
    assert activity.post_fee_per_day == pytest.approx(0.05)
    assert activity.activity_ratio is None and activity.fee_ratio is None
    quality = tables["quality"].first()
    assert (quality.row_count, quality.unique_accounts, quality.qualifying_increases) == (23, 9, 18)
    weekly = tables["weekly"].collect()
    assert len(weekly) == 8 and all(r.cohort_size == 6 for r in weekly)
    heat = tables["heatmap"].collect()
    assert len(heat) == 8 * len({r.entry_week for r in heat})


def test_profile_rows(raw):
    rows = {r.account[-1]: r for r in co.retention_profile(se.type_events(raw), CASE).collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "6", "8"]
    assert rows["1"].first_trade == datetime(2023, 10, 10, 12) and str(rows["1"].entry_week) == "2023-11-13"
    assert rows["4"].r30 and not rows["4"].strict_r30 and rows["4"].campaign_volume_usd == 2000.0


def test_profile_equals_joined_form(raw):
    trades = se.type_events(raw)
    joined = co.join_outcomes(co.join_first_seen(co.campaign_cohort(trades, CASE), co.first_seen(trades)),
                              co.window_outcomes(trades, CASE))
    one_pass = co.retention_profile(trades, CASE)
    assert sorted(map(str, joined.select(*one_pass.columns).collect())) == sorted(map(str, one_pass.collect()))


def test_recount_agrees(raw):
    assert cross_check.recount_differences(se.type_events(raw), CASE).count() == 0


def test_unknown_creation_withholds_strict_only(raw):
    found = summary(changed(raw, 13, "order_created_at", None))
    assert found["strict_r30"].n is None and found["strict_r30"].rate is None
    assert found["r30"].n == 3


def test_short_coverage_withholds_r60(raw):
    cut = raw.filter(F.col("timestamp") < "2024-04-29")
    found = summary(cut, coverage_end=datetime(2024, 4, 29), campaign=CASE)
    assert found["r30"].n == 3 and found["r60"].n is None


def test_unverified_decreases_withhold_voluntary(raw):
    found = summary(raw, decreases_verified=False)
    assert found["voluntary30"].n is None and found["open_or_decrease30"].n == 4


def test_missing_fee_is_not_zero(raw):
    trades = se.type_events(changed(raw, 13, "position_fee_usd", None))
    row = co.activity_intensity(co.wallet_daily(trades), co.retention_profile(trades, CASE), CASE, COVERAGE[0]).first()
    assert row.post_fee_usd is None and row.fee_ratio is None and row.post_active_days == 6


def test_late_end_moves_the_anchor(raw):
    late = Campaign(CASE.start, utc("2024-03-29T20:00:00+08:00"))
    assert late.anchor == datetime(2024, 3, 30)
    assert late.window(late.late) == (datetime(2024, 4, 22), datetime(2024, 4, 29))
    assert summary(raw, late)["r30"].n == 4


def test_empty_cohort_has_null_rate(raw):
    empty = summary(raw, Campaign(datetime(2024, 3, 27), CASE.end))
    assert empty["r30"].cohort_size == 0 and empty["r30"].rate is None
    nothing = summary(raw.limit(0))
    assert nothing["r30"].n == 0 and nothing["r30"].rate is None


@pytest.mark.parametrize("index, column, value, rule", [
    (0, "size_delta_usd", "NaN", "size is not finite and non-negative"),
    (0, "size_delta_usd", "-1", "size is not finite and non-negative"),
    (0, "order_created_at", "2026-01-01T00:00:00Z", "creation follows execution"),
    (0, "timestamp", "2023-10-10T12:00:00", "time has no zone or is invalid"),
    (0, "timestamp", "2025-10-10T12:00:00Z", "event outside coverage"),
    (0, "account", "0x" + "0" * 40, "invalid account"), (0, "action", "open", "unknown action"),
    (0, "success", "yes", "unknown success value"), (0, "chain_id", "1", "unexpected chain"),
    (0, "market", None, "malformed row"), (0, "log_index", "-1", "invalid log index")])
def test_row_gate(raw, index, column, value, rule):
    found = gates.validate_rows(changed(raw, index, column, value), 42161, *COVERAGE)
    assert rule in {r.rule for r in found.collect()}
    with pytest.raises(ValueError):
        gates.enforce(found)


def test_row_gate_accepts_the_fixture(raw):
    assert gates.validate_rows(raw, 42161, *COVERAGE).count() == 0


def test_duplicate_gate(raw):
    upper = raw.limit(1).withColumn("tx_hash", F.concat(F.lit("0x"), F.upper(F.substring("tx_hash", 3, 64))))
    assert gates.validate_unique_events(raw.unionByName(upper)).first().copies == 2
    assert gates.validate_unique_events(raw).count() == 0


def test_boundary_and_provenance_gates():
    with pytest.raises(ValueError, match="30 full"):
        gates.check_case_boundaries(CASE, COVERAGE[0], datetime(2024, 4, 27))
    with pytest.raises(ValueError, match="the campaign and 30 full"):
        gates.check_case_boundaries(CASE, COVERAGE[1], COVERAGE[0])
    gates.check_provenance({"is_synthetic": False, "boundary_status": "provisional"}, {"is_synthetic": False}, exploratory=True)
    gates.check_provenance({"is_synthetic": True, "boundary_status": "synthetic"}, {"is_synthetic": True})
    assert gates.provenance_problems({"is_synthetic": False, "boundary_status": "synthetic"}, {"is_synthetic": False})
    with pytest.raises(ValueError, match="nobody verified"):
        gates.check_provenance({"is_synthetic": False, "boundary_status": "provisional"}, {"is_synthetic": False})
    with pytest.raises(ValueError, match="different things"):
        gates.check_provenance({"is_synthetic": True, "boundary_status": "synthetic"}, {"is_synthetic": False})
    with pytest.raises(ValueError, match="timezone"):
        utc("2024-03-29T00:00:00")
    with pytest.raises(ValueError, match="precede"):
        Campaign(CASE.end, CASE.start)


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "snapshot")
    raw.write.option("header", True).csv(path)
    trades = campaign_case.load_checked(spark, path, 42161, COVERAGE)
    assert trades.count() == 23 and dict(trades.dtypes)["position_fee_usd"] == "decimal(38,12)"
    tables = campaign_case.describe_campaign(trades, CASE, COVERAGE)
    campaign_case.write_case(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/wallet_cohorts")).count() == 6
    raw.drop("market").write.option("header", True).csv(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="required columns"):
        se.read_event_text(spark, str(tmp_path / "short"))


def test_return_flags_are_nested(raw):
    profile = co.retention_profile(se.type_events(raw), CASE)
    assert profile.filter("sustained30 AND NOT r30 OR r30 AND NOT cumulative30 OR r30 AND NOT open_or_decrease30").count() == 0


def test_top_percent_breaks_ties_by_account(spark):
    rows = spark.createDataFrame([(f"a{i:03d}", 5.0, i == 0) for i in range(150)], "account string, campaign_volume_usd double, r30 boolean")
    found = {r.label: (r.size, r.r30_n) for r in ranking.exclude_top_percent(rows).collect()}
    assert found == {"all": (150, 1), "excluding_top": (148, 0)}
