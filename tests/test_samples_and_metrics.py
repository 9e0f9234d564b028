"""Feature boundaries, invariance to the future, metrics against plain formulas, leakage."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recohort.contracts import FEATURES, LOG_FEATURES, landmarks
from recohort.operators import evaluation as ev, landmarks as lm, models as mo, ranking as rk
from recohort.operators.classify import scan_openings
from recohort.plans import return_study

START, END = datetime(2023, 11, 1), datetime(2024, 3, 1)
MARKS = landmarks(START, END, [datetime(2023, 11, 15)], datetime(2024, 1, 1), END)
COVERAGE = (datetime(2023, 9, 1), datetime(2024, 4, 1))
SCHEMA = ("timestamp timestamp_ntz, account int, size_delta_usd double, position_fee_usd decimal(38,12), market int, "
          "action string, success boolean")


def events(spark, *rows):
    from decimal import Decimal
    full = []
    for row in rows:
        fields = {"account": 1, "size": 100.0, "fee": 1, "market": 1, "action": "increase", "success": True, **row[1]}
        full.append((datetime.fromisoformat(row[0]), fields["account"], float(fields["size"]),
                     None if fields["fee"] is None else Decimal(fields["fee"]), fields["market"], fields["action"], fields["success"]))
    return spark.createDataFrame(full, SCHEMA)


def samples(trades):
    return return_study.build_samples(trades, MARKS, START, COVERAGE)


def test_feature_boundaries(spark):
    rows = [("2023-10-01T00:00:00", {}), ("2023-11-01T00:00:00", {"account": 2}),
            ("2023-11-08T00:00:00", {"size": 300, "market": 2}), ("2023-11-08T23:59:59", {"market": 2}),
            ("2023-11-14T23:59:59", {}), ("2023-11-15T00:00:00", {"account": 3}),
            ("2023-11-14T23:00:00", {"account": 4, "success": False}), ("2023-11-14T23:00:00", {"account": 5, "size": 0}),
            ("2023-11-14T23:00:00", {"account": 6, "action": "decrease"}), ("2023-12-07T23:59:59", {"account": 2}),
            ("2023-12-08T00:00:00", {}), ("2023-12-15T00:00:00", {"account": 2})]
    built = samples(events(spark, *rows))
    first, idle = built.filter("split = 'train'").orderBy("account").collect()
    assert (first.account, idle.account) == (1, 2)
    assert (first.opening_count_7d, first.active_days_7d, first.opening_size_usd_7d, first.opening_fee_usd_7d) == (3, 2, 500, 3)
    assert first.market_count_30d == 2 and first.top_market_share_30d == pytest.approx(0.8)
    assert first.days_since_first_observed_opening == 45
    assert first.days_since_last_opening == pytest.approx(1 / 86400, rel=1e-12)
    assert (first.pre_campaign_opening, first.label) == (1, 1)
    assert (idle.opening_count_7d, idle.opening_fee_usd_7d, idle.pre_campaign_opening, idle.label) == (0, 0, 0, 0)
    assert lm.split_summary(built, MARKS).filter("split = 'train'").first().positive == 1
    assert len(FEATURES) == 17 and len(LOG_FEATURES) == 15


def test_later_events_leave_earlier_features_alone(spark):
    base = [("2023-11-02T00:00:00", {}), ("2023-11-02T00:00:00", {"account": 2})]
    later = [("2024-03-24T00:00:00", {"account": 3, "fee": None}), ("2024-03-25T00:00:00", {"size": 999999})]
    before, after = samples(events(spark, *base)), samples(events(spark, *base, *later))
    key = ("account", "as_of", *FEATURES)
    assert sorted(map(str, before.select(*key).collect())) == sorted(map(str, after.select(*key).collect()))
    last = lm.split_summary(after, MARKS).filter("split = 'test'").first()
    assert (last.n, last.positive) == (2, 1)
    stale = after.filter("split = 'test'").first()
    assert (stale.opening_count_60d, stale.market_count_30d, stale.top_market_share_30d) == (0, 0, 0)


def test_joined_forms_agree_with_the_one_pass_form(spark):
    rng = random.Random(3)
    rows = [((datetime(2023, 9, 5) + timedelta(minutes=rng.randrange(200 * 1440))).isoformat(),
             {"account": rng.randrange(25), "market": rng.randrange(3), "size": rng.randrange(1, 500)}) for _ in range(400)]
    opened = scan_openings(events(spark, *rows))
    one = lm.landmark_samples(opened, MARKS, START)
    members = lm.join_landmarks(opened, MARKS, START)
    labels = lm.label_exists(members, opened, MARKS).select("as_of", "account", "label")
    counts = lm.join_trailing_window(members, opened, MARKS, 30).groupBy("as_of", "account").agg(
        F.count("*").alias("c"), F.count_distinct(F.to_date("timestamp")).alias("days"))
    both = members.select("as_of", "account").join(labels, ["as_of", "account"]).join(counts, ["as_of", "account"], "left")
    want = {(r.as_of, r.account, r.label, float(r.c or 0), float(r.days or 0)) for r in both.collect()}
    assert want == {(r.as_of, r.account, r.label, r.opening_count_30d, r.active_days_30d) for r in one.collect()}


def test_fee_gate_and_frozen_counts(spark):
    with pytest.raises(ValueError, match="missing_fees"):
        samples(events(spark, ("2023-11-02T00:00:00", {"fee": None})))
    fine = events(spark, ("2023-11-02T00:00:00", {}), ("2023-11-02T00:00:00", {"account": 2, "fee": None, "size": 0}),
                  ("2023-11-02T00:00:00", {"account": 3, "fee": None, "action": "decrease"}))
    assert lm.split_summary(samples(fine), MARKS).filter("split = 'train'").first().n == 1
    frozen = spark.createDataFrame([(END, 2, 0)], "as_of timestamp_ntz, n int, positive int")
    with pytest.raises(ValueError, match="expected_n"):
        return_study.build_samples(fine, MARKS, START, COVERAGE, frozen)
    with pytest.raises(ValueError, match="60-day"):
        return_study.build_samples(fine, MARKS, START, (datetime(2023, 10, 1), COVERAGE[1]))
    with pytest.raises(ValueError, match="label window"):
        return_study.build_samples(fine, MARKS, START, (COVERAGE[0], datetime(2024, 3, 30)))


@pytest.mark.parametrize("train, validation, message", [
    ([datetime(2023, 11, 15)], datetime(2023, 12, 1), "mature"), ([datetime(2023, 11, 15)], datetime(2024, 2, 15), "mature"),
    ([datetime(2023, 11, 15)], datetime(2024, 1, 1, 12), "midnight"), ([], datetime(2024, 1, 1), "training cutoffs"),
    ([datetime(2023, 10, 15)], datetime(2024, 1, 1), "increase")])
def test_cutoffs(train, validation, message):
    with pytest.raises(ValueError, match=message):
        landmarks(START, END, train, validation, END)


def plain_metrics(rows, probability=True):
    """AP, top tenth, ROC and losses by direct formulas."""
    n, positives = len(rows), sum(label for _, label, _ in rows)
    steps = {}
    for _, label, score in rows:
        c = steps.setdefault(score, [0, 0])
        c[0] += 1
        c[1] += label
    seen = hits = 0
    ap = []
    for score in sorted(steps, reverse=True):
        seen, hits = seen + steps[score][0], hits + steps[score][1]
        ap.append(steps[score][1] / positives * hits / seen)
    k = math.ceil(n * 0.1)
    top = sum(label for _, label, _ in sorted(rows, key=lambda r: (-r[2], r[0]))[:k])
    wins = sum((p > q) + (p == q) / 2 for _, a, p in rows if a for _, b, q in rows if not b)
    return {"average_precision": math.fsum(ap), "top10_precision": top / k, "top10_recall": top / positives,
            "roc_auc": wins / positives / (n - positives), "brier": math.fsum((s - y) ** 2 for _, y, s in rows) / n}


@pytest.mark.parametrize("levels", [5, 10 ** 9])
def test_metrics_against_formulas(spark, levels):
    rng = random.Random(levels)
    rows = [(f"a{i:04d}", rng.randrange(2), rng.randrange(levels) / levels) for i in range(700)]
    found = ev.evaluate_scores(spark.createDataFrame(rows, "account string, label int, score double").repartition(5)).first()
    for name, value in plain_metrics(rows).items():
        assert found[name] == pytest.approx(value, abs=1e-12), name
    bins = ev.reliability_bins(spark.createDataFrame(rows, "account string, label int, score double")).collect()
    assert sum(b["count"] for b in bins) == 700
    curve = ev.pr_curve_points(spark.createDataFrame(rows, "account string, label int, score double")).collect()
    assert len(curve) <= 500 and curve[0].sampled == (levels > 500)


def test_bins_of_a_dominant_run(spark):
    # Two thirds of all rows belong to one run; bins by run equal the bins of each run alone.
    rng = random.Random(5)
    rows = [(f"a{i:04d}", rng.randrange(2), rng.randrange(40) / 40, "big" if i % 3 else "small") for i in range(900)]
    frame = spark.createDataFrame(rows, "account string, label int, score double, model string")
    together = {(r.model, r.bin, r["count"]) for r in ev.reliability_bins(frame, ("model",)).collect()}
    apart = {(m, r.bin, r["count"]) for m in ("big", "small") for r in ev.reliability_bins(frame.filter(F.col("model") == m)).collect()}
    assert together == apart


def test_ties_and_degenerate_runs(spark):
    def run(rows, **options):
        return ev.evaluate_scores(spark.createDataFrame(rows, "account string, label int, score double"), **options).first()

    tied = [("d", 0, 0.5), ("c", 1, 0.5), ("b", 0, 0.5), ("a", 1, 0.5)]
    found = run(tied)
    assert (found.top10_count, found.top10_precision, found.average_precision) == (1, 1.0, 0.5)
    bins = ev.reliability_bins(spark.createDataFrame(tied, "account string, label int, score double")).collect()
    assert [(b.mean_probability, b.observed_rate, b["count"]) for b in bins] == [(0.5, 0.5, 4)]
    single = run([("a", 0, 0.1), ("b", 0, 0.2)])
    assert single.roc_auc is None and single.average_precision is None and single.top10_recall is None
    assert run([]).prevalence is None
    ranking = run([("a", 0, -10.0), ("b", 1, -1.0)], probability=False)
    assert ranking.average_precision == 1 and ranking.brier is None
    bad = spark.createDataFrame([("a", 0, -10.0), ("b", 2, 0.5), ("c", 1, float("nan"))], "account string, label int, score double")
    assert sorted(r.rule for r in ev.scored_faults(bad).collect()) == ["label is not 0 or 1", "score is out of range", "score is out of range"]


def test_running_totals_with_a_hot_value(spark):
    # A third of all rows share one value; totals by group must still be exact.
    rng = random.Random(9)
    rows = [(i % 2, 7 if i % 3 == 0 else rng.randrange(1000), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g int, v int, id int").repartition(8)
    placed = rk.positions(frame, [F.asc("v"), F.asc("id")], ("g",)).collect()
    for g in (0, 1):
        order = sorted((v, i) for k, v, i in rows if k == g)
        assert [(r.v, r.id) for r in sorted((r for r in placed if r.g == g), key=lambda r: r.position)] == order
        assert {r.group_size for r in placed if r.g == g} == {len(order)}
    found = {r["g"]: r["median"] for r in rk.medians(frame, "v", ("g",)).collect()}
    for g in (0, 1):
        values = sorted(v for k, v, _ in rows if k == g)
        assert found[g] == (values[len(values) // 2 - 1] + values[len(values) // 2]) / 2


@pytest.fixture(scope="module")
def study(spark):
    out = []
    for split, count, day in (("train", 64, 17), ("validation", 16, 21), ("test", 16, 27)):
        for i in range(count):
            values = {name: float(i % 9 + 1) for name in FEATURES}
            values.update(pre_campaign_opening=float(i % 2), top_market_share_30d=(i % 4) / 4, days_since_last_opening=float(i))
            account = i if split != "test" or i < 8 else i + 100
            out.append((account, datetime(2024, 1, day), split, i % 2, *[values[n] for n in FEATURES]))
    return spark.createDataFrame(out, "account int, as_of timestamp_ntz, split string, label int, "
                                 + ", ".join(f"{n} double" for n in FEATURES))


def test_scaler_sees_training_rows_only(study):
    moved = study.withColumn("opening_size_usd_30d", F.when(F.col("split") != "train", 1e15).otherwise(F.col("opening_size_usd_30d")))
    fit = {r.feature: (r["mean"], r["scale"]) for r in mo.fit_scaler_train_only(study).collect()}
    assert fit == {r.feature: (r["mean"], r["scale"]) for r in mo.fit_scaler_train_only(moved).collect()}
    values = [math.log1p(i % 9 + 1) for i in range(64)]
    mean = math.fsum(values) / 64
    assert fit["opening_count_7d"][0] == pytest.approx(mean)
    assert fit["opening_count_7d"][1] == pytest.approx(math.sqrt(math.fsum((v - mean) ** 2 for v in values) / 64))
    assert "pre_campaign_opening" not in fit and len(fit) == 16


def test_feature_gate(study):
    assert lm.validate_features(study).count() == 0
    broken = study.withColumns({"opening_fee_usd_7d": F.lit(float("nan")), "pre_campaign_opening": F.lit(0.5), "top_market_share_30d": F.lit(2.0)})
    assert {r.feature for r in lm.validate_features(broken).collect()} == {"opening_fee_usd_7d", "pre_campaign_opening", "top_market_share_30d"}
    with pytest.raises(ValueError, match="contract"):
        lm.validate_features(study.withColumn("future_label", F.lit(1.0)))


def test_study_runs_and_ignores_test_labels(study):
    found = return_study.run_study(study, repeats=2, seeds=(42,), rounds=(3, 5), iterations=(5, 10))
    assert found["predictions"].count() == 5 * 16
    assert found["predictions"].filter("seen_in_training = 1").count() == 5 * 8
    assert found["metrics"].count() == 2 * 5 and found["importance"].count() == 17
    chosen = found["selected"].first().selected_model
    flipped = study.withColumn("label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    again = return_study.run_study(flipped, repeats=1, seeds=(42,), rounds=(3, 5), iterations=(5, 10))
    assert again["selected"].first().selected_model == chosen
    key = ("model", "seed", "average_precision")
    assert sorted(map(str, found["metrics"].filter("split = 'validation'").select(*key).collect())) == sorted(
        map(str, again["metrics"].filter("split = 'validation'").select(*key).collect()))


def test_whole_curve_has_every_threshold(spark):
    rows = [(f"a{i:04d}", i % 3 % 2, i / 1000) for i in range(1000)]
    scores = spark.createDataFrame(rows, "account string, label int, score double")
    curve = ev.pr_curve(scores).orderBy("point").collect()
    assert [r.threshold for r in curve] == [i / 1000 for i in range(1000)] + [None]
    assert [r.point for r in curve] == list(range(1001)) and (curve[-1].precision, curve[-1].recall) == (1.0, 0.0)
    thinned = {r.point: tuple(r[1:4]) for r in ev.pr_curve_points(scores).collect()}
    assert len(thinned) == 500 and all(tuple(curve[p][1:4]) == r for p, r in thinned.items())


def test_gradient_is_zero_at_the_fitted_weights(study):
    rows = mo.prepared(study)
    fitted = mo.fit_logistic(rows, (0.5, 5.0))
    found = {r.feature: r for r in mo.optimality(fitted, rows).collect()}
    assert set(found) == {*FEATURES, "intercept"} and all(abs(r.gradient) < 1e-5 for r in found.values())
    assert {(r.train_rows, r.train_positives) for r in found.values()} == {(64, 32)}
    # By hand, and not zero elsewhere: the same weights under another penalty.
    train = [r for r in mo.score_model(fitted, rows.select("*", F.array(*FEATURES).alias("x"))).collect() if r.split == "train"]
    for i, name in enumerate(FEATURES):
        by_hand = sum((r.score - r.label) * r.x[i] for r in train) / 64 + found[name].weight / (fitted.setting * 64)
        assert found[name].gradient == pytest.approx(by_hand, abs=1e-12)
    other = mo.Fitted(fitted.name, fitted.model, fitted.setting / 100, ())
    assert max(abs(r.gradient) for r in mo.optimality(other, rows).collect()) > 1e-3


def test_first_trees_of_a_long_fit_are_the_short_fit(study):
    rows = mo.prepared(study.withColumn("label", F.when(F.col("opening_count_7d") > 4, 1).otherwise(F.col("label"))))
    together = mo.fit_boosting(rows, (3, 8))
    staged = mo.staged_scores(together.model, rows, [3, 8])
    for rounds in (3, 8):
        alone = mo.fit_boosting(rows, (rounds,))
        pairs = staged.join(mo.score_model(alone, rows), ["account", "as_of"])
        assert pairs.agg(F.max(F.abs(F.col("score") - F.col(f"score_{rounds}")))).first()[0] < 1e-12
        assert dict(together.candidates)[float(rounds)] == alone.candidates[0][1]
    assert together.rounds == int(together.setting)
    assert mo.score_model(together, rows).columns == ["account", "as_of", "split", "label", "score"]


def test_importance_of_a_given_score(study):
    rows = study.filter("split = 'validation'").collect()
    found = {r.feature: r for r in mo.permutation_importance(
        lambda frame: frame.withColumn("score", F.col("opening_count_7d") + F.col("top_market_share_30d")), study, repeats=4, seed=7).collect()}

    def precision(pairs):
        pairs = sorted(pairs, reverse=True)
        total, hits, value = sum(label for _, label in pairs), 0, 0.0
        for score in sorted({s for s, _ in pairs}, reverse=True):
            own = [label for s, label in pairs if s == score]
            hits += sum(own)
            value += sum(own) / total * hits / sum(s >= score for s, _ in pairs)
        return value

    rows = sorted(rows, key=lambda r: r.account)
    base = precision([(r.opening_count_7d + r.top_market_share_30d, r.label) for r in rows])
    for feature in FEATURES:
        drops = []
        for rep in range(1, 5):
            donors = sorted(rows, key=lambda r: (hashlib.sha256(f"{r.account}:7:{rep}".encode()).hexdigest(), r.account))
            mixed = [{**r.asDict(), feature: d[feature]} for r, d in zip(rows, donors, strict=True)]
            drops.append(base - precision([(m["opening_count_7d"] + m["top_market_share_30d"], m["label"]) for m in mixed]))
        assert found[feature].ap_drop_mean == pytest.approx(sum(drops) / 4, abs=1e-12) and found[feature].repeats == 4
    assert found["opening_count_60d"].ap_drop_std == 0


def test_null_groups_are_groups(spark):
    rows = [(g, f"a{i:02d}", int(i % 3 == 0), [0.9, 0.4, 0.4, 0.1][i % 4] if g != "flat" else 0.5) for g in (None, "x", "flat") for i in range(21)]
    scores = spark.createDataFrame(rows, "g string, account string, label int, score double")
    together = {r.g: r.asDict() for r in ev.evaluate_scores(scores, ("g",)).collect()}
    assert set(together) == {None, "x", "flat"}
    for group in together:
        alone = ev.evaluate_scores(scores.filter(F.col("g").eqNullSafe(group))).first().asDict()
        assert {**alone, "g": group} == together[group] and alone["average_precision"] is not None
    assert {k: v for k, v in together[None].items() if k != "g"} == {k: v for k, v in together["x"].items() if k != "g"}
    bins = {}
    for r in ev.reliability_bins(scores, ("g",), bins=4).collect():
        bins.setdefault(r.g, set()).add((r.bin, round(r.mean_probability, 9), r["count"]))
    assert bins[None] == bins["x"] and sum(c for _, _, c in bins[None]) == 21 and bins["flat"] == {(0, 0.5, 21)}
    sub = {r.subgroup: r.average_precision for r in ev.subgroup_metrics(scores.drop("g"), F.when(F.col("label") == 1, "pos"), ()).collect()}
    assert sub == {"pos": 1.0, None: None}


@pytest.mark.parametrize("size", [1, 10, 11, 40])
def test_top_tenth_with_ties_at_its_edge(spark, size):
    for seed in range(3):
        random.seed(seed)
        rows = [(f"a{i:03d}", random.randrange(2), random.choice([0.2, 0.8, 0.8])) for i in range(size)]
        found = ev.evaluate_scores(spark.createDataFrame(rows, "account string, label int, score double").repartition(4)).first()
        best = sorted(rows, key=lambda r: (-r[2], r[0]))[:math.ceil(size * 0.1)]
        assert (found.top10_count, found.top10_precision) == (len(best), sum(r[1] for r in best) / len(best))
        assert found.brier == pytest.approx(sum((s - y) ** 2 for _, y, s in rows) / size)


def test_statistics_leave_nulls_out(spark):
    rows = [("a", None), ("a", None), ("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), (None, None), (None, 6.0), (None, 100.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    assert {r.g: r["median"] for r in rk.medians(frame, "v", ("g",)).collect()} == {"a": 2.0, "b": None, None: 6.0}
    assert {r.g: r.quantiles for r in rk.linear_quantiles(frame, "v", [0.0, 0.5, 1.0], ("g",)).collect()} == {
        "a": [1.0, 2.0, 3.0], "b": [None] * 3, None: [5.0, 6.0, 100.0]}
    assert {(r.g, r["quantile"]): r.value for r in rk.floor_percentiles(frame, "v", [0.5], ("g",)).collect()} == {("a", 0.5): 1.0, ("b", 0.5): None, (None, 0.5): 6.0}
