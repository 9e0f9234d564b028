"""The prediction study: gated samples, scaled features, models and held-out metrics."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recohort.contracts import Landmark
from recohort.operators import evaluation as ev, gates, landmarks as lm, models as mo
from recohort.operators.classify import scan_openings
from recohort.session import pin, prepare


def build_samples(trades: DataFrame, marks: list[Landmark], start: datetime,
                  coverage: tuple[datetime, datetime], expected: DataFrame | None = None) -> DataFrame:
    """Samples that passed the fee, feature and frozen-count gates."""
    prepare(trades.sparkSession)
    gates.check_study_boundaries(marks, start, *coverage)
    openings = scan_openings(trades)
    gates.enforce(lm.validate_fee_presence(openings, marks, start))
    samples = pin(lm.landmark_samples(openings, marks, start), "samples")
    gates.enforce(lm.validate_features(samples))
    if expected is not None:
        gates.enforce(lm.expected_counts(lm.split_summary(samples, marks), expected))
    return samples


def run_study(samples: DataFrame, repeats: int = 10, seeds=mo.SEEDS, rounds=(100, 200),
              iterations=(50, 100)) -> dict[str, DataFrame]:
    """Scores of every run, validation and test metrics, subgroups, selection and importance."""
    rows = mo.prepared(samples)
    logistic, boosting = mo.fit_logistic(rows), mo.fit_boosting(rows, rounds)
    networks = mo.fit_networks(rows, seeds, iterations)
    primary = mo.PRIMARY_SEED if mo.PRIMARY_SEED in networks else seeds[0]

    def run(scores: DataFrame, name: str, seed: int | None = None) -> DataFrame:
        return scores.select("account", "as_of", "split", "label", "score").withColumns(
            {"model": F.lit(name), "seed": F.lit(seed).cast("int")})

    probabilities = [run(mo.score_constant(samples), "constant"),
                     run(mo.score_model(logistic, rows), logistic.name), run(mo.score_model(boosting, rows), boosting.name)]
    probabilities += [run(mo.score_model(fitted, rows), fitted.name, seed) for seed, fitted in networks.items()]
    held = F.col("split") != "train"
    train = samples.filter("split = 'train'")
    scored = pin(lm.seen_in_training_flag(reduce(DataFrame.unionByName, probabilities).filter(held), train), "scores")
    ranked = pin(lm.seen_in_training_flag(run(mo.score_recency(samples), "recency").filter(held), train), "scores")
    key, group = ("model", "seed", "split"), F.col("seen_in_training")
    gates.enforce(ev.scored_faults(scored))
    gates.enforce(ev.scored_faults(ranked, probability=False))
    steps, ranked_steps = ev.score_steps(scored, key), ev.score_steps(ranked, key)
    metrics = pin(ev.evaluate_scores(scored, key, steps=steps).unionByName(
        ev.evaluate_scores(ranked, key, probability=False, steps=ranked_steps)), "metrics")
    subgroups = ev.subgroup_metrics(scored, group, key).unionByName(ev.subgroup_metrics(ranked, group, key, probability=False))
    validation = metrics.filter((F.col("split") == "validation") & ((F.col("model") != "mlp") | (F.col("seed") == primary)))
    return {
        "predictions": scored.unionByName(ranked).filter("split = 'test'"), "metrics": metrics, "subgroups": subgroups,
        "reliability": ev.reliability_bins(scored, key, steps=steps),
        "pr_curve": ev.pr_curve(scored, key, steps).unionByName(ev.pr_curve(ranked, key, ranked_steps)),
        "selected": ev.select_model(validation, [logistic.name, boosting.name, "mlp"]),
        "importance": mo.permutation_importance(networks[primary], rows, repeats),
        "feature_shift": lm.feature_shift(samples),
    }
