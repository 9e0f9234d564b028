"""Feature scaling and return models."""

from __future__ import annotations

from functools import lru_cache, partial, reduce

from pyspark.sql import DataFrame, functions as F

from recohort.contracts import FEATURES, LOG_FEATURES
from recohort.operators import evaluation as ev, models as mo
from recohort.suite import tables as t
from recohort.suite.registry import query, rounded
from recohort.suite.samples import study_samples


@lru_cache(maxsize=4)
def _prepared(spark, d):
    """Scaled study rows, written once per session and folder."""
    return mo.prepared(study_samples(spark, d))


_SAMPLES = t.STUDY_SQL + ", " + t.samples_sql(t.STUDY_START)


def _scaler_sql() -> str:
    parts = []
    for name in mo.SCALED:
        value = f"ln(1 + {name})" if name in LOG_FEATURES else name
        parts.append(f"SELECT '{name}' AS feature, avg({value}) AS mean, stddev_pop({value}) AS deviation, count(*) AS fit_rows FROM samples WHERE split = 'train'")
    return _SAMPLES + f", s AS ({' UNION ALL '.join(parts)}) " + """
SELECT feature, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(CASE WHEN deviation <= abs(mean) * 1e-14 THEN 1 ELSE deviation END, 6) AS scale, fit_rows FROM s"""


@query("fit_scaler_train_only", _scaler_sql())
def _scaler(spark, d):
    return rounded(mo.fit_scaler_train_only(study_samples(spark, d)), "mean", "deviation", "scale", digits=6)


@query("score_constant", _SAMPLES + """
SELECT account, as_of, split, label, round((SELECT avg(label) FROM samples WHERE split = 'train'), 9) AS score FROM samples""")
def _constant(spark, d):
    return rounded(mo.score_constant(study_samples(spark, d)), "score")


@query("score_recency", _SAMPLES + " SELECT account, as_of, split, label, -days_since_last_opening AS score FROM samples")
def _recency(spark, d):
    return mo.score_recency(study_samples(spark, d))


# Fits are kept for a session and folder, because several queries look at the same models.

@lru_cache(maxsize=4)
def _logistic_fit(spark, d):
    return mo.fit_logistic(_prepared(spark, d))


@lru_cache(maxsize=4)
def _boosting_fit(spark, d):
    return mo.fit_boosting(_prepared(spark, d))


@lru_cache(maxsize=4)
def _network_fits(spark, d):
    return mo.fit_networks(_prepared(spark, d))


@query("score_logistic")
def _logistic(spark, d):
    return rounded(mo.score_model(_logistic_fit(spark, d), _prepared(spark, d)), "score", digits=6)


@query("score_boosting")
def _boosting(spark, d):
    return rounded(mo.score_model(_boosting_fit(spark, d), _prepared(spark, d)), "score", digits=6)


def _network_scores(spark, d):
    rows = _prepared(spark, d)
    return reduce(DataFrame.unionByName, [mo.score_model(f, rows).withColumn("seed", F.lit(seed)) for seed, f in _network_fits(spark, d).items()])


@query("score_mlp")
def _mlp(spark, d):
    return rounded(_network_scores(spark, d), "score", digits=6)


_WEIGHTS = (*FEATURES, "intercept")
_SETTLED = 1e-5  # Largest component of the gradient of the mean loss, which is about 0.1.


@query("logistic_optimality", _SAMPLES + f""", train AS (SELECT count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS p FROM samples WHERE split = 'train')
SELECT unnest([{', '.join(f"'{name}'" for name in _WEIGHTS)}]) AS feature, TRUE AS settled, n AS train_rows, p AS train_positives FROM train""")
def _optimality(spark, d):
    """The fitted weights satisfy the conditions of the optimum, whatever solver found them."""
    found = mo.optimality(_logistic_fit(spark, d), _prepared(spark, d))
    return found.select("feature", (F.abs("gradient") <= _SETTLED).alias("settled"), "train_rows", "train_positives")


_RUNS = [("logistic_regression", 0), ("gradient_boosting", 0), *(("mlp", seed) for seed in mo.SEEDS)]


@query("scored_runs", _SAMPLES + f", runs(model, seed) AS (VALUES {', '.join(f'({name!r}, {seed})' for name, seed in _RUNS)})" + """
SELECT model, CAST(seed AS BIGINT) AS seed, split, count(*) AS rows, count(DISTINCT account) AS accounts, CAST(sum(label) AS BIGINT) AS positives,
  count(*) AS in_range FROM runs, samples GROUP BY 1, 2, 3""")
def _scored_runs(spark, d):
    """Every learned run scores every sample of every split, with a probability."""
    rows = _prepared(spark, d)
    # Boosting is many short passes, the networks are few long ones: together they fill the cluster.
    mo.together(spark, [partial(fit, spark, d) for fit in (_logistic_fit, _boosting_fit, _network_fits)])
    one = [mo.score_model(_logistic_fit(spark, d), rows).withColumn("model", F.lit("logistic_regression")),
           mo.score_model(_boosting_fit(spark, d), rows).withColumn("model", F.lit("gradient_boosting"))]
    every = reduce(DataFrame.unionByName, one).withColumn("seed", F.lit(0)).unionByName(_network_scores(spark, d).withColumn("model", F.lit("mlp")))
    per_account = every.groupBy("model", "seed", "split", "account").agg(
        F.count("*").alias("rows"), F.sum("label").alias("positives"), F.count_if((F.col("score") >= 0) & (F.col("score") <= 1)).alias("in_range"))
    return per_account.groupBy("model", "seed", "split").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("accounts"), F.sum("positives").alias("positives"), F.sum("in_range").alias("in_range"))


@query("permutation_importance")
def _importance(spark, d):
    found = mo.permutation_importance(_network_fits(spark, d)[mo.PRIMARY_SEED], _prepared(spark, d))
    return rounded(found, "ap_drop_mean", "ap_drop_std", digits=6)


# A fixed linear score over all features, in steps that doubles hold, so that both engines see the same ties.
_POINTS = {name: (1 if k % 2 else -1) * 2.0 ** -(k % 5) for k, name in enumerate(FEATURES)}
_REPEATS = 10


def _linear(rows):
    return rows.withColumn("score", reduce(lambda a, b: a + b, [F.col(name).cast("double") * F.lit(w) for name, w in _POINTS.items()]))


def _linear_sql(source) -> str:
    return " + ".join(f"CAST({source(name)} AS DOUBLE) * {w}::DOUBLE" for name, w in _POINTS.items())


def _importance_sql() -> str:
    one = ("SELECT {rep} AS rep, '{name}' AS feature, o.account, o.label, {score} AS score FROM {rows}")
    parts = [one.format(rep="d.rep", name=f, rows="own o JOIN donors d ON d.position = o.position", score=_linear_sql(lambda n, f=f: f"d.{n}" if n == f else f"o.{n}"))
             for f in FEATURES]
    return _SAMPLES + f""",
val AS (SELECT account, label, {', '.join(FEATURES)} FROM samples WHERE split = 'validation'),
own AS (SELECT *, row_number() OVER (ORDER BY account) AS position FROM val),
donors AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY sha256(CAST(account AS VARCHAR) || ':{mo.PRIMARY_SEED}:' || CAST(rep AS VARCHAR)), account) AS position
           FROM val, range(1, {_REPEATS + 1}) AS r(rep)),
scored AS ({one.format(rep=0, name="", rows="own o", score=_linear_sql(lambda n: f"o.{n}"))} UNION ALL {' UNION ALL '.join(parts)}),
steps AS (SELECT rep, feature, score, count(*) AS n, sum(label) AS hits FROM scored GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(n) OVER w AS n_upto, sum(hits) OVER w AS hits_upto, sum(hits) OVER (PARTITION BY rep, feature) AS positives
        FROM steps WINDOW w AS (PARTITION BY rep, feature ORDER BY score DESC)),
ap AS (SELECT rep, feature, sum(hits::DOUBLE * hits_upto / n_upto) / nullif(max(positives), 0)::DOUBLE AS v FROM cum GROUP BY 1, 2)
SELECT feature, round(avg((SELECT v FROM ap WHERE rep = 0) - v), 6) + 0.0::DOUBLE AS ap_drop_mean, round(stddev_pop((SELECT v FROM ap WHERE rep = 0) - v), 6) AS ap_drop_std,
  count(*) AS repeats FROM ap WHERE rep > 0 GROUP BY 1"""


@query("importance_of_given_score", _importance_sql())
def _given_importance(spark, d):
    """Importance needs no fitted model: any score of the features can be explained."""
    return rounded(mo.permutation_importance(_linear, study_samples(spark, d), _REPEATS), "ap_drop_mean", "ap_drop_std", digits=6)


@query("model_metrics")
def _metrics(spark, d):
    """Validation and test metrics of the constant, recency and logistic runs, seen and new accounts apart."""
    from recohort.operators.landmarks import seen_in_training_flag
    samples = mo.pin(study_samples(spark, d), "samples")
    logistic = mo.score_model(_logistic_fit(spark, d), _prepared(spark, d))
    runs = (mo.score_constant(samples).withColumn("model", F.lit("constant"))
            .unionByName(logistic.withColumn("model", F.lit("logistic_regression"))))
    flagged = seen_in_training_flag(runs.filter("split <> 'train'"), samples.filter("split = 'train'"))
    scored = ev.evaluate_scores(flagged, ("model", "split", "seen_in_training"))
    ranks = ev.evaluate_scores(seen_in_training_flag(
        mo.score_recency(samples).filter("split <> 'train'").withColumn("model", F.lit("recency")),
        samples.filter("split = 'train'")), ("model", "split", "seen_in_training"), probability=False)
    out = scored.unionByName(ranks)
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"], digits=6)
