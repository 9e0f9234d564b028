"""Feature scaling and return models on pyspark.ml, chosen by validation average precision.

Only fitted parameters and one metric per candidate reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recohort.contracts import BINARY_FEATURE, FEATURES, LOG_FEATURES
from recohort.operators.evaluation import average_precision, variant_precision
from recohort.operators.ranking import numbered
from recohort.session import enough_parts, pin, shared_folder

SEEDS = (17, 42, 73)  # Fixed values: seeds of the neural runs; 42 is the primary one.
PRIMARY_SEED = 42
PARALLEL = 4  # Fits that run at once.
ROWS_PER_TASK = 100_000
ROWS_SORTED = 500_000  # Rows of a slice that is sorted and written.
SCALED = tuple(name for name in FEATURES if name != BINARY_FEATURE)
_ID = ("account", "as_of", "split", "label")


@dataclass(frozen=True)
class Fitted:
    """A model, the setting that won on validation, and every candidate's validation score.

    ``rounds`` says how many trees of a boosted model count; the model may have more.
    """

    name: str
    model: Model
    setting: float
    candidates: tuple[tuple[float, float | None], ...]
    rounds: int | None = None


def _logged(name: str) -> Column:
    return F.log1p(F.col(name)) if name in LOG_FEATURES else F.col(name).cast("double")


def fit_scaler_train_only(samples: DataFrame) -> DataFrame:
    """Mean, population deviation and scale per feature from training rows only; a zero deviation scales by 1."""
    train = samples.filter(F.col("split") == "train")
    measures = [m for name in SCALED for m in (F.avg(_logged(name)).alias(f"m_{name}"),
                                               F.stddev_pop(_logged(name)).alias(f"s_{name}"))]
    row = train.agg(F.count("*").alias("fit_rows"), *measures)
    items = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"m_{name}").alias("mean"),
                               F.col(f"s_{name}").alias("deviation")) for name in SCALED])
    # Rounding noise of a constant feature is not a deviation.
    tiny = F.col("i.deviation") <= F.abs(F.col("i.mean")) * 1e-14
    return row.select("fit_rows", F.explode(items).alias("i")).select(
        "i.feature", "i.mean", "i.deviation",
        F.when(tiny, 1.0).otherwise(F.col("i.deviation")).alias("scale"), "fit_rows")


def scale_features(samples: DataFrame, scaler: DataFrame) -> DataFrame:
    """Apply a fitted scaler; the binary flag stays as it is."""
    fitted = {row["feature"]: row for row in scaler.collect()}  # one row per feature
    columns = {BINARY_FEATURE: F.col(BINARY_FEATURE).cast("double")}
    for name in SCALED:
        columns[name] = (_logged(name) - F.lit(fitted[name]["mean"])) / F.lit(fitted[name]["scale"])
    return samples.select(*_ID, *[columns[name].alias(name) for name in FEATURES])


def with_vector(scaled: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scaled)


def _kept(rows: DataFrame) -> list[str]:
    return [name for name in rows.columns if name not in ("features", *FEATURES)]


def _scored(model: Model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(*_kept(rows), vector_to_array("probability")[1].alias("score"))


def staged_scores(model: Model, rows: DataFrame, stages: list[int]) -> DataFrame:
    """Scores of a boosted model cut off after each number of rounds, one column ``score_<rounds>`` each.

    Boosting adds one tree a round, so the first trees of a long fit are the model of a shorter one,
    and their weighted sum is its margin.
    """
    trees, weights, kept = model.trees, model.treeWeights, _kept(rows)
    out, margin, found = rows, F.lit(0.0), {}
    for k in range(max(stages)):
        out = trees[k].setPredictionCol(f"_tree{k}").transform(out)
        margin = margin + F.lit(float(weights[k])) * F.col(f"_tree{k}")
        if k + 1 in stages:
            found[k + 1] = F.lit(1.0) / (1 + F.exp(-2 * margin))
    return out.select(*kept, *[found[stage].alias(f"score_{stage}") for stage in stages])


def together(spark: SparkSession, jobs: list[Callable[[], object]]) -> list:
    """Results of independent fits, which share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(min(len(jobs), PARALLEL)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _training(rows: DataFrame) -> DataFrame:
    """What fits read again and again, kept in memory or on disk; the caller unpersists it.

    A fit is hundreds of short passes, so few rows are not spread thinner than a task is worth.
    """
    train = rows.filter(F.col("split") == "train").select("features", "label")
    return train.coalesce(max(1, -(-train.count() // ROWS_PER_TASK))).persist(StorageLevel.MEMORY_AND_DISK)


def _best(found: dict[int, float | None], count: int) -> int:
    return max(range(count), key=lambda i: (found.get(i) is not None, found.get(i) or 0.0, -i))


def _choose(name: str, rows: DataFrame, settings, build, train: DataFrame | None = None) -> Fitted:
    """Fit every candidate on training rows and keep the best; all are evaluated in one pass.

    ``train`` are kept training rows that several choices share and the caller unpersists.
    """
    kept, validation = _training(rows) if train is None else train, rows.filter(F.col("split") == "validation")
    models = together(rows.sparkSession, [partial(build(setting).fit, kept) for setting in settings])
    if train is None:
        kept.unpersist()
    scored = reduce(DataFrame.unionByName, [
        _scored(model, validation).withColumn("candidate", F.lit(i)) for i, model in enumerate(models)])
    found = {row["candidate"]: row["average_precision"] for row in average_precision(scored, ("candidate",)).collect()}
    best = _best(found, len(models))
    tried = tuple((float(setting), found.get(i)) for i, setting in enumerate(settings))
    return Fitted(name, models[best], float(settings[best]), tried)


def score_constant(samples: DataFrame) -> DataFrame:
    """Training prevalence for every row."""
    prevalence = samples.filter(F.col("split") == "train").agg(F.avg("label")).scalar()
    return samples.select(*_ID, prevalence.alias("score"))


def score_recency(samples: DataFrame) -> DataFrame:
    """Minus days since the last opening: a ranking, not a probability."""
    return samples.select(*_ID, (-F.col("days_since_last_opening")).alias("score"))


def fit_logistic(rows: DataFrame, strengths=(0.1, 1.0, 10.0)) -> Fitted:
    """L2 logistic regression; C is turned into the mean-loss penalty 1 / (C n)."""
    n = rows.filter(F.col("split") == "train").count()
    return _choose("logistic_regression", rows, strengths, lambda c: LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-5))


def optimality(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """Gradient of the penalised mean loss at the fitted weights, one row per feature and one for the intercept.

    At the optimum every component is zero: mean((p - y) x) + weight / (C n), without the penalty for the
    intercept. One aggregate over the training rows, whatever the solver did.
    """
    scored = _scored(fitted.model, rows.filter(F.col("split") == "train").withColumn("_x", F.array(*FEATURES)))
    error = F.col("score") - F.col("label")
    sums = scored.agg(F.count("*").alias("train_rows"), F.count_if(F.col("label") == 1).alias("train_positives"),
                      *[F.avg(error * F.get("_x", F.lit(i))).alias(f"g{i}") for i in range(len(FEATURES))], F.avg(error).alias("g_intercept"))
    names = [*FEATURES, "intercept"]
    weights = [*map(float, fitted.model.coefficients), 0.0]
    parts = [F.struct(F.lit(name).alias("feature"), F.lit(weight).alias("weight"),
                      (F.col("g_intercept" if name == "intercept" else f"g{i}") + F.lit(weight) / (F.lit(fitted.setting) * F.col("train_rows"))).alias("gradient"))
             for i, (name, weight) in enumerate(zip(names, weights, strict=True))]
    return sums.select("train_rows", "train_positives", F.explode(F.array(*parts)).alias("part")).select("part.*", "train_rows", "train_positives")


def fit_boosting(rows: DataFrame, rounds=(100, 200), depth: int = 3, rate: float = 0.05) -> Fitted:
    """Boosted small trees: one fit of the most rounds, whose first trees are the other candidates."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{shared_folder(rows.sparkSession)}/checkpoints")
    train, validation = _training(rows), rows.filter(F.col("split") == "validation")
    # Each round builds on the one before; the interval keeps that lineage short.
    model = GBTClassifier(maxIter=max(rounds), maxDepth=depth, stepSize=rate, seed=PRIMARY_SEED, checkpointInterval=25).fit(train)
    train.unpersist()
    # A fit may end early, when nothing is left to learn.
    stages = sorted({min(r, len(model.trees)) for r in rounds})
    scored = staged_scores(model, validation, stages)
    columns = F.explode(F.array(*[F.struct(F.lit(s).alias("candidate"), F.col(f"score_{s}").alias("score")) for s in stages])).alias("c")
    each = scored.select("account", "label", columns).select("account", "label", "c.*")
    by_stage = {row["candidate"]: row["average_precision"] for row in average_precision(each, ("candidate",)).collect()}
    found = {i: by_stage.get(min(r, len(model.trees))) for i, r in enumerate(rounds)}
    best = _best(found, len(rounds))
    tried = tuple((float(r), found[i]) for i, r in enumerate(rounds))
    return Fitted("gradient_boosting", model, float(rounds[best]), tried, min(rounds[best], len(model.trees)))


def fit_mlp(rows: DataFrame, seed: int = PRIMARY_SEED, iterations=(50, 100), train: DataFrame | None = None) -> Fitted:
    """A 17-32-16 network; the number of iterations is chosen like early stopping would."""
    return _choose("mlp", rows, iterations, lambda m: MultilayerPerceptronClassifier(
        layers=[len(FEATURES), 32, 16, 2], seed=seed, maxIter=m, blockSize=256), train)


def score_model(fitted: Fitted, rows: DataFrame) -> DataFrame:
    if fitted.rounds is not None:
        return staged_scores(fitted.model, rows, [fitted.rounds]).withColumnRenamed(f"score_{fitted.rounds}", "score")
    return _scored(fitted.model, rows)


def score_logistic(rows: DataFrame) -> DataFrame:
    return score_model(fit_logistic(rows), rows)


def score_boosting(rows: DataFrame, rounds=(100, 200)) -> DataFrame:
    return score_model(fit_boosting(rows, rounds), rows)


def fit_networks(rows: DataFrame, seeds=SEEDS, iterations=(50, 100)) -> dict[int, Fitted]:
    """The network of each seed, all fitted at once on the same kept training rows."""
    train = _training(rows)
    fitted = together(rows.sparkSession, [partial(fit_mlp, rows, seed, iterations, train) for seed in seeds])
    train.unpersist()
    return dict(zip(seeds, fitted, strict=True))


def score_mlp(rows: DataFrame, seeds=SEEDS, iterations=(50, 100)) -> DataFrame:
    """Scores of every seed."""
    fitted = fit_networks(rows, seeds, iterations)
    return reduce(DataFrame.unionByName, [score_model(f, rows).withColumn("seed", F.lit(seed)) for seed, f in fitted.items()])


def shuffled_by_key(rows: DataFrame, repeats: int, seed: int, keep: list[Column]) -> DataFrame:
    """For each repeat the rows in an order that depends on key and seed alone: (rep, position, kept columns).

    The order is that of the SHA-256 of ``account:seed:repeat``, so any engine repeats it.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    digest = F.sha2(F.concat_ws(":", F.col("account").cast("string"), F.lit(str(seed)), "rep"), 256)
    drawn = rows.select(reps.alias("rep"), "account", *keep).withColumn("_h", F.unhex(digest))
    parts = enough_parts(rows.sparkSession, rows.count() * repeats, ROWS_SORTED)
    return numbered(drawn, [F.asc("_h"), F.asc("account")], ("rep",), parts, ("_h", "account"))


def permutation_importance(scorer: Fitted | Callable[[DataFrame], DataFrame], rows: DataFrame, repeats: int = 10,
                           seed: int = PRIMARY_SEED) -> DataFrame:
    """Loss of validation average precision when one feature is shuffled: mean and population deviation.

    ``scorer`` is a fitted model, or a function that adds ``score`` to rows with the features, from those alone. A
    repeat's shuffle pairs the rows in the order of their accounts with the rows in a keyed order; the pairs meet on
    the position. A row whose partner has the same value of a feature stays as it is and so keeps its score; all the
    others, of all repeats and features, are scored in one pass.
    """
    def score(found: DataFrame) -> DataFrame:
        return score_model(scorer, with_vector(found)) if isinstance(scorer, Fitted) else scorer(found)

    spark = rows.sparkSession
    validation = pin(rows.filter(F.col("split") == "validation").select("account", "label", *FEATURES), "validation")
    count = validation.count()
    ordered = numbered(validation, [F.asc("account")], (), enough_parts(spark, count, ROWS_SORTED))
    base = pin(score(ordered.withColumn("own", F.array(*FEATURES))).select("position", "account", "label", "own", F.col("score").cast("double").alias("own_score")), "base")
    # Ordered by number alone: a partner's values move once, to the row that they meet.
    order = shuffled_by_key(base, repeats, seed, [F.col("position").alias("giver")])
    parts = enough_parts(spark, count * repeats, ROWS_PER_TASK)
    givers = base.select(F.col("position").alias("giver"), F.col("own").alias("donor")).repartition(parts, "giver")
    donors = order.repartition(parts, "giver").join(givers, "giver").drop("giver")
    pairs = base.repartition(parts, "position").join(donors.repartition(parts, "position"), "position")
    # A fold, because a long list of comparisons is too much code to be compiled with the steps that follow.
    features = F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))
    one = F.call_function("shiftleft", F.lit(1), F.col("f"))
    # Never null, or it would be made once more to tell where it is.
    bits = F.coalesce(F.aggregate(features, F.lit(0), lambda found, i: F.when(F.get("own", i).eqNullSafe(F.get("donor", i)), found).otherwise(
        found + F.call_function("shiftleft", F.lit(1), i))), F.lit(0))
    spread = (pairs.select("rep", "account", "label", "own", "donor", "own_score", bits.alias("bits"))
              .select("*", F.explode(features).alias("f")).filter(F.col("bits").bitwiseAND(one) != 0).withColumn("value", F.get("donor", F.col("f"))))
    mixed = [F.when(F.col("f") == i, F.col("value")).otherwise(F.get("own", F.lit(i))).alias(name) for i, name in enumerate(FEATURES)]
    scored = score(spread.select("rep", "f", "bits", "account", "label", "own_score", *mixed))
    hits, names = F.coalesce(F.col("label").cast("long"), F.lit(0)), ("rep", "bits", "score", "n", "hits")
    # The old score leaves all runs of the repeat at once, beside the lowest changed feature.
    gone = F.when(F.col("bits").bitwiseAND(one - 1) == 0, F.col("bits"))
    changes = scored.select(F.stack(F.lit(2), "rep", one, F.col("score").cast("double"), F.lit(1), hits,
                                    "rep", gone, "own_score", F.lit(-1), -hits).alias(*names)).filter("bits IS NOT NULL")
    records = base.select(F.lit(0), F.lit(0), "own_score", F.lit(1), hits).toDF(*names).unionByName(changes)
    found = variant_precision(records, repeats, len(FEATURES))
    baseline = found.filter("rep = 0").select("average_precision").scalar()
    drops = found.filter("rep > 0").withColumn("drop", baseline - F.col("average_precision"))
    names = F.array(*[F.lit(name) for name in FEATURES])
    return (drops.groupBy(F.get(names, F.col("f")).alias("feature"))
            .agg(F.avg("drop").alias("ap_drop_mean"), F.stddev_pop("drop").alias("ap_drop_std"),
                 F.count("*").alias("repeats")))


def prepared(samples: DataFrame) -> DataFrame:
    """Scaled rows with their vector, written once because every fit reads them many times."""
    fixed = pin(samples, "samples")
    return with_vector(pin(scale_features(fixed, fit_scaler_train_only(fixed)), "scaled"))
