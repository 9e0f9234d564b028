"""Ranking and probability metrics over scored rows; tied scores are one step.

Rows need ``account``, ``label`` (0/1) and ``score``; ``within`` names the columns of a run
(model, seed, subgroup ...). Every metric is computed for all runs at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recohort.functions.scalars import is_finite, rate
from recohort.operators.ranking import join_groups, positions, running_totals, top_count
from recohort.session import enough_parts, pin

_SALTS = 256


def scored_faults(scores: DataFrame, probability: bool = True) -> DataFrame:
    """Rows whose label or score cannot be evaluated."""
    bad_label = F.col("label").isNull() | ~F.col("label").isin(0, 1)
    bad_score = ~is_finite(F.col("score"))
    if probability:
        bad_score = bad_score | (F.col("score") < 0) | (F.col("score") > 1)
    rules = F.array_compact(F.array(F.when(bad_label, "label is not 0 or 1"),
                                    F.when(bad_score, "score is out of range")))
    return scores.select("*", F.explode(rules).alias("rule"))


def score_steps(scores: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct score, with counts at and above it."""
    steps = scores.groupBy(*within, "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    placed = running_totals(steps, [F.desc("score")], {
        "n": F.col("n"), "hits": F.col("hits"), "steps": F.lit(1).cast("long")}, within)
    return placed.withColumns({"n_upto": F.col("n_before") + F.col("n"),
                               "hits_upto": F.col("hits_before") + F.col("hits")})


def average_precision(scores: DataFrame, within: tuple[str, ...] = (), steps: DataFrame | None = None) -> DataFrame:
    """Sum of recall steps times precision; null without positives."""
    steps = score_steps(scores, within) if steps is None else steps
    gain = F.col("hits").cast("double") * F.col("hits_upto") / F.col("n_upto")
    return (steps.groupBy(*within).agg(F.sum(gain).alias("gain"), F.sum("hits").alias("positives"))
            .select(*within, rate(F.col("gain"), F.col("positives")).alias("average_precision")))


def variant_precision(records: DataFrame, repeats: int, width: int, most: int = 1_000_000) -> DataFrame:
    """Average precision of a base run and of ``repeats`` x ``width`` runs that differ from it in some rows.

    ``records`` (rep, bits, score, n, hits) with rep 0 are the rows of the base run. One with another rep is a row that
    the runs (rep, f) have besides (n = 1), or have no longer (n = -1, hits negative), for every bit f of ``bits``.
    Rows that a run shares with the base are moved and ordered once for all runs. A slice of the scores gives, for each
    run, its counts and its steps with positives; what lies above a slice is added afterwards. The base is run (0, 0).
    """
    run = F.call_function("shiftleft", F.col("rep").cast("long"), F.lit(width)).bitwiseOR(F.col("bits").cast("long"))
    kept = pin(records.select((run * F.col("n")).alias("run"), "score", "hits"), "records")
    sliced = kept.repartitionByRange(enough_parts(kept.sparkSession, kept.count(), most), "score").select("run", "score", "hits")
    steps = pin(sliced.mapInArrow(_slice_steps(repeats, width), "slice long, rep int, f int, n long, hits long, "
                                  "step_hits array<long>, hits_upto array<long>, n_upto array<long>"), "steps")
    above = Window.partitionBy("rep", "f").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.select("slice", "rep", "f", *[F.coalesce(F.sum(name).over(above), F.lit(0)).alias(f"{name}_above") for name in ("n", "hits")])
    gain = F.aggregate(F.arrays_zip("step_hits", "hits_upto", "n_upto"), F.lit(0.0), lambda total, step: total + step["step_hits"].cast("double") * (
        step["hits_upto"] + F.col("hits_above")) / (step["n_upto"] + F.col("n_above")))
    return (steps.join(offsets, ["slice", "rep", "f"]).groupBy("rep", "f").agg(F.sum(gain).alias("gain"), F.sum("hits").alias("positives"))
            .select("rep", "f", rate(F.col("gain"), F.col("positives")).alias("average_precision")))


def _slice_steps(repeats: int, width: int, loose: int = 4_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and steps of every run over one slice of the scores. Equal records are summed when many have gathered."""
    def ordered(batch: pa.RecordBatch) -> np.ndarray:
        """Keys that rise as scores fall: NaN first, as in Spark's order, null last; zeros are one."""
        score = batch.column("score")
        values = score.to_numpy(zero_copy_only=False).astype(float) + 0.0
        values[np.isnan(values)] = np.nan
        bits = values.view(np.int64)
        rising = bits ^ ((bits >> 63) & np.iinfo(np.int64).max)
        rising[score.is_null().to_numpy(zero_copy_only=False)] = np.iinfo(np.int64).min
        return ~rising

    def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums of sorted rows with equal keys."""
        new = np.ones(len(keys[0]), bool)
        if len(new):
            new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
        first = np.flatnonzero(new)
        return [key[first] for key in keys], [np.add.reduceat(value, first) if len(first) else value for value in values]

    def upto(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, gathered, bound = [], 0, loose
        for batch in batches:
            run, hits = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("run", "hits"))
            parts.append((np.abs(run), ordered(batch), np.where(run < 0, -1, 1), hits))
            gathered += len(run)
            if gathered > bound:
                columns = [np.concatenate(column) for column in zip(*parts, strict=True)]
                order = np.lexsort(columns[1::-1])
                keys, values = summed([column[order] for column in columns[:2]], [column[order] for column in columns[2:]])
                parts, gathered = [(*keys, *values)], len(keys[0])
                bound = max(loose, 2 * gathered)
        if not gathered:
            return
        run, key, n, hits = (np.concatenate(column) for column in zip(*parts, strict=True))
        rep = run >> width
        by_rep = np.argsort(rep.astype(np.min_scalar_type(repeats)), kind="stable")
        edges = np.searchsorted(rep[by_rep], np.arange(repeats + 2))
        found, lists = [], [[], [], []]
        for r in range(repeats + 1):
            own = by_rep[edges[r]:edges[r + 1]]
            own = own[np.argsort(key[own])]
            own_bits, own_key, own_n, own_hits = (column[own] for column in (run, key, n, hits))
            if not r:
                (base,), (base_n, base_hits) = summed([own_key], [own_n, own_hits])
                positive, base_n, base_hits = base[base_hits != 0], upto(base_n), upto(base_hits)
            for f in range(width if r else 1):
                here = np.flatnonzero(own_bits >> f & 1) if r else np.empty(0, int)
                (other,), (other_n, other_hits) = summed([own_key[here]], [own_n[here], own_hits[here]])
                points = np.union1d(positive, other[other_hits != 0])
                other_n, other_hits = upto(other_n), upto(other_hits)
                to, at = np.searchsorted(base, points, "right"), np.searchsorted(other, points, "right")
                n_upto, hits_upto = base_n[to] + other_n[at], base_hits[to] + other_hits[at]
                step = hits_upto - base_hits[np.searchsorted(base, points)] - other_hits[np.searchsorted(other, points)]
                some = step != 0
                found.append((r, f, base_n[-1] + other_n[-1], base_hits[-1] + other_hits[-1], np.count_nonzero(some)))
                for values, one in zip(lists, (step, hits_upto, n_upto), strict=True):
                    values.append(one[some])
        reps, fs, ns, sums, sizes = map(np.array, zip(*found, strict=True))
        offsets = pa.array(upto(sizes).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(reps), key.min())), pa.array(reps.astype(np.int32)), pa.array(fs.astype(np.int32)), pa.array(ns), pa.array(sums),
             *[pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values))) for values in lists]],
            names=["slice", "rep", "f", "n", "hits", "step_hits", "hits_upto", "n_upto"])

    return each


def roc_auc(scores: DataFrame, within: tuple[str, ...] = (), steps: DataFrame | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties half; null with one class."""
    steps = score_steps(scores, within) if steps is None else steps
    sized = steps.withColumns({"misses": F.col("n") - F.col("hits"),
                               "misses_above": F.col("n_before") - F.col("hits_before")})
    # Negatives above a positive are lost pairs; doubled counts stay whole numbers.
    lost = F.col("hits").cast("decimal(38,0)") * (F.col("misses_above") * 2 + F.col("misses"))
    totals = sized.groupBy(*within).agg(F.sum(lost).cast("double").alias("lost"),
                                        F.sum("hits").alias("positives"), F.sum("misses").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.select(*within, (F.lit(1.0) - rate(F.col("lost"), pairs * 2)).alias("roc_auc"))


def pr_curve(scores: DataFrame, within: tuple[str, ...] = (), steps: DataFrame | None = None) -> DataFrame:
    """Precision and recall at every threshold in ascending order, then the (1, 0) end point."""
    steps = score_steps(scores, within) if steps is None else steps
    known = steps.filter("hits_total > 0").withColumn("thresholds", F.col("steps_total"))
    point = known.select(*within, (F.col("thresholds") - F.col("steps_before") - 1).alias("point"),
                         rate(F.col("hits_upto"), F.col("n_upto")).alias("precision"),
                         rate(F.col("hits_upto"), F.col("hits_total")).alias("recall"),
                         F.col("score").cast("double").alias("threshold"), "thresholds")
    end = (known.groupBy(*within).agg(F.max("thresholds").alias("thresholds")).filter("thresholds IS NOT NULL")
           .select(*within, F.col("thresholds").alias("point"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                   F.lit(None).cast("double").alias("threshold"), "thresholds"))
    return point.unionByName(end).withColumn("full_point_count", F.col("thresholds") + 1).drop("thresholds")


def pr_curve_points(scores: DataFrame, within: tuple[str, ...] = (), most: int = 500,
                    steps: DataFrame | None = None) -> DataFrame:
    """The curve for drawing: above ``most`` points it is thinned evenly and marked. ``pr_curve`` has every point."""
    full = F.col("full_point_count")
    kept = F.least(full, F.lit(most))
    step = (full - 1).cast("double") / F.greatest(kept - 1, F.lit(1)).cast("double")
    # A point survives when some index lands on it after flooring.
    index = F.floor(F.col("point") / step)
    lands = F.exists(F.array(index - 1, index, index + 1), lambda i: (
        (i >= 0) & (i < kept) & (F.when(i == kept - 1, full - 1).otherwise(F.floor(i * step)) == F.col("point"))))
    return (pr_curve(scores, within, steps).filter((full <= most) | lands)
            .select(*within, "point", "precision", "recall", "threshold", (full > most).alias("sampled"), "full_point_count"))


def _tied_hits(scores: DataFrame, edges: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Positives among the first ``need`` rows, by account, of those that share the score at the edge.

    Only the rows at that very score are ordered; all the others are settled by their counts.
    """
    tied = join_groups(scores.select(*within, "score", "account", "label"), edges.select(*within, "score", "need"), [*within, "score"])
    ranked = positions(tied.drop("score"), [F.asc("account")], within)
    return ranked.groupBy(*within).agg(F.sum(F.when(F.col("position") <= F.col("need"), F.col("label"))).alias("tied_hits"))


def top_decile_metrics(scores: DataFrame, within: tuple[str, ...] = (), share: float = 0.1, steps: DataFrame | None = None) -> DataFrame:
    """Precision, recall and lift of the ceil(share) best scores, ties by account."""
    steps = score_steps(scores, within) if steps is None else steps
    count = top_count(F.col("n_total"), share)
    whole, cut = F.col("n_upto") <= count, (F.col("n_before") < count) & (F.col("n_upto") > count)
    # A step whose labels are all the same needs no order.
    mixed = cut & (F.col("hits") > 0) & (F.col("hits") < F.col("n"))
    plain = F.when(whole, F.col("hits")).when(cut & ~mixed & (F.col("hits") > 0), count - F.col("n_before")).otherwise(0)
    totals = steps.groupBy(*within).agg(F.max("n_total").alias("n"), F.max("hits_total").alias("positives"), F.max(count).alias("top10_count"),
                                        F.sum(plain).alias("plain_hits"))
    edges = steps.filter(mixed).select(*within, "score", (count - F.col("n_before")).alias("need"))
    found = join_groups(totals, _tied_hits(scores, edges, within), list(within), "left") if within else totals.withColumn(
        "tied_hits", _tied_hits(scores, edges, within).agg(F.sum("tied_hits")).scalar())
    hits = F.col("plain_hits") + F.coalesce("tied_hits", F.lit(0))
    precision = rate(hits, F.col("top10_count"))
    return found.select(*within, "top10_count", precision.alias("top10_precision"), rate(hits, F.col("positives")).alias("top10_recall"),
                        rate(precision, rate(F.col("positives"), F.col("n"))).alias("top10_lift"))


def _log_loss(score: Column, label: Column) -> Column:
    epsilon = sys.float_info.epsilon
    clipped = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), score.cast("double")))
    return -F.ln(F.when(label == 1, clipped).otherwise(1 - clipped))


def brier_logloss(scores: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Mean squared error, and log loss with scores kept off 0 and 1 by machine epsilon."""
    return scores.groupBy(*within).agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"),
                                       F.avg(_log_loss(F.col("score"), F.col("label"))).alias("log_loss"))


def _quantiles_of_steps(steps: DataFrame, probabilities: list[float], within: tuple[str, ...]) -> DataFrame:
    """Exact quantiles of the scores with linear interpolation; the steps run from the highest score down."""
    below = F.col("n_total") - F.col("n_upto")
    spots = [(F.col("n_total") - 1).cast("double") * F.lit(float(p)) for p in probabilities]

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < below + F.col("n")), F.col("score").cast("double")))

    ends = [at(end(spot)) for spot in spots for end in (F.floor, F.ceil)]
    shares = [F.max(spot - F.floor(spot)) for spot in spots]
    found = steps.groupBy(*within).agg(*[e.alias(f"_e{i}") for i, e in enumerate(ends)], *[s.alias(f"_s{i}") for i, s in enumerate(shares)])
    values = [F.col(f"_e{2 * i}") + (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) * F.col(f"_s{i}") for i in range(len(spots))]
    return found.select(*within, F.array(*values).alias("quantiles"))


def reliability_bins(scores: DataFrame, within: tuple[str, ...] = (), bins: int = 10, steps: DataFrame | None = None) -> DataFrame:
    """Quantile bins with merged duplicate edges: mean score, observed rate and count.

    Edges, means and rates all come from the steps, so rows are counted by score once and never ordered.
    """
    steps = score_steps(scores, within) if steps is None else steps
    edges = _quantiles_of_steps(steps, [i / bins for i in range(bins + 1)], within).withColumn(
        "edges", F.array_sort(F.array_distinct("quantiles"))).drop("quantiles")
    # Inner edges only; one array of at most bins + 1 numbers per run.
    inner = F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))))
    if within:
        # A run may hold most steps: its edges are copied to every salt so that its steps still spread.
        salted = steps.withColumn("_salt", F.pmod(F.xxhash64("score"), F.lit(_SALTS)).cast("int"))
        copies = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        placed = join_groups(salted, copies, [*within, "_salt"])
    else:
        placed = steps.withColumn("edges", edges.select("edges").scalar())
    bucket = F.size(F.filter(F.coalesce(inner, F.array().cast("array<double>")), lambda e: e <= F.col("score")))
    sums = placed.groupBy(*within, bucket.alias("bin")).agg(
        F.sum(F.col("score") * F.col("n")).alias("_score"), F.sum("hits").alias("_hits"), F.sum("n").alias("count"))
    return sums.select(*within, "bin", rate(F.col("_score"), F.col("count")).alias("mean_probability"),
                       rate(F.col("_hits"), F.col("count")).alias("observed_rate"), "count")


def evaluate_scores(scores: DataFrame, within: tuple[str, ...] = (), probability: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """All scalar metrics, one row per run; undefined ones are null.

    Rows are counted by score once; every metric is a sum over those steps, and only rows tied at the edge of
    the top tenth are looked at again. Recency-like runs are rankings, not probabilities: pass
    ``probability=False`` for them.
    """
    steps = score_steps(scores, within) if steps is None else steps
    score, hits, misses = F.col("score").cast("double"), F.col("hits"), F.col("n") - F.col("hits")
    squares = F.sum(hits * F.pow(score - 1, F.lit(2)) + misses * F.pow(score, F.lit(2)))
    losses = F.sum(F.when(hits > 0, hits * _log_loss(score, F.lit(1))).otherwise(0.0) + F.when(misses > 0, misses * _log_loss(score, F.lit(0))).otherwise(0.0))
    n = F.sum("n")
    unknown = F.lit(None).cast("double")
    base = steps.groupBy(*within).agg(
        F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("positives"), rate(F.sum("hits"), n).alias("prevalence"),
        (rate(squares, n) if probability else unknown).alias("brier"), (rate(losses, n) if probability else unknown).alias("log_loss"))
    parts = [average_precision(scores, within, steps), roc_auc(scores, within, steps), top_decile_metrics(scores, within, steps=steps)]
    out = base
    for part in parts:
        if within:
            out = join_groups(out, part, list(within), "left")
        else:
            out = out.withColumn("_r", part.select(F.struct("*").alias("r")).scalar()).select("*", "_r.*").drop("_r")
    last = ["brier", "log_loss"]
    return out.select(*[name for name in out.columns if name not in last], *last)


def subgroup_metrics(scores: DataFrame, group: Column, within: tuple[str, ...] = (),
                     probability: bool = True) -> DataFrame:
    """The same metrics for each subgroup."""
    return evaluate_scores(scores.withColumn("subgroup", group), (*within, "subgroup"), probability)


def select_model(metrics: DataFrame, learned: list[str]) -> DataFrame:
    """The learned model with the best validation average precision; first listed wins a tie."""
    place = F.array_position(F.array(*[F.lit(name) for name in learned]), F.col("model"))
    return (metrics.filter(F.col("model").isin(*learned))
            .agg(F.max_by("model", F.struct("average_precision", (-place).alias("p"))).alias("selected_model"),
                 F.max("average_precision").alias("average_precision")))
