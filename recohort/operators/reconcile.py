"""Comparison of two independent computations of the same numbers.

Tables meet on their keys as whole rows; only differing fields are expanded afterwards, so the
shuffle does not grow with the number of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from recohort.contracts import AUDIT_FIELDS, DAILY_FIELDS, MUST_BE_ZERO, RECONCILED_METRICS
from recohort.functions.scalars import is_close


def _by_key(rows: DataFrame, keys: list[str], fields: list[str], side: str) -> DataFrame:
    """One row per key: its fields, and how many copies there were."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*fields)).alias(side), F.count("*").alias(f"{side}_copies"))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.0,
                   numeric: tuple[str, ...] = ()) -> DataFrame:
    """Every differing field: keys, field, both values, and kind.

    ``drift`` is a numeric difference inside the tolerance; missing and repeated keys are
    differences of the pseudo-field ``row``.
    """
    fields = [name for name in left.columns if name not in keys]
    if sorted(fields) != sorted(name for name in right.columns if name not in keys):
        raise ValueError("tables have different columns")
    both = _by_key(left, keys, fields, "l").join(_by_key(right, keys, fields, "r"), keys, "full_outer")
    checks = [
        F.when(F.col("l_copies").isNull(), _change("row", None, "present", "missing_from_left")),
        F.when(F.col("r_copies").isNull(), _change("row", "present", None, "missing_from_right")),
        F.when((F.col("l_copies") > 1) | (F.col("r_copies") > 1),
               _change("row", F.col("l_copies").cast("string"), F.col("r_copies").cast("string"), "repeated_key")),
    ]
    paired = F.col("l_copies").isNotNull() & F.col("r_copies").isNotNull()
    for name in fields:
        a, b = F.col(f"l.{name}"), F.col(f"r.{name}")
        kind = F.lit("difference")
        if tolerance and name in numeric:
            close = F.coalesce(is_close(a.try_cast("double"), b.try_cast("double"), tolerance), F.lit(False))
            kind = F.when(close, "drift").otherwise("difference")
        checks.append(F.when(paired & ~a.eqNullSafe(b), _change(name, a.cast("string"), b.cast("string"), kind)))
    changes = F.explode(F.array_compact(F.array(*checks)))
    return both.select(*keys, changes.alias("c")).select(*keys, "c.field", "c.left_value", "c.right_value", "c.kind")


def _change(field: str, left, right, kind) -> Column:
    def text(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")
    return F.struct(F.lit(field).alias("field"), text(left).alias("left_value"), text(right).alias("right_value"),
                    text(kind).alias("kind"))


def difference_summary(changes: DataFrame) -> DataFrame:
    """Counts: differences decide the verdict, accepted drift is reported apart."""
    drift = F.col("kind") == "drift"
    return changes.agg(F.count_if(~drift).alias("difference_count"), F.count_if(drift).alias("accepted_float_drift_count")
                       ).withColumn("passed", F.col("difference_count") == 0)


def difference_examples(changes: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    return changes.orderBy(*keys, "field").limit(most)


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """Array of (path, type, value) for every leaf of a nested column."""
    leaf = F.array(F.struct(path.alias("path"), F.lit(kind.simpleString()).alias("type"), _text(value, kind).alias("value")))
    if isinstance(kind, T.StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.when(value.isNull(), _null_leaf(path)).otherwise(F.flatten(F.array(*parts)))
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda item, i: _leaves(
            item, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(value.isNull(), _null_leaf(path)).otherwise(inner)
    if isinstance(kind, T.MapType):
        inner = F.flatten(F.transform(F.map_entries(value), lambda entry: _leaves(
            entry["value"], kind.valueType, F.concat(path, F.lit("."), entry["key"].cast("string")))))
        return F.when(value.isNull(), _null_leaf(path)).otherwise(inner)
    return leaf


def _text(value: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return F.lit(None).cast("string") if nested else value.cast("string")


def _null_leaf(path: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit("null").alias("type"), F.lit(None).cast("string").alias("value")))


def flatten_results(results: DataFrame, key: str, value: str) -> DataFrame:
    """Nested results as (key, path, type, value) rows; the schema decides the shape."""
    kind = results.schema[value].dataType
    return results.select(key, F.explode(_leaves(F.col(value), kind, F.lit("$"))).alias("e")).select(
        key, "e.path", "e.type", "e.value")


def compare_results(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Nested results compared path by path; only floating-point values may drift."""
    a = flatten_results(left, key, value).withColumnsRenamed({"type": "l_type", "value": "l"})
    b = flatten_results(right, key, value).withColumnsRenamed({"type": "r_type", "value": "r"})
    both = a.join(b, [key, "path"], "full_outer")
    same = F.col("l_type").eqNullSafe(F.col("r_type")) & F.col("l").eqNullSafe(F.col("r"))
    kind = (F.when(F.col("l_type").isNull(), "missing_from_left").when(F.col("r_type").isNull(), "missing_from_right")
            .when(F.lit(tolerance > 0) & (F.col("l_type") == "double") & (F.col("r_type") == "double")
                  & F.coalesce(is_close(F.col("l").try_cast("double"), F.col("r").try_cast("double"), tolerance), F.lit(False)), "drift")
            .otherwise("difference"))
    return both.filter(~same).select(key, "path", F.col("l").alias("left_value"), F.col("r").alias("right_value"),
                                     kind.alias("kind"))


def reconcile_daily(exported: DataFrame, local: DataFrame, fields: tuple[str, ...] = DAILY_FIELDS) -> DataFrame:
    """Day and field where two daily tables disagree; days on one side only are a coverage issue."""
    mine = local.select("day", F.struct(*fields).alias("mine"))
    both = exported.select("day", F.struct(*fields).alias("theirs")).join(mine, "day")
    checks = [F.when(~F.col(f"theirs.{n}").eqNullSafe(F.col(f"mine.{n}")), F.struct(
        F.lit(n).alias("field"), F.col(f"theirs.{n}").cast("long").alias("exported"),
        F.col(f"mine.{n}").cast("long").alias("local"))) for n in fields]
    return both.select("day", F.explode(F.array_compact(F.array(*checks))).alias("d")).select(
        "day", "d.field", "d.exported", "d.local")


def daily_grain_identities(exported: DataFrame) -> DataFrame:
    """Counts of one daily export that contradict each other, and error counters above zero."""
    none = F.lit(None)
    by_action = F.col("increase") + F.col("decrease") + F.col("liquidation") + F.col("collateral")
    bad_counts = (F.col("accounts") > F.col("rows")) | (by_action != F.col("rows")) | (F.col("zero_size") > F.col("rows"))
    bad_grain = ((F.col("position_rows") != F.col("rows"))
                 | (F.col("execution_rows") != F.col("rows") + F.col("out_of_scope_execution_rows")))

    def issue(reason, field, count):
        return F.struct(F.lit(reason).alias("reason"), field.cast("string").alias("field"), count.cast("long").alias("count"))

    checks = [F.when(bad_counts, issue("invalid_daily_counts", none, none)),
              F.when(bad_grain, issue("invalid_source_grain", none, none))]
    checks += [F.when(F.col(n) != 0, issue("source_quality_failure", F.lit(n), F.col(n))) for n in MUST_BE_ZERO]
    return exported.select("day", F.explode(F.array_compact(F.array(*checks))).alias("i")).select(
        "day", "i.reason", "i.field", "i.count")


def audit_totals(exported: DataFrame) -> DataFrame:
    """Sum of every audit counter."""
    return exported.agg(*[F.sum(n).alias(n) for n in AUDIT_FIELDS])


def reconcile_metrics(exported: DataFrame, local: DataFrame) -> DataFrame:
    """Per metric: agreement, difference, withheld or missing, with everything wrong about it.

    ``exported`` holds (metric, numerator, denominator, rate, strict_unknown_events), ``local``
    (metric, n, cohort_size). Strict return must be withheld exactly when creations are unknown.
    """
    names = F.array(*[F.lit(name) for name in RECONCILED_METRICS])
    expected = exported.sparkSession.range(1).select(F.explode(names).alias("metric")).withColumn("expected", F.lit(True))
    mine = local.filter(F.col("metric").isin(*RECONCILED_METRICS)).select(
        "metric", F.col("n").alias("local_n"), F.col("cohort_size").alias("local_size"))
    theirs = exported.withColumn("exported", F.lit(True))
    both = expected.join(theirs, "metric", "full_outer").join(mine, "metric", "left")
    spread = exported.agg(F.struct(F.min("strict_unknown_events").alias("u0"), F.max("strict_unknown_events").alias("u1"),
                                   F.min("denominator").alias("d0"), F.max("denominator").alias("d1")).alias("s")).scalar()
    both = both.withColumn("s", spread)
    strict = (F.col("metric") == "strict_r30") & (F.col("strict_unknown_events") > 0)
    present, known = F.col("exported").isNotNull(), F.col("expected").isNotNull()
    gap = F.abs(F.col("rate") - F.col("numerator").cast("double") / F.nullif(F.col("denominator"), F.lit(0)))
    invalid = ~F.coalesce((F.col("numerator") <= F.col("denominator")) & (F.col("rate") >= 0) & (F.col("rate") <= 1)
                          & (gap <= 1e-12), F.lit(False))
    open_metric = present & known & ~strict
    issues = F.array_compact(F.array(
        F.when(known & ~present, "metric_missing"), F.when(~known & present, "metric_unexpected"),
        F.when(strict & (F.col("numerator").isNotNull() | F.col("rate").isNotNull()), "strict_metric_not_withheld"),
        F.when(strict, "strict_creation_unknown"),
        F.when(open_metric & invalid, "invalid_retention_counts_or_rate"),
        F.when(open_metric & F.col("local_n").isNull(), "local_metric_unavailable"),
        F.when(present & (F.col("s.u0") != F.col("s.u1")), "inconsistent_strict_unknown_events"),
        F.when(present & (F.col("s.d0") != F.col("s.d1")), "inconsistent_denominators")))
    agrees = (F.col("numerator") == F.col("local_n")) & (F.col("denominator") == F.col("local_size"))
    status = (F.when(~known, "unexpected").when(~present, "missing").when(strict, "withheld")
              .when(F.col("local_n").isNull(), "withheld").when(agrees, "agreement").otherwise("difference"))
    differs = present & known & ((F.col("denominator") != F.col("local_size")) | F.coalesce(open_metric & ~agrees, F.lit(False)))
    return both.select("metric", status.alias("status"), F.col("numerator").alias("n"), F.col("denominator").alias("cohort_size"),
                       F.coalesce(differs, F.lit(False)).alias("differs"), issues.alias("issues"))


def reconcile_status(metrics: DataFrame, daily_differences: DataFrame, daily_issues: DataFrame,
                     coverage_issues: DataFrame, synthetic: bool) -> DataFrame:
    """Overall status: invalid before differences before agreement; synthetic data never validates.

    Problems that only touch strict return do not spoil the opening metrics.
    """
    other = (daily_issues.agg(F.count("*")).scalar() + coverage_issues.agg(F.count("*")).scalar())
    daily = daily_differences.agg(F.count("*")).scalar()
    only_strict = F.array(F.lit("strict_creation_unknown"), F.lit("local_metric_unavailable"))
    is_strict = F.col("metric") == "strict_r30"
    hard = F.when(is_strict, F.size(F.array_except("issues", only_strict))).otherwise(F.size("issues"))
    row = metrics.agg(F.sum(F.size("issues")).alias("issues"), F.sum(hard).alias("hard"),
                      F.count_if("differs").alias("differences"),
                      F.count_if(F.col("differs") & ~is_strict).alias("open_differences"),
                      F.count_if(~is_strict & (F.col("status") == "agreement")).alias("agreeing"))
    row = row.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in row.columns]).withColumns(
        {"other": other, "daily": daily})
    status = (F.when(F.col("issues") + F.col("other") > 0, "invalid_or_incomplete")
              .when(F.col("differences") + F.col("daily") > 0, "differences").otherwise("agreement"))
    opening = (F.when(F.col("hard") + F.col("other") > 0, "invalid_or_incomplete")
               .when(F.col("open_differences") + F.col("daily") > 0, "differences")
               .when(F.col("agreeing") == len(RECONCILED_METRICS) - 1, "agreement").otherwise("incomplete"))
    return row.select(status.alias("comparison_status"), opening.alias("opening_retention_status"),
                      ((status == "agreement") & F.lit(not synthetic)).alias("validated"),
                      ((opening == "agreement") & F.lit(not synthetic)).alias("opening_retention_validated"))
