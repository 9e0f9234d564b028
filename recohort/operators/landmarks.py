"""Event-time samples at several cutoffs, built without looking ahead.

Cutoffs are midnights and few, so each opening is copied beside the cutoffs it matters to (an
array literal, no join) and merged map-side. Only mergeable partials are shuffled: counts, exact
sums, first and last time, and one bit per calendar day for distinct days.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from recohort.contracts import BINARY_FEATURE, FEATURE_DAYS, FEATURES, SHARE_FEATURE, Landmark
from recohort.functions.scalars import is_finite, rate
from recohort.functions.times import fractional_days, instant
from recohort.operators.ranking import medians

_KEY = ("as_of", "split", "label_start", "label_end", "account")


def landmark_array(marks: list[Landmark]) -> Column:
    return F.array(*[F.struct(instant(m.as_of).alias("as_of"), F.lit(m.split).alias("split"),
                              instant(m.label_start).alias("label_start"),
                              instant(m.label_end).alias("label_end")) for m in marks])


def landmark_table(spark, marks: list[Landmark]) -> DataFrame:
    """Cutoff, split and label window, one row each."""
    return spark.range(1).select(F.explode(landmark_array(marks)).alias("m")).select("m.*")


def join_landmarks(openings: DataFrame, marks: list[Landmark], start: datetime) -> DataFrame:
    """Accounts with an opening since the campaign start and before each cutoff.

    The earliest campaign opening of an account decides every cutoff, so accounts (not events)
    are copied beside cutoffs.
    """
    entered = (openings.filter((F.col("timestamp") >= instant(start)) & (F.col("timestamp") < instant(marks[-1].as_of)))
               .groupBy("account").agg(F.min("timestamp").alias("entered")))
    later = F.filter(landmark_array(marks), lambda m: F.col("entered") < m["as_of"])
    return entered.select("account", F.explode(later).alias("m")).select("m.*", "account")


def join_history(cohort: DataFrame, openings: DataFrame) -> DataFrame:
    """Every opening of a sampled account strictly before its cutoff."""
    return cohort.join(openings, "account").filter(F.col("timestamp") < F.col("as_of"))


def join_trailing_window(cohort: DataFrame, openings: DataFrame, marks: list[Landmark], days: int = 30) -> DataFrame:
    """Openings in [as_of - days, as_of) of sampled accounts.

    An opening first meets the few cutoffs as a literal; one that lies in no window is dropped before anything moves.
    """
    span = F.make_dt_interval(days=F.lit(days))
    near = F.filter(landmark_array(marks), lambda m: (F.col("timestamp") >= m["as_of"] - span) & (F.col("timestamp") < m["as_of"]))
    inside = openings.select("*", F.explode(F.transform(near, lambda m: m["as_of"])).alias("as_of"))
    return cohort.join(inside, ["account", "as_of"])


def label_exists(cohort: DataFrame, openings: DataFrame, marks: list[Landmark]) -> DataFrame:
    """0/1: an opening inside the label window. Openings shrink to (account, cutoff) before the join."""
    hit = F.filter(landmark_array(marks), lambda m: ((F.col("timestamp") >= m["label_start"])
                                                     & (F.col("timestamp") < m["label_end"])))
    labelled = (openings.select("account", F.explode(hit).alias("m"))
                .select("account", F.col("m.as_of").alias("as_of")).distinct().withColumn("_hit", F.lit(1)))
    return (cohort.join(labelled, ["account", "as_of"], "left")
            .withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit"))


def _beside_cutoffs(openings: DataFrame, marks: list[Landmark], labels: bool) -> DataFrame:
    """Each opening next to the cutoffs it precedes, and those whose label window it falls into."""
    ts = F.col("timestamp")

    def relevant(m):
        earlier = ts < m["as_of"]
        return earlier | ((ts >= m["label_start"]) & (ts < m["label_end"])) if labels else earlier

    beside = F.explode(F.filter(landmark_array(marks), relevant))
    return openings.select("account", "market", "timestamp", "size_usd", "fee_usd", beside.alias("m")).select(
        "m.*", "account", "market", "timestamp", "size_usd", "fee_usd")


def _partials(start: datetime) -> list[Column]:
    """Mergeable pieces per (cutoff, account, market)."""
    ts, as_of = F.col("timestamp"), F.col("as_of")
    before = ts < as_of
    age = F.datediff(F.to_date(as_of), F.to_date(ts))  # 1 is the last full day before the cutoff
    recent = before & (age <= max(FEATURE_DAYS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (age - 1).cast("int"))
    out = [F.min(F.when(before, ts)).alias("first_ts"), F.max(F.when(before, ts)).alias("last_ts"),
           F.count_if(before & (ts >= instant(start))).alias("campaign_n"),
           F.count_if((ts >= F.col("label_start")) & (ts < F.col("label_end"))).alias("label_n"),
           F.bit_or(F.when(recent, bit)).alias("day_bits")]
    for days in FEATURE_DAYS:
        inside = before & (age <= days)
        out += [F.count_if(inside).alias(f"n_{days}"),
                F.sum(F.when(inside, F.col("size_usd"))).alias(f"size_{days}"),
                F.sum(F.when(inside, F.col("fee_usd"))).alias(f"fee_{days}")]
    return out


def _merged() -> list[Column]:
    out = [F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
           F.sum("campaign_n").alias("campaign_n"), F.sum("label_n").alias("label_n"),
           F.coalesce(F.bit_or("day_bits"), F.lit(0).cast("long")).alias("day_bits"),
           F.count_if(F.col("n_30") > 0).alias("market_count_30d"), F.max("size_30").alias("largest_30")]
    for days in FEATURE_DAYS:
        out += [F.sum(f"n_{days}").alias(f"n_{days}"), F.sum(f"size_{days}").alias(f"size_{days}"),
                F.sum(f"fee_{days}").alias(f"fee_{days}")]
    return out


def _checked(marks: list[Landmark]) -> None:
    if any(m.as_of.time() != datetime.min.time() for m in marks):
        raise ValueError("cutoffs must be midnights")


def _sampled(openings: DataFrame, marks: list[Landmark], start: datetime, labels: bool) -> DataFrame:
    _checked(marks)
    by_market = _beside_cutoffs(openings, marks, labels).groupBy(*_KEY, "market").agg(*_partials(start))
    return by_market.groupBy(*_KEY).agg(*_merged()).filter("campaign_n > 0")


def _window_columns() -> dict[str, Column]:
    out = {}
    for days in FEATURE_DAYS:
        mask = F.lit((1 << days) - 1).cast("long")
        out[f"opening_count_{days}d"] = F.col(f"n_{days}").cast("double")
        out[f"active_days_{days}d"] = F.bit_count(F.col("day_bits").bitwiseAND(mask)).cast("double")
        out[f"opening_size_usd_{days}d"] = F.coalesce(F.col(f"size_{days}").cast("double"), F.lit(0.0))
        out[f"opening_fee_usd_{days}d"] = F.coalesce(F.col(f"fee_{days}").cast("double"), F.lit(0.0))
    return out


def _recency_columns(start: datetime) -> dict[str, Column]:
    return {"days_since_first_observed_opening": fractional_days(F.col("as_of"), F.col("first_ts")),
            "days_since_last_opening": fractional_days(F.col("as_of"), F.col("last_ts")),
            BINARY_FEATURE: (F.col("first_ts") < instant(start)).cast("double")}


def _market_columns() -> dict[str, Column]:
    share = rate(F.col("largest_30"), F.col("size_30"))
    return {"market_count_30d": F.col("market_count_30d").cast("double"),
            SHARE_FEATURE: F.coalesce(share, F.lit(0.0))}


def _named(rows: DataFrame, columns: dict[str, Column], *lead) -> DataFrame:
    return rows.select(*lead, *[value.alias(name) for name, value in columns.items()])


def trailing_window_features(openings: DataFrame, marks: list[Landmark], start: datetime) -> DataFrame:
    """Counts, active days, size and fee over 7, 30 and 60 days; zero when inactive."""
    return _named(_sampled(openings, marks, start, False), _window_columns(), "as_of", "account")


def recency_features(openings: DataFrame, marks: list[Landmark], start: datetime) -> DataFrame:
    """Fractional days since first and last opening, and whether history predates the campaign."""
    return _named(_sampled(openings, marks, start, False), _recency_columns(start), "as_of", "account")


def market_concentration(openings: DataFrame, marks: list[Landmark], start: datetime) -> DataFrame:
    """Markets touched and the largest market's share of size in the 30 days before a cutoff.

    Only accounts active in those days have a row.
    """
    active = _sampled(openings, marks, start, False).filter("n_30 > 0")
    return _named(active, _market_columns(), "as_of", "account")


def join_market_features(cohort: DataFrame, concentration: DataFrame) -> DataFrame:
    """Concentration beside every sampled account, zero when absent."""
    names = ("market_count_30d", SHARE_FEATURE)
    return (cohort.join(concentration, ["as_of", "account"], "left")
            .withColumns({name: F.coalesce(name, F.lit(0.0)) for name in names}))


def landmark_samples(openings: DataFrame, marks: list[Landmark], start: datetime) -> DataFrame:
    """account, cutoff, split, label and the 17 features, from one scan and two shrinking shuffles."""
    rows = _sampled(openings, marks, start, True)
    columns = {**_window_columns(), **_recency_columns(start), **_market_columns()}
    return rows.select("account", "as_of", "split", (F.col("label_n") > 0).cast("int").alias("label"),
                       *[columns[name].alias(name) for name in FEATURES])


def split_summary(samples: DataFrame, marks: list[Landmark]) -> DataFrame:
    """Rows, positives and distinct accounts per cutoff with its label window, empty cutoffs kept."""
    counts = (samples.groupBy("as_of", "account").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
              .groupBy("as_of").agg(F.sum("n").alias("n"), F.sum("p").alias("positive"),
                                    F.count("*").alias("unique_accounts")))
    zero = F.lit(0).cast("long")
    return (landmark_table(samples.sparkSession, marks).join(counts, "as_of", "left")
            .select("split", "as_of", "label_start", "label_end", F.coalesce("n", zero).alias("n"),
                    F.coalesce("positive", zero).alias("positive"),
                    F.coalesce("unique_accounts", zero).alias("unique_accounts")))


def feature_shift(samples: DataFrame) -> DataFrame:
    """Per cutoff: inactive rows, returns among them, and exact medians of two features."""
    counts = samples.groupBy("as_of", "split").agg(
        F.count("*").alias("n"), F.count_if(F.col("opening_count_30d") == 0).alias("no_opening_30d"),
        F.coalesce(F.sum(F.when(F.col("opening_count_30d") == 0, F.col("label"))), F.lit(0)).alias("returns_among_inactive"))
    tall = samples.selectExpr("as_of", "stack(2, 'days_since_last_opening', days_since_last_opening, "
                                       "'opening_count_30d', opening_count_30d) AS (feature, value)")
    middle = medians(tall, "value", ("as_of", "feature"))
    wide = middle.groupBy("as_of").agg(*[
        F.max(F.when(F.col("feature") == name, F.col("median"))).alias(f"median_{name}")
        for name in ("days_since_last_opening", "opening_count_30d")])
    return counts.join(wide, "as_of")


def validate_fee_presence(openings: DataFrame, marks: list[Landmark], start: datetime) -> DataFrame:
    """Sampled accounts with an unknown fee on an opening before their cutoff."""
    rows = _beside_cutoffs(openings, marks, False)
    per = rows.groupBy("as_of", "account").agg(
        F.count_if(F.col("timestamp") >= instant(start)).alias("campaign_n"),
        F.count_if(F.col("fee_usd").isNull()).alias("missing_fees"))
    return per.filter("campaign_n > 0 AND missing_fees > 0").select("as_of", "account", "missing_fees")


def validate_features(samples: DataFrame) -> DataFrame:
    """Feature values outside the contract: not finite, negative, share above one, flag not binary."""
    missing = [name for name in FEATURES if name not in samples.columns]
    extra = [name for name in samples.columns if name not in (*FEATURES, "account", "as_of", "split", "label")]
    if missing or extra:
        raise ValueError(f"feature list differs from the contract: missing {missing}, unexpected {extra}")
    checks = []
    for name in FEATURES:
        value = F.col(name)
        checks.append(F.when(~is_finite(value) | (value < 0), F.struct(
            F.lit("not finite and non-negative").alias("rule"), F.lit(name).alias("feature"))))
    checks.append(F.when(F.col(SHARE_FEATURE) > 1, F.struct(
        F.lit("share above one").alias("rule"), F.lit(SHARE_FEATURE).alias("feature"))))
    checks.append(F.when(~F.col(BINARY_FEATURE).isin(0.0, 1.0), F.struct(
        F.lit("flag is not binary").alias("rule"), F.lit(BINARY_FEATURE).alias("feature"))))
    faults = F.explode(F.array_compact(F.array(*checks)))
    return samples.select("account", "as_of", faults.alias("f")).select("f.rule", "f.feature", "account", "as_of")


def expected_counts(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """Frozen counts (as_of, n, positive) that the samples do not reproduce, or that name a cutoff twice."""
    frozen = expected.groupBy("as_of").agg(F.min("n").alias("expected_n"), F.min("positive").alias("expected_positive"),
                                           F.count("*").alias("copies"))
    found = summary.select("as_of", "n", "positive")
    both = frozen.join(found, "as_of", "left")
    wrong = (~F.col("n").eqNullSafe(F.col("expected_n"))) | (~F.col("positive").eqNullSafe(F.col("expected_positive")))
    wrong = wrong | (F.col("copies") > 1)
    return both.filter(wrong).select("as_of", "n", "expected_n", "positive", "expected_positive")


def seen_in_training_flag(scored: DataFrame, training: DataFrame) -> DataFrame:
    """Whether a scored account occurs in any training row."""
    known = training.select("account").distinct().withColumn("_known", F.lit(True))
    return scored.join(known, "account", "left").withColumn(
        "seen_in_training", F.col("_known").isNotNull().cast("int")).drop("_known")


def validate_cutoffs(anchors: DataFrame) -> DataFrame:
    """Cutoffs (campaign, as_of, split) that are not midnights, or whose labels mature too late.

    Every campaign has only a handful of cutoffs.
    """
    chain = Window.partitionBy("campaign").orderBy("as_of")
    following = anchors.withColumns({"next_as_of": F.lead("as_of").over(chain), "next_split": F.lead("split").over(chain)})
    matured = F.col("as_of") + F.make_dt_interval(days=F.lit(30))
    order = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    rules = F.array_compact(F.array(
        F.when(F.date_trunc("day", "as_of").cast("timestamp_ntz") != F.col("as_of"), "not at midnight"),
        F.when(F.col("next_as_of") == F.col("as_of"), "repeated cutoff"),
        F.when(F.array_position(order, F.col("next_split")) < F.array_position(order, F.col("split")), "split out of order"),
        F.when((F.col("next_split") != F.col("split")) & (matured > F.col("next_as_of")), "labels mature too late")))
    return following.select("campaign", "as_of", "split", F.explode(rules).alias("rule"))

