"""Global order without a single task: positions, running totals, top shares, quantiles.

Rows are range-partitioned by the whole sort key, so equal scores with different tie-breakers still
spread over tasks. Each slice is summed, the slice totals (one row per slice and group) are turned
into offsets, and the running totals inside a slice start from its offset. The slice number is
written with the rows, so both uses see the same slices even after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recohort.functions.scalars import rate
from recohort.session import pin

_SLICE = "_slice"


def join_groups(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join by group columns in which a null group meets itself; the right side's copies of the names are dropped."""
    theirs = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    same = [left[name].eqNullSafe(theirs[f"_r_{name}"]) for name in names]
    return left.join(theirs, same, how).drop(*[f"_r_{name}" for name in names])


def running_totals(rows: DataFrame, order: list[Column], totals: dict[str, Column],
                   within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``<name>_before``, the sum over all earlier rows of the same group, and ``<name>_total``.

    ``order`` must be a total order inside a group.
    """
    keyed = rows.withColumns({f"_v_{name}": value for name, value in totals.items()})
    sliced = pin(keyed.repartitionByRange(*[F.col(name) for name in within], *order)
                 .withColumn(_SLICE, F.spark_partition_id()), "slices")
    group = list(within)
    sums = sliced.groupBy(*group, _SLICE).agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in totals])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = sums.select(*group, _SLICE, *[
        column for name in totals for column in (
            F.coalesce(F.sum(f"_t_{name}").over(earlier), zero).alias(f"_o_{name}"),
            F.sum(f"_t_{name}").over(whole).alias(f"{name}_total"))])
    before = Window.partitionBy(*group, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_groups(sliced, offsets, [*group, _SLICE]).withColumns({
        f"{name}_before": F.col(f"_o_{name}") + F.coalesce(F.sum(f"_v_{name}").over(before), zero)
        for name in totals})
    return placed.drop(_SLICE, *[f"_v_{name}" for name in totals], *[f"_o_{name}" for name in totals])


def positions(rows: DataFrame, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Add ``position``, 1-based, in the given total order of each group, and ``group_size``."""
    placed = running_totals(rows, order, {"_n": F.lit(1).cast("long")}, within)
    return (placed.withColumn("position", F.col("_n_before") + 1)
            .withColumnRenamed("_n_total", "group_size").drop("_n_before"))


def numbered(rows: DataFrame, order: list[Column], within: tuple[str, ...], parts: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``position``, 1-based, in the given total order of each group, moving the rows once.

    A slice is written in its order with the number of each row, so that only its first number and
    its rows per group, not the rows again, meet to give the offsets. Columns named by ``drop`` only
    give the order and are not written.
    """
    group = list(within)
    spread = rows.repartitionByRange(parts, *[F.col(name) for name in group], *order).sortWithinPartitions(*group, *order)
    written = pin(spread.withColumn("_at", F.monotonically_increasing_id()).drop(*drop), "numbered").withColumn(_SLICE, F.shiftright("_at", 33))
    sums = written.groupBy(*group, _SLICE).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, _SLICE, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    # One row a slice and group; sizes are guessed too high for the rows to stay where they are.
    placed = join_groups(written, F.broadcast(offsets), [*group, _SLICE])
    return placed.withColumn("position", F.col("_at") + F.col("_offset")).drop(_SLICE, "_at", "_offset")


def top_count(total: Column, share: float) -> Column:
    """ceil(total * share) in double arithmetic."""
    return F.ceil(total * F.lit(float(share)))


def exclude_top_percent(profile: DataFrame, share: float = 0.01, flag: str = "r30") -> DataFrame:
    """Late return of everyone, and without the ceil(share) largest by campaign size.

    Ranked only on size before the cutoff, ties by account; never on later returns.
    """
    ranked = positions(profile.select("account", "campaign_volume_usd", flag),
                       [F.desc("campaign_volume_usd"), F.asc("account")])
    kept = ranked.withColumn("kept", F.col("position") > top_count(F.col("group_size"), share))
    totals = kept.agg(F.count("*").alias("a"), F.count_if(flag).alias("b"), F.count_if("kept").alias("c"),
                      F.count_if(F.col("kept") & F.col(flag)).alias("d"))
    rows = totals.selectExpr("stack(2, 'all', a, b, 'excluding_top', c, d) AS (label, size, r30_n)")
    return rows.withColumn("r30_rate", rate(F.col("r30_n"), F.col("size")))


def order_statistics(values: DataFrame, value: str, within: tuple[str, ...],
                     targets: dict[str, Column]) -> DataFrame:
    """Exact values at given 1-based positions of each group's sorted values.

    ``targets`` maps an output name to a position computed from the column ``n`` (the group's number of
    values). Nulls are no values; a group of nulls has n = 0 and null statistics. Duplicates are counted
    first, so the order runs over distinct values only.
    """
    counted = values.groupBy(*within, value).agg(F.count(value).alias("_c"))
    sized = running_totals(counted, [F.asc(value)], {"_c": F.col("_c")}, within).withColumn("n", F.col("_c_total"))
    picks = []
    for name, position in targets.items():
        hit = (F.col("_c_before") < position) & (position <= F.col("_c_before") + F.col("_c"))
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return sized.groupBy(*within).agg(F.max("n").alias("n"), *picks)


def medians(values: DataFrame, value: str, within: tuple[str, ...]) -> DataFrame:
    """Exact median per group, averaging the two middle values."""
    low = F.floor((F.col("n") + 1) / 2)
    high = F.floor((F.col("n") + 2) / 2)
    found = order_statistics(values, value, within, {"_lo": low, "_hi": high})
    return found.select(*within, ((F.col("_lo").cast("double") + F.col("_hi").cast("double")) / 2).alias("median"))


def linear_quantiles(values: DataFrame, value: str, probabilities: list[float],
                     within: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one array per group."""
    targets, spots = {}, []
    for i, p in enumerate(probabilities):
        spot = (F.col("n") - 1).cast("double") * F.lit(float(p))
        spots.append(spot)
        targets[f"_lo{i}"] = F.floor(spot) + 1
        targets[f"_hi{i}"] = F.ceil(spot) + 1
    found = order_statistics(values, value, within, targets)
    quantiles = []
    for i, spot in enumerate(spots):
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        quantiles.append(low + (high - low) * (spot - F.floor(spot)))
    return found.select(*within, F.array(*quantiles).alias("quantiles"))


def floor_percentiles(values: DataFrame, value: str, probabilities: list[float],
                      within: tuple[str, ...] = ()) -> DataFrame:
    """The element at floor((n - 1) * q) of the sorted values, one row per probability."""
    targets = {f"q{i}": F.floor((F.col("n") - 1) * F.lit(float(p))) + 1 for i, p in enumerate(probabilities)}
    found = order_statistics(values, value, within, targets)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.col(f"q{i}").alias("v"))
                      for i, p in enumerate(probabilities)])
    return found.select(*within, F.explode(pairs).alias("p")).select(
        *within, F.col("p.q").alias("quantile"), F.col("p.v").alias("value"))


def events_per_account(events: DataFrame) -> DataFrame:
    return events.groupBy("account").agg(F.count("*").alias("events"))


def top_accounts(events: DataFrame, most: int = 10) -> DataFrame:
    """The accounts with most events, ties by account; a bounded top-k."""
    return events_per_account(events).orderBy(F.desc("events"), F.asc("account")).limit(most)


def top_share(events: DataFrame, share: float = 0.01) -> DataFrame:
    """Events held by the ceil(share) busiest accounts."""
    ranked = running_totals(events_per_account(events), [F.desc("events"), F.asc("account")],
                            {"accounts": F.lit(1).cast("long"), "all": F.col("events")})
    chosen = F.col("accounts_before") < top_count(F.col("accounts_total"), share)
    return ranked.agg(F.max("accounts_total").alias("accounts"), F.count_if(chosen).alias("top_accounts"),
                      F.coalesce(F.sum(F.when(chosen, F.col("events"))), F.lit(0)).alias("top_events"),
                      F.coalesce(F.max("all_total"), F.lit(0)).alias("events")).withColumn(
        "share", rate(F.col("top_events"), F.col("events")))


def ordered_export(rows: DataFrame, *keys: str) -> DataFrame:
    """Stable global order by range partitions."""
    return rows.orderBy(*keys)


def limit_probe(rows: DataFrame, condition: Column, order: list[str], most: int = 5) -> DataFrame:
    """First rows of a selection in an explicit order."""
    return rows.filter(condition).orderBy(*order).limit(most)
