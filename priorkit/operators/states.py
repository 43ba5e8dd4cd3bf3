"""States that see only earlier periods.

The sums of every (key, period) are taken once; what a period may see is a window
over the periods of its key. No loop over periods and no range join of rows: one
shuffle by the key for the sums, and the rows join their own key and period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_sums(rows: DataFrame, keys: Sequence[str], value: Column, period: str = "season") -> DataFrame:
    """(keys, period, s, n): sum and count of the non-null values."""
    return rows.groupBy(*keys, period).agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def prior_sums(rows: DataFrame, keys: Sequence[str], value: Column, period: str = "season", width: int | None = None) -> DataFrame:
    """(keys, period, s, n): over the periods before, or the `width` periods before; 0 where there are none."""
    w = Window.partitionBy(*keys).orderBy(period).rangeBetween(Window.unboundedPreceding if width is None else -width, -1)
    sums = period_sums(rows, keys, value, period)
    return sums.select(*keys, period, F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"))


def prior_rate(rows: DataFrame, value: Column, period: str = "season", default: float = 0.5) -> DataFrame:
    """(period, rate): the mean of all earlier periods; `default` for the first."""
    return earlier_rate(rows.groupBy(period).agg(F.sum(value).alias("s"), F.count(value).alias("n")), period, default)  # a row for each period


def earlier_rate(sums: DataFrame, period: str = "season", default: float = 0.5) -> DataFrame:
    """`prior_rate` of rows whose sums (period, s, n) are known."""
    w = Window.orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return sums.select(period, F.coalesce(F.sum("s").over(w) / F.nullif(F.sum("n").over(w), F.lit(0)), F.lit(default)).alias("rate"))


def prior_effects(rows: DataFrame, keys: Sequence[str], residual: Column, k: float, width: int, period: str = "season") -> DataFrame:
    """(keys, period, effect, n): empirical-Bayes effect sum / (n + k) of the `width` periods before."""
    return prior_sums(rows, keys, residual, period, width).select(*keys, period, (F.col("s") / (F.col("n") + k)).alias("effect"), "n")


def residual_effects(sums: DataFrame, keys: Sequence[str], k: float, width: int, period: str = "season") -> DataFrame:
    """(keys, period, effect): `prior_effects` of the residuals from each period's mean, from the sums (keys, period, s, n) of the values."""
    sums = sums.where(F.col(period).isNotNull())
    means = sums.groupBy(period).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("__mean"))  # a row for each period
    rest = sums.join(F.broadcast(means), period).withColumn("s", F.when(F.col("n") > 0, F.col("s") - F.col("n") * F.col("__mean")))
    w = Window.partitionBy(*keys).orderBy(period).rangeBetween(-width, -1)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return rest.select(*keys, period, (total("s") / (total("n") + k)).alias("effect"))


def demeaned(rows: DataFrame, value: str, out: str, period: str = "season") -> DataFrame:
    """`value` less the mean of its period. The means, a row for each period, are joined back."""
    means = rows.groupBy(period).agg(F.avg(value).alias("__mean"))
    return rows.join(F.broadcast(means), period).withColumn(out, F.col(value) - F.col("__mean")).drop("__mean")


def season_end(rows: DataFrame, entity: str, n: str, columns: Sequence[str], order: Sequence[str], period: str = "season") -> DataFrame:
    """(entity, period, columns): the row of the largest cumulative count in each period, the first in `order` on ties.

    max_by over a struct with the order's columns negated would need numbers; a
    minimum over (-n, order) serves any sortable column.
    """
    first = F.min(F.struct((-F.col(n)).alias("neg"), *order, *[F.col(c).alias(f"v_{c}") for c in columns]))
    return rows.groupBy(entity, period).agg(first.alias("m")).select(entity, period, *[F.col(f"m.v_{c}").alias(c) for c in columns])


def asof(rows: DataFrame, state: DataFrame, entity: str, period: str = "season", prefix: str = "state_") -> DataFrame:
    """Each row with the latest state of its entity from a period strictly before.

    States become intervals [period, next period); a row of period v belongs to the
    interval that holds v - 1. The join is on the entity, with the interval a residual
    predicate over at most a few periods for an entity.
    """
    w = Window.partitionBy(entity).orderBy(period)
    values = [c for c in state.columns if c not in (entity, period)]
    spans = state.select(
        F.col(entity).alias("__e"), F.col(period).alias("__from"), F.lead(period).over(w).alias("__to"), *[F.col(c).alias(prefix + c) for c in values]
    )
    inside = (F.col("__from") < F.col(period)) & (F.col("__to").isNull() | (F.col(period) <= F.col("__to")))
    return rows.join(spans, (F.col(entity) == F.col("__e")) & inside, "left").withColumnRenamed("__from", prefix + period).drop("__e", "__to")


def target_encoding(rows: DataFrame, keys: Sequence[str], target: str, smoothing: float = 100.0, period: str = "season") -> DataFrame:
    """(keys, period, history_rate, history_log_n, last_rate, last_log_n), null keys kept.

    The history shrinks to the mean of all earlier periods, the last period to its own
    mean, or to the history's where it has none.
    """
    sums = period_sums(rows, keys, F.col(target), period)
    past = Window.partitionBy(*keys).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*keys).orderBy(period).rangeBetween(-1, -1)
    totals = rows.groupBy(period).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    all_past, all_last = Window.orderBy(period).rangeBetween(Window.unboundedPreceding, -1), Window.orderBy(period).rangeBetween(-1, -1)
    rate = lambda w: F.sum("s").over(w) / F.nullif(F.sum("n").over(w), F.lit(0))
    base = totals.select(period, F.coalesce(rate(all_past), F.lit(0.5)).alias("__h")).join(totals.select(period, rate(all_last).alias("__l")), period)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    cols = sums.select(*keys, period, total("s", past).alias("hs"), total("n", past).alias("hn"), total("s", last).alias("ls"), total("n", last).alias("ln"))
    out = cols.join(F.broadcast(base), period)
    prior_last = F.coalesce("__l", "__h")
    return out.select(
        *keys, period,
        ((F.col("hs") + smoothing * F.col("__h")) / (F.col("hn") + smoothing)).alias("history_rate"), F.log1p("hn").alias("history_log_n"),
        ((F.col("ls") + smoothing * prior_last) / (F.col("ln") + smoothing)).alias("last_rate"), F.log1p("ln").alias("last_log_n"),
    )


def hierarchical_rates(rows: DataFrame, levels: Sequence[tuple[Sequence[str], float]], target: str) -> DataFrame:
    """Posterior rates down a hierarchy: each level shrinks to its parent's posterior, the first to the overall rate.

    `levels` are (keys, strength), coarse to fine; each level's keys contain its
    parent's. Sums of coarse levels come from the finer ones, so rows are shuffled once.
    """
    finest = list(levels[-1][0])
    cells = rows.groupBy(*finest).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    overall = cells.agg((F.sum("s") / F.sum("n")).alias("rate_0"))
    out = None
    for i, (keys, k) in enumerate(levels, 1):
        sums = cells.groupBy(*keys).agg(F.sum("s").alias("__s"), F.sum("n").alias(f"n_{i}"))
        if out is None:
            joined = sums.join(F.broadcast(overall), F.lit(True))  # one row
        else:
            joined = sums.join(out, list(levels[i - 2][0]))
        out = joined.withColumn(f"rate_{i}", (F.col("__s") + k * F.col(f"rate_{i - 1}")) / (F.col(f"n_{i}") + k)).drop("__s")
    return out


def running_before(rows: DataFrame, entity: Sequence[str], order: Sequence[str], value: str, period: str | None = None) -> DataFrame:
    """Adds n_before and s_before: count and sum of an entity's earlier rows.

    With a `period` that rises along `order`, rows are ordered within entity and period
    only, on top of the sums of the periods before, so that an entity's whole history
    need not pass through one task.
    """
    keys = [*entity, *([period] if period else [])]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n, s = F.count("*").over(w), F.coalesce(F.sum(value).over(w), F.lit(0))
    if period is None:
        return rows.withColumns({"n_before": n, "s_before": s})
    past = Window.partitionBy(*entity).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    sums = sums.select(*keys, F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(past), F.lit(0)).alias("__s"))
    joined = rows.join(sums, keys)
    return joined.withColumns({"n_before": F.col("__n") + n, "s_before": F.col("__s") + s}).drop("__n", "__s")
