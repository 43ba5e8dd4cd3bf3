"""Scores of probability predictions, and choices that use earlier periods alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brier(p: str = "p", target: str = "target") -> list[Column]:
    """Aggregates: n, Brier score, skill against the mean rate, mean prediction, rate."""
    loss, m = F.avg(F.pow(F.col(p) - F.col(target), 2)), F.avg(target)
    return [
        F.count("*").alias("n"), F.round(loss, 6).alias("brier"), F.round(100000 * (1 - loss / F.nullif(m * (1 - m), F.lit(0.0))), 3).alias("skill"),
        F.round(F.avg(p), 6).alias("mean_p"), F.round(m, 6).alias("rate"),
    ]


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def calibration(predicted: DataFrame, by: str, p: str = "p", target: str = "target") -> DataFrame:
    """Least-squares line of outcomes on predictions, and their correlation; groups of constant predictions are left out."""
    return predicted.groupBy(by).agg(
        F.round(F.regr_slope(target, p), 4).alias("slope"), F.round(F.regr_intercept(target, p), 5).alias("intercept"),
        F.round(correlation(target, p), 6).alias("correlation"), F.stddev_pop(p).alias("__s"),
    ).where("__s > 1e-12").drop("__s")


def select_by_prior(scores: DataFrame) -> DataFrame:
    """From (season, k, ix, brier) the candidate of each season with the least worst score before it, then mean, then index."""
    seasons = scores.select("season").distinct()
    before = seasons.alias("a").join(F.broadcast(scores).alias("b"), F.col("b.season") < F.col("a.season"))  # candidates x seasons
    history = before.groupBy(F.col("a.season").alias("season"), "b.k", "b.ix").agg(F.max("b.brier").alias("worst"), F.avg("b.brier").alias("mean"))
    chosen = history.groupBy("season").agg(F.min_by("k", F.struct(F.round("worst", 9), F.round("mean", 9), "ix")).alias("k"))
    return chosen.join(scores, ["season", "k"]).select("season", "k", "brier")
