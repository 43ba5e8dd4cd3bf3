"""Pipelines that are fitted, stored, read and applied to later years."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import frozen, states
from ..sources.io import Stage, shared_folder, small, table
from .base import facts, rounded, supplier_state

FEATURES = ["discount", "tax", "quantity", "effect", "number"]


def line_features(j: DataFrame, *more: str) -> DataFrame:
    """Residual and features of lines that have their rate and effect."""
    zero = F.lit(0.0)
    features = {"discount": F.nullif("l_discount", zero), "tax": F.nullif("l_tax", zero), "quantity": F.col("l_quantity"), "effect": F.col("effect"), "number": F.col("l_linenumber")}
    return j.select("season", "l_suppkey", "target", "rate", (F.col("target") - F.col("rate")).alias("rest"), *[c.alias(k) for k, c in features.items()], *more)


def residual_rows(spark, d) -> DataFrame:
    """Lines with the residual of their earlier rate and features; a discount or tax of 0 counts as missing, so does the effect of a supplier not seen before."""
    stage = Stage(spark)
    f = facts(spark, d, "l_discount", "l_tax", "l_quantity")
    effect, rate = supplier_state(stage, f)
    return line_features(f.join(small(stage(effect)), ["l_suppkey", "season"], "left").join(F.broadcast(rate), "season"))  # a rate for each year


def moved_losses(scored: DataFrame) -> DataFrame:
    """Of each year with a pipeline: lines, Brier score of the earlier rate and of it moved by the prediction, and the mean of the latter."""
    shift = X.clip(F.col("shift"), -0.03, 0.03)
    loss = lambda p: F.avg(F.pow(p - F.col("target"), 2))
    return scored.where("shift IS NOT NULL").groupBy("season").agg(F.count("*").alias("n"), loss(F.col("rate")).alias("base"), loss(X.clip(F.col("rate") + shift, 0.0, 1.0)).alias("brier"), F.avg("shift").alias("mean"))


def stored_run(spark, rows: DataFrame, features: list[str]) -> DataFrame:
    """Fit a pipeline for each year but the first two, whose rate no earlier year gives or that have no fold before them; store, read and apply it."""
    rows = Stage(spark)(rows)  # read three times, by the result too
    years = sorted(r[0] for r in rows.select("season").distinct().collect() if r[0] is not None)[1:]
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    frozen.save(spark, frozen.fit(rows.where(F.col("season").isin(years)), features, "rest", years), path)
    return frozen.apply(rows, frozen.load(spark, path), "shift")


def frozen_pipeline(spark, d):
    """A ridge of the residual for each year, fitted on the years before, written, read, checked and applied to the year's lines."""
    return rounded(moved_losses(stored_run(spark, residual_rows(spark, d), FEATURES)), "base", "brier", "mean")


def side_rows(spark, d) -> DataFrame:
    """Lines whose supplier the side log maps: the usual part brand of its lines of the year before, if 5 lines or more and a share of 0.02 support it, with the log's summary of that brand and year.

    A line of a year sees the mapping and the summary of the year before alone; lines without a mapping are left to the base.
    """
    stage = Stage(spark)
    f = facts(spark, d, "l_discount", "l_tax", "l_quantity")
    effect, rate = supplier_state(stage, f)
    part = table(spark, d, "part", ["p_partkey", "p_brand", "p_size"])
    log = facts(spark, d, "l_partkey", "l_extendedprice", "l_quantity")
    log = log.select("season", "l_suppkey", "l_partkey", "target", (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("price")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    means = {"brand_rate": "target", "brand_price": "price", "brand_size": "p_size"}
    added = [a for k, c in means.items() for a in (F.sum(c).alias(f"s_{k}"), F.count(c).alias(f"n_{k}"))]
    cells = stage(log.groupBy("l_suppkey", "season", "p_brand").agg(F.count("*").alias("c"), *added))  # lines meet their parts once
    best = cells.groupBy("season", "l_suppkey").agg(F.sum("c").alias("total"), F.min(F.struct((-F.col("c")).alias("neg"), F.col("p_brand").alias("brand"))).alias("m"))
    mapped = best.where((F.col("total") >= 5) & (-F.col("m.neg") / F.col("total") >= 0.02)).select((F.col("season") + 1).alias("season"), "l_suppkey", F.col("m.brand").alias("brand"), (-F.col("m.neg") / F.col("total")).alias("share"))
    sums = cells.groupBy((F.col("season") + 1).alias("season"), F.col("p_brand").alias("brand")).agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for k in means for x in "sn"])
    summary = sums.select("season", "brand", *[(F.col(f"s_{k}") / F.nullif(F.col(f"n_{k}"), F.lit(0))).alias(k) for k in means])
    side = mapped.join(effect, ["season", "l_suppkey"], "left").join(small(stage(summary)), ["season", "brand"])
    return line_features(f.join(small(stage(side)), ["season", "l_suppkey"]).join(F.broadcast(rate), "season"), "brand", "share", *means)  # a rate for each year


def side_log_residual(spark, d):
    """The frozen ridge on the lines a side log maps alone, with its summaries as features; the other lines keep the base and do not count here."""
    return rounded(moved_losses(stored_run(spark, side_rows(spark, d), [*FEATURES, "share", "brand_rate", "brand_price", "brand_size"])), "base", "brier", "mean")


QUERIES = {"frozen_pipeline": frozen_pipeline, "side_log_residual": side_log_residual}
ORACLES: dict[str, str] = {}
