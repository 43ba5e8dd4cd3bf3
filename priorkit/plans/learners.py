"""Models of interactions fitted on earlier years alone, over weighted cells of binned fields."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import logit, machines, mixed, states, trees
from ..sources.io import Stage, shared_folder, small, table
from .base import facts, rounded, supplier_state

#: Fields and how many codes each has: the supplier's earlier effect, number, status, quantity, discount and quarter of the line.
FIELDS = {"effect": 8, "number": 7, "status": 2, "quantity": 5, "discount": 4, "quarter": 4}


def field_cells(spark, d, counts: dict[str, Column] | None = None, *columns: str) -> DataFrame:
    """(season, FIELDS, n, hits, offset): all lines by their binned fields; the offset is the logit of the rate of earlier years. With the sums of `counts`, over `columns` too."""
    counts = counts or {}
    f, stage = facts(spark, d, "l_quantity", "l_discount", *columns), Stage(spark)
    effect, rate = supplier_state(stage, f)
    j = f.join(small(stage(effect)), ["l_suppkey", "season"], "left")
    codes = {
        "effect": X.truncated_bin(F.coalesce("effect", F.lit(0.0)), -0.06, 0.015, 7), "number": F.col("l_linenumber") - 1, "status": (F.col("l_linestatus") == "O").cast("int"),
        "quantity": X.truncated_bin(F.col("l_quantity"), 1.0, 10.0, 4), "discount": X.truncated_bin(F.col("l_discount"), 0.0, 0.03, 3), "quarter": F.quarter("l_shipdate") - 1,
    }
    sums = [F.sum(c).cast("double").alias(c) for c in counts]
    cells = j.select("season", "target", *[c.alias(k) for k, c in codes.items()], *[c.cast("int").alias(k) for k, c in counts.items()]).groupBy("season", *codes).agg(F.count("*").cast("double").alias("n"), F.sum("target").cast("double").alias("hits"), *sums)
    return cells.join(F.broadcast(rate), "season").withColumn("offset", X.logit(F.col("rate"), 1e-3)).drop("rate")  # a row for each year


def years_of(cells: DataFrame) -> list[int]:
    """All years but the first."""
    return sorted(r[0] for r in cells.select("season").distinct().collect() if r[0] is not None)[1:]


def losses(scored: DataFrame, fitted: dict) -> DataFrame:
    """Of each year: lines, Brier score of the offset and of the model, steps, and the objective's first and last value."""
    brier = lambda p: F.sum(F.col("hits") * F.pow(1 - p, 2) + (F.col("n") - F.col("hits")) * F.pow(p, 2)) / F.sum("n")
    out = scored.where("logit IS NOT NULL").groupBy("season").agg(F.sum("n").cast("long").alias("n"), brier(X.expit(F.col("offset"))).alias("base"), brier(X.expit(F.col("logit"))).alias("brier"))
    spark = scored.sparkSession
    steps = spark.createDataFrame([(f, len(t), t[0], t[-1]) for f, (_, t) in fitted.items() if t], "season int, steps int, first double, last double")
    return rounded(out.join(F.broadcast(steps), "season"), "base", "brier", "first", "last")


def learned(spark, d, machine) -> DataFrame:
    stage = Stage(spark)  # the result reads it
    cells = stage(field_cells(spark, d))
    fitted = machines.train(cells, machine, list(FIELDS), years_of(cells))
    return losses(machines.scored(cells, machine, list(FIELDS), fitted), fitted)


def interaction_machine(spark, d):
    """A factorisation machine of orders 1 to 3 of each year, fitted on the years before, beside the earlier rate."""
    return learned(spark, d, machines.Factorisation(list(FIELDS.values())))


def cross_network(spark, d):
    """A cross network of two layers of each year, fitted on the years before, beside the earlier rate."""
    return learned(spark, d, machines.CrossNetwork(list(FIELDS.values())))


#: Columns of the bounded fit, their bounds and penalties.
BOUNDED = {"x_effect": (0.0, 1.0, 4.0), "x_quantity": (-0.2, 0.2, 4.0), "x_discount": (-0.2, 0.2, 4.0), "x_open": (-0.1, 0.1, 4.0), "x_trend": (-0.05, 0.05, 4.0)}


def bounded_logit(spark, d):
    """Coefficients of each year, fitted on the years before beside their rate's logit and held within bounds; rounds, objective and distance from the conditions of an optimum."""
    with Stage(spark) as stage:
        cells = stage(field_cells(spark, d))
        years = years_of(cells)
        x = {"x_effect": (F.col("effect") - 3.5) / 8, "x_quantity": (F.col("quantity") - 2.0) / 4, "x_discount": (F.col("discount") - 1.5) / 3, "x_open": F.col("status") - 0.5, "x_trend": (F.col("season") - (years[0] if years else 0)) / 4.0}
        lower, upper, penalty = zip(*BOUNDED.values())
        fits = logit.bounded_logistic(cells.withColumns(x), list(BOUNDED), years, lower, upper, penalty)
    rows = [(f, c, float(b), bool(b in (lo, hi)), len(fit.told), fit.told[-1], fit.kkt) for f, fit in fits.items() for (c, (lo, hi, _)), b in zip(BOUNDED.items(), fit.beta)]
    return rounded(spark.createDataFrame(rows, "season int, feature string, coefficient double, at_bound boolean, rounds int, objective double, kkt double"), "coefficient", "objective")


SLOPES = ["one", "quantity", "discount"]


def slope_rows(spark, d) -> DataFrame:
    """Lines with the residual of their year, slopes' numbers, the part's brand and the line's context, once for each later year (fold) that may see them."""
    f = states.demeaned(facts(spark, d, "l_partkey", "l_quantity", "l_discount"), "target", "residual")
    brand = table(spark, d, "part", ["p_partkey", "p_brand"])
    f = f.join(brand, f["l_partkey"] == brand["p_partkey"])
    context = (F.col("l_linenumber") - 1) * 2 + (F.col("l_linestatus") == "O").cast("int")
    return f.select("season", "l_suppkey", "p_brand", context.alias("context"), F.lit(1.0).alias("one"), ((F.col("l_quantity") - 25.5) / 25).alias("quantity"), ((F.col("l_discount") - 0.05) / 0.05).alias("discount"), "residual", "target")


def random_slope_effects(spark, d):
    """Of each year: Brier score of the earlier rate, and moved by the slopes of suppliers with intercepts of brands and contexts, fitted on the years before; the fold's variances beside them."""
    stage = Stage(spark)
    rows = stage.bucketed(slope_rows(spark, d), "l_suppkey")  # no round moves it
    years = sorted(r[0] for r in rows.select("season").distinct().collect() if r[0] is not None)[1:]
    if not years:
        return spark.createDataFrame([], "season int, n long, base double, brier double, noise double, slope_variance double, covariance double")
    cells = mixed.product_rows(rows, "season", "l_suppkey", "p_brand", "context", SLOPES, "residual")
    slopes, others, contexts, variances, _ = mixed.random_slopes(cells, len(SLOPES), stage, rounds=6, folds=years)
    j = rows.withColumn("fold", F.col("season")).join(small(slopes.withColumnRenamed("entity", "l_suppkey")), ["fold", "l_suppkey"], "left")
    j = j.join(small(others.withColumnRenamed("other", "p_brand")), ["fold", "p_brand"], "left").join(small(contexts), ["fold", "context"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))  # noqa: E731  unseen keys
    moved = sum((zero(f"u_{i}") * F.col(c) for i, c in enumerate(SLOPES)), zero("a") + zero("b"))
    rate = states.prior_rate(rows, F.col("target"))
    j = j.join(F.broadcast(rate), "season").where(F.col("season").isin(years))  # a row for each year
    loss = lambda p: F.avg(F.pow(p - F.col("target"), 2))
    out = j.groupBy("season").agg(F.count("*").alias("n"), loss(F.col("rate")).alias("base"), loss(X.clip(F.col("rate") + X.clip(moved, -0.03, 0.03), 0.0, 1.0)).alias("brier"))
    told = spark.createDataFrame([(f, v.noise, float(v.slopes[0, 0]), float(v.slopes[0, 1])) for f, v in variances.items()], "season int, noise double, slope_variance double, covariance double")
    return rounded(out.join(F.broadcast(told), "season"), "base", "brier", "noise", "slope_variance", "covariance")


ROUNDS = 10


def boosted_cells(spark, d, stage: Stage) -> tuple[DataFrame, list[int]]:
    """Cells with `rest`, the hits beyond those the offset expects, of all years but the first, whose offset no earlier year gives; and these years."""
    cells = stage(field_cells(spark, d).withColumn("rest", F.col("hits") - F.col("n") * X.expit(F.col("offset"))))
    years = years_of(cells)
    return cells.where(F.col("season").isin(years)), years


def shifted_losses(scored: DataFrame) -> DataFrame:
    """Of each year: lines, Brier score of the earlier rate, and of it moved by `shift`."""
    p = X.expit(F.col("offset"))
    brier = lambda p: F.sum(F.col("hits") * F.pow(1 - p, 2) + (F.col("n") - F.col("hits")) * F.pow(p, 2)) / F.sum("n")
    return scored.where("shift IS NOT NULL").groupBy("season").agg(F.sum("n").cast("long").alias("n"), brier(p).alias("base"), brier(X.clip(p + F.col("shift"), 0.0, 1.0)).alias("brier"))


def residual_boosting(spark, d):
    """Trees on the residuals of each year, fitted on the years before, as many as lost least in the year before it, when that was the year to come."""
    stage = Stage(spark)  # the result reads it
    cells, years = boosted_cells(spark, d, stage)
    fields, sizes = list(FIELDS), list(FIELDS.values())
    nodes = trees.boost(cells, fields, sizes, years, rounds=ROUNDS)
    counts = trees.counts_from_prior(trees.staged_losses(cells, nodes, fields, years, ROUNDS), ROUNDS // 2)
    told = spark.createDataFrame(list(counts.items()), "season int, trees int")
    return rounded(shifted_losses(trees.scored(cells, nodes, fields, counts)).join(F.broadcast(told), "season"), "base", "brier")


def stored_ensemble(spark, d):
    """An ensemble fitted for each year, written as a table of nodes, read and checked, and applied to the year's cells: its size, and whether all scores are those of the fitted one."""
    stage = Stage(spark)
    cells, years = boosted_cells(spark, d, stage)
    fields, sizes = list(FIELDS), list(FIELDS.values())
    nodes = trees.boost(cells, fields, sizes, years, rounds=3, depth=3)
    path = f"{shared_folder(spark)}/ensemble-{uuid.uuid4().hex}"
    trees.save_ensemble(spark, nodes, path)
    stored = trees.load_ensemble(spark, path)
    counts = dict.fromkeys(years, 3)
    after = trees.scored(trees.scored(cells, nodes, fields, counts).withColumnRenamed("shift", "before"), stored, fields, counts)
    size = spark.createDataFrame([(f, sum(n["fold"] == f for n in stored), sum(n["fold"] == f and "leaf" in n for n in stored)) for f in years], "season int, nodes int, leaves int")
    same = after.where("shift IS NOT NULL").groupBy("season").agg(F.every(F.col("before") == F.col("shift")).alias("equal"))
    return rounded(shifted_losses(after).join(F.broadcast(size), "season").join(same, "season"), "base", "brier")


def factorisation_machine(spark, d):
    """A factorisation machine of order 2 of each year, fitted on the years before, beside the earlier rate."""
    return learned(spark, d, machines.Factorisation(list(FIELDS.values()), rank=4, orders=(2,)))


QUERIES = {
    "interaction_machine": interaction_machine, "cross_network": cross_network, "factorisation_machine": factorisation_machine, "bounded_logit": bounded_logit, "random_slope_effects": random_slope_effects,
    "residual_boosting": residual_boosting, "stored_ensemble": stored_ensemble,
}
ORACLES: dict[str, str] = {}
