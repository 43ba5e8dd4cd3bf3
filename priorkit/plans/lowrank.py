"""Factors of rank r: of the sparse matrix of suppliers and parts, of what biases leave, and of weighted cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import factors, linalg, states
from ..sources.io import Stage, small
from .base import facts, rounded
from .models import effect_matrix

RANK = 3
#: Singular values are right to about the square of this share of the largest.
TOLERANCE = 1e-2
#: Directions beyond the wanted ones that the iteration carries.
EXTRA = 9
#: At most so many rounds; the residual in the result says how far they came.
ROUNDS = 12


def pair_cells(spark, d) -> DataFrame:
    """(l_suppkey, l_partkey, value): shrunk mean residual of each pair that occurs."""
    f = states.demeaned(facts(spark, d, "l_partkey"), "target", "r")
    return f.groupBy("l_suppkey", "l_partkey").agg((F.sum("r") / (F.count("*") + 2.0)).alias("value"))


def told(spark, df: DataFrame, sigma: np.ndarray, residual: float) -> DataFrame:
    """`df` with the singular values and the residual of the iteration."""
    return df.withColumns({f"sigma{i}": F.lit(float(s)) for i, s in enumerate(sigma)}).withColumn("residual", F.lit(residual))


def pair_svd(spark, d):
    """Of each supplier: its pairs, their squares, what the RANK leading directions of suppliers x parts leave of them; the singular values, and how far the iteration is from them."""
    stage = Stage(spark)  # the result reads it
    cells = stage(pair_cells(spark, d))
    left, sigma, right, residual = factors.truncated_svd(cells, "l_suppkey", "l_partkey", RANK, stage, rounds=ROUNDS, tolerance=TOLERANCE, extra=EXTRA)
    fit = factors.fitted_products(cells, left, right, "l_suppkey", "l_partkey", sigma)
    out = fit.groupBy("l_suppkey").agg(F.count("*").alias("cells"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.sum(F.pow(F.col("value") - F.col("fit"), 2)).alias("rest"))
    return rounded(told(spark, out, sigma, residual), "squares", "rest", *[f"sigma{i}" for i in range(RANK)])


def interaction_svd(spark, d):
    """Of each context: squares of the mean residuals of suppliers x contexts, what ridge biases of both sides leave, and what the two leading directions of that rest leave."""
    stage = Stage(spark)
    cells = stage(effect_matrix(spark, d))
    a, b = linalg.two_way_bias(cells, "l_suppkey", "context", "s", "n", 200.0, 50.0, 3)
    rest = cells.join(small(a), "l_suppkey").join(small(b), "context")
    rest = stage(rest.select("l_suppkey", "context", "n", (F.col("s") / F.col("n")).alias("mean"), ((F.col("s") - F.col("n") * (F.col("bias_a") + F.col("bias_b"))) / (F.col("n") + 20.0)).alias("value")))
    left, sigma, right, residual = factors.truncated_svd(rest.select("l_suppkey", "context", "value"), "l_suppkey", "context", 2, stage, rounds=ROUNDS, tolerance=TOLERANCE, extra=EXTRA)
    fit = factors.fitted_products(rest, left, right, "l_suppkey", "context", sigma)
    square = lambda c: F.sum(F.col("n") * F.pow(c, 2))
    out = fit.groupBy("context").agg(F.sum("n").alias("n"), square(F.col("mean")).alias("squares"), F.sum(F.pow("value", 2)).alias("interaction"), F.sum(F.pow(F.col("value") - F.col("fit"), 2)).alias("rest"))
    return rounded(told(spark, out, sigma, residual), "squares", "interaction", "rest", "sigma0", "sigma1")


def als_factors(spark, d):
    """Of each context: weighted squares of the mean residuals, what factors of rank 2 leave of them, and the objective's first and last value and rounds."""
    stage = Stage(spark)
    cells = stage(effect_matrix(spark, d).select("l_suppkey", "context", (F.col("s") / F.col("n")).alias("value"), F.col("n").cast("double").alias("weight")))
    left, right, objectives = factors.weighted_als(cells, "l_suppkey", "context", 2, 25.0, stage, rounds=12, tolerance=1e-4)
    fit = factors.fitted_products(cells, left, right, "l_suppkey", "context", np.ones(2))
    square = lambda c: F.sum(F.col("weight") * F.pow(c, 2))
    out = fit.groupBy("context").agg(square(F.col("value")).alias("squares"), square(F.col("value") - F.col("fit")).alias("rest"))
    out = out.withColumns({"first": F.lit(objectives[0] if objectives else None).cast("double"), "last": F.lit(objectives[-1] if objectives else None).cast("double"), "rounds": F.lit(len(objectives))})
    return rounded(out, "squares", "rest", "first", "last")


QUERIES = {"pair_svd": pair_svd, "interaction_svd": interaction_svd, "als_factors": als_factors}
ORACLES: dict[str, str] = {}
