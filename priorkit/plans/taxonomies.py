"""Classes and auxiliary outcomes of lines, fitted on earlier years, and what they say of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import classes
from ..sources.io import Stage
from .base import rounded
from .history import joint_class
from .learners import FIELDS, field_cells, years_of

CLASSES = [f"class_{k}" for k in range(5)]
#: Outcomes beside the target: kept for good, taxed above its discount.
AUXILIARY = [["kept", "not_kept"], ["taxed", "not_taxed"]]


def outcome_cells(spark, d) -> DataFrame:
    """The cells of the fields with the lines of every class and of either side of the auxiliary outcomes."""
    kept, taxed = F.coalesce(F.col("l_returnflag") == "A", F.lit(False)), F.coalesce(F.col("l_tax") > F.col("l_discount"), F.lit(False))
    counts = {c: joint_class() == k for k, c in enumerate(CLASSES)} | {"kept": kept, "not_kept": ~kept, "taxed": taxed, "not_taxed": ~taxed}
    return field_cells(spark, d, counts, "l_tax")


def fitted(spark, d, groups, stage: Stage) -> tuple[DataFrame, classes.ClassModel]:
    cells = stage(outcome_cells(spark, d))
    model = classes.boost_classes(cells, list(FIELDS), list(FIELDS.values()), groups, years_of(cells))
    return classes.class_scored(cells, model), model


def class_taxonomy(spark, d):
    """Probabilities of the five classes in each year, fitted on the years before, each weighing alike: log loss of the earlier shares and of the model, and how far the probabilities' sum is from 1 at most."""
    stage = Stage(spark)  # the result reads it
    scored, model = fitted(spark, d, [CLASSES], stage)
    shares = spark.createDataFrame([(f, *[s[c] for c in CLASSES]) for f, s in model.shares.items()], "season int, " + ", ".join(f"s_{c} double" for c in CLASSES))
    loss = lambda p: F.sum(-sum(F.col(c) * F.log(F.col(p + c)) for c in CLASSES)) / F.sum("n")
    out = scored.where("p_class_0 IS NOT NULL").join(F.broadcast(shares), "season")
    out = out.groupBy("season").agg(F.sum("n").cast("long").alias("n"), loss("s_").alias("base"), loss("p_").alias("model"), F.max(F.abs(sum(F.col(f"p_{c}") for c in CLASSES) - 1)).alias("off"))
    return rounded(out, "base", "model", "off")


#: Of each outcome all classes but one: the last is what the others leave of 1.
SIGNALS = [f"p_{c}" for g in [CLASSES, *AUXILIARY] for c in g[:-1]]


def auxiliary_stack(spark, d):
    """A ridge of the target's residual on out-of-fold scores of the classes and of the auxiliary outcomes, less their earlier shares: fitted on scores of earlier years, which saw still earlier ones alone."""
    stage = Stage(spark)
    scored, model = fitted(spark, d, [CLASSES, *AUXILIARY], stage)
    shares = spark.createDataFrame([(f, *[s[c[2:]] for c in SIGNALS]) for f, s in model.shares.items()], "season int, " + ", ".join(f"s_{c} double" for c in SIGNALS))
    p = X.expit(F.col("offset"))
    x = {f"x_{c}": F.col(c) - F.col(f"s_{c}") for c in SIGNALS}
    moved = stage(scored.join(F.broadcast(shares), "season").withColumns(x).withColumn("rest", F.col("hits") - F.col("n") * p).select("season", "n", "hits", "offset", "rest", *x))
    weights = classes.rolling_ridge(moved, list(x), "rest", "n", 50.0)
    found = spark.createDataFrame([(y, [float(v) for v in w], float(abs(w).sum())) for y, w in weights.items()], "season int, w array<double>, size double")
    shift = X.clip(F.coalesce(sum(F.col("w")[i] * F.col(c) for i, c in enumerate(x)), F.lit(0.0)), -0.03, 0.03)
    brier = lambda q: F.sum(F.col("hits") * F.pow(1 - q, 2) + (F.col("n") - F.col("hits")) * F.pow(q, 2)) / F.sum("n")
    out = moved.join(F.broadcast(found), "season", "left").groupBy("season").agg(F.sum("n").cast("long").alias("n"), brier(p).alias("base"), brier(X.clip(p + shift, 0.0, 1.0)).alias("brier"), F.max("size").alias("size"))
    return rounded(out, "base", "brier", "size")


QUERIES = {"class_taxonomy": class_taxonomy, "auxiliary_stack": auxiliary_stack}
ORACLES: dict[str, str] = {}
