"""Exact quantiles by group without holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted_quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, quantiles): exact ones, interpolated, from counted values and running sums: no group is held in memory. Nulls do not count; a key without values has nulls."""
    w = Window.partitionBy(key).orderBy(value)
    c = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__m")).withColumn("__upto", F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = rows.groupBy(key).agg((F.count(value) - 1).alias("__last"))
    at = lambda share: F.lit(share) * F.col("__last")
    ends = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col(value)))
    found = n.join(c, key, "left").groupBy(key).agg(F.first("__last").alias("__last"), *[ends(F.floor(at(s))).alias(f"__lo_{k}") for k, s in shares.items()], *[ends(F.ceil(at(s))).alias(f"__hi_{k}") for k, s in shares.items()])
    part = lambda s: at(s) - F.floor(at(s))
    return found.select(key, *[(F.col(f"__lo_{k}") + part(s) * (F.col(f"__hi_{k}") - F.col(f"__lo_{k}"))).alias(k) for k, s in shares.items()])
