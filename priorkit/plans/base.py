"""The fact rows the queries share, and their SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import states
from ..sources.io import BROADCAST_ROWS, Stage, small, table  # noqa: F401

PLACES = 6


def facts(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Line items as dated binary outcomes: season, target (returned), entity keys; only these columns are scanned."""
    wanted = dict.fromkeys(["l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_shipdate", *extra])
    return table(spark, sf_dir, "lineitem", list(wanted)).withColumns(
        {"season": F.year("l_shipdate"), "target": (F.col("l_returnflag") == "R").cast("int")}
    )


FACTS = "f AS (SELECT *, year(l_shipdate)::INTEGER AS season, (l_returnflag = 'R')::INTEGER AS target FROM lineitem)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are compared after rounding."""
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def supplier_state(stage: Stage, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(effects of suppliers by year, earlier rates of years), from one scan of the lines."""
    sums = stage(states.period_sums(f, ["l_suppkey"], F.col("target")))  # read by both
    rate = states.earlier_rate(sums.groupBy("season").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    return states.residual_effects(sums, ["l_suppkey"], 200.0, 3), rate
