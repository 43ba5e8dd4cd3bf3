"""Pivots, mixes, profiles, quantiles, slopes and two-level summaries of entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.quantiles import counted_quantiles
from ..sources.io import table
from .base import FACTS, facts, rounded

FLAGS = ["A", "N", "R"]


def propensity(spark, d):
    """Mix of return flags by supplier and status, shrunk to the supplier's mix; absent flags count 0. With its entropy."""
    f = facts(spark, d)
    cells = f.groupBy("l_suppkey", "l_linestatus").pivot("l_returnflag", FLAGS).count().na.fill(0)
    w = Window.partitionBy("l_suppkey")
    n = sum(F.col(x) for x in FLAGS)
    whole = sum(F.sum(x).over(w) for x in FLAGS)
    mix = {f"p_{x.lower()}": (F.col(x) + 20.0 * F.sum(x).over(w) / whole) / (n + 20.0) for x in FLAGS}
    out = cells.select("l_suppkey", "l_linestatus", n.alias("n"), *(c.alias(k) for k, c in mix.items()), X.entropy(F.array(*[F.col(x).cast("double") for x in FLAGS])).alias("entropy"))
    return rounded(out, *mix, "entropy")


_CELLS = f"{FACTS}, c AS (SELECT l_suppkey, l_linestatus, " + ", ".join(f"count(*) FILTER (l_returnflag = '{x}') AS c{x}" for x in FLAGS) + " FROM f GROUP BY ALL)"
_TERM = "CASE WHEN c{0} > 0 THEN -(c{0} / n) * ln(c{0} / n) ELSE 0 END"
PROPENSITY_SQL = f"WITH {_CELLS}, e AS (SELECT *, (cA + cN + cR)::DOUBLE AS n, " + ", ".join(f"sum(c{x}) OVER w AS t{x}" for x in FLAGS) + ", sum(cA + cN + cR) OVER w AS t FROM c WINDOW w AS (PARTITION BY l_suppkey))\n" + (
    "SELECT l_suppkey, l_linestatus, n::BIGINT AS n, " + ", ".join(f"round((c{x} + 20.0 * t{x} / t) / (n + 20.0), 6) AS p_{x.lower()}" for x in FLAGS)
    + ", round(" + " + ".join(_TERM.format(x) for x in FLAGS) + ", 6) AS entropy FROM e"
)


def expected_value(spark, d):
    """Expected price under a supplier's mix of line numbers, over the numbers that have prices, and its spread."""
    f = facts(spark, d, "l_extendedprice")
    price = f.where("l_linestatus = 'F'").groupBy("l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    mix = f.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("w"))
    joined = mix.join(F.broadcast(price), "l_linenumber", "left")
    seen = F.sum(F.when(F.col("m").isNotNull(), F.col("w")))
    e = F.sum(F.col("w") * F.col("m")) / F.nullif(seen, F.lit(0))
    spread = F.sum(F.col("w") * F.col("m") * F.col("m")) / F.nullif(seen, F.lit(0)) - e * e
    return joined.groupBy("l_suppkey").agg(F.round(e, 4).alias("expected"), F.round(F.sqrt(F.greatest(spread, F.lit(0.0))), 3).alias("spread"))


EXPECTED_SQL = f"""WITH {FACTS}, p AS (SELECT l_linenumber, avg(l_extendedprice) AS m FROM f WHERE l_linestatus = 'F' GROUP BY 1), w AS (SELECT l_suppkey, l_linenumber, count(*) AS w FROM f GROUP BY 1, 2)
SELECT l_suppkey, round(sum(w * m) / nullif(sum(w) FILTER (m IS NOT NULL), 0), 4) AS expected,
  round(sqrt(greatest(sum(w * m * m) / nullif(sum(w) FILTER (m IS NOT NULL), 0) - (sum(w * m) / nullif(sum(w) FILTER (m IS NOT NULL), 0)) ** 2, 0)), 3) AS spread
FROM w LEFT JOIN p USING (l_linenumber) GROUP BY 1"""


RAKING = 4


def raked_weights(spark, d):
    """Weights of a supplier's cells of status and line number, raked in RAKING rounds to fixed shares of either: .6 and .4 of the statuses, a seventh of each number; and how far the statuses are off."""
    cells = facts(spark, d).groupBy("l_suppkey", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))
    share = F.when(F.col("l_linestatus") == "O", 0.6).otherwise(0.4)
    w = cells.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")))
    for _ in range(RAKING):
        w = w.withColumn("weight", F.col("weight") * share / F.sum("weight").over(Window.partitionBy("l_suppkey", "l_linestatus")))
        w = w.withColumn("weight", F.col("weight") / 7.0 / F.sum("weight").over(Window.partitionBy("l_suppkey", "l_linenumber")))
    off = F.abs(F.sum("weight").over(Window.partitionBy("l_suppkey", "l_linestatus")) - share)
    return rounded(w.select("l_suppkey", "l_linestatus", "l_linenumber", "weight", off.alias("off")), "weight", "off")


def _raked_sql() -> str:
    share = "CASE WHEN l_linestatus = 'O' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END"
    parts = ["w0 AS (SELECT l_suppkey, l_linestatus, l_linenumber, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS weight FROM lineitem GROUP BY 1, 2, 3)"]
    for i in range(RAKING):
        parts.append(f"v{i} AS (SELECT * REPLACE (weight * {share} / sum(weight) OVER (PARTITION BY l_suppkey, l_linestatus) AS weight) FROM w{i})")
        parts.append(f"w{i + 1} AS (SELECT * REPLACE (weight / 7.0 / sum(weight) OVER (PARTITION BY l_suppkey, l_linenumber) AS weight) FROM v{i})")
    return f"WITH {', '.join(parts)} SELECT l_suppkey, l_linestatus, l_linenumber, round(weight, 6) AS weight, round(abs(sum(weight) OVER (PARTITION BY l_suppkey, l_linestatus) - {share}), 6) AS off FROM w{RAKING}"


RAKED_SQL = _raked_sql()


def profile(spark, d):
    """Mean, spread, exact quantiles, distinct parts and mode of the line number of each supplier: values are counted first, so that no supplier's lines are held at once."""
    f = facts(spark, d, "l_extendedprice", "l_quantity", "l_partkey", "l_orderkey")
    g = f.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("sd"), F.stddev_pop("l_quantity").alias("sd_pop"))
    parts = f.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("parts"))
    lines = f.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("m")).groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("m", -F.col("l_linenumber"))).alias("common_line"))
    prices = counted_quantiles(f, "l_suppkey", "l_extendedprice", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    middle = counted_quantiles(f, "l_suppkey", "l_quantity", {"middle": 0.5})
    out = g.join(parts, "l_suppkey").join(lines, "l_suppkey").join(prices, "l_suppkey").join(middle, "l_suppkey").withColumn("width", F.col("q90") - F.col("q10"))
    return out.withColumns({c: F.round(c, 3) for c in ("mean", "sd", "sd_pop", "q10", "q50", "q90", "width")})


PROFILE_SQL = """WITH m AS (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS sd, round(stddev_pop(l_quantity), 3) AS sd_pop, count(DISTINCT l_partkey)::BIGINT AS parts,
  median(l_quantity) AS middle, round(quantile_cont(l_extendedprice, 0.1), 3) AS q10, round(quantile_cont(l_extendedprice, 0.5), 3) AS q50, round(quantile_cont(l_extendedprice, 0.9), 3) AS q90,
  round(quantile_cont(l_extendedprice, 0.9) - quantile_cont(l_extendedprice, 0.1), 3) AS width FROM lineitem GROUP BY 1)
SELECT g.*, l_linenumber AS common_line FROM g JOIN m USING (l_suppkey) WHERE r = 1"""


def centred_slope(spark, d):
    """Slope of price on line number centred within the order, summed by supplier; rows without a price count in the denominator."""
    f = facts(spark, d, "l_orderkey", "l_extendedprice")
    xc = F.col("l_linenumber") - F.avg("l_linenumber").over(Window.partitionBy("l_orderkey"))
    g = f.withColumn("xc", xc).groupBy("l_suppkey").agg((F.sum(F.col("xc") * F.col("l_extendedprice")) / F.nullif(F.sum(F.col("xc") * F.col("xc")), F.lit(0.0))).alias("slope"))
    return g.select("l_suppkey", F.round("slope", 4).alias("slope"))


SLOPE_SQL = """SELECT l_suppkey, round(sum(xc * l_extendedprice) / nullif(sum(xc * xc), 0), 4) AS slope FROM (
  SELECT *, l_linenumber - avg(l_linenumber) OVER (PARTITION BY l_orderkey) AS xc FROM lineitem) GROUP BY 1"""


def period_delta(spark, d):
    """Change of a supplier's mean quantity from early to late years, and all-history against last-year means."""
    f = facts(spark, d, "l_quantity")
    q = F.col("l_quantity")
    g = f.groupBy("l_suppkey").agg(
        (F.avg(F.when(F.col("season") >= 1999, q)) - F.avg(F.when(F.col("season") < 1998, q))).alias("delta"),
        F.avg(q).alias("history"), F.avg(F.when(F.col("season") == 2001, q)).alias("last"),
    )
    return rounded(g, "delta", "history", "last")


DELTA_SQL = f"""WITH {FACTS} SELECT l_suppkey, round(avg(l_quantity) FILTER (season >= 1999) - avg(l_quantity) FILTER (season < 1998), 6) AS delta,
  round(avg(l_quantity), 6) AS history, round(avg(l_quantity) FILTER (season = 2001), 6) AS last FROM f GROUP BY 1"""


def trajectory(spark, d):
    """Slope, spread and last value of a supplier's yearly rates over its last three years."""
    f = facts(spark, d)
    y = f.groupBy("l_suppkey", "season").agg(F.avg("target").alias("rate"))
    last = y.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("season")))).where("r <= 3")
    g = last.groupBy("l_suppkey").agg(F.regr_slope("rate", "season").alias("slope"), F.stddev_pop("rate").alias("spread"), F.max_by("rate", "season").alias("last_rate"), F.count("*").alias("years"))
    return rounded(g, "slope", "spread", "last_rate")


TRAJECTORY_SQL = f"""WITH {FACTS}, y AS (SELECT l_suppkey, season, avg(target) AS rate FROM f GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY season DESC) AS r FROM y)
SELECT l_suppkey, round(regr_slope(rate, season), 6) AS slope, round(stddev_pop(rate), 6) AS spread, round(arg_max(rate, season), 6) AS last_rate, count(*)::BIGINT AS years FROM l WHERE r <= 3 GROUP BY 1"""


def workload(spark, d):
    """Two levels: lines to orders, orders to customers."""
    li = table(spark, d, "lineitem", ["l_orderkey", "l_quantity"]).groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("q"))
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    g = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.avg("lines").alias("mean_lines"), F.max("lines").alias("most_lines"), F.stddev_samp("q").alias("sd_q"))
    return rounded(g, "mean_lines", "sd_q")


WORKLOAD_SQL = """WITH l AS (SELECT l_orderkey, count(*)::BIGINT AS lines, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*)::BIGINT AS orders, round(avg(lines), 6) AS mean_lines, max(lines) AS most_lines, round(stddev_samp(q), 6) AS sd_q FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1"""


def period_outer(spark, d):
    """Summaries of two periods side by side; parts of one period alone keep nulls for the other."""
    f = facts(spark, d, "l_partkey", "l_quantity")
    a = f.where("season <= 1996").groupBy("l_partkey").agg(F.sum("l_quantity").alias("early"))
    b = f.where("season >= 2000").groupBy("l_partkey").agg(F.sum("l_quantity").alias("late"))
    return a.join(b, "l_partkey", "full")


OUTER_SQL = f"""WITH {FACTS}, a AS (SELECT l_partkey, sum(l_quantity) AS early FROM f WHERE season <= 1996 GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity) AS late FROM f WHERE season >= 2000 GROUP BY 1)
SELECT l_partkey, early, late FROM a FULL JOIN b USING (l_partkey)"""


def period_pivot(spark, d):
    """Counts of return flags by year, absent cells 0."""
    return facts(spark, d).groupBy("season").pivot("l_returnflag", FLAGS).count().na.fill(0)


PIVOT_SQL = f"WITH {FACTS} SELECT season, " + ", ".join(f'count(*) FILTER (l_returnflag = \'{x}\')::BIGINT AS "{x}"' for x in FLAGS) + " FROM f GROUP BY 1"


def univariate_signals(spark, d):
    """Standardised slope of the outcome on each measure by year."""
    f = facts(spark, d, "l_quantity", "l_discount", "l_tax")
    long = f.unpivot(["season", "target"], ["l_quantity", "l_discount", "l_tax"], "feature", "x")
    g = long.groupBy("season", "feature").agg((F.covar_pop("x", "target") / F.nullif(F.stddev_pop("x"), F.lit(0.0))).alias("slope"))
    signs = g.withColumn("agree", F.size(F.collect_set(F.signum(F.round("slope", 9))).over(Window.partitionBy("feature"))))
    return rounded(signs, "slope")


SIGNAL_SQL = f"""WITH {FACTS}, u AS (UNPIVOT (SELECT season, target, l_quantity, l_discount, l_tax FROM f) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x),
g AS (SELECT season, feature, covar_pop(x, target) / nullif(stddev_pop(x), 0) AS slope FROM u GROUP BY 1, 2)
SELECT season, feature, round(slope, 6) AS slope, (SELECT count(DISTINCT sign(round(h.slope, 9))) FROM g h WHERE h.feature = g.feature)::INTEGER AS agree FROM g"""

QUERIES = {
    "propensity_entropy": propensity, "expected_value_mix": expected_value, "raked_weights": raked_weights, "profile_quantiles": profile, "centred_slope": centred_slope,
    "period_delta": period_delta, "career_trajectory": trajectory, "workload_two_level": workload, "period_outer_join": period_outer, "count_pivot": period_pivot,
    "univariate_signals": univariate_signals,
}
ORACLES = {
    "propensity_entropy": PROPENSITY_SQL, "expected_value_mix": EXPECTED_SQL, "raked_weights": RAKED_SQL, "profile_quantiles": PROFILE_SQL, "centred_slope": SLOPE_SQL,
    "period_delta": DELTA_SQL, "career_trajectory": TRAJECTORY_SQL, "workload_two_level": WORKLOAD_SQL, "period_outer_join": OUTER_SQL, "count_pivot": PIVOT_SQL,
    "univariate_signals": SIGNAL_SQL,
}
