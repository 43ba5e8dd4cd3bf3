"""Frozen vocabularies, imputation, spline and piecewise codes, group weights, state filters and agreement of labels."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import linalg
from ..operators.quantiles import counted_quantiles
from ..sources.io import table
from .base import FACTS, facts, rounded, small
from .models import NAMES, candidates

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def one_hot(spark, d):
    """One column for each segment in a fixed order, and one for segments that are null or of no column. Of customers with a negative balance the segment counts as null."""
    c = table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    hot = [F.coalesce((segment == s).cast("int"), F.lit(0)).alias(f"is_{s.lower()}") for s in SEGMENTS]
    return c.select("c_custkey", *hot, (~F.coalesce(segment.isin(SEGMENTS), F.lit(False))).cast("int").alias("is_missing"))


_SEGMENT = "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END"
ONE_HOT_SQL = "SELECT c_custkey, " + ", ".join(f"coalesce(({_SEGMENT} = '{s}')::INTEGER, 0) AS is_{s.lower()}" for s in SEGMENTS) + (
    f", (NOT coalesce({_SEGMENT} IN ({', '.join(map(repr, SEGMENTS))}), false))::INTEGER AS is_missing FROM customer"
)


def frozen_codes(spark, d):
    """Dense codes of the part types among small parts, in order; other parts get the code of their type, or null where it was not seen."""
    p = table(spark, d, "part", ["p_partkey", "p_type", "p_size"])
    vocabulary = p.where("p_size <= 2").groupBy("p_type").count().select("p_type", (F.dense_rank().over(Window.orderBy("p_type")) - 1).alias("code"))
    return p.join(small(vocabulary), "p_type", "left").select("p_partkey", "code")


FROZEN_SQL = """WITH v AS (SELECT p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_size <= 2))
SELECT p_partkey, code FROM part LEFT JOIN v USING (p_type)"""


def imputed(spark, d):
    """Sizes above 40 count as missing: the median takes their place; then centred, divided by the standard deviation of the whole, with a flag."""
    size = F.when(F.col("p_size") <= 40, F.col("p_size"))
    p = table(spark, d, "part", ["p_partkey", "p_size"]).select("p_partkey", size.alias("size"))
    filled = p.join(F.broadcast(p.agg(F.percentile("size", F.lit(0.5)).alias("median"))))
    filled = filled.select("p_partkey", F.coalesce("size", "median").alias("x"), F.col("size").isNull().cast("int").alias("missing"))
    whole = filled.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    out = filled.join(F.broadcast(whole)).select("p_partkey", "missing", ((F.col("x") - F.col("m")) / F.nullif("s", F.lit(0))).alias("scaled"))
    return rounded(out, "scaled")


IMPUTED_SQL = """WITH p AS (SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size END AS size FROM part),
x AS (SELECT p_partkey, (size IS NULL)::INTEGER AS missing, coalesce(size, (SELECT quantile_cont(size, 0.5) FROM p)) AS x FROM p)
SELECT p_partkey, missing, round((x - (SELECT avg(x) FROM x)) / nullif((SELECT stddev_pop(x) FROM x), 0), 6) AS scaled FROM x"""

KNOTS = [0.0, 0.02, 0.05, 0.1]


def piecewise(spark, d):
    """Mean piecewise-linear codes of the discounts of each supplier."""
    codes = X.piecewise_codes(F.col("l_discount"), KNOTS)
    return table(spark, d, "lineitem", ["l_suppkey", "l_discount"]).groupBy("l_suppkey").agg(*[F.round(F.avg(c), 6).alias(f"code{i}") for i, c in enumerate(codes)])


PIECEWISE_SQL = "SELECT l_suppkey, " + ", ".join(
    f"round(avg(least(greatest((l_discount - {a}) / ({b} - {a}), 0), 1)), 6) AS code{i}" for i, (a, b) in enumerate(zip(KNOTS, KNOTS[1:]))
) + " FROM lineitem GROUP BY 1"


def splines(spark, d):
    """Cubic splines of part sizes with one inner knot."""
    basis = X.spline_basis(F.col("p_size") / 50.0, [0.5])
    return table(spark, d, "part", ["p_partkey", "p_size"]).select("p_partkey", *[F.round(b, 6).alias(f"b{i}") for i, b in enumerate(basis)])


# the five cubics in closed form: powers of u = 1 - 2x left of the knot, of v = 2x - 1 right of it
SPLINES_SQL = """WITH t AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part), s AS (SELECT *, greatest(1 - 2 * x, 0) AS u, greatest(2 * x - 1, 0) AS v FROM t)
SELECT p_partkey, round(u ** 3, 6) AS b0, round(2 * (1 - x) ** 3 - 2 * u ** 3, 6) AS b1,
  round(1 - u ** 3 - v ** 3 - (2 * (1 - x) ** 3 - 2 * u ** 3) - (2 * x ** 3 - 2 * v ** 3), 6) AS b2, round(2 * x ** 3 - 2 * v ** 3, 6) AS b3, round(v ** 3, 6) AS b4 FROM s"""


def brand_stats(spark, d):
    """Each part beside the mean, median and deviation of its brand's prices; the groups are aggregated before they are joined back."""
    p = table(spark, d, "part", ["p_partkey", "p_brand", "p_retailprice"])
    of = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("deviation"))
    of = of.join(counted_quantiles(p, "p_brand", "p_retailprice", {"median": 0.5}), "p_brand")
    return rounded(p.join(of, "p_brand").select("p_partkey", (F.col("p_retailprice") - F.col("mean")).alias("gap"), "median", "deviation"), "gap", "median", "deviation")


BRAND_SQL = """SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER w, 6) AS gap, round(median(p_retailprice) OVER w, 6) AS median, round(stddev_samp(p_retailprice) OVER w, 6) AS deviation
FROM part WINDOW w AS (PARTITION BY p_brand)"""


def mode_and_last(spark, d):
    """Per supplier: the commonest line number (of equals the smallest), distinct parts, share returned, and the order last shipped."""
    f = facts(spark, d, "l_orderkey", "l_partkey")
    last = F.max(F.struct("l_shipdate", "l_orderkey"))["l_orderkey"]
    return f.groupBy("l_suppkey").agg(
        F.mode("l_linenumber", True).alias("mode"), F.count_distinct("l_partkey").alias("parts"), F.round(F.avg("target"), 6).alias("returned"), last.alias("last_order")
    )


MODE_SQL = f"""WITH {FACTS}, c AS (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM f GROUP BY 1, 2),
o AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS r FROM f),
s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, round(avg(target), 6) AS returned FROM f GROUP BY 1)
SELECT s.*, c.l_linenumber AS mode, o.l_orderkey AS last_order FROM s JOIN c USING (l_suppkey) JOIN o USING (l_suppkey) WHERE c.r = 1 AND o.r = 1"""


def class_weights(spark, d):
    """Row weights that give every season and class the same mass, with mean 1."""
    cells = facts(spark, d).groupBy("season", "l_returnflag").agg(F.count("*").alias("n"))
    whole = cells.agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    return cells.join(F.broadcast(whole)).select("season", "l_returnflag", "n", F.round(F.col("total") / (F.col("cells") * F.col("n")), 6).alias("weight"))


CLASS_SQL = f"WITH {FACTS} SELECT season, l_returnflag, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM f GROUP BY 1, 2"


def extrapolated(spark, d):
    """Each supplier's yearly rates on a least-squares line, carried to the year after the last of the table."""
    yearly = facts(spark, d).groupBy("l_suppkey", "season").agg(F.avg("target").alias("rate"))
    ahead = F.regr_intercept("rate", "season") + F.regr_slope("rate", "season") * (F.max("latest") + 1)
    latest = yearly.agg(F.max("season").alias("latest"))
    lines = yearly.join(F.broadcast(latest)).groupBy("l_suppkey").agg(F.round(F.regr_slope("rate", "season"), 6).alias("slope"), X.clip(ahead, 0.0, 1.0).alias("ahead"))
    return rounded(lines, "ahead")


EXTRAPOLATED_SQL = f"""WITH {FACTS}, y AS (SELECT l_suppkey, season, avg(target) AS rate, max(season) OVER () AS latest FROM f GROUP BY 1, 2)
SELECT l_suppkey, round(regr_slope(rate, season), 6) AS slope, round(least(greatest(regr_intercept(rate, season) + regr_slope(rate, season) * (max(latest) + 1), 0::DOUBLE), 1::DOUBLE), 6) AS ahead FROM y GROUP BY 1"""

STEP, ROUNDS, CAP = 4.0, 3, 2.0


def group_weights(spark, d):
    """Weights of seasons raised exponentially with their loss against the overall rate, none above CAP times the least, summing to 1."""
    f = facts(spark, d)
    loss = f.join(F.broadcast(f.agg(F.avg("target").alias("p")))).groupBy("season").agg(F.avg(F.pow(F.col("p") - F.col("target"), 2)).alias("loss"))
    raised = loss.select("season", "loss", F.exp(STEP * ROUNDS * F.col("loss")).alias("w"))  # one row a season
    capped = raised.join(F.broadcast(raised.agg(F.min("w").alias("least")))).select("season", "loss", F.least("w", CAP * F.col("least")).alias("w"))
    whole = capped.agg(F.sum("w").alias("total"))
    return rounded(capped.join(F.broadcast(whole)).select("season", "loss", (F.col("w") / F.col("total")).alias("weight")), "loss", "weight")


GROUP_SQL = f"""WITH {FACTS}, l AS (SELECT season, avg(((SELECT avg(target) FROM f) - target) ** 2) AS loss FROM f GROUP BY 1),
w AS (SELECT season, loss, least(exp({STEP * ROUNDS} * loss), {CAP} * min(exp({STEP * ROUNDS} * loss)) OVER ()) AS w FROM l)
SELECT season, round(loss, 6) AS loss, round(w / sum(w) OVER (), 6) AS weight FROM w"""

STAY, HIGH, LOW = 0.9, 0.4, 0.2


def filtered_state(spark, d):
    """The filtered chance that a supplier is in its high state after each year: two sticky states, and rates of return HIGH and LOW over the year's items."""
    yearly = facts(spark, d).groupBy("l_suppkey", "season").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    odds = F.col("s") * math.log(HIGH / LOW) + (F.col("n") - F.col("s")) * math.log((1 - HIGH) / (1 - LOW))
    past = F.array_sort(F.collect_list(F.struct("season", odds.alias("odds"))))  # an entity has one element a year

    def step(p, e):
        ahead = p * STAY + (1 - p) * (1 - STAY)
        return 1 / (1 + (1 - ahead) / ahead * F.exp(-e["odds"]))

    seen = yearly.groupBy("l_suppkey").agg(past.alias("past")).select("l_suppkey", F.posexplode("past").alias("i", "e"), "past")
    p = F.aggregate(F.slice("past", F.lit(1), F.col("i") + 1), F.lit(0.5), step)
    return rounded(seen.select("l_suppkey", F.col("e.season").alias("season"), p.alias("high")), "high")


FILTER_SQL = f"""WITH RECURSIVE {FACTS}, y AS (SELECT l_suppkey, season, sum(target) * ln({HIGH / LOW}) + (count(*) - sum(target)) * ln({(1 - HIGH) / (1 - LOW)}) AS odds,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY season) AS i FROM f GROUP BY 1, 2),
s AS (SELECT l_suppkey, 0::BIGINT AS i, NULL::INTEGER AS season, 0.5::DOUBLE AS high FROM y WHERE i = 1
  UNION ALL SELECT l_suppkey, y.i, y.season, 1 / (1 + (1 - (high * {STAY} + (1 - high) * {1 - STAY})) / (high * {STAY} + (1 - high) * {1 - STAY}) * exp(-odds)) FROM s JOIN y USING (l_suppkey) WHERE y.i = s.i + 1)
SELECT l_suppkey, season, round(high, 6) AS high FROM s WHERE i > 0"""


def label_agreement(spark, d):
    """The adjusted Rand index of status and return flag by year, from their contingency counts."""
    cells = facts(spark, d).groupBy("season", "l_linestatus", "l_returnflag").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    both = cells.groupBy("season").agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    a, b = (cells.groupBy("season", k).agg(F.sum("n").alias("n")).groupBy("season").agg(F.sum(pairs(F.col("n"))).alias(k)) for k in ("l_linestatus", "l_returnflag"))
    chance = F.col("l_linestatus") * F.col("l_returnflag") / pairs(F.col("total"))
    most = (F.col("l_linestatus") + F.col("l_returnflag")) / 2
    out = both.join(a, "season").join(b, "season").select("season", ((F.col("both") - chance) / F.nullif(most - chance, F.lit(0.0))).alias("agreement"))
    return rounded(out, "agreement")


AGREEMENT_SQL = f"""WITH {FACTS}, c AS (SELECT season, l_linestatus, l_returnflag, count(*)::DOUBLE AS n FROM f GROUP BY ALL),
a AS (SELECT season, sum(n * (n - 1) / 2) AS a FROM (SELECT season, sum(n) AS n FROM c GROUP BY season, l_linestatus) GROUP BY 1),
b AS (SELECT season, sum(n * (n - 1) / 2) AS b FROM (SELECT season, sum(n) AS n FROM c GROUP BY season, l_returnflag) GROUP BY 1),
t AS (SELECT season, sum(n * (n - 1) / 2) AS x, sum(n) * (sum(n) - 1) / 2 AS m FROM c GROUP BY 1)
SELECT season, round((x - a * b / m) / nullif((a + b) / 2 - a * b / m, 0), 6) AS agreement FROM t JOIN a USING (season) JOIN b USING (season)"""


def key_coverage(spark, d):
    """By year, how many rows have a supplier, and a supplier with its line number, that an earlier year has."""
    f = facts(spark, d)
    first = f.groupBy("l_suppkey", "l_linenumber").agg(F.min("season").alias("fine"))
    cells = f.groupBy("season", "l_suppkey", "l_linenumber").agg(F.count("*").alias("n")).join(first, ["l_suppkey", "l_linenumber"])
    coarse = first.groupBy("l_suppkey").agg(F.min("fine").alias("coarse"))
    known = lambda c: F.sum(F.when(F.col(c) < F.col("season"), F.col("n")).otherwise(0))
    return cells.join(coarse, "l_suppkey").groupBy("season").agg(F.sum("n").alias("n"), known("coarse").alias("supplier"), known("fine").alias("supplier_line"))


COVERAGE_SQL = f"""WITH {FACTS}, g AS (SELECT season, min(season) OVER (PARTITION BY l_suppkey) AS coarse, min(season) OVER (PARTITION BY l_suppkey, l_linenumber) AS fine FROM f)
SELECT season, count(*) AS n, count(*) FILTER (coarse < season) AS supplier, count(*) FILTER (fine < season) AS supplier_line FROM g GROUP BY 1"""


CENTRES = [0.1, 0.3, 0.5]


def soft_cells(spark, d):
    """Shrunk residual effects of suppliers' soft classes by status: a row counts in each class by the closeness of its supplier's rate to the class centre."""
    f = facts(spark, d)
    cells = f.groupBy("l_suppkey", "l_linestatus").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    rate = F.sum("s").over(Window.partitionBy("l_suppkey")) / F.sum("n").over(Window.partitionBy("l_suppkey"))
    near = F.array(*[F.exp(-F.pow(F.col("rate") - c, 2) / 0.02) for c in CENTRES])
    rows = cells.withColumn("rate", rate).withColumn("near", near).withColumn("all", F.aggregate("near", F.lit(0.0), lambda a, x: a + x))
    soft = rows.select("l_linestatus", "s", "n", "all", F.posexplode("near").alias("class", "w")).withColumn("w", F.col("w") / F.col("all"))
    whole = f.agg(F.avg("target").alias("mean"))
    sums = soft.groupBy("class", "l_linestatus").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("n")).alias("n"))
    out = sums.join(F.broadcast(whole)).select("class", "l_linestatus", F.col("n").alias("mass"), ((F.col("s") - F.col("n") * F.col("mean")) / (F.col("n") + 50.0)).alias("effect"))
    return rounded(out, "mass", "effect").withColumn("mass", F.round("mass", 3))


_ALL = " + ".join(f"exp(-((rate - {c}) ** 2) / 0.02)" for c in CENTRES)
SOFT_SQL = f"""WITH {FACTS}, c AS (SELECT l_suppkey, l_linestatus, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2),
r AS (SELECT *, sum(s) OVER (PARTITION BY l_suppkey) / sum(n) OVER (PARTITION BY l_suppkey) AS rate FROM c),
w AS ({" UNION ALL ".join(f"SELECT {i} AS class, l_linestatus, s, n, exp(-((rate - {c}) ** 2) / 0.02) / ({_ALL}) AS w FROM r" for i, c in enumerate(CENTRES))})
SELECT class, l_linestatus, round(sum(w * n), 3) AS mass, round((sum(w * s) - sum(w * n) * (SELECT avg(target) FROM f)) / (sum(w * n) + 50.0), 6) AS effect FROM w GROUP BY 1, 2"""


def bounded_composition(spark, d):
    """Non-negative weights, at most 1 in sum, of three corrections to the constant prediction that leave the least Brier score."""
    c = candidates(spark, d)
    moves = c.select(*[(F.col(p) - F.col("p1")).alias(p) for p in NAMES[1:]], (F.col("target") - F.col("p1")).alias("residual"))
    g = linalg.gram(moves, [*NAMES[1:], "residual"])
    scale = max(float(g[-1, -1]), 1e-12)  # of the residuals
    w = linalg.bounded_weights(g[:-1, :-1] / scale, g[:-1, -1] / scale, 1.0)
    return spark.createDataFrame([(n, round(float(x), 6)) for n, x in zip(NAMES[1:], w)], "candidate string, weight double")

QUERIES = {
    "one_hot_levels": one_hot, "frozen_codes": frozen_codes, "imputed_scaled": imputed, "piecewise_codes": piecewise, "spline_basis": splines, "partition_stats": brand_stats,
    "mode_and_last": mode_and_last, "class_weights": class_weights, "extrapolated_rates": extrapolated, "group_loss_weights": group_weights, "filtered_state": filtered_state,
    "label_agreement": label_agreement, "key_coverage": key_coverage, "soft_cell_effects": soft_cells,
}
ORACLES = dict(zip(QUERIES, [
    ONE_HOT_SQL, FROZEN_SQL, IMPUTED_SQL, PIECEWISE_SQL, SPLINES_SQL, BRAND_SQL, MODE_SQL, CLASS_SQL, EXTRAPOLATED_SQL, GROUP_SQL, FILTER_SQL, AGREEMENT_SQL, COVERAGE_SQL, SOFT_SQL,
]))
QUERIES["bounded_composition"] = bounded_composition  # iterative: the solver is tested against brute force
