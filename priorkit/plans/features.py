"""Row-local features: projections, bins, keys, classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.quantiles import counted_quantiles
from ..sources.io import table
from .base import FACTS, facts, rounded, small

FEATURES = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def static_features(spark, d):
    f = facts(spark, d, *FEATURES)
    q, p, x, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return f.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        (F.col("l_linenumber") * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("packed"),
        F.round(F.log1p(q), 6).alias("log_quantity"),
        F.round(p / q, 9).alias("unit_price"),
        F.round(F.abs(x - t), 6).alias("rate_gap"),
        F.round(F.greatest(x, t), 6).alias("max_rate"),
        F.round(p * (1 - x) * (1 + t), 7).alias("charge"),
        (x > t).cast("int").alias("discount_above_tax"),
        F.round(F.hypot(x, t), 6).alias("rate_norm"),
        F.round(X.logit((x + 0.01) / 0.2), 6).alias("logit_discount"),
    )


STATIC_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
  (l_linenumber * 2 + (l_linestatus = 'O')::INTEGER)::INTEGER AS packed,
  round(ln(1 + l_quantity), 6) AS log_quantity, round(l_extendedprice / l_quantity, 9) AS unit_price,
  round(abs(l_discount - l_tax), 6) AS rate_gap, round(greatest(l_discount, l_tax), 6) AS max_rate,
  round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge,
  (l_discount > l_tax)::INTEGER AS discount_above_tax,
  round(sqrt(l_discount * l_discount + l_tax * l_tax), 6) AS rate_norm,
  round(ln(least(greatest((l_discount + 0.01) / 0.2, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest((l_discount + 0.01) / 0.2, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))), 6) AS logit_discount
FROM lineitem"""


def bins(spark, d):
    li = table(spark, d, "lineitem", ["l_quantity", "l_discount", "l_linenumber"])
    q, x = F.col("l_quantity"), F.col("l_discount")
    cells = li.select(
        X.equal_width_bin(q, 5.0).alias("width_bin"), X.truncated_bin(x, 0.02, 0.025, 12).alias("probability_bin"),
        X.right_closed_bin(F.col("l_linenumber"), [2, 4]).alias("phase"), X.left_closed_bin(q, [10.0, 20.0, 40.0]).alias("edge_bin"),
    )
    return cells.groupBy("width_bin", "probability_bin", "phase", "edge_bin").agg(F.count("*").alias("n"))


BINS_SQL = """
SELECT CASE WHEN l_quantity IS NULL THEN -1 ELSE floor(l_quantity / 5.0)::INTEGER END AS width_bin,
  least(greatest(trunc((l_discount - 0.02) / 0.025::DOUBLE)::INTEGER, 0), 12) AS probability_bin,
  CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS phase,
  ((l_quantity >= 10)::INTEGER + (l_quantity >= 20)::INTEGER + (l_quantity >= 40)::INTEGER) AS edge_bin,
  count(*)::BIGINT AS n
FROM lineitem GROUP BY ALL"""

RULES = (("steel|tin", "metal"), ("copper|brass|nickel", "alloy"), ("small|mini", "small"), ("large|big", "large"), ("green|blue|red", "colour"))


def regex_class(spark, d):
    parts = table(spark, d, "part", ["p_partkey", "p_name", "p_type"])
    text = F.concat_ws(" ", "p_name", "p_type")
    return parts.select("p_partkey", X.last_rule_wins(text, RULES, "other").alias("label"), F.concat_ws("|", "p_type", F.substring("p_name", 1, 3)).alias("joint"))


REGEX_SQL = "SELECT p_partkey, CASE " + " ".join(
    f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '{p}') THEN '{label}'" for p, label in reversed(RULES)
) + " ELSE 'other' END AS label, p_type || '|' || substr(p_name, 1, 3) AS joint FROM part"


def context_keys(spark, d):
    f = facts(spark, d)
    key = X.packed_key([(F.col("l_linenumber") - 1, 7), ((F.col("l_linestatus") == "O").cast("int"), 2), (F.col("target"), 2)])
    return f.groupBy(key.alias("context")).agg(F.count("*").alias("n"), F.sum("target").alias("hits"))


CONTEXT_SQL = f"""WITH {FACTS} SELECT (((l_linenumber - 1) * 2 + (l_linestatus = 'O')::INTEGER) * 2 + target)::INTEGER AS context,
  count(*)::BIGINT AS n, sum(target)::BIGINT AS hits FROM f GROUP BY 1"""


def peer_zscore(spark, d):
    """Price against its peers of year and status, within -5 and 5; peers without spread give null."""
    f = facts(spark, d, "l_orderkey", "l_extendedprice")
    keys = ["season", "l_linestatus", "l_linenumber"]
    middle = counted_quantiles(f.withColumn("peer", F.struct(*keys)), "peer", "l_extendedprice", {"m": 0.5})
    peers = f.groupBy(F.struct(*keys).alias("peer")).agg(F.stddev_samp("l_extendedprice").alias("s")).join(middle, "peer").select("peer.*", "m", "s")
    z = X.clip((F.col("l_extendedprice") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), -5.0, 5.0)
    out = f.join(F.broadcast(peers), keys)  # at most years x 2 x 7 rows
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.round(z, 6).alias("z"))


PEER_SQL = f"""WITH {FACTS}, p AS (SELECT season, l_linestatus, l_linenumber, median(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM f GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate,
  round(CASE WHEN s = 0 OR s IS NULL THEN NULL ELSE least(greatest((l_extendedprice - m) / s, -5), 5) END, 6) AS z
FROM f JOIN p USING (season, l_linestatus, l_linenumber)"""


def calendar(spark, d):
    """Calendar harmonics and phases of each shipping day."""
    days = facts(spark, d).select(F.to_date("l_shipdate").alias("day")).distinct()
    waves = X.harmonics(F.dayofyear("day"), 365.25)
    month = F.month("day")
    return days.select(
        F.col("day").cast("string").alias("day"), *(F.round(c, 6).alias(k) for k, c in waves.items()),
        F.when(month <= 4, "early").when(month <= 8, "middle").otherwise("late").alias("phase"),
    )


CALENDAR_SQL = """SELECT DISTINCT l_shipdate::DATE::VARCHAR AS day,
  round(sin(dayofyear(l_shipdate) * (2 * 3.141592653589793 / 365.25::DOUBLE)), 6) AS sin1, round(cos(dayofyear(l_shipdate) * (2 * 3.141592653589793 / 365.25::DOUBLE)), 6) AS cos1,
  round(sin(dayofyear(l_shipdate) * (2 * 3.141592653589793 / 365.25::DOUBLE) * 2), 6) AS sin2, round(cos(dayofyear(l_shipdate) * (2 * 3.141592653589793 / 365.25::DOUBLE) * 2), 6) AS cos2,
  CASE WHEN month(l_shipdate) <= 4 THEN 'early' WHEN month(l_shipdate) <= 8 THEN 'middle' ELSE 'late' END AS phase
FROM lineitem"""


def dense_codes(spark, d):
    """Brands in dense codes frozen on parts of the first half by key; parts with unseen brands get -1."""
    parts = table(spark, d, "part", ["p_partkey", "p_brand", "p_size"])
    codes = parts.where("p_size <= 25").select("p_brand").distinct().select("p_brand", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).alias("code"))
    return parts.join(small(codes), "p_brand", "left").select("p_partkey", F.coalesce("code", F.lit(-1)).alias("code"))


CODES_SQL = """WITH c AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 25))
SELECT p_partkey, coalesce(code, -1)::INTEGER AS code FROM part LEFT JOIN c USING (p_brand)"""


def extrapolation_flags(spark, d):
    """Prices of each year outside the range of all earlier years."""
    f = facts(spark, d, "l_extendedprice")
    w = Window.orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    ranges = f.groupBy("season").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    seen = ranges.select("season", F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    outside = (F.col("l_extendedprice") < F.col("lo")) | (F.col("l_extendedprice") > F.col("hi"))
    return f.join(F.broadcast(seen), "season").groupBy("season").agg(F.count("*").alias("n"), F.count_if(outside).alias("outside"))


EXTRA_SQL = f"""WITH {FACTS}, r AS (SELECT season, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM f GROUP BY 1),
s AS (SELECT season, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM r WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT f.season, count(*)::BIGINT AS n, count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi)::BIGINT AS outside FROM f JOIN s USING (season) GROUP BY 1"""


def standardised(spark, d):
    """Median-imputed, centred and scaled discount by year, with a missing flag; discounts of 0 count as missing."""
    f = facts(spark, d, "l_orderkey", "l_discount").withColumn("x", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    stats = counted_quantiles(f, "season", "x", {"m": 0.5}).join(f.groupBy("season").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s")), "season")  # a row for each year
    return rounded(f.join(F.broadcast(stats), "season").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", ((F.coalesce("x", "m") - F.col("a")) / F.nullif(F.col("s"), F.lit(0.0))).alias("scaled"), F.col("x").isNull().cast("int").alias("missing")
    ), "scaled")


STANDARD_SQL = f"""WITH {FACTS}, g AS (SELECT *, CASE WHEN l_discount > 0 THEN l_discount END AS x FROM f),
s AS (SELECT season, quantile_cont(x, 0.5) AS m, avg(x) AS a, stddev_pop(x) AS s FROM g GROUP BY 1)
SELECT l_orderkey, l_suppkey, l_linenumber, l_shipdate, round((coalesce(x, m) - a) / nullif(s, 0), 6) AS scaled, (x IS NULL)::INTEGER AS missing FROM g JOIN s USING (season)"""


def interaction_sums(spark, d):
    """ANOVA terms of order two and three over each line's four scaled measures."""
    f = facts(spark, d, *FEATURES)
    x = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.round(X.pairwise_products(x), 11).alias("pairs"), F.round(X.triple_products(x), 11).alias("triples"))


INTERACTION_SQL = """WITH x AS (SELECT *, l_quantity / 50 AS a, l_extendedprice / 1e5::DOUBLE AS b, l_discount * 10 AS c, l_tax * 10 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(a*b + a*c + a*e + b*c + b*e + c*e, 11) AS pairs, round(a*b*c + a*b*e + a*c*e + b*c*e, 11) AS triples FROM x"""

QUERIES = {
    "static_features": static_features, "bins": bins, "regex_class": regex_class, "context_keys": context_keys, "peer_zscore": peer_zscore,
    "calendar_harmonics": calendar, "dense_codes": dense_codes, "extrapolation_flags": extrapolation_flags, "standardised": standardised,
    "interaction_sums": interaction_sums,
}
ORACLES = {
    "static_features": STATIC_SQL, "bins": BINS_SQL, "regex_class": REGEX_SQL, "context_keys": CONTEXT_SQL, "peer_zscore": PEER_SQL,
    "calendar_harmonics": CALENDAR_SQL, "dense_codes": CODES_SQL, "extrapolation_flags": EXTRA_SQL, "standardised": STANDARD_SQL,
    "interaction_sums": INTERACTION_SQL,
}
