"""Ordered analytics, selections and set operations over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.io import table
from .base import rounded

GAP_HOURS = 6


def lead_transitions(spark, d):
    """Next event type of the same user, and how often each change occurs."""
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("next_type", F.lead("event_type").over(w)).groupBy("event_type", "next_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


LEAD_SQL = """SELECT event_type, next_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM (
  SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) GROUP BY 1, 2"""


def sessions(spark, d):
    """Sessions of a user: a new one after a gap of GAP_HOURS or a null-safe change of type; ordinal, span and sums."""
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {GAP_HOURS} HOURS")
    new = F.lag("event_id").over(w).isNull() | late | ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))
    flagged = e.withColumn("new", new.cast("int"))
    numbered = flagged.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.round(F.sum("value"), 6).alias("value")
    )


SESSION_SQL = f"""WITH g AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL {GAP_HOURS} HOUR OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*)::BIGINT AS n, min(event_id) AS first_id, min(ts) AS start, max(ts) AS end, round(sum(value), 6) AS value FROM s GROUP BY 1, 2"""


def rest_days(spark, d):
    """Days since a customer's previous order, with the order's running number."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", "o_custkey", F.row_number().over(w).alias("ordinal"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("rest"))


REST_SQL = """SELECT o_orderkey, o_custkey, row_number() OVER w::INTEGER AS ordinal, (o_orderdate::DATE - (lag(o_orderdate) OVER w)::DATE)::INTEGER AS rest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
REST_SQL = REST_SQL.replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")


def rolling_sums(spark, d):
    """Sums of the last three and five values of a user, null until that many are known; and their running maximum."""
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "value"])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")

    def rolled(k: int):
        span = w.rowsBetween(1 - k, 0)
        return F.when(F.count("value").over(span) == k, F.round(F.sum("value").over(span), 6))

    return e.select("event_id", rolled(3).alias("sum_3"), rolled(5).alias("sum_5"), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


ROLLING_SQL = """SELECT event_id, CASE WHEN count(value) OVER a = 3 THEN round(sum(value) OVER a, 6) END AS sum_3, CASE WHEN count(value) OVER b = 5 THEN round(sum(value) OVER b, 6) END AS sum_5,
  max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak
FROM events WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)"""


def first_last_rows(spark, d):
    """A customer's first, last and largest order, in one aggregation without a sort."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"),
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest_order"), F.count("*").alias("n"),
    )


FIRST_SQL = """SELECT o_custkey, max(CASE WHEN a = 1 THEN o_orderkey END) AS first_order, max(CASE WHEN z = 1 THEN o_orderkey END) AS last_order,
  max(CASE WHEN l = 1 THEN o_orderkey END) AS largest_order, count(*)::BIGINT AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS l FROM orders) GROUP BY 1"""


def best_runner_up(spark, d):
    """A supplier's best and second part by value, and the margin between them."""
    li = table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_extendedprice"])
    sums = li.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 4).alias("v"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("v"), "l_partkey")
    ranked = sums.withColumns({"r": F.row_number().over(w), "next": F.lead("v").over(w), "next_part": F.lead("l_partkey").over(w)})
    return ranked.where("r = 1").select("l_suppkey", F.col("l_partkey").alias("best"), F.col("next_part").alias("runner_up"), F.round(F.col("v") - F.col("next"), 4).alias("margin"))


BEST_SQL = """WITH s AS (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(v) OVER w AS nv, lead(l_partkey) OVER w AS np FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY v DESC, l_partkey))
SELECT l_suppkey, l_partkey AS best, np AS runner_up, round(v - nv, 4) AS margin FROM r WHERE r = 1"""


def top_parts(spark, d):
    """The report of the twenty parts with most value."""
    li = table(spark, d, "lineitem", ["l_partkey", "l_extendedprice"])
    return li.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v")).orderBy(F.desc("v"), "l_partkey").limit(20)


TOP_SQL = "SELECT l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1 ORDER BY v DESC, l_partkey LIMIT 20"


def even_sample(spark, d):
    """Every tenth order of each customer by date: the sampling operator of evenly spaced rows."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r % 10 = 1").select("o_orderkey", "o_custkey")


EVEN_SQL = "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r % 10 = 1"


def _customers(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderdate"])
    year = F.year("o_orderdate")
    return o.where(year == 1996).select("o_custkey"), o.where(year == 1997).select("o_custkey")


def set_union(spark, d):
    a, b = _customers(spark, d)
    return a.union(b).distinct()


def set_intersect(spark, d):
    a, b = _customers(spark, d)
    return a.intersect(b)


def set_except(spark, d):
    a, b = _customers(spark, d)
    return a.subtract(b)


def set_union_all(spark, d):
    a, b = _customers(spark, d)
    return a.withColumn("year", F.lit(1996)).unionByName(b.withColumn("year", F.lit(1997))).groupBy("o_custkey", "year").agg(F.count("*").alias("n"))


def key_sets_equal(spark, d):
    """Whether line items and orders have the same order keys: counts of keys on one side alone."""
    a = table(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(F.count_if(F.col("b").isNull()).alias("only_orders"), F.count_if(F.col("a").isNull()).alias("only_lines"))


KEYS_SQL = """SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))::BIGINT AS only_orders,
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders))::BIGINT AS only_lines"""


def duplicate_keys(spark, d):
    """Line numbers that an order has more than once."""
    li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


DUP_SQL = "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def content_digests(spark, d):
    """Rows of equal content by digest: the least key of each and how many share it."""
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    digest = F.md5(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return c.groupBy(digest.alias("digest")).agg(F.min("c_custkey").alias("first_key"), F.count("*").alias("n"))


DIGEST_SQL = "SELECT md5(c_nationkey::VARCHAR || '|' || c_mktsegment) AS digest, min(c_custkey) AS first_key, count(*)::BIGINT AS n FROM customer GROUP BY 1"


def upsert_latest(spark, d):
    """Keep-last upsert: a customer's state from the later of two batches of orders."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])
    old, new = o.where(F.year("o_orderdate") < 1998).withColumn("batch", F.lit(0)), o.where(F.year("o_orderdate") >= 1998).withColumn("batch", F.lit(1))
    both = old.unionByName(new)
    return both.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("batch", "o_orderdate", "o_orderkey")).alias("s")).select("o_custkey", "s.o_orderkey", "s.o_orderstatus")


UPSERT_SQL = "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (year(o_orderdate) >= 1998)::INTEGER DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"

PAIR = "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = {}"
QUERIES = {
    "lead_transition": lead_transitions, "sessionise": sessions, "rest_days": rest_days, "rolling_sum_3_5": rolling_sums, "first_last_row": first_last_rows,
    "best_runner_up": best_runner_up, "top_parts": top_parts, "even_sample": even_sample, "set_union": set_union, "set_intersect": set_intersect,
    "set_except": set_except, "set_union_all": set_union_all, "key_sets_equal": key_sets_equal, "duplicate_keys": duplicate_keys,
    "content_digests": content_digests, "upsert_latest": upsert_latest,
}
ORACLES = {
    "lead_transition": LEAD_SQL, "sessionise": SESSION_SQL, "rest_days": REST_SQL, "rolling_sum_3_5": ROLLING_SQL, "first_last_row": FIRST_SQL,
    "best_runner_up": BEST_SQL, "top_parts": TOP_SQL, "even_sample": EVEN_SQL,
    "set_union": f"{PAIR.format(1996)} UNION {PAIR.format(1997)}", "set_intersect": f"{PAIR.format(1996)} INTERSECT {PAIR.format(1997)}",
    "set_except": f"{PAIR.format(1996)} EXCEPT {PAIR.format(1997)}",
    "set_union_all": "SELECT o_custkey, year(o_orderdate)::INTEGER AS year, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2",
    "key_sets_equal": KEYS_SQL, "duplicate_keys": DUP_SQL, "content_digests": DIGEST_SQL, "upsert_latest": UPSERT_SQL,
}
