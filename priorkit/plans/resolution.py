"""Entity resolution: exact and approximate sequence joins, majority mappings, assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resolve
from ..sources.io import table


def _days(spark, d):
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    return e.withColumn("day", F.to_date("ts").cast("string"))


def other_side(spark, d):
    """The events as a second source might log them: users under other ids, some events dropped, some typed otherwise, some logged twice."""
    e = _days(spark, d).select((F.col("user_id") * 7 + 1000003).alias("alias_id"), "ts", "event_id", F.lit(0).alias("extra"), "event_type")
    read = e.where("event_id % 101 != 7").withColumn("event_type", F.when(F.col("event_id") % 97 == 3, "view").otherwise(F.col("event_type")))
    return read.unionByName(e.where("event_id % 89 = 5").withColumn("extra", F.lit(1)))


OTHER = """o AS (SELECT user_id * 7 + 1000003 AS alias_id, ts, event_id, 0 AS extra, CASE WHEN event_id % 97 = 3 THEN 'view' ELSE event_type END AS event_type FROM events WHERE event_id % 101 != 7
  UNION ALL SELECT user_id * 7 + 1000003, ts, event_id, 1, event_type FROM events WHERE event_id % 89 = 5)"""


def exact_sequence_match(spark, d):
    """Users of either side matched by the day and the ordered types of its events; sequences of several users match nothing, nor do those of fewer than three events."""
    left = resolve.sequence_key(_days(spark, d), ["user_id", "day"], ["ts", "event_id"], F.col("event_type")).where("n >= 3")
    right = resolve.sequence_key(other_side(spark, d).withColumn("day", F.to_date("ts").cast("string")), ["alias_id", "day"], ["ts", "event_id", "extra"], F.col("event_type")).where("n >= 3")
    return resolve.unique_matches(left, right, ["day", "n", "sequence"], "user_id", "alias_id").groupBy("user_id", "alias_id").agg(F.count("*").alias("days"))


EXACT_SQL = f"""WITH {OTHER}, l AS (SELECT user_id, ts::DATE AS day, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS q FROM events GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT alias_id, ts::DATE AS day, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id, extra) AS q FROM o GROUP BY 1, 2 HAVING count(*) >= 3),
lu AS (SELECT day, n, q, min(user_id) AS user_id FROM l GROUP BY 1, 2, 3 HAVING count(*) = 1), ru AS (SELECT day, n, q, min(alias_id) AS alias_id FROM r GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT user_id, alias_id, count(*) AS days FROM lu JOIN ru USING (day, n, q) GROUP BY 1, 2"""


def position_zip(spark, d):
    """Events of both sides of a user side by side by their position in the day: how often their types agree, and how often one side has none."""
    place = lambda *keys: F.row_number().over(Window.partitionBy("alias_id", "day").orderBy(*keys)).alias("pos")
    left = _days(spark, d).withColumn("alias_id", F.col("user_id") * 7 + 1000003).select("alias_id", "day", place("ts", "event_id"), "event_type")
    right = other_side(spark, d).withColumn("day", F.to_date("ts").cast("string")).select("alias_id", "day", place("ts", "event_id", "extra"), F.col("event_type").alias("other"))
    both = left.join(right, ["alias_id", "day", "pos"], "full")
    return both.groupBy(F.coalesce("event_type", F.lit("none")).alias("event_type")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == F.col("other")).alias("agree"), F.count_if(F.col("other").isNull()).alias("alone"))


ZIP_SQL = f"""WITH {OTHER}, l AS (SELECT user_id * 7 + 1000003 AS alias_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS pos, event_type FROM events),
r AS (SELECT alias_id, ts::DATE AS day, row_number() OVER (PARTITION BY alias_id, ts::DATE ORDER BY ts, event_id, extra) AS pos, event_type AS other FROM o)
SELECT coalesce(event_type, 'none') AS event_type, count(*) AS n, count(*) FILTER (event_type = other) AS agree, count(*) FILTER (other IS NULL) AS alone FROM l FULL JOIN r USING (alias_id, day, pos) GROUP BY 1"""


def majority_mapping(spark, d):
    """Each user's usual event type, if five events or more and a share of 0.3 support it."""
    return resolve.majority_mapping(_days(spark, d), "user_id", "event_type", 5, 0.3).withColumn("share", F.round("share", 6))


MAJORITY_SQL = """WITH c AS (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS t FROM c)
SELECT user_id, event_type, n, round(n / t, 6) AS share FROM r WHERE r = 1 AND t >= 5 AND n / t >= 0.3"""


def mutual_best(spark, d):
    """Suppliers and parts that are each other's largest by value, with the margin to the runner-up."""
    li = table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_extendedprice"])
    scored = li.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 4).alias("v"))
    return resolve.mutual_best(scored, "l_suppkey", "l_partkey", "v").withColumn("margin", F.round("margin", 4))


MUTUAL_SQL = """WITH s AS (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS ra, row_number() OVER (PARTITION BY l_partkey ORDER BY v DESC, l_suppkey) AS rb, lead(v) OVER w AS nx FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY v DESC, l_partkey))
SELECT l_suppkey, l_partkey, v, round(v - nx, 4) AS margin FROM r WHERE ra = 1 AND rb = 1"""


def assignment(spark, d):
    """Within each nation the one-to-one pairing of suppliers and market segments of least total price distance."""
    s = table(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    c = table(spark, d, "customer", ["c_nationkey", "c_mktsegment", "c_acctbal"]).groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("level"))
    costs = s.join(c, s["s_nationkey"] == c["c_nationkey"]).select("s_nationkey", "s_suppkey", "c_mktsegment", F.round(F.abs(F.col("s_acctbal") - F.col("level")), 4).alias("cost"))
    return resolve.assign_within(costs, "s_nationkey", "s_suppkey", "c_mktsegment", "cost")


def fuzzy_sequence_match(spark, d):
    """Orders of one customer whose sequences of line numbers match to 0.8 or more: each order in the class of the smallest with its sequence ('member'), and the pairs of classes that match ('alike')."""
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"])
    s = resolve.sequence_key(li, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"], F.col("l_linenumber"))
    rows = s.join(o, s["l_orderkey"] == o["o_orderkey"])
    pairs, members = resolve.alike_classes(rows, ["o_custkey"], "o_orderkey", "sequence", 0.8)
    own = members.select("o_custkey", F.lit("member").alias("kind"), F.col("class").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("ratio"))
    return own.unionByName(pairs.withColumn("kind", F.lit("alike")))


def _placed(rows, key: str, order: list[str]):
    """(week, key, pos, symbol, id): each event's place in the week of its user and the first letter of its type, which no two types share."""
    w = Window.partitionBy(key, "week").orderBy(*order)
    rows = rows.withColumn("week", F.date_trunc("week", "ts").cast("date"))
    return rows.select("week", F.col(key).alias("key"), (F.row_number().over(w) - 1).alias("pos"), F.substring("event_type", 1, 1).alias("symbol"), F.col("event_id").alias("id"))


def partial_aligned_rows(spark, d):
    """Events of both sides that stand for each other ('row'): users of either side whose weeks match to 0.9 and best, 0.05 ahead of the next; and the users of each class of equal weeks ('member', b the class)."""
    left = _placed(_days(spark, d), "user_id", ["ts", "event_id"])
    right = _placed(other_side(spark, d), "alias_id", ["ts", "event_id", "extra"])
    rows, members = resolve.aligned_classes(left, right, ["week"], 0.9, margin=0.05)
    ids = [side.select("week", F.col("key").alias(k), F.col("pos").alias(f"pos_{k}"), F.col("id").alias(f"id_{k}")) for side, k in ((left, "a"), (right, "b"))]
    out = rows.join(ids[0], ["week", "a", "pos_a"]).join(ids[1], ["week", "b", "pos_b"]).select("week", F.lit("row").alias("kind"), "a", "b", "pos_a", "pos_b", "id_a", "id_b", F.round("ratio", 6).alias("ratio"), F.round("margin", 6).alias("margin"))
    return out.unionByName(members.select("week", F.concat(F.lit("member "), "side").alias("kind"), F.col("key").alias("a"), F.col("class").alias("b")), allowMissingColumns=True)


def key_contract(spark, d):
    """Counts of contract violations between orders and the order keys of line items."""
    from ..sources.io import contract_report

    orders = table(spark, d, "orders", ["o_orderkey"])
    keys = table(spark, d, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return contract_report(orders, keys, "o_orderkey")


CONTRACT_SQL = """SELECT (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)::BIGINT AS null_keys,
  (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))::BIGINT AS duplicate_keys,
  (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT AS missing_keys,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))::BIGINT AS extra_keys"""

QUERIES = {
    "exact_sequence_match": exact_sequence_match, "position_zip": position_zip, "majority_mapping": majority_mapping, "mutual_best": mutual_best,
    "assignment_min_cost": assignment, "fuzzy_sequence_match": fuzzy_sequence_match, "partial_aligned_rows": partial_aligned_rows, "key_contract": key_contract,
}
ORACLES = {
    "exact_sequence_match": EXACT_SQL, "position_zip": ZIP_SQL, "majority_mapping": MAJORITY_SQL, "mutual_best": MUTUAL_SQL, "key_contract": CONTRACT_SQL,
}
