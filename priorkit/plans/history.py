"""Cumulative states: what a row knew, what can be read back from it, and how it carries over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import states
from .base import FACTS, facts, rounded

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def running(spark, d) -> DataFrame:
    """Each line with its supplier's count and successes before it, over all years, and the rate in six digits."""
    f = facts(spark, d, "l_orderkey", "l_partkey", "l_extendedprice")
    r = states.running_before(f, ["l_suppkey"], ORDER, "target", "season")
    return r.withColumn("rate_before", F.when(F.col("n_before") > 0, F.col("s_before") / F.col("n_before")))


_O = "ORDER BY " + ", ".join(ORDER)
RUNNING = f"""{FACTS}, r AS (SELECT *, count(*) OVER w AS n_before, coalesce(sum(target) OVER w, 0) AS s_before FROM f
  WINDOW w AS (PARTITION BY l_suppkey {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def season_end_state(spark, d):
    """The state after the last line of each supplier and year: that line's counts and its own outcome."""
    ends = states.season_end(running(spark, d), "l_suppkey", "n_before", ["n_before", "s_before", "target"], ORDER)
    return ends.select("l_suppkey", "season", (F.col("n_before") + 1).alias("n"), (F.col("s_before") + F.col("target")).alias("s"))


END = f"""{RUNNING}, ends AS (SELECT l_suppkey, season, (n_before + 1)::BIGINT AS n, (s_before + target)::BIGINT AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, season ORDER BY n_before DESC) AS k FROM r) WHERE k = 1)"""


def asof_state(spark, d):
    """Suppliers' lines by year with the latest state before the year; the year before may be absent."""
    ends = season_end_state(spark, d)
    cells = facts(spark, d).groupBy("l_suppkey", "season").agg(F.count("*").alias("lines"))
    return states.asof(cells, ends, "l_suppkey").select("l_suppkey", "season", "lines", "state_season", F.coalesce("state_n", F.lit(0)).alias("n"), F.coalesce("state_s", F.lit(0)).alias("s"))


ASOF_SQL = f"""WITH {END}, c AS (SELECT l_suppkey, season, count(*)::BIGINT AS lines FROM f GROUP BY 1, 2)
SELECT c.l_suppkey, c.season, lines, e.season AS state_season, coalesce(n, 0)::BIGINT AS n, coalesce(s, 0)::BIGINT AS s FROM c ASOF LEFT JOIN ends e ON e.l_suppkey = c.l_suppkey AND c.season > e.season"""


def current_season(spark, d):
    """What a line knew of its own year: cumulative counts less the frozen end of earlier years; with shrunk rates at four strengths."""
    ends = season_end_state(spark, d)
    r = running(spark, d)
    joined = states.asof(r, ends, "l_suppkey")
    n = F.col("n_before") - F.coalesce("state_n", F.lit(0))
    s = F.rint(F.col("n_before") * F.coalesce("rate_before", F.lit(0.0))).cast("long") - F.coalesce("state_s", F.lit(0))
    cells = joined.withColumns({"n_now": n, "s_now": s})
    rates = {f"shrunk_{k}": F.avg(X.shrunk_rate(F.col("n_now"), F.col("s_now") / F.nullif(F.col("n_now"), F.lit(0)), float(k), 0.5)) for k in (10, 30, 100, 300)}
    out = cells.groupBy("l_suppkey", "season").agg(
        F.count("*").alias("lines"), F.count_if((F.col("n_now") < 0) | (F.col("s_now") < 0) | (F.col("s_now") > F.col("n_now"))).alias("violations"),
        F.sum("n_now").alias("sum_n"), F.sum("s_now").alias("sum_s"), *(c.alias(k) for k, c in rates.items()),
    )
    return rounded(out, *rates)


CURRENT_SQL = f"""WITH {END}, j AS (SELECT r.*, (n_before - coalesce(e.n, 0))::BIGINT AS n_now, (s_before - coalesce(e.s, 0))::BIGINT AS s_now
  FROM r ASOF LEFT JOIN ends e ON e.l_suppkey = r.l_suppkey AND r.season > e.season)
SELECT l_suppkey, season, count(*)::BIGINT AS lines, count(*) FILTER (n_now < 0 OR s_now < 0 OR s_now > n_now)::BIGINT AS violations, sum(n_now)::BIGINT AS sum_n, sum(s_now)::BIGINT AS sum_s, """ + ", ".join(
    f"round(avg((s_now + {k} * 0.5::DOUBLE) / (n_now + {k})), 6) AS shrunk_{k}" for k in (10, 30, 100, 300)) + " FROM j GROUP BY 1, 2"


def label_recovery(spark, d):
    """Outcomes read back from cumulative counts of a supplier's next line, against the outcomes themselves."""
    r = running(spark, d)
    count = F.rint(F.col("n_before") * F.coalesce("rate_before", F.lit(0.0))).cast("long")
    keyed = r.withColumn("count", count)
    n_of_key = F.count("*").over(Window.partitionBy("l_suppkey", "n_before"))
    keyed = keyed.withColumn("copies", n_of_key).where("copies = 1")
    following = keyed.select("l_suppkey", (F.col("n_before") - 1).alias("n_before"), F.col("count").alias("count_after"))
    joined = keyed.join(following, ["l_suppkey", "n_before"], "left").withColumn("delta", F.col("count_after") - F.col("count"))
    label = F.when(F.col("delta").isin(0, 1), F.col("delta"))
    return joined.withColumn("label", label).groupBy("season").agg(
        F.count("*").alias("rows"), F.count("label").alias("recovered"), F.count_if(F.col("label") == F.col("target")).alias("right"), F.count_if(F.col("delta").isNotNull() & F.col("label").isNull()).alias("invalid")
    )


RECOVERY_SQL = f"""WITH {RUNNING}, j AS (SELECT *, lead(s_before) OVER (PARTITION BY l_suppkey ORDER BY n_before) - s_before AS delta FROM r)
SELECT season, count(*)::BIGINT AS rows, count(delta)::BIGINT AS recovered, count(*) FILTER (delta = target)::BIGINT AS right, 0::BIGINT AS invalid FROM j GROUP BY 1"""


def category_recovery(spark, d):
    """The category of a line from one-hot differences of a supplier's cumulative category counts."""
    flags = ["A", "N", "R"]
    f = facts(spark, d, "l_orderkey", "l_partkey", "l_extendedprice")
    w = Window.partitionBy("l_suppkey").orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = f.withColumn("counts", F.array(*[F.coalesce(F.sum((F.col("l_returnflag") == x).cast("int")).over(before), F.lit(0)) for x in flags]))
    delta = F.zip_with(F.lead("counts").over(w), "counts", lambda a, b: a - b)
    r = r.withColumn("delta", delta).withColumn("class", F.when(F.array_max("delta") == 1, F.array_position("delta", 1) - 1))
    return r.groupBy("l_returnflag", "class").agg(F.count("*").alias("n"))


CATEGORY_SQL = f"""WITH {FACTS}, r AS (SELECT *, lead(l_orderkey) OVER (PARTITION BY l_suppkey {_O}) IS NOT NULL AS known FROM f)
SELECT l_returnflag, CASE WHEN known THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END END::BIGINT AS class, count(*)::BIGINT AS n FROM r GROUP BY 1, 2"""


def joint_class() -> Column:
    """Number of the line's class, by its flags."""
    return (
        F.when((F.col("target") == 1) & (F.col("l_discount") >= 0.05), 0).when(F.col("target") == 1, 1)
        .when((F.col("l_returnflag") == "A") & (F.col("l_tax") > F.col("l_discount")), 2).when(F.col("l_returnflag") == "A", 3).otherwise(4)
    )


def taxonomy(spark, d):
    """Five disjoint classes of a line by its flags."""
    return facts(spark, d, "l_discount", "l_tax").groupBy("season", joint_class().alias("class")).agg(F.count("*").alias("n"))


TAXONOMY_SQL = f"""WITH {FACTS} SELECT season, (CASE WHEN target = 1 AND l_discount >= 0.05 THEN 0 WHEN target = 1 THEN 1 WHEN l_returnflag = 'A' AND l_tax > l_discount THEN 2 WHEN l_returnflag = 'A' THEN 3 ELSE 4 END)::INTEGER AS class,
  count(*)::BIGINT AS n FROM f GROUP BY 1, 2"""


def latent_states(spark, d) -> DataFrame:
    """(season, l_suppkey, theta, reliability): logit of a supplier's shrunk yearly rate less the year's logit."""
    f = facts(spark, d)
    y = f.groupBy("season", "l_suppkey").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    year = f.groupBy("season").agg(F.avg("target").alias("m"))
    j = y.join(F.broadcast(year), "season")
    p = (F.col("s") + 50.0 * F.col("m")) / (F.col("n") + 50.0)
    return j.select("season", "l_suppkey", "n", (X.logit(p) - X.logit(F.col("m"))).alias("theta"), (F.col("n") / (F.col("n") + 50.0)).alias("reliability"))


LATENT = f"""{FACTS}, yr AS (SELECT season, avg(target) AS m FROM f GROUP BY 1),
y AS (SELECT season, l_suppkey, sum(target) AS s, count(*)::BIGINT AS n FROM f GROUP BY 1, 2),
z AS (SELECT season, l_suppkey, n, ln(p / (1 - p)) - ln(m / (1 - m)) AS theta, n / (n + 50.0::DOUBLE) AS reliability FROM (
  SELECT *, (s + 50.0::DOUBLE * m) / (n + 50.0::DOUBLE) AS p FROM y JOIN yr USING (season)))"""


def latent_state(spark, d):
    return rounded(latent_states(spark, d), "theta", "reliability")


def persistence(spark, d) -> DataFrame:
    """(season, rho): AR(1) persistence from all consecutive pairs before the season, ridge through the origin, within 0 and 1."""
    z = latent_states(spark, d)
    w = Window.partitionBy("l_suppkey").orderBy("season")
    pairs = z.withColumns({"x": F.lag("theta").over(w), "gap": F.col("season") - F.lag("season").over(w), "rx": F.lag("reliability").over(w)}).where("gap = 1")
    weight = F.col("rx") * F.col("reliability")
    sums = pairs.groupBy("season").agg(F.sum(weight * F.col("x") * F.col("theta")).alias("xy"), F.sum(weight * F.col("x") * F.col("x")).alias("xx"))
    past = Window.orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    return sums.select("season", X.clip(F.coalesce(F.sum("xy").over(past), F.lit(0.0)) / (F.coalesce(F.sum("xx").over(past), F.lit(0.0)) + 1.0), 0.0, 1.0).alias("rho"))


RHO = f"""{LATENT}, q AS (SELECT season, theta, reliability, lag(theta) OVER w AS x, season - lag(season) OVER w AS gap, lag(reliability) OVER w AS rx FROM z WINDOW w AS (PARTITION BY l_suppkey ORDER BY season)),
u AS (SELECT season, sum(rx * reliability * x * theta) AS xy, sum(rx * reliability * x * x) AS xx FROM q WHERE gap = 1 GROUP BY 1),
rho AS (SELECT season, least(greatest(coalesce(sum(xy) OVER w, 0) / (coalesce(sum(xx) OVER w, 0) + 1.0), 0), 1) AS rho FROM u WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def ar_rho(spark, d):
    return rounded(persistence(spark, d), "rho")


def ar_forecast(spark, d):
    """A supplier's state carried to each of its years: rho to the power of the gap times the latest earlier state; 0 in its first year."""
    z = latent_states(spark, d)
    rows = z.select("season", "l_suppkey")
    j = states.asof(rows, z.select("l_suppkey", "season", "theta"), "l_suppkey").join(F.broadcast(persistence(spark, d)), "season", "left")
    value = F.pow(F.col("rho"), F.col("season") - F.col("state_season")) * F.col("state_theta")
    return rounded(j.select("season", "l_suppkey", F.coalesce(value, F.lit(0.0)).alias("forecast")), "forecast")


FORECAST_SQL = f"""WITH {RHO} SELECT a.season, a.l_suppkey, round(coalesce(rho ** (a.season - b.season) * b.theta, 0), 6) AS forecast
FROM z a ASOF LEFT JOIN z b ON b.l_suppkey = a.l_suppkey AND a.season > b.season LEFT JOIN rho ON rho.season = a.season"""


def seen_unseen(spark, d):
    """Lines of parts that earlier years have seen, and of parts new in the year."""
    f = facts(spark, d, "l_partkey")
    first = f.groupBy("l_partkey").agg(F.min("season").alias("first"))
    j = f.groupBy("l_partkey", "season").agg(F.count("*").alias("n")).join(first, "l_partkey")
    return j.groupBy("season", (F.col("first") < F.col("season")).alias("seen")).agg(F.sum("n").alias("lines"), F.count("*").alias("parts"))


SEEN_SQL = f"""WITH {FACTS}, a AS (SELECT l_partkey, min(season) AS first FROM f GROUP BY 1)
SELECT season, first < season AS seen, count(*)::BIGINT AS lines, count(DISTINCT l_partkey)::BIGINT AS parts FROM f JOIN a USING (l_partkey) GROUP BY 1, 2"""


def denominators(spark, d):
    """Least common denominator, at most 180, that explains both of a supplier's rates of a quarter over all its lines, as written with six digits.

    `denominators_all_lines` takes whole years and no bound; plans/recovered.py has windows of several quarters.
    """
    return _denominators(facts(spark, d, "l_discount").withColumn("quarter", F.quarter("l_shipdate")), F.lit(180), ["season", "quarter"])


def denominators_all_lines(spark, d):
    """Least common denominator that explains both of a supplier's yearly rates over all its lines, as written with six digits: at most the number of lines, which always does."""
    return _denominators(facts(spark, d, "l_discount"), F.col("n"), ["season"])


def _denominators(f, most, periods):
    y = f.groupBy("l_suppkey", *periods).agg(F.avg("target").alias("a"), F.avg((F.col("l_discount") >= 0.05).cast("int")).alias("b"), F.count("*").alias("n"))
    six = lambda c: F.format_string("%.6f", c).cast("double")
    pairs = y.select("l_suppkey", *periods, six(F.col("a")).alias("a"), six(F.col("b")).alias("b"), most.cast("int").alias("most"))
    distinct = pairs.groupBy("a", "b").agg(F.min("most").alias("most")).withColumn("m", F.explode(F.sequence(F.lit(1), F.col("most"))))
    fits = lambda c: six(F.rint(F.col(c) * F.col("m")) / F.col("m")) == F.col(c)
    least = distinct.where(fits("a") & fits("b")).groupBy("a", "b").agg(F.min("m").alias("m"))
    return pairs.join(least, ["a", "b"], "left").select("l_suppkey", *periods, "a", "b", "m")


DENOMINATOR_SQL = f"""WITH {FACTS}, y AS (SELECT l_suppkey, season, quarter(l_shipdate)::INTEGER AS quarter, printf('%.6f', avg(target))::DOUBLE AS a, printf('%.6f', avg((l_discount >= 0.05)::INTEGER))::DOUBLE AS b FROM f GROUP BY 1, 2, 3),
m AS (SELECT a, b, min(m)::INTEGER AS m FROM (SELECT DISTINCT a, b FROM y), (SELECT unnest(range(1, 181)) AS m)
  WHERE printf('%.6f', round_even(a * m, 0) / m)::DOUBLE = a AND printf('%.6f', round_even(b * m, 0) / m)::DOUBLE = b GROUP BY 1, 2)
SELECT l_suppkey, season, quarter, a, b, m FROM y LEFT JOIN m USING (a, b)"""
ALL_LINES_SQL = f"""WITH {FACTS}, y AS (SELECT l_suppkey, season, printf('%.6f', avg(target))::DOUBLE AS a, printf('%.6f', avg((l_discount >= 0.05)::INTEGER))::DOUBLE AS b, count(*) AS n FROM f GROUP BY 1, 2),
m AS (SELECT a, b, min(m)::INTEGER AS m FROM (SELECT a, b, unnest(range(1, max(n) + 1)) AS m FROM y GROUP BY a, b)
  WHERE printf('%.6f', round_even(a * m, 0) / m)::DOUBLE = a AND printf('%.6f', round_even(b * m, 0) / m)::DOUBLE = b GROUP BY 1, 2)
SELECT l_suppkey, season, a, b, m FROM y LEFT JOIN m USING (a, b)"""

QUERIES = {
    "season_end_state": season_end_state, "asof_state": asof_state, "asof_current_season": current_season, "label_recovery": label_recovery,
    "category_recovery": category_recovery, "taxonomy": taxonomy, "latent_state": latent_state, "ar_rho": ar_rho, "ar_forecast": ar_forecast,
    "seen_unseen": seen_unseen, "denominators": denominators, "denominators_all_lines": denominators_all_lines,
}
ORACLES = {
    "season_end_state": f"WITH {END} SELECT l_suppkey, season, n, s FROM ends", "asof_state": ASOF_SQL, "asof_current_season": CURRENT_SQL,
    "label_recovery": RECOVERY_SQL, "category_recovery": CATEGORY_SQL, "taxonomy": TAXONOMY_SQL,
    "latent_state": f"WITH {LATENT} SELECT season, l_suppkey, n, round(theta, 6) AS theta, round(reliability, 6) AS reliability FROM z",
    "ar_rho": f"WITH {RHO} SELECT season, round(rho, 6) AS rho FROM rho", "ar_forecast": FORECAST_SQL, "seen_unseen": SEEN_SQL, "denominators": DENOMINATOR_SQL, "denominators_all_lines": ALL_LINES_SQL,
}
