"""What rounded rates give away: denominators of one or several windows, rates of several kinds, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import states
from ..sources.io import Stage
from .base import FACTS, facts, rounded
from .history import RHO, latent_states, persistence

#: Denominators are searched up to these, for windows of one, three and five periods.
MOST = {1: 180, 3: 450, 5: 700}


def six_digits(x: Column) -> Column:
    """x as it reads with six significant digits, for x from 0 to 1."""
    places = F.when(x > 0, F.greatest(F.lit(0), 5 - F.floor(F.log10(x)))).otherwise(6).cast("int")
    scale = F.pow(F.lit(10.0), places)
    return F.rint(x * scale) / scale


def fitting(pairs: DataFrame, a: str, b: str, most: int, m: str) -> DataFrame:
    """(a, b, m) for each distinct pair of rates and each denominator up to `most` that both may have, as read with six digits."""
    distinct = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    tried = distinct.withColumn(m, F.explode(F.sequence(F.lit(1), F.lit(most))))
    fits = lambda c: six_digits(F.rint(F.col(c) * F.col(m)) / F.col(m)) == F.col(c)
    near = lambda c: F.abs(F.rint(F.col(c) * F.col(m)) - F.col(c) * F.col(m)) <= 6e-6 * F.col(m)  # noqa: E731  six digits of 0 to 1 are off by 5e-6 at most: the cheap test leaves few to the exact one
    return tried.where(near(a) & near(b) & fits(a) & fits(b))


_SIX = "(CASE WHEN {x} > 0 THEN round_even({x} * 10.0 ** greatest(0, 5 - floor(log10({x}))), 0) / 10.0 ** greatest(0, 5 - floor(log10({x}))) ELSE 0.0 END)"


def six_sql(x: str) -> str:
    return _SIX.format(x=f"({x})")


def windows(spark, d) -> DataFrame:
    """Rates of a supplier over its last 1, 3 and 5 active quarters before a quarter, as read with six digits, and the true counts."""
    f = facts(spark, d, "l_discount").withColumn("quarter", 4 * F.col("season") + F.quarter("l_shipdate"))
    c = f.groupBy("l_suppkey", "quarter").agg(F.count("*").alias("n"), F.sum("target").alias("s"), F.count_if(F.col("l_discount") >= 0.05).alias("t"))
    for k in MOST:
        w = Window.partitionBy("l_suppkey").orderBy("quarter").rowsBetween(-k, -1)
        full = F.count("*").over(w) == k
        n = F.sum("n").over(w)
        c = c.withColumns({f"n{k}": F.when(full, n), f"a{k}": F.when(full, six_digits(F.sum("s").over(w) / n)), f"b{k}": F.when(full, six_digits(F.sum("t").over(w) / n))})
    return c.select("l_suppkey", "quarter", *[f"{x}{k}" for k in MOST for x in "nab"])


WINDOWS = f"""{FACTS}, w0 AS (SELECT l_suppkey, (4 * season + quarter(l_shipdate))::INTEGER AS quarter, count(*) AS n, sum(target) AS s, count(*) FILTER (l_discount >= 0.05) AS t FROM f GROUP BY 1, 2),
w1 AS (SELECT l_suppkey, quarter, {', '.join(f"CASE WHEN count(*) OVER w{k} = {k} THEN sum(n) OVER w{k} END AS n{k}, CASE WHEN count(*) OVER w{k} = {k} THEN sum(s) OVER w{k} / sum(n) OVER w{k} END AS x{k}, CASE WHEN count(*) OVER w{k} = {k} THEN sum(t) OVER w{k} / sum(n) OVER w{k} END AS y{k}" for k in MOST)}
  FROM w0 WINDOW {', '.join(f'w{k} AS (PARTITION BY l_suppkey ORDER BY quarter ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)' for k in MOST)}),
wn AS (SELECT l_suppkey, quarter, {', '.join(f"n{k}::BIGINT AS n{k}, CASE WHEN x{k} IS NOT NULL THEN {six_sql(f'x{k}')} END AS a{k}, CASE WHEN y{k} IS NOT NULL THEN {six_sql(f'y{k}')} END AS b{k}" for k in MOST)} FROM w1)"""


def _fit_sql(k: int, pairs: str = "wn") -> str:
    return f"""d{k} AS (SELECT a{k}, b{k}, m{k}::INTEGER AS m{k} FROM (SELECT DISTINCT a{k}, b{k} FROM {pairs} WHERE a{k} IS NOT NULL AND b{k} IS NOT NULL), (SELECT unnest(range(1, {MOST[k]} + 1)) AS m{k})
  WHERE {six_sql(f'round_even(a{k} * m{k}, 0) / m{k}')} = a{k} AND {six_sql(f'round_even(b{k} * m{k}, 0) / m{k}')} = b{k})"""


def window_denominators(spark, d):
    """The least denominator of each window on its own, where there is one within the bounds, and the greatest over growing windows."""
    w = base = Stage(spark)(windows(spark, d))  # the result reads it
    for k, most in MOST.items():
        least = fitting(base, f"a{k}", f"b{k}", most, f"m{k}").groupBy(f"a{k}", f"b{k}").agg(F.min(f"m{k}").alias(f"m{k}"))
        w = w.join(least, [f"a{k}", f"b{k}"], "left")
    return w.select("l_suppkey", "quarter", *[f"{x}{k}" for k in MOST for x in "nm"], F.greatest("m1", "m3").alias("most3"), F.greatest("m1", "m3", "m5").alias("most5"))


DENOMINATOR_SQL = f"""WITH {WINDOWS}, {', '.join(map(_fit_sql, MOST))}, {', '.join(f'l{k} AS (SELECT a{k}, b{k}, min(m{k}) AS m{k} FROM d{k} GROUP BY 1, 2)' for k in MOST)}
SELECT l_suppkey, quarter, n1, m1, n3, m3, n5, m5, greatest(m1, m3) AS most3, greatest(m1, m3, m5) AS most5 FROM wn {' '.join(f'LEFT JOIN l{k} USING (a{k}, b{k})' for k in MOST)}"""


def joint_denominators(spark, d):
    """The first triple of denominators, in order, that the three windows can have together: each longer window has two more at least, and no fewer of either count.

    The denominators of a pair of rates are one sorted array, no longer than the bound, so triples are counted, not made: for each
    denominator of the middle window those of the short one that fit below it times those of the long one that fit above.
    """
    w = Stage(spark)(windows(spark, d).where("n5 IS NOT NULL"))  # read five times, by the result too
    rates = [f"{x}{k}" for k in MOST for x in "ab"]
    one = w.select(*rates).distinct()
    for k, most in MOST.items():
        a, b = f"a{k}", f"b{k}"
        count = lambda x: F.rint(F.col(x) * F.col("m")).cast("int").alias(x[0])
        found = fitting(w, a, b, most, "m").groupBy(a, b).agg(F.sort_array(F.collect_list(F.struct("m", count(a), count(b)))).alias(f"d{k}"))
        one = one.join(found, [a, b])
    fits = lambda less, more: (more["m"] >= less["m"] + 2) & (more["a"] >= less["a"]) & (more["b"] >= less["b"])
    sides = lambda y: F.struct(y["m"].alias("m3"), F.filter("d1", lambda x: fits(x, y)).alias("below"), F.filter("d5", lambda z: fits(y, z)).alias("above"))
    counted = F.transform(F.transform("d3", sides), lambda y: F.struct(F.get(y["below"], F.lit(0))["m"].alias("m1"), y["m3"].alias("m3"), F.get(y["above"], F.lit(0))["m"].alias("m5"), (F.size(y["below"]) * F.size(y["above"])).cast("long").alias("ways")))
    best = one.select(*rates, F.filter(counted, lambda y: y["ways"] > 0).alias("c")).where(F.size("c") > 0)
    best = best.select(*rates, F.array_min("c").alias("m"), F.aggregate("c", F.lit(0).cast("long"), lambda total, y: total + y["ways"]).alias("ways"))
    return w.join(best, rates, "left").select("l_suppkey", "quarter", "n1", "n3", "n5", "m.m1", "m.m3", "m.m5", F.coalesce("ways", F.lit(0)).alias("ways"))


JOINT_SQL = f"""WITH {WINDOWS}, w5 AS (SELECT * FROM wn WHERE n5 IS NOT NULL), {', '.join(_fit_sql(k, 'w5') for k in MOST)},
t AS (SELECT a1, b1, a3, b3, a5, b5, m1, m3, m5 FROM (SELECT DISTINCT a1, b1, a3, b3, a5, b5 FROM w5) JOIN d1 USING (a1, b1) JOIN d3 USING (a3, b3) JOIN d5 USING (a5, b5)
  WHERE m3 >= m1 + 2 AND m5 >= m3 + 2 AND round_even(a3 * m3, 0) >= round_even(a1 * m1, 0) AND round_even(b3 * m3, 0) >= round_even(b1 * m1, 0) AND round_even(a5 * m5, 0) >= round_even(a3 * m3, 0) AND round_even(b5 * m5, 0) >= round_even(b3 * m3, 0)),
b AS (SELECT a1, b1, a3, b3, a5, b5, min({{'a': m1, 'b': m3, 'c': m5}}) AS m, count(*) AS ways FROM t GROUP BY ALL)
SELECT l_suppkey, quarter, n1, n3, n5, m.a AS m1, m.b AS m3, m.c AS m5, coalesce(ways, 0) AS ways FROM w5 LEFT JOIN b USING (a1, b1, a3, b3, a5, b5)"""


def window_posteriors(spark, d):
    """What the recovered window of three says: its reliability n / (n + 60), its shrunk rate less the rate of the five, and how many times its least denominator the true one may be."""
    w = windows(spark, d).where("n5 IS NOT NULL")
    least = fitting(w, "a3", "b3", MOST[3], "m").groupBy("a3", "b3").agg(F.min("m").alias("m"), F.count("*").alias("ways"))
    j = w.join(least, ["a3", "b3"])
    rel = F.col("m") / (F.col("m") + 60.0)
    return rounded(j.select("l_suppkey", "quarter", "m", "ways", rel.alias("reliability"), (rel * (F.col("a3") - F.col("a5"))).alias("delta"), (F.log1p("m") - F.log1p("n3")).alias("log_gap")), "reliability", "delta", "log_gap")


POSTERIOR_SQL = f"""WITH {WINDOWS}, w5 AS (SELECT * FROM wn WHERE n5 IS NOT NULL), {_fit_sql(3, 'w5')}, l AS (SELECT a3, b3, min(m3) AS m, count(*) AS ways FROM d3 GROUP BY 1, 2)
SELECT l_suppkey, quarter, m, ways, round(m / (m + 60.0), 6) AS reliability, round(m / (m + 60.0) * (a3 - a5), 6) AS delta, round(ln(1 + m) - ln(1 + n3), 6) AS log_gap FROM w5 JOIN l USING (a3, b3)"""


def tolerant_denominators(spark, d, most: int = 180, tolerance: float = 2e-6):
    """The least denominator with which both raw rates of a supplier's quarter are within a tolerance of a fraction."""
    f = facts(spark, d, "l_discount").groupBy("l_suppkey", "season", F.quarter("l_shipdate").alias("quarter")).agg(F.avg("target").alias("a"), F.avg((F.col("l_discount") >= 0.05).cast("int")).alias("b"), F.count("*").alias("n"))
    near = lambda c: F.abs(F.rint(F.col(c) * F.col("m")) / F.col("m") - F.col(c)) <= tolerance
    least = f.select("a", "b").distinct().withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(near("a") & near("b")).groupBy("a", "b").agg(F.min("m").alias("m"))
    return f.join(least, ["a", "b"], "left").select("l_suppkey", "season", "quarter", "n", "m")


TOLERANT_SQL = f"""WITH {FACTS}, q AS (SELECT l_suppkey, season, quarter(l_shipdate)::INTEGER AS quarter, avg(target) AS a, avg((l_discount >= 0.05)::INTEGER) AS b, count(*) AS n FROM f GROUP BY 1, 2, 3),
l AS (SELECT a, b, min(m)::INTEGER AS m FROM (SELECT DISTINCT a, b FROM q), (SELECT unnest(range(1, 181)) AS m) WHERE abs(round_even(a * m, 0) / m - a) <= 2e-6 AND abs(round_even(b * m, 0) / m - b) <= 2e-6 GROUP BY 1, 2)
SELECT l_suppkey, season, quarter, n, m FROM q LEFT JOIN l USING (a, b)"""

#: Ten rates in three groups: of a supplier over its lines, of a supplier over its open lines, of a part over its lines.
RATES = {
    "own": ("l_suppkey", "true", {"success": "l_returnflag = 'R'", "accepted": "l_returnflag = 'A'", "open": "l_linestatus = 'O'", "deep": "l_discount >= 0.05"}),
    "late": ("l_suppkey", "l_linestatus = 'O'", {"few": "l_quantity < 20", "taxed": "l_tax >= 0.04", "first": "l_linenumber = 1"}),
    "part": ("l_partkey", "true", {"success": "l_returnflag = 'R'", "deep": "l_discount >= 0.05", "many": "l_quantity >= 40"}),
}
CURRENT_K = 30.0


def multi_rates(spark, d):
    """Ten rates of this half-year before and after, from cumulative rates: counts of a year's second half, clipped to what is possible, and how many had to be.

    Each group's cumulative counts at the end of June and of December are frozen; the
    second half is their difference, its rate shrunk to the rate of the year.
    """
    f = facts(spark, d, "l_partkey", "l_discount", "l_tax", "l_quantity").withColumn("late", (F.month("l_shipdate") > 6))
    out = None
    for group, (key, of, rates) in RATES.items():
        cell = f.where(of).groupBy(key, "season").agg(
            F.count("*").alias("n1"), F.count_if(~F.col("late")).alias("n0"),
            *[F.count_if(F.expr(c)).alias(f"s1_{r}") for r, c in rates.items()], *[F.count_if(F.expr(c) & ~F.col("late")).alias(f"s0_{r}") for r, c in rates.items()],
        ).where("n0 > 0")
        # counts read back from rates of six digits, as a frozen table would hold them
        read = lambda s, n: F.rint(F.round(F.col(s) / F.col(n), 6) * F.col(n))
        each = F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"s1_{r}").alias("s1"), F.col(f"s0_{r}").alias("s0")) for r in rates])
        raw, n = read("s1", "n1") - read("s0", "n0"), F.col("n1") - F.col("n0")
        one = cell.select("season", "n1", "n0", F.inline(each)).withColumns({"raw": raw, "n": n, "held": F.least(F.greatest(raw, F.lit(0.0)), n)})
        p = (F.col("held") + CURRENT_K * F.col("s1") / F.col("n1")) / (F.col("n") + CURRENT_K)
        one = one.groupBy("season", F.lit(group).alias("group"), "rate").agg(F.count("*").alias("entities"), F.sum("n").alias("lines"), F.avg(p).alias("mean"), F.count_if(F.col("raw") != F.col("held")).alias("clipped"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean")


def _multi_sql() -> str:
    parts = []
    for group, (key, of, rates) in RATES.items():
        for r, c in rates.items():
            parts.append(f"""SELECT season, '{group}' AS "group", '{r}' AS rate, count(*) AS entities, sum(n)::BIGINT AS lines, round(avg((held + {CURRENT_K} * s1 / n1) / (n + {CURRENT_K})), 6) AS mean, count(*) FILTER (raw != held) AS clipped FROM (
  SELECT *, least(greatest(raw, 0), n) AS held FROM (SELECT *, n1 - n0 AS n, round_even(round(s1 / n1, 6) * n1, 0) - round_even(round(s0 / n0, 6) * n0, 0) AS raw FROM (
  SELECT {key}, season, count(*) AS n1, count(*) FILTER (month(l_shipdate) <= 6) AS n0, count(*) FILTER ({c}) AS s1, count(*) FILTER ({c} AND month(l_shipdate) <= 6) AS s0 FROM f WHERE {of} GROUP BY 1, 2) WHERE n0 > 0)) GROUP BY 1""")
    return f"WITH {FACTS} " + " UNION ALL ".join(parts)


def forecast_deltas(spark, d):
    """A supplier's carried state as a rate, shrunk by what it saw last, less the rate of all its earlier years: of each year after its first."""
    z = latent_states(spark, d)
    f = facts(spark, d)
    own = states.prior_sums(f, ["l_suppkey"], F.col("target")).select("l_suppkey", "season", "s", F.col("n").alias("n_before"))
    j = states.asof(z.select("season", "l_suppkey"), z.select("l_suppkey", "season", "theta", "n"), "l_suppkey").join(F.broadcast(persistence(spark, d)), "season", "left")
    j = j.join(own, ["l_suppkey", "season"]).where("state_season IS NOT NULL")
    carried = F.pow(F.coalesce("rho", F.lit(0.0)), F.col("season") - F.col("state_season")) * F.col("state_theta")
    center = F.col("s") / F.col("n_before")
    posterior = (F.col("state_n") * X.expit(X.logit(center) + carried) + 200.0 * center) / (F.col("state_n") + 200.0)
    return rounded(j.select("season", "l_suppkey", (posterior - center).alias("delta")), "delta")


FORECAST_SQL = f"""WITH {RHO}, c1 AS (SELECT l_suppkey, season, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2), pr AS (SELECT l_suppkey, season, sum(s) OVER w / sum(n) OVER w AS center FROM c1 WINDOW w AS (PARTITION BY l_suppkey ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT a.season, a.l_suppkey, coalesce(rho.rho, 0.0) ** (a.season - b.season) * b.theta AS carried, b.n AS n FROM z a ASOF JOIN z b ON b.l_suppkey = a.l_suppkey AND a.season > b.season LEFT JOIN rho ON rho.season = a.season),
k AS (SELECT season, l_suppkey, n, center, least(greatest(center, 1e-6), 1 - 1e-6) AS c, carried FROM j JOIN pr USING (season, l_suppkey))
SELECT season, l_suppkey, round((n * (1 / (1 + exp(-(ln(c / (1 - c)) + carried)))) + 200.0 * center) / (n + 200.0) - center, 6) AS delta FROM k"""


def career_features(spark, d):
    """A part's career up to a year: years seen, years since the first and the last, lines a year, and the share of its lines in its busiest year."""
    c = facts(spark, d, "l_partkey").groupBy("l_partkey", "season").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_partkey").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    seen, lines = F.count("*").over(w), F.coalesce(F.sum("n").over(w), F.lit(0))
    return rounded(c.select(
        "l_partkey", "season", seen.alias("years"), (F.col("season") - F.min("season").over(w)).alias("age"), (F.col("season") - F.max("season").over(w)).alias("away"),
        (lines / F.nullif(seen, F.lit(0))).alias("a_year"), (F.max("n").over(w) / F.nullif(lines, F.lit(0))).alias("busiest"),
    ), "a_year", "busiest")


CAREER_SQL = f"""WITH {FACTS}, c AS (SELECT l_partkey, season, count(*) AS n FROM f GROUP BY 1, 2)
SELECT l_partkey, season, count(*) OVER w AS years, season - min(season) OVER w AS age, season - max(season) OVER w AS away, round(coalesce(sum(n) OVER w, 0) / nullif(count(*) OVER w, 0), 6) AS a_year, round(max(n) OVER w / nullif(sum(n) OVER w, 0), 6) AS busiest
FROM c WINDOW w AS (PARTITION BY l_partkey ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

#: A stored ridge: feature -> (fill, mean, scale, coefficient, coefficient of the missing flag).
STORED_RIDGE = {"l_discount": (0.05, 0.05, 0.03, -0.004, 0.001), "l_tax": (0.04, 0.04, 0.025, 0.002, -0.003), "l_quantity": (25.0, 25.5, 14.4, 0.006, 0.0)}


def stored_ridge(features: dict[str, Column], stored: dict[str, tuple]) -> Column:
    """A stored linear model applied to a row: missing features filled and flagged, standardised, and summed in the order of `stored`."""
    total = F.lit(0.0)
    for name, (fill, mean, scale, coefficient, flag) in stored.items():
        x = features[name]
        total = total + (F.coalesce(x, F.lit(fill)) - mean) / scale * coefficient + F.when(x.isNull(), flag).otherwise(0.0)
    return total


def ridge_application(spark, d):
    """Corrections of a stored model for the lines of each supplier and year; a discount, tax or quantity of 0 or 1 counts as missing."""
    f = facts(spark, d, "l_discount", "l_tax", "l_quantity")
    x = {"l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": F.nullif("l_tax", F.lit(0.0)), "l_quantity": F.nullif("l_quantity", F.lit(1.0))}
    return rounded(f.groupBy("l_suppkey", "season").agg(F.count("*").alias("n"), F.avg(X.clip(stored_ridge(x, STORED_RIDGE), -0.01, 0.01)).alias("correction")), "correction")


RIDGE_SQL = f"WITH {FACTS} SELECT l_suppkey, season, count(*) AS n, round(avg(least(greatest(" + " + ".join(
    f"(coalesce(nullif({k}, {1.0 if k == 'l_quantity' else 0.0}), {v[0]}) - {v[1]}) / {v[2]} * ({v[3]}) + CASE WHEN nullif({k}, {1.0 if k == 'l_quantity' else 0.0}) IS NULL THEN {v[4]} ELSE 0 END" for k, v in STORED_RIDGE.items()) + ", -0.01), 0.01)), 6) AS correction FROM f GROUP BY 1, 2"

QUERIES = {
    "window_denominators": window_denominators, "joint_denominators": joint_denominators, "window_posteriors": window_posteriors, "tolerant_denominators": tolerant_denominators, "multi_rates": multi_rates,
    "forecast_deltas": forecast_deltas, "career_features": career_features, "ridge_application": ridge_application,
}
ORACLES = {
    "window_denominators": DENOMINATOR_SQL, "joint_denominators": JOINT_SQL, "window_posteriors": POSTERIOR_SQL, "tolerant_denominators": TOLERANT_SQL, "multi_rates": _multi_sql(),
    "forecast_deltas": FORECAST_SQL, "career_features": CAREER_SQL, "ridge_application": RIDGE_SQL,
}
