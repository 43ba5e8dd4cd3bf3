"""Empirical-Bayes effects of earlier periods, hierarchies, target encoding, policies, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import metrics, states
from .base import FACTS, facts, rounded

K, WIDTH = 200.0, 3
KEYS = ["l_suppkey", "l_linestatus"]


def predictions(spark, d, k: float = K, width: int = WIDTH) -> DataFrame:
    """(season, l_suppkey, l_linestatus, target, base, p): the prior rate moved by the key's effect of earlier years."""
    f = facts(spark, d)
    rows = states.demeaned(f, "target", "residual")
    effects = states.prior_effects(rows, KEYS, F.col("residual"), k, width)
    base = states.prior_rate(f, F.col("target"))
    joined = f.join(effects.drop("n"), [*KEYS, "season"], "left").join(F.broadcast(base), "season")  # a row for each year
    return joined.select("season", *KEYS, "l_linenumber", "target", F.col("rate").alias("base"), X.clip(F.col("rate") + F.coalesce("effect", F.lit(0.0)), 0.0, 1.0).alias("p"))


def predictions_sql(k: float = K, width: int = WIDTH) -> str:
    return f"""{FACTS},
means AS (SELECT season, avg(target) AS m, sum(target) AS s, count(*) AS n FROM f GROUP BY 1),
base AS (SELECT season, coalesce(sum(s) OVER w / nullif(sum(n) OVER w, 0), 0.5) AS rate FROM means WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cells AS (SELECT l_suppkey, l_linestatus, season, sum(target - m) AS s, count(*) AS n FROM f JOIN means USING (season) GROUP BY ALL),
effects AS (SELECT l_suppkey, l_linestatus, season, coalesce(sum(s) OVER w, 0) / (coalesce(sum(n) OVER w, 0) + {k}) AS effect FROM cells
  WINDOW w AS (PARTITION BY l_suppkey, l_linestatus ORDER BY season RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)),
predicted AS (SELECT season, l_suppkey, l_linestatus, l_linenumber, target, rate AS base, least(greatest(rate + coalesce(effect, 0), 0), 1) AS p
  FROM f LEFT JOIN effects USING (l_suppkey, l_linestatus, season) JOIN base USING (season))"""


METRICS_SQL = """count(*)::BIGINT AS n, round(avg((p - target) * (p - target)), 6) AS brier,
  round(100000 * (1 - avg((p - target) * (p - target)) / nullif(avg(target) * (1 - avg(target)), 0)), 3) AS skill,
  round(avg(p), 6) AS mean_p, round(avg(target), 6) AS rate"""


def eb_prior_years(spark, d):
    return predictions(spark, d).groupBy("season").agg(*metrics.brier())


def prediction_cells(spark, d):
    return rounded(predictions(spark, d).groupBy("season", *KEYS).agg(F.count("*").alias("n"), F.max("p").alias("p")), "p")


def regime_metrics(spark, d):
    return predictions(spark, d).groupBy("season", "l_linestatus").agg(*metrics.brier())


def segment_metrics(spark, d):
    p = predictions(spark, d)
    segments = F.array(F.lit("all"), F.when(F.col("l_linenumber") <= 2, "head").otherwise("tail"), F.concat(F.lit("status_"), "l_linestatus"))
    return p.withColumn("segment", F.explode(segments)).groupBy("segment").agg(*metrics.brier())


def calibration(spark, d):
    return metrics.calibration(predictions(spark, d), "season")


CALIBRATION_SQL = """SELECT season, round(regr_slope(target, p), 4) AS slope, round(regr_intercept(target, p), 5) AS intercept, round(corr(target, p), 6) AS correlation
FROM predicted GROUP BY 1 HAVING stddev_pop(p) > 1e-12"""


def gap_decomposition(spark, d):
    """Each regime's share of a year's Brier gap between the prediction and its base."""
    p = predictions(spark, d)
    gap = F.pow(F.col("p") - F.col("target"), 2) - F.pow(F.col("base") - F.col("target"), 2)
    cells = p.groupBy("season", "l_linestatus").agg(F.sum(gap).alias("s"), F.count("*").alias("m"))
    n = F.sum("m").over(Window.partitionBy("season"))
    return cells.select("season", "l_linestatus", F.round(F.col("s") / n, 9).alias("contribution"), F.round(F.col("m") / n, 6).alias("share"))


GAP_SQL = """SELECT season, l_linestatus, round(sum((p - target) ** 2 - (base - target) ** 2) / sum(count(*)) OVER (PARTITION BY season), 9) AS contribution,
  round(count(*) / sum(count(*)) OVER (PARTITION BY season), 6) AS share FROM predicted GROUP BY 1, 2"""

GRID = (50.0, 200.0, 800.0)


def prior_cells(spark, d, width: int = WIDTH) -> DataFrame:
    """(season, KEYS, n, hits, ps, pn, rate): a cell's lines and outcomes, its residual sums and lines of the years before, and the year's prior rate.

    A prediction is one number for a cell, so scores at any strength need no more than
    this table: one scan and one shuffle of the lines.
    """
    cells = facts(spark, d).groupBy(*KEYS, "season").agg(F.count("*").alias("n"), F.sum("target").alias("hits"))
    years = cells.groupBy("season").agg(F.sum("n").alias("yn"), F.sum("hits").alias("yh"))  # a row for each year
    past = Window.orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    years = years.select("season", (F.col("yh") / F.col("yn")).alias("mean"), F.coalesce(F.sum("yh").over(past) / F.sum("yn").over(past), F.lit(0.5)).alias("rate"))
    w = Window.partitionBy(*KEYS).orderBy("season").rangeBetween(-width, -1)
    j = cells.join(F.broadcast(years), "season").withColumn("s", F.col("hits") - F.col("n") * F.col("mean"))
    return j.select("season", *KEYS, "n", "hits", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("ps"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("pn"), "rate")


def moved(k: float):
    """The prior rate of a cell moved by its effect at strength k."""
    return X.clip(F.col("rate") + F.col("ps") / (F.col("pn") + k), 0.0, 1.0)


def cell_loss(p):
    """Squared errors of one prediction summed over the lines of a cell."""
    return F.col("hits") * F.pow(1 - p, 2) + (F.col("n") - F.col("hits")) * F.pow(p, 2)


def candidate_selection(spark, d):
    """For each year the smoothing of the best worst-year Brier over earlier years, and its Brier this year; all strengths from one scan."""
    losses = prior_cells(spark, d).groupBy("season").agg(*[F.round(F.sum(cell_loss(moved(k))) / F.sum("n"), 9).alias(f"b{i}") for i, k in enumerate(GRID)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("ix"), F.col(f"b{i}").alias("brier")) for i, k in enumerate(GRID)]))
    return metrics.select_by_prior(losses.select("season", rows.alias("c")).select("season", "c.*"))


def _selection_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT season, {k} AS k, {i} AS ix, round(avg((p - target) * (p - target)), 9) AS brier FROM (WITH {predictions_sql(k)} SELECT * FROM predicted) GROUP BY 1"
        for i, k in enumerate(GRID)
    )
    return f"""WITH s AS ({parts}), h AS (
SELECT a.season, b.k, b.ix, max(b.brier) AS worst, avg(b.brier) AS mean FROM (SELECT DISTINCT season FROM s) a JOIN s b ON b.season < a.season GROUP BY ALL),
c AS (SELECT season, k, row_number() OVER (PARTITION BY season ORDER BY round(worst, 9), round(mean, 9), ix) AS r FROM h)
SELECT c.season, c.k::DOUBLE AS k, s.brier FROM c JOIN s ON s.season = c.season AND s.k = c.k WHERE r = 1"""


def shrunk_rates(spark, d):
    """Each supplier's rate of all earlier years, shrunk to the year's prior rate."""
    f = facts(spark, d)
    sums = states.prior_sums(f, ["l_suppkey"], F.col("target")).join(F.broadcast(states.prior_rate(f, F.col("target"))), "season")
    rate = X.shrunk_rate(F.col("n"), F.col("s") / F.nullif(F.col("n"), F.lit(0)), 100.0, F.col("rate"))
    return rounded(sums.select("season", "l_suppkey", "n", rate.alias("shrunk")), "shrunk")


SHRUNK_SQL = f"""WITH {FACTS}, m AS (SELECT season, sum(target) AS s, count(*) AS n FROM f GROUP BY 1),
b AS (SELECT season, coalesce(sum(s) OVER w / nullif(sum(n) OVER w, 0), 0.5) AS rate FROM m WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT l_suppkey, season, sum(target) AS s, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT l_suppkey, season, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(n) OVER w, 0) AS n FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, l_suppkey, n::BIGINT AS n, round((s + 100.0 * rate) / (n + 100.0), 6) AS shrunk FROM p JOIN b USING (season)"""


def null_keys_clipped(spark, d):
    """Effects of nation by status, null keys kept, within 0.02; suppliers of nations above 20 count as of none."""
    from ..sources.io import table

    f = states.demeaned(facts(spark, d), "target", "residual")
    s = table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]).select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_nationkey") <= 20, F.col("s_nationkey")).alias("nation"))
    e = states.prior_effects(f.join(s, "l_suppkey", "left"), ["nation", "l_linestatus"], F.col("residual"), 500.0, 3)
    return rounded(e.select("nation", "l_linestatus", "season", X.clip(F.col("effect"), -0.02, 0.02).alias("effect"), "n"), "effect")


NULL_SQL = f"""WITH {FACTS}, g AS (SELECT f.*, CASE WHEN s_nationkey <= 20 THEN s_nationkey END AS nation, target - avg(target) OVER (PARTITION BY season) AS residual
  FROM f LEFT JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT nation, l_linestatus, season, sum(residual) AS s, count(*) AS n FROM g GROUP BY ALL)
SELECT nation, l_linestatus, season, round(least(greatest(coalesce(sum(s) OVER w, 0) / (coalesce(sum(n) OVER w, 0) + 500.0), -0.02::DOUBLE), 0.02::DOUBLE), 6) AS effect, coalesce(sum(n) OVER w, 0)::BIGINT AS n
FROM c WINDOW w AS (PARTITION BY nation, l_linestatus ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)"""

LEVELS = [(["l_suppkey"], 500.0), (["l_suppkey", "l_returnflag"], 200.0), (["l_suppkey", "l_returnflag", "l_linenumber", "l_linestatus"], 100.0)]


def three_level(spark, d):
    f = facts(spark, d, "l_discount").withColumn("hit", (F.col("l_discount") >= 0.05).cast("int"))
    return rounded(states.hierarchical_rates(f, LEVELS, "hit").select(*LEVELS[-1][0], "n_1", "n_2", "n_3", "rate_1", "rate_2", "rate_3"), "rate_1", "rate_2", "rate_3")


def four_level(spark, d):
    levels = [LEVELS[0], LEVELS[1], (["l_suppkey", "l_returnflag", "l_linestatus"], 100.0), (LEVELS[2][0], 50.0)]
    f = facts(spark, d, "l_discount").withColumn("hit", (F.col("l_discount") >= 0.05).cast("int"))
    out = states.hierarchical_rates(f, levels, "hit")
    return rounded(out.select(*levels[-1][0], "n_3", "n_4", "rate_3", "rate_4"), "rate_3", "rate_4")


def _levels_sql(levels: list[tuple[str, float]]) -> str:
    parts = ["o AS (SELECT avg(hit) AS rate_0 FROM g)"]
    for i, (keys, k) in enumerate(levels, 1):
        source = "o" if i == 1 else f"r{i - 1}"
        join = "CROSS JOIN o" if i == 1 else f"JOIN {source} USING ({levels[i - 2][0]})"
        parts.append(f"c{i} AS (SELECT {keys}, sum(hit) AS s{i}, count(*) AS n_{i} FROM g GROUP BY {keys}), r{i} AS (SELECT *, (s{i} + {k} * rate_{i - 1}) / (n_{i} + {k}) AS rate_{i} FROM c{i} {join})")
    return f"WITH g AS (SELECT *, (l_discount >= 0.05)::INTEGER AS hit FROM lineitem), " + ", ".join(parts)


THREE_SQL = _levels_sql([("l_suppkey", 500.0), ("l_suppkey, l_returnflag", 200.0), ("l_suppkey, l_returnflag, l_linenumber, l_linestatus", 100.0)]) + """
SELECT l_suppkey, l_returnflag, l_linenumber, l_linestatus, n_1, n_2, n_3, round(rate_1, 6) AS rate_1, round(rate_2, 6) AS rate_2, round(rate_3, 6) AS rate_3 FROM r3"""
FOUR_SQL = _levels_sql([("l_suppkey", 500.0), ("l_suppkey, l_returnflag", 200.0), ("l_suppkey, l_returnflag, l_linestatus", 100.0), ("l_suppkey, l_returnflag, l_linenumber, l_linestatus", 50.0)]) + """
SELECT l_suppkey, l_returnflag, l_linenumber, l_linestatus, n_3, n_4, round(rate_3, 6) AS rate_3, round(rate_4, 6) AS rate_4 FROM r4"""


def fallback_lookup(spark, d):
    """The finest rate known from earlier years: supplier and line, else supplier, else the year's prior rate."""
    f = facts(spark, d)
    fine = states.prior_sums(f, ["l_suppkey", "l_linenumber"], F.col("target"), width=1).where("n > 0").select("l_suppkey", "l_linenumber", "season", (F.col("s") / F.col("n")).alias("fine"))
    coarse = states.prior_sums(f, ["l_suppkey"], F.col("target"), width=1).where("n > 0").select("l_suppkey", "season", (F.col("s") / F.col("n")).alias("coarse"))
    cells = f.groupBy("l_suppkey", "l_linenumber", "season").agg(F.count("*").alias("n"))
    out = cells.join(fine, ["l_suppkey", "l_linenumber", "season"], "left").join(coarse, ["l_suppkey", "season"], "left").join(F.broadcast(states.prior_rate(f, F.col("target"))), "season")
    level = F.when(F.col("fine").isNotNull(), 2).when(F.col("coarse").isNotNull(), 1).otherwise(0)
    return rounded(out.select("l_suppkey", "l_linenumber", "season", "n", level.alias("level"), F.coalesce("fine", "coarse", "rate").alias("value")), "value")


FALLBACK_SQL = f"""WITH {FACTS}, m AS (SELECT season, sum(target) AS s, count(*) AS n FROM f GROUP BY 1),
b AS (SELECT season, coalesce(sum(s) OVER w / nullif(sum(n) OVER w, 0), 0.5) AS rate FROM m WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT l_suppkey, l_linenumber, season, sum(target) AS s, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT l_suppkey, season, sum(s) AS s, sum(n) AS n FROM c GROUP BY ALL)
SELECT c.l_suppkey, c.l_linenumber, c.season, c.n, (CASE WHEN x.n IS NOT NULL THEN 2 WHEN y.n IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS level,
  round(coalesce(x.s / x.n, y.s / y.n, rate), 6) AS value
FROM c JOIN b USING (season) LEFT JOIN c x ON x.l_suppkey = c.l_suppkey AND x.l_linenumber = c.l_linenumber AND x.season = c.season - 1
LEFT JOIN e y ON y.l_suppkey = c.l_suppkey AND y.season = c.season - 1"""


def target_encoding(spark, d):
    e = states.target_encoding(facts(spark, d), ["l_suppkey", "l_linestatus"], "target")
    return rounded(e, "history_rate", "history_log_n", "last_rate", "last_log_n")


TARGET_SQL = f"""WITH {FACTS}, m AS (SELECT season, sum(target) AS s, count(*) AS n FROM f GROUP BY 1),
b AS (SELECT season, coalesce(sum(s) OVER w / nullif(sum(n) OVER w, 0), 0.5) AS h, sum(s) OVER v / nullif(sum(n) OVER v, 0) AS l FROM m
  WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (ORDER BY season RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)),
c AS (SELECT l_suppkey, l_linestatus, season, sum(target) AS s, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT l_suppkey, l_linestatus, season, coalesce(sum(s) OVER w, 0) AS hs, coalesce(sum(n) OVER w, 0) AS hn, coalesce(sum(s) OVER v, 0) AS ls, coalesce(sum(n) OVER v, 0) AS ln_ FROM c
  WINDOW w AS (PARTITION BY l_suppkey, l_linestatus ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY l_suppkey, l_linestatus ORDER BY season RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING))
SELECT l_suppkey, l_linestatus, season, round((hs + 100.0 * h) / (hn + 100.0), 6) AS history_rate, round(ln(1 + hn), 6) AS history_log_n,
  round((ls + 100.0 * coalesce(l, h)) / (ln_ + 100.0), 6) AS last_rate, round(ln(1 + ln_), 6) AS last_log_n FROM k JOIN b USING (season)"""


def yearly_effects(spark, d) -> DataFrame:
    rows = states.demeaned(facts(spark, d), "target", "residual")
    return rows.groupBy(*KEYS, "season").agg((F.sum("residual") / (F.count("*") + 50.0)).alias("effect"))


YEARLY_SQL = f"""{FACTS}, y AS (SELECT l_suppkey, l_linestatus, season, sum(residual) / (count(*) + 50.0) AS effect FROM
  (SELECT *, target - avg(target) OVER (PARTITION BY season) AS residual FROM f) GROUP BY ALL)"""


def sign_stable(spark, d):
    """Keys whose effects of all years have one sign: the mean, and the mean of the last two where those agree."""
    y = yearly_effects(spark, d).select(*KEYS, "season", F.round("effect", 9).alias("effect"))
    seasons = y.select("season").distinct().count()
    e = F.transform(F.array_sort(F.collect_list(F.struct("season", "effect"))), lambda s: s["effect"])
    g = y.groupBy(*KEYS).agg(e.alias("e"), F.count("*").alias("n"), F.min(F.signum("effect")).alias("lo"), F.max(F.signum("effect")).alias("hi"))
    last, before = F.element_at("e", -1), F.try_element_at("e", F.lit(-2))
    stable = (F.col("n") == seasons) & (F.col("lo") == F.col("hi")) & (F.col("lo") != 0)
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    return rounded(g.select(*KEYS, "n", F.when(stable, mean).alias("stable_all"), F.when(F.signum(last) * F.signum(before) > 0, (last + before) / 2).alias("stable_last_two")), "stable_all", "stable_last_two")


SIGN_SQL = f"""WITH {YEARLY_SQL}, r AS (SELECT l_suppkey, l_linestatus, season, round(effect, 9) AS effect, row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY season DESC) AS k FROM y)
SELECT l_suppkey, l_linestatus, count(*)::BIGINT AS n,
  round(CASE WHEN count(*) = (SELECT count(DISTINCT season) FROM y) AND min(sign(effect)) = max(sign(effect)) AND min(sign(effect)) <> 0 THEN avg(effect) END, 6) AS stable_all,
  round(CASE WHEN count(*) >= 2 AND max(CASE WHEN k = 1 THEN sign(effect) END) * max(CASE WHEN k = 2 THEN sign(effect) END) > 0 THEN (max(CASE WHEN k = 1 THEN effect END) + max(CASE WHEN k = 2 THEN effect END)) / 2 END, 6) AS stable_last_two
FROM r GROUP BY ALL"""


def source_policies(spark, d):
    """Ways to combine a key's yearly effects: equal over all years of the table, last, recency, median, trend."""
    y = yearly_effects(spark, d)
    span = y.agg(F.min("season").alias("first"), F.max("season").alias("latest")).first()
    years = span["latest"] - span["first"] + 1
    weight = F.pow(F.lit(0.5), F.lit(span["latest"]) - F.col("season"))
    g = y.groupBy(*KEYS).agg(
        (F.sum("effect") / years).alias("equal"), F.max_by("effect", "season").alias("last"),
        (F.sum(weight * F.col("effect")) / F.sum(weight)).alias("recency"), F.median("effect").alias("middle"),
        (F.regr_intercept("effect", F.col("season") - span["first"]) + F.regr_slope("effect", F.col("season") - span["first"]) * years).alias("trend"),
    )
    return rounded(g, "equal", "last", "recency", "middle", "trend")


POLICY_SQL = f"""WITH {YEARLY_SQL}, a AS (SELECT min(season) AS lo, max(season) AS hi FROM y)
SELECT l_suppkey, l_linestatus, round(sum(effect) / any_value(hi - lo + 1), 6) AS equal, round(arg_max(effect, season), 6) AS last,
  round(sum(0.5::DOUBLE ** (hi - season) * effect) / sum(0.5::DOUBLE ** (hi - season)), 6) AS recency, round(median(effect), 6) AS middle,
  round(regr_intercept(effect, season - lo) + regr_slope(effect, season - lo) * any_value(hi - lo + 1), 6) AS trend
FROM y, a GROUP BY 1, 2"""


def row_weights(spark, d):
    """Weights by year: season-equal with mean 1, season and class equal, and decay by age."""
    cells = facts(spark, d).groupBy("season", "target").agg(F.count("*").alias("m"))
    year, whole = Window.partitionBy("season"), Window.partitionBy(F.lit(1))  # a few rows
    n, in_year = F.sum("m").over(whole), F.sum("m").over(year)
    seasons = F.size(F.collect_set("season").over(whole))
    return rounded(cells.select(
        "season", "target", (n / (seasons * in_year)).alias("equal"), (n / (seasons * 2 * F.col("m"))).alias("class_equal"), F.pow(F.lit(0.8), F.max("season").over(whole) - F.col("season")).alias("decay")
    ), "equal", "class_equal", "decay")


WEIGHT_SQL = f"""WITH {FACTS}, c AS (SELECT season, target, count(*) AS m FROM f GROUP BY ALL), t AS (SELECT sum(m) AS n, count(DISTINCT season) AS s, max(season) AS hi FROM c)
SELECT season, target, round(n / (s * sum(m) OVER (PARTITION BY season)), 6) AS equal, round(n / (s * 2 * m), 6) AS class_equal, round(0.8::DOUBLE ** (hi - season), 6) AS decay FROM c, t"""

P = f"WITH {predictions_sql()} "
QUERIES = {
    "eb_prior_years": eb_prior_years, "eb_prediction_cells": prediction_cells, "regime_metrics": regime_metrics, "segment_metrics": segment_metrics,
    "calibration": calibration, "gap_decomposition": gap_decomposition, "candidate_selection": candidate_selection, "shrunk_rate_by_supplier": shrunk_rates,
    "eb_null_keys_clipped": null_keys_clipped, "eb_three_level": three_level, "eb_four_level": four_level, "eb_fallback_lookup": fallback_lookup,
    "target_encoding_temporal": target_encoding, "sign_stable_effects": sign_stable, "source_policies": source_policies, "row_weights": row_weights,
}
ORACLES = {
    "eb_prior_years": P + f"SELECT season, {METRICS_SQL} FROM predicted GROUP BY 1",
    "eb_prediction_cells": P + "SELECT season, l_suppkey, l_linestatus, count(*)::BIGINT AS n, round(max(p), 6) AS p FROM predicted GROUP BY ALL",
    "regime_metrics": P + f"SELECT season, l_linestatus, {METRICS_SQL} FROM predicted GROUP BY 1, 2",
    "segment_metrics": P + f"SELECT segment, {METRICS_SQL} FROM (SELECT *, unnest(['all', CASE WHEN l_linenumber <= 2 THEN 'head' ELSE 'tail' END, 'status_' || l_linestatus]) AS segment FROM predicted) GROUP BY 1",
    "calibration": P + CALIBRATION_SQL, "gap_decomposition": P + GAP_SQL, "candidate_selection": _selection_sql(), "shrunk_rate_by_supplier": SHRUNK_SQL,
    "eb_null_keys_clipped": NULL_SQL, "eb_three_level": THREE_SQL, "eb_four_level": FOUR_SQL, "eb_fallback_lookup": FALLBACK_SQL,
    "target_encoding_temporal": TARGET_SQL, "sign_stable_effects": SIGN_SQL, "source_policies": POLICY_SQL, "row_weights": WEIGHT_SQL,
}
