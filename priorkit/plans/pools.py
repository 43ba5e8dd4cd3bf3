"""Pools of stored predictions, attachments by key and position, choices on grids, and hidden states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import hidden, states
from ..sources.io import table
from .base import FACTS, facts, rounded
from .effects import prior_cells
from .lookups import MEANS, PRIOR

KEYS = ["season", "l_suppkey", "l_linestatus"]
STRENGTHS = {"k50": 50.0, "k200": 200.0, "k800": 800.0, "copy": 200.0}


def prediction_pool(spark, d) -> DataFrame:
    """(KEYS, n, hits, candidate, p): the predictions of all candidates, keyed rather than by position."""
    cells = prior_cells(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), (F.col("rate") + F.col("ps") / (F.col("pn") + k)).alias("p")) for c, k in STRENGTHS.items()]))
    return cells.select(*KEYS, "n", "hits", each.alias("c")).select(*KEYS, "n", "hits", "c.*")


POOL = f"""{MEANS}, cl AS (SELECT season, l_suppkey, l_linestatus, count(*) AS n, sum(target) AS hits, sum(residual) AS s FROM fr GROUP BY 1, 2, 3), ys AS (SELECT season, sum(hits) AS yh, sum(n) AS yn FROM cl GROUP BY 1),
rt AS (SELECT season, coalesce(sum(yh) OVER w / sum(yn) OVER w, 0.5) AS rate FROM ys WINDOW w AS ({PRIOR})),
pc AS (SELECT season, l_suppkey, l_linestatus, n, hits, coalesce(sum(s) OVER w, 0) AS ps, coalesce(sum(n) OVER w, 0) AS pn FROM cl WINDOW w AS (PARTITION BY l_suppkey, l_linestatus ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
pool AS ({' UNION ALL '.join(f"SELECT season, l_suppkey, l_linestatus, n, hits, '{c}' AS candidate, rate + ps / (pn + {k}) AS p FROM pc JOIN rt USING (season)" for c, k in STRENGTHS.items())})"""


def distinct_candidates(spark, d):
    """Candidates of one content under their first name: a digest over the yearly sums of predictions and squares, with those outside 0 and 1 told."""
    pool = prediction_pool(spark, d)
    y = pool.groupBy("candidate", "season").agg(F.round(F.sum(F.col("p") * F.col("n")), 4).cast("decimal(20,4)").alias("a"), F.round(F.sum(F.col("p") * F.col("p") * F.col("n")), 4).cast("decimal(20,4)").alias("b"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("wild"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("season", "a", "b"))), lambda s: F.concat_ws(":", s["season"].cast("string"), s["a"].cast("string"), s["b"].cast("string"))), ",")
    one = y.groupBy("candidate").agg(F.md5(text).alias("digest"), F.sum("wild").alias("wild"))  # a few years each
    return one.groupBy("digest").agg(F.min("candidate").alias("candidate"), F.count("*").alias("names"), F.sum("wild").alias("wild"))


DISTINCT_SQL = f"""WITH {POOL}, y AS (SELECT candidate, season, round(sum(p * n), 4)::DECIMAL(20, 4) AS a, round(sum(p * p * n), 4)::DECIMAL(20, 4) AS b, count(*) FILTER (p < 0 OR p > 1) AS wild FROM pool GROUP BY 1, 2),
o AS (SELECT candidate, md5(string_agg(season || ':' || a || ':' || b, ',' ORDER BY season)) AS digest, sum(wild)::BIGINT AS wild FROM y GROUP BY 1)
SELECT digest, min(candidate) AS candidate, count(*) AS names, sum(wild)::BIGINT AS wild FROM o GROUP BY 1"""


def recomposed_base(spark, d):
    """The stored candidates side by side again, composed as .5, .4 and .1 of three of them, and the composition's Brier score by year."""
    pool = prediction_pool(spark, d).where("candidate != 'copy'")
    wide = pool.groupBy(*KEYS).pivot("candidate", ["k200", "k50", "k800"]).agg(F.first("p")).join(prior_cells(spark, d).select(*KEYS, "n", "hits"), KEYS)
    p = X.clip(0.5 * F.col("k200") + 0.4 * F.col("k50") + 0.1 * F.col("k800"), 0.0, 1.0)
    return rounded(wide.groupBy("season").agg(F.sum("n").alias("n"), (F.sum(F.col("hits") * F.pow(1 - p, 2) + (F.col("n") - F.col("hits")) * F.pow(p, 2)) / F.sum("n")).alias("brier")), "brier")


_MIX = "least(greatest(0.5 * k200 + 0.4 * k50 + 0.1 * k800, 0), 1)"
RECOMPOSED_SQL = f"""WITH {POOL}, w AS (SELECT season, l_suppkey, l_linestatus, any_value(n) AS n, any_value(hits) AS hits, {', '.join(f"max(p) FILTER (candidate = '{k}') AS {k}" for k in ('k50', 'k200', 'k800'))} FROM pool GROUP BY 1, 2, 3)
SELECT season, sum(n)::BIGINT AS n, round(sum(hits * (1 - {_MIX}) ** 2 + (n - hits) * ({_MIX}) ** 2) / sum(n), 6) AS brier FROM w GROUP BY 1"""


def mapped_attach(spark, d):
    """Supplier and year joined with the log of the customers they are mapped to (by the largest earlier business): last year's orders of the mapped customer, missing where unmapped or silent."""
    li, o = table(spark, d, "lineitem", ["l_orderkey", "l_suppkey"]), table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("season", F.year("o_orderdate"))
    pair = j.groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("m"))
    mapping = pair.groupBy("l_suppkey").agg(F.max_by("o_custkey", F.struct("m", -F.col("o_custkey"))).alias("o_custkey"))
    log = o.groupBy("o_custkey", (F.year("o_orderdate") + 1).alias("season")).agg(F.count("*").alias("orders_before"))
    cells = j.groupBy("l_suppkey", "season").agg(F.count("*").alias("lines"))
    return cells.join(mapping, "l_suppkey", "left").join(log, ["o_custkey", "season"], "left").select("l_suppkey", "season", "lines", F.col("o_custkey").alias("mapped"), F.coalesce("orders_before", F.lit(0)).alias("orders_before"))


ATTACH_SQL = """WITH j AS (SELECT l_suppkey, o_custkey, year(o_orderdate)::INTEGER AS season FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT l_suppkey, o_custkey, count(*) AS m FROM j GROUP BY 1, 2),
mp AS (SELECT l_suppkey, first(o_custkey ORDER BY m DESC, o_custkey) AS mapped FROM p GROUP BY 1), lg AS (SELECT o_custkey AS mapped, (year(o_orderdate) + 1)::INTEGER AS season, count(*) AS orders_before FROM orders GROUP BY 1, 2)
SELECT l_suppkey, season, lines, mapped, coalesce(orders_before, 0) AS orders_before FROM (SELECT l_suppkey, season, count(*) AS lines FROM j GROUP BY 1, 2) LEFT JOIN mp USING (l_suppkey) LEFT JOIN lg USING (mapped, season)"""


def position_attach(spark, d):
    """A stored vector of a supplier's yearly predictions put back by position: its i-th number belongs to the i-th year."""
    cells = prior_cells(spark, d).groupBy("l_suppkey", "season").agg(F.sum("n").alias("n"), F.max("rate").alias("rate"), F.sum("ps").alias("ps"), F.sum("pn").alias("pn"))
    p = F.round(F.col("rate") + F.col("ps") / (F.col("pn") + 200.0), 6)
    stored = cells.groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("season", p.alias("p")))), lambda s: s["p"]).alias("vector"))  # a number for each year
    long = stored.select("l_suppkey", F.posexplode("vector").alias("pos", "p"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("season")) - 1
    return cells.select("l_suppkey", "season", "n", place.alias("pos")).join(long, ["l_suppkey", "pos"], "left").select("l_suppkey", "season", "n", "pos", "p")


POSITION_SQL = f"""WITH {POOL}, c AS (SELECT l_suppkey, season, sum(n)::BIGINT AS n, sum(ps) AS ps, sum(pn) AS pn, any_value(rate) AS rate FROM pc JOIN rt USING (season) GROUP BY 1, 2)
SELECT l_suppkey, season, n, (row_number() OVER (PARTITION BY l_suppkey ORDER BY season) - 1)::INTEGER AS pos, round(rate + ps / (pn + 200.0), 6) AS p FROM c"""

GRID = [(k, w) for k in (50.0, 200.0, 800.0) for w in (0.25, 0.5, 1.0)]


def nested_grid(spark, d):
    """Strength and weight of the correction chosen for each year by the mean Brier score of the years before it, refitted with all of them; the path of choices and this year's score."""
    c = prior_cells(spark, d)
    p = lambda k, w: X.clip(F.col("rate") + w * F.col("ps") / (F.col("pn") + k), 0.0, 1.0)
    loss = lambda x: F.round(F.sum(F.col("hits") * F.pow(1 - x, 2) + (F.col("n") - F.col("hits")) * F.pow(x, 2)) / F.sum("n"), 9)
    y = c.groupBy("season").agg(*[loss(p(k, w)).alias(f"g{i}") for i, (k, w) in enumerate(GRID)])  # a row for each year
    past = Window.orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    y = y.select("season", *[f"g{i}" for i in range(len(GRID))], F.array(*[F.struct(F.round(F.avg(f"g{i}").over(past), 9).alias("l"), F.lit(i).alias("i")) for i in range(len(GRID))]).alias("before"))
    best = F.when(F.col("before")[0]["l"].isNull(), 0).otherwise(F.array_min("before")["i"])
    y = y.withColumn("best", best)
    pick = lambda values: F.element_at(F.array(*values), F.col("best") + 1)
    return y.select("season", pick([F.lit(k) for k, _ in GRID]).alias("strength"), pick([F.lit(w) for _, w in GRID]).alias("weight"), F.round(pick([F.col(f"g{i}") for i in range(len(GRID))]), 6).alias("brier"))


def _grid_sql() -> str:
    p = lambda k, w: f"least(greatest(rate + {w} * ps / (pn + {k}), 0), 1)"
    losses = ", ".join(f"round(sum(hits * (1 - {p(k, w)}) ** 2 + (n - hits) * ({p(k, w)}) ** 2) / sum(n), 9) AS g{i}" for i, (k, w) in enumerate(GRID))
    structs = ", ".join(f"{{'l': round(avg(g{i}) OVER w, 9), 'i': {i}}}" for i in range(len(GRID)))
    return f"""WITH {POOL}, y AS (SELECT season, {losses} FROM pc JOIN rt USING (season) GROUP BY 1), b AS (SELECT *, CASE WHEN avg(g0) OVER w IS NULL THEN 0 ELSE list_min([{structs}]).i END AS best FROM y WINDOW w AS ({PRIOR}))
SELECT season, [{', '.join(f'{k}::DOUBLE' for k, _ in GRID)}][best + 1] AS strength, [{', '.join(f'{w}::DOUBLE' for _, w in GRID)}][best + 1] AS weight, round([{', '.join(f'g{i}' for i in range(len(GRID)))}][best + 1], 6) AS brier FROM b"""


def source_corrections(spark, d):
    """The correction of each line number's context looked up in each of the two years before on its own, then joined by policy: mean, last, and the one nearer to 0 if their signs agree."""
    f = states.demeaned(facts(spark, d), "target", "residual")
    e = f.groupBy("season", "l_suppkey", "l_linenumber").agg((F.sum("residual") / (F.count("*") + 30.0)).alias("e"))
    own = f.groupBy("season", "l_suppkey").agg((F.sum("residual") / (F.count("*") + 100.0)).alias("o"))
    rows = facts(spark, d).groupBy("season", "l_suppkey", "l_linenumber").agg(F.count("*").alias("lines"))
    for back in (1, 2):
        fine = e.select((F.col("season") + back).alias("season"), "l_suppkey", "l_linenumber", F.col("e").alias("fine"))
        coarse = own.select((F.col("season") + back).alias("season"), "l_suppkey", F.col("o").alias("coarse"))
        rows = rows.join(fine, ["season", "l_suppkey", "l_linenumber"], "left").join(coarse, ["season", "l_suppkey"], "left").withColumn(f"c{back}", F.coalesce("fine", "coarse", F.lit(0.0))).drop("fine", "coarse")
    agree = F.when(F.signum("c1") == F.signum("c2"), F.when(F.abs("c1") < F.abs("c2"), F.col("c1")).otherwise(F.col("c2"))).otherwise(0.0)
    return rounded(rows.select("season", "l_suppkey", "l_linenumber", "lines", ((F.col("c1") + F.col("c2")) / 2).alias("mean"), F.col("c1").alias("last"), agree.alias("guarded")), "mean", "last", "guarded")


CORRECTIONS_SQL = f"""WITH {MEANS}, e AS (SELECT season, l_suppkey, l_linenumber, sum(residual) / (count(*) + 30.0) AS e FROM fr GROUP BY 1, 2, 3), o AS (SELECT season, l_suppkey, sum(residual) / (count(*) + 100.0) AS o FROM fr GROUP BY 1, 2),
r AS (SELECT season, l_suppkey, l_linenumber, count(*) AS lines FROM f GROUP BY 1, 2, 3),
c AS (SELECT r.*, coalesce(e1.e, o1.o, 0) AS c1, coalesce(e2.e, o2.o, 0) AS c2 FROM r {' '.join(f"LEFT JOIN e e{b} ON e{b}.season = r.season - {b} AND e{b}.l_suppkey = r.l_suppkey AND e{b}.l_linenumber = r.l_linenumber LEFT JOIN o o{b} ON o{b}.season = r.season - {b} AND o{b}.l_suppkey = r.l_suppkey" for b in (1, 2))})
SELECT season, l_suppkey, l_linenumber, lines, round((c1 + c2) / 2, 6) AS mean, round(c1, 6) AS last, round(CASE WHEN sign(c1) = sign(c2) THEN CASE WHEN abs(c1) < abs(c2) THEN c1 ELSE c2 END ELSE 0 END, 6) AS guarded FROM c"""


def observed_quarters(spark, d) -> DataFrame:
    """(l_suppkey, observed): each supplier's quarters in order, 0 to 2 by the rate of returns."""
    q = facts(spark, d).groupBy("l_suppkey", (4 * F.col("season") + F.quarter("l_shipdate")).alias("quarter")).agg(F.avg("target").alias("rate"))
    level = F.when(F.col("rate") < 0.15, 0).when(F.col("rate") < 0.4, 1).otherwise(2)
    return q.groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("quarter", level.alias("o")))), lambda s: s["o"]).alias("observed"))


HIDDEN_START = ([0.5, 0.5], [[0.8, 0.2], [0.2, 0.8]], [[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])


def hidden_states(spark, d):
    """Two hidden states of the suppliers' quarters after five rounds over all sequences: parameters, and the log likelihood of each round; states ordered by how often they show the highest level."""
    start, move, show, told = hidden.fit(observed_quarters(spark, d), "observed", *HIDDEN_START, rounds=5)
    rows = [("start", i, 0, float(v)) for i, v in enumerate(start)] + [("move", i, j, float(v)) for i, r in enumerate(move) for j, v in enumerate(r)]
    rows += [("show", i, j, float(v)) for i, r in enumerate(show) for j, v in enumerate(r)] + [("log_likelihood", i, 0, v) for i, v in enumerate(told)]
    return rounded(spark.createDataFrame(rows, "kind string, i int, j int, value double"), "value")


QUERIES = {
    "distinct_candidates": distinct_candidates, "recomposed_base": recomposed_base, "mapped_attach": mapped_attach, "position_attach": position_attach, "nested_grid": nested_grid, "source_corrections": source_corrections, "hidden_states": hidden_states,
}
ORACLES = {
    "distinct_candidates": DISTINCT_SQL, "recomposed_base": RECOMPOSED_SQL, "mapped_attach": ATTACH_SQL, "position_attach": POSITION_SQL, "nested_grid": _grid_sql(), "source_corrections": CORRECTIONS_SQL,
}
