"""Models fitted on earlier years alone: closed forms and fixed numbers of rounds over aggregated cells, so that each has its SQL.

Fits whose size does not grow with the rows (a few sums for each year) are windows over
yearly sums; fits of a number for each entity are rounds of groupings over staged cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import states
from ..sources.io import Stage
from .base import FACTS, facts, rounded
from .effects import predictions, predictions_sql
from .lookups import MEANS, PRIOR, RATE
from .models import MATRIX, effect_matrix


def earlier() -> Window:
    """All years before, over a table of a row for each year."""
    return Window.orderBy("season").rangeBetween(Window.unboundedPreceding, -1)


def affine_calibration(spark, d):
    """A line from predictions to outcomes, fitted on the predictions of earlier years, slope within .5 and 1.5, shift within .05; and the Brier score with it."""
    p = predictions(spark, d)
    y = p.groupBy("season").agg(F.count("*").alias("n"), F.sum("p").alias("x"), F.sum("target").alias("y"), F.sum(F.col("p") * F.col("p")).alias("xx"), F.sum(F.col("p") * F.col("target")).alias("xy"))
    n, x, t, xx, xy = (F.sum(c).over(earlier()) for c in ("n", "x", "y", "xx", "xy"))
    det = xx - x * x / n
    slope = F.when(det > 1e-9, X.clip((xy - x * t / n) / det, 0.5, 1.5)).otherwise(1.0)
    line = y.select("season", slope.alias("slope"), n.alias("sn"), x.alias("sx"), t.alias("st")).withColumn("shift", F.coalesce(X.clip((F.col("st") - F.col("slope") * F.col("sx")) / F.col("sn"), -0.05, 0.05), F.lit(0.0)))
    j = p.join(F.broadcast(line), "season")
    loss = lambda c: F.avg(F.pow(c - F.col("target"), 2))
    out = j.groupBy("season").agg(F.first("slope").alias("slope"), F.first("shift").alias("shift"), loss(F.col("p")).alias("plain"), loss(X.clip(F.col("slope") * F.col("p") + F.col("shift"), 0.0, 1.0)).alias("calibrated"))
    return out.select("season", F.round("slope", 4).alias("slope"), F.round("shift", 4).alias("shift"), F.round("plain", 6).alias("plain"), F.round("calibrated", 6).alias("calibrated"))


AFFINE_SQL = f"""WITH {predictions_sql()}, y AS (SELECT season, count(*) AS n, sum(p) AS x, sum(target) AS y, sum(p * p) AS xx, sum(p * target) AS xy FROM predicted GROUP BY 1),
s AS (SELECT season, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM y WINDOW w AS ({PRIOR})),
a AS (SELECT *, CASE WHEN xx - x * x / n > 1e-9 THEN least(greatest((xy - x * y / n) / (xx - x * x / n), 0.5), 1.5) ELSE 1.0 END AS slope FROM s),
b AS (SELECT season, slope, CASE WHEN n IS NULL THEN 0.0 ELSE least(greatest((y - slope * x) / n, -0.05), 0.05) END AS shift FROM a)
SELECT season, round(any_value(slope), 4) AS slope, round(any_value(shift), 4) AS shift, round(avg((p - target) ** 2), 6) AS plain, round(avg((least(greatest(slope * p + shift, 0), 1) - target) ** 2), 6) AS calibrated FROM predicted JOIN b USING (season) GROUP BY 1"""


def prior_ridge(spark, d):
    """A ridge of the residuals on discount and tax, each less its year's mean, fitted on earlier years (two unknowns, in closed form), and the loss with it."""
    f = states.demeaned(states.demeaned(states.demeaned(facts(spark, d, "l_discount", "l_tax"), "target", "r"), "l_discount", "a"), "l_tax", "b")
    a, b, r = F.col("a"), F.col("b"), F.col("r")
    y = f.groupBy("season").agg(F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"), F.sum(a * r).alias("ar"), F.sum(b * r).alias("br"))
    aa, bb, ab, ar, br = (F.coalesce(F.sum(c).over(earlier()), F.lit(0.0)) for c in ("aa", "bb", "ab", "ar", "br"))
    aa, bb = aa + 1.0, bb + 1.0
    det = aa * bb - ab * ab
    w = y.select("season", ((bb * ar - ab * br) / det).alias("wa"), ((aa * br - ab * ar) / det).alias("wb"))
    j = f.join(F.broadcast(w), "season")
    out = j.groupBy("season").agg(F.first("wa").alias("wa"), F.first("wb").alias("wb"), F.avg(r * r).alias("plain"), F.avg(F.pow(r - F.col("wa") * a - F.col("wb") * b, 2)).alias("fitted"))
    return out.select("season", F.round("wa", 4).alias("wa"), F.round("wb", 4).alias("wb"), F.round("plain", 6).alias("plain"), F.round("fitted", 6).alias("fitted"))


RIDGE_SQL = f"""WITH {FACTS}, g AS (SELECT season, target - avg(target) OVER w AS r, l_discount - avg(l_discount) OVER w AS a, l_tax - avg(l_tax) OVER w AS b FROM f WINDOW w AS (PARTITION BY season)),
y AS (SELECT season, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * r) AS ar, sum(b * r) AS br FROM g GROUP BY 1),
s AS (SELECT season, coalesce(sum(aa) OVER w, 0) + 1.0 AS aa, coalesce(sum(bb) OVER w, 0) + 1.0 AS bb, coalesce(sum(ab) OVER w, 0) AS ab, coalesce(sum(ar) OVER w, 0) AS ar, coalesce(sum(br) OVER w, 0) AS br FROM y WINDOW w AS ({PRIOR})),
c AS (SELECT season, (bb * ar - ab * br) / (aa * bb - ab * ab) AS wa, (aa * br - ab * ar) / (aa * bb - ab * ab) AS wb FROM s)
SELECT season, round(any_value(wa), 4) AS wa, round(any_value(wb), 4) AS wb, round(avg(r * r), 6) AS plain, round(avg((r - wa * a - wb * b) ** 2), 6) AS fitted FROM g JOIN c USING (season) GROUP BY 1"""


def cross_fitted_encoding(spark, d):
    """Target means of parts from the other four fifths of the orders only, shrunk to the overall rate, and how well they rank: mean by outcome and fold."""
    f = facts(spark, d, "l_partkey", "l_orderkey").withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))
    cell = f.groupBy("l_partkey", "fold").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    whole = cell.groupBy("l_partkey").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rate = f.agg(F.avg("target").alias("rate"))  # one row
    code = cell.join(whole, "l_partkey").crossJoin(F.broadcast(rate)).select("l_partkey", "fold", ((F.col("ts") - F.col("s") + 10.0 * F.col("rate")) / (F.col("tn") - F.col("n") + 10.0)).alias("code"))
    out = f.join(code, ["l_partkey", "fold"]).groupBy("fold", "target").agg(F.count("*").alias("n"), F.avg("code").alias("code"), F.avg(F.pow(F.col("code") - F.col("target"), 2)).alias("brier"))
    return rounded(out, "code", "brier")


CROSS_SQL = f"""WITH {FACTS}, g AS (SELECT *, (l_orderkey % 5)::INTEGER AS fold FROM f), c AS (SELECT l_partkey, fold, sum(target) AS s, count(*) AS n FROM g GROUP BY 1, 2),
e AS (SELECT l_partkey, fold, (sum(s) OVER p - s + 10.0 * (SELECT avg(target) FROM f)) / (sum(n) OVER p - n + 10.0) AS code FROM c WINDOW p AS (PARTITION BY l_partkey))
SELECT fold, target, count(*) AS n, round(avg(code), 6) AS code, round(avg((code - target) ** 2), 6) AS brier FROM g JOIN e USING (l_partkey, fold) GROUP BY 1, 2"""

NEWTON = 4


def offset_effects(spark, d):
    """Effects on the logit of each supplier and status beside the prior rate as an offset: NEWTON steps of penalised likelihood, over counts of cells."""
    f = facts(spark, d)
    rate = states.prior_rate(f, F.col("target"))
    cells = f.groupBy("l_suppkey", "l_linestatus", "season").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    cells = cells.join(F.broadcast(rate), "season").withColumn("offset", X.logit(F.col("rate"), 1e-3))
    held = cells.groupBy("l_suppkey", "l_linestatus").agg(F.collect_list(F.struct("s", "n", "offset")).alias("years"), F.sum("n").alias("n"))  # a few years each
    effect: Column = F.lit(0.0)
    for _ in range(NEWTON):
        held = held.withColumn("effect", effect)
        p = lambda y: X.expit(y["offset"] + F.col("effect"))
        score = F.aggregate("years", F.lit(0.0), lambda a, y: a + y["s"] - y["n"] * p(y)) - 20.0 * F.col("effect")
        curve = F.aggregate("years", F.lit(0.0), lambda a, y: a + y["n"] * p(y) * (1 - p(y))) + 20.0
        effect = F.col("effect") + score / curve
    return rounded(held.select("l_suppkey", "l_linestatus", "n", effect.alias("effect")), "effect")


def _offset_sql() -> str:
    parts = [f"""{RATE}, o AS (SELECT l_suppkey, l_linestatus, season, sum(target) AS s, count(*) AS n, any_value(ln(least(greatest(rate, 1e-3), 1 - 1e-3) / (1 - least(greatest(rate, 1e-3), 1 - 1e-3)))) AS q FROM f JOIN rate USING (season) GROUP BY 1, 2, 3),
e0 AS (SELECT DISTINCT l_suppkey, l_linestatus, 0.0::DOUBLE AS e FROM o)"""]
    for i in range(NEWTON):
        parts.append(f"""e{i + 1} AS (SELECT l_suppkey, l_linestatus, any_value(e) + (sum(s - n / (1 + exp(-(q + e)))) - 20.0 * any_value(e)) / (sum(n / (1 + exp(-(q + e))) * (1 - 1 / (1 + exp(-(q + e))))) + 20.0) AS e FROM o JOIN e{i} USING (l_suppkey, l_linestatus) GROUP BY 1, 2)""")
    return f"WITH {', '.join(parts)} SELECT l_suppkey, l_linestatus, (SELECT sum(n)::BIGINT FROM o WHERE o.l_suppkey = e{NEWTON}.l_suppkey AND o.l_linestatus = e{NEWTON}.l_linestatus) AS n, round(e, 6) AS effect FROM e{NEWTON}"


ROUNDS = 3


def weighted_factors(spark, d):
    """One factor of suppliers and contexts fitted to their mean residuals, each cell weighted by its lines: ROUNDS exact solves for either side in turn, with a ridge."""
    cells = effect_matrix(spark, d).select("l_suppkey", "context", (F.col("s") / F.col("n")).alias("m"), "n").persist()  # read in each round
    b = cells.select("context").distinct().withColumn("v", 1.0 + F.col("context") / 10.0)  # 14 contexts
    for _ in range(ROUNDS):
        a = cells.join(F.broadcast(b), "context").groupBy("l_suppkey").agg((F.sum(F.col("n") * F.col("m") * F.col("v")) / (F.sum(F.col("n") * F.col("v") * F.col("v")) + 25.0)).alias("u"))
        b = cells.join(a, "l_suppkey").groupBy("context").agg((F.sum(F.col("n") * F.col("m") * F.col("u")) / (F.sum(F.col("n") * F.col("u") * F.col("u")) + 0.01)).alias("v"))
    out = cells.join(a, "l_suppkey").join(F.broadcast(b), "context")
    loss = F.sum(F.col("n") * F.pow(F.col("m") - F.col("u") * F.col("v"), 2))
    return rounded(out.groupBy("context").agg(F.first("v").alias("factor"), F.sum("n").alias("n"), loss.alias("loss"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("before")), "factor", "loss", "before")


def _factors_sql() -> str:
    parts = [f"{MATRIX}, c AS (SELECT l_suppkey, context, s / n AS m, n FROM e), b0 AS (SELECT DISTINCT context, 1.0 + context / 10.0 AS v FROM c)"]
    for i in range(ROUNDS):
        parts.append(f"a{i} AS (SELECT l_suppkey, sum(n * m * v) / (sum(n * v * v) + 25.0) AS u FROM c JOIN b{i} USING (context) GROUP BY 1)")
        parts.append(f"b{i + 1} AS (SELECT context, sum(n * m * u) / (sum(n * u * u) + 0.01) AS v FROM c JOIN a{i} USING (l_suppkey) GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT context, round(any_value(v), 6) AS factor, sum(n)::BIGINT AS n, round(sum(n * (m - u * v) ** 2), 6) AS loss, round(sum(n * m * m), 6) AS before FROM c JOIN a{ROUNDS - 1} USING (l_suppkey) JOIN b{ROUNDS} USING (context) GROUP BY 1"


def pair_factors(spark, d):
    """The leading factors of the sparse matrix of suppliers and parts after ROUNDS power steps, and the product looked up for pairs, 0 where a side is unseen: by supplier, and its singular value."""
    f = states.demeaned(facts(spark, d, "l_partkey"), "target", "r")
    cells = f.groupBy("l_suppkey", "l_partkey").agg((F.sum("r") / (F.count("*") + 2.0)).alias("m")).persist()  # read in each round
    v = cells.select("l_partkey").distinct().withColumn("v", 1.0 + F.col("l_partkey") % 3)
    for _ in range(ROUNDS):  # lengths are set at the end: rounds are few
        u = cells.join(v, "l_partkey").groupBy("l_suppkey").agg(F.sum(F.col("m") * F.col("v")).alias("u")).persist()
        v = cells.join(u, "l_suppkey").groupBy("l_partkey").agg(F.sum(F.col("m") * F.col("u")).alias("v")).persist()
    length = lambda df, c, name: df.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(name))  # noqa: E731  one row
    one = length(u, "u", "lu").crossJoin(length(v, "v", "lv"))
    u = u.crossJoin(F.broadcast(one)).select("l_suppkey", (F.col("u") / F.col("lu")).alias("u"), (F.col("lv") / F.col("lu")).alias("sigma"))
    v = v.crossJoin(F.broadcast(one)).select("l_partkey", (F.col("v") / F.col("lu")).alias("v"))
    product = cells.join(u, "l_suppkey", "left").join(v, "l_partkey", "left").withColumn("fit", F.coalesce(F.col("u") * F.col("v"), F.lit(0.0)))
    out = product.groupBy("l_suppkey").agg(F.abs(F.first("u")).alias("left"), F.sum(F.pow(F.col("m") - F.col("fit"), 2)).alias("rest"), F.count("*").alias("cells"), F.first("sigma").alias("sigma"))
    return rounded(out, "left", "rest", "sigma")


def _pair_sql() -> str:
    parts = [f"{MEANS}, c AS (SELECT l_suppkey, l_partkey, sum(residual) / (count(*) + 2.0) AS m FROM fr GROUP BY 1, 2), v0 AS (SELECT DISTINCT l_partkey, 1.0 + l_partkey % 3 AS v FROM c)"]
    for i in range(ROUNDS):
        parts.append(f"x{i} AS (SELECT l_suppkey, sum(m * v) AS u FROM c JOIN v{i} USING (l_partkey) GROUP BY 1), u{i} AS (SELECT l_suppkey, u / (SELECT sqrt(sum(u * u)) FROM x{i}) AS u FROM x{i})")
        parts.append(f"v{i + 1} AS (SELECT l_partkey, sum(m * u) AS v FROM c JOIN u{i} USING (l_suppkey) GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT l_suppkey, round(abs(any_value(u)), 6) AS left, round(sum((m - u * v) ** 2), 6) AS rest, count(*) AS cells, round((SELECT sqrt(sum(v * v)) FROM v{ROUNDS}), 6) AS sigma FROM c JOIN u{ROUNDS - 1} USING (l_suppkey) JOIN v{ROUNDS} USING (l_partkey) GROUP BY 1"


def source_similarity(spark, d):
    """Experts of earlier years weighted by how alike the line's context was in them: P(year | number, status) over earlier years times that year's rate there."""
    f = facts(spark, d)
    c = f.groupBy("season", "l_linenumber", "l_linestatus").agg(F.count("*").alias("n"), F.sum("target").alias("s"))  # 14 cells a year
    y = c.groupBy("season").agg(F.sum("n").alias("total"))
    c = c.join(F.broadcast(y), "season").select("season", "l_linenumber", "l_linestatus", (F.col("n") / F.col("total")).alias("like"), (F.col("s") / F.col("n")).alias("rate"), "n", "s")
    pair = c.alias("x").join(c.alias("e"), ["l_linenumber", "l_linestatus"]).where(F.col("e.season") < F.col("x.season"))
    gate = pair.groupBy(F.col("x.season").alias("season"), "l_linenumber", "l_linestatus").agg(
        (F.sum(F.col("e.like") * F.col("e.rate")) / F.sum("e.like")).alias("p"), F.max("e.like").alias("top"), F.first("x.n").alias("n"), F.first("x.s").alias("s"),
    )
    brier = (F.col("s") * F.pow(1 - F.col("p"), 2) + (F.col("n") - F.col("s")) * F.pow(F.col("p"), 2)) / F.col("n")
    return rounded(gate.select("season", "l_linenumber", "l_linestatus", "n", "p", "top", brier.alias("brier")), "p", "top", "brier")


SIMILARITY_SQL = f"""WITH {FACTS}, c AS (SELECT season, l_linenumber, l_linestatus, count(*) AS n, sum(target) AS s, count(*) / sum(count(*)) OVER (PARTITION BY season) AS likely FROM f GROUP BY 1, 2, 3),
g AS (SELECT x.season, l_linenumber, l_linestatus, sum(e.likely * e.s / e.n) / sum(e.likely) AS p, max(e.likely) AS top, any_value(x.n) AS n, any_value(x.s) AS s FROM c x JOIN c e USING (l_linenumber, l_linestatus) WHERE e.season < x.season GROUP BY 1, 2, 3)
SELECT season, l_linenumber, l_linestatus, n, round(p, 6) AS p, round(top, 6) AS top, round((s * (1 - p) ** 2 + (n - s) * p ** 2) / n, 6) AS brier FROM g"""

BLENDS = (0.0, 0.25, 0.5, 0.75, 1.0)


def expert_mixture(spark, d):
    """A rate for each status of line from earlier years, mixed by the supplier's earlier shares of them, then blended with the base by the weight that was best on the years before."""
    f = facts(spark, d)
    kinds = ["F", "O"]
    rate = states.prior_rate(f, F.col("target"))
    # a year in which a status does not occur still asks for its expert
    every = f.select("season").distinct()
    total = f.groupBy("season", "l_linestatus").agg(F.sum("target").alias("s"), F.count("*").alias("n"))
    grid = every.alias("y").join(total.alias("t"), F.col("t.season") < F.col("y.season"), "left").groupBy(F.col("y.season").alias("season")).agg(
        *[F.coalesce(F.sum(F.when(F.col("l_linestatus") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in kinds for c in "sn"]
    ).join(rate, "season")  # a row for each year
    share = f.groupBy("l_suppkey", "season").agg(F.count("*").alias("n"), F.sum("target").alias("s"), *[F.count_if(F.col("l_linestatus") == k).alias(f"c{k}") for k in kinds])
    w = Window.partitionBy("l_suppkey").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    share = share.withColumns({f"h{k}": F.coalesce(F.sum(f"c{k}").over(w), F.lit(0)) for k in kinds}).join(F.broadcast(grid.withColumnsRenamed({x: f"g_{x}" for x in ("sF", "nF", "sO", "nO")})), "season")
    expert = lambda k: (F.col(f"g_s{k}") + 50.0 * F.col("rate")) / (F.col(f"g_n{k}") + 50.0)
    part = lambda k: (F.col(f"h{k}") + 10.0) / (F.col("hF") + F.col("hO") + 20.0)
    share = share.withColumn("mix", part("F") * expert("F") + part("O") * expert("O"))
    loss = lambda p: F.sum(F.col("s") * F.pow(1 - p, 2) + (F.col("n") - F.col("s")) * F.pow(p, 2))
    y = share.groupBy("season").agg(F.sum("n").alias("n"), *[loss((1 - b) * F.col("rate") + b * F.col("mix")).alias(f"l{i}") for i, b in enumerate(BLENDS)])
    past = y.select("season", "n", *[f"l{i}" for i in range(len(BLENDS))], *[F.sum(f"l{i}").over(earlier()).alias(f"p{i}") for i in range(len(BLENDS))])
    best = F.array_min(F.array(*[F.struct(F.coalesce(F.round(F.col(f"p{i}"), 6), F.lit(0.0)).alias("l"), F.lit(i).alias("i")) for i in range(len(BLENDS))]))["i"]
    chosen = F.element_at(F.array(*[F.col(f"l{i}") for i in range(len(BLENDS))]), best + 1) / F.col("n")
    weight = F.element_at(F.array(*map(F.lit, BLENDS)), best + 1)
    return rounded(past.select("season", "n", weight.alias("weight"), (F.col("l0") / F.col("n")).alias("base"), chosen.alias("brier")), "base", "brier")


MIXTURE_SQL = f"""WITH {RATE}, t AS (SELECT season, l_linestatus, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2),
g AS (SELECT r.season, any_value(r.rate) AS rate, {', '.join(f"coalesce(sum({c}) FILTER (l_linestatus = '{k}'), 0) AS {c}{k}" for k in 'FO' for c in 'sn')} FROM rate r LEFT JOIN t ON t.season < r.season GROUP BY 1),
c AS (SELECT l_suppkey, season, count(*) AS n, sum(target) AS s, count(*) FILTER (l_linestatus = 'F') AS cf, count(*) FILTER (l_linestatus = 'O') AS co FROM f GROUP BY 1, 2),
h AS (SELECT *, coalesce(sum(cf) OVER w, 0) AS hf, coalesce(sum(co) OVER w, 0) AS ho FROM c WINDOW w AS (PARTITION BY l_suppkey {PRIOR})),
m AS (SELECT h.season, h.n, h.s, rate, (hf + 10.0) / (hf + ho + 20.0) * ((sF + 50.0 * rate) / (nF + 50.0)) + (ho + 10.0) / (hf + ho + 20.0) * ((sO + 50.0 * rate) / (nO + 50.0)) AS mix FROM h JOIN g USING (season)),
yl AS (SELECT season, sum(n) AS n, {', '.join(f"sum(s * (1 - ({1 - b} * rate + {b} * mix)) ** 2 + (n - s) * ({1 - b} * rate + {b} * mix) ** 2) AS l{i}" for i, b in enumerate(BLENDS))} FROM m GROUP BY 1),
p AS (SELECT *, list_min([{', '.join(f"{{'l': coalesce(round(sum(l{i}) OVER w, 6), 0.0), 'i': {i}}}" for i in range(len(BLENDS)))}]).i AS best FROM yl WINDOW w AS ({PRIOR}))
SELECT season, n::BIGINT AS n, [{', '.join(f'{b}::DOUBLE' for b in BLENDS)}][best + 1] AS weight, round(l0 / n, 6) AS base, round([{', '.join(f'l{i}' for i in range(len(BLENDS)))}][best + 1] / n, 6) AS brier FROM p"""


def minimax_weights(spark, d):
    """The weight of the correction, in tenths, that loses least in the worst of the earlier years, relative to that year's base; and this year's loss with it."""
    p = predictions(spark, d)
    c, r = F.col("p") - F.col("base"), F.col("target") - F.col("base")
    y = p.groupBy("season").agg(F.count("*").alias("n"), F.sum(c * c).alias("cc"), F.sum(c * r).alias("cr"), F.sum(r * r).alias("rr"))  # a row for each year
    grid = y.withColumn("w", F.explode(F.array(*[F.lit(i / 10) for i in range(11)]))).withColumn("gain", F.round((F.col("w") * F.col("w") * F.col("cc") - 2 * F.col("w") * F.col("cr")) / F.col("n"), 9))
    past = grid.alias("a").join(grid.alias("b"), (F.col("b.season") < F.col("a.season")) & (F.col("a.w") == F.col("b.w")), "left")
    worst = past.groupBy(F.col("a.season").alias("season"), F.col("a.w").alias("w")).agg(F.coalesce(F.max("b.gain"), F.lit(0.0)).alias("worst"), F.first("a.gain").alias("gain"))
    out = worst.groupBy("season").agg(F.min(F.struct("worst", "w", "gain")).alias("m")).select("season", F.col("m.w").alias("weight"), F.col("m.worst").alias("worst"), F.col("m.gain").alias("gain"))
    return out.withColumns({k: F.round(k, 8) for k in ("worst", "gain")})


MINIMAX_SQL = f"""WITH {predictions_sql()}, y AS (SELECT season, count(*) AS n, sum((p - base) ** 2) AS cc, sum((p - base) * (target - base)) AS cr FROM predicted GROUP BY 1),
g AS (SELECT season, w / 10.0::DOUBLE AS w, round((w / 10.0 * (w / 10.0) * cc - 2 * (w / 10.0) * cr) / n, 9) AS gain FROM y, (SELECT unnest(range(0, 11)) AS w)),
h AS (SELECT a.season, a.w, coalesce(max(b.gain), 0) AS worst, any_value(a.gain) AS gain FROM g a LEFT JOIN g b ON b.season < a.season AND a.w = b.w GROUP BY 1, 2),
m AS (SELECT season, min({{'a': worst, 'b': w, 'c': gain}}) AS m FROM h GROUP BY 1) SELECT season, m.b AS weight, round(m.a, 8) AS worst, round(m.c, 8) AS gain FROM m"""


def yearly_slopes(spark, d):
    """One residual slope on the discount for each year; later years take the mean of the earlier slopes, that of those whose signs agree, and one fitted on open lines for open lines alone."""
    f = states.demeaned(states.demeaned(facts(spark, d, "l_discount"), "target", "r"), "l_discount", "x")
    x, r, is_open = F.col("x"), F.col("r"), F.col("l_linestatus") == "O"
    slope = lambda on: F.sum(F.when(on, x * r)) / (F.coalesce(F.sum(F.when(on, x * x)), F.lit(0.0)) + 1.0)
    y = f.groupBy("season").agg(slope(F.lit(True)).alias("own"), F.coalesce(slope(is_open), F.lit(0.0)).alias("own_open"))
    n, pos = F.count("*").over(earlier()), F.sum((F.col("own") > 0).cast("int")).over(earlier())
    bag = F.coalesce(F.avg("own").over(earlier()), F.lit(0.0))
    s = y.select("season", "own", bag.alias("bagged"), F.when((pos == n) | (pos == 0), bag).otherwise(0.0).alias("agreed"), F.coalesce(F.avg("own_open").over(earlier()), F.lit(0.0)).alias("open_only"))
    j = f.join(F.broadcast(s), "season")
    loss = lambda b: F.avg(F.pow(r - b * x, 2))
    out = j.groupBy("season").agg(F.first("own").alias("own"), F.first("bagged").alias("slope"), loss(F.col("bagged")).alias("bagged"), loss(F.col("agreed")).alias("agreed"), loss(F.when(is_open, F.col("open_only")).otherwise(0.0)).alias("open_only"))
    return out.select("season", F.round("own", 4).alias("own"), F.round("slope", 4).alias("slope"), *[F.round(c, 6).alias(c) for c in ("bagged", "agreed", "open_only")])


SLOPES_SQL = f"""WITH {FACTS}, g AS (SELECT season, l_linestatus, target - avg(target) OVER w AS r, l_discount - avg(l_discount) OVER w AS x FROM f WINDOW w AS (PARTITION BY season)),
y AS (SELECT season, sum(x * r) / (sum(x * x) + 1.0) AS own, coalesce(sum(x * r) FILTER (l_linestatus = 'O') / (sum(x * x) FILTER (l_linestatus = 'O') + 1.0), 0) AS own_open FROM g GROUP BY 1),
s AS (SELECT season, own, coalesce(avg(own) OVER w, 0) AS bagged, CASE WHEN count(*) FILTER (own > 0) OVER w IN (0, count(*) OVER w) THEN coalesce(avg(own) OVER w, 0) ELSE 0 END AS agreed, coalesce(avg(own_open) OVER w, 0) AS open_only FROM y WINDOW w AS ({PRIOR}))
SELECT season, round(any_value(own), 4) AS own, round(any_value(s.bagged), 4) AS slope, round(avg((r - s.bagged * x) ** 2), 6) AS bagged, round(avg((r - s.agreed * x) ** 2), 6) AS agreed, round(avg((r - CASE WHEN l_linestatus = 'O' THEN s.open_only ELSE 0 END * x) ** 2), 6) AS open_only FROM g JOIN s USING (season) GROUP BY 1"""


def two_experts(spark, d):
    """Two slopes of the residual on the price, fitted on the earlier lines of well-seen and of little-seen suppliers, each applied to its own kind."""
    f = states.demeaned(facts(spark, d, "l_extendedprice"), "target", "r").withColumn("price", F.log("l_extendedprice"))
    f = states.demeaned(f, "price", "x")
    seen = states.prior_sums(f, ["l_suppkey"], F.lit(1)).select("l_suppkey", "season", (F.col("n") >= 200).alias("known"))
    f = f.join(seen, ["l_suppkey", "season"])
    w = Window.partitionBy("known").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    y = f.groupBy("known", "season").agg(F.sum(F.col("x") * F.col("r")).alias("xr"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    s = y.select("known", "season", (F.coalesce(F.sum("xr").over(w), F.lit(0.0)) / (F.coalesce(F.sum("xx").over(w), F.lit(0.0)) + 10.0)).alias("slope"))
    out = f.join(F.broadcast(s), ["known", "season"]).groupBy("season", "known").agg(F.count("*").alias("n"), F.first("slope").alias("slope"), F.avg(F.pow(F.col("r") - F.col("slope") * F.col("x"), 2)).alias("loss"))
    return rounded(out, "slope", "loss")


EXPERTS_SQL = f"""WITH {FACTS}, g AS (SELECT l_suppkey, season, target - avg(target) OVER w AS r, ln(l_extendedprice) - avg(ln(l_extendedprice)) OVER w AS x FROM f WINDOW w AS (PARTITION BY season)),
c AS (SELECT l_suppkey, season, count(*) AS n FROM f GROUP BY 1, 2), k AS (SELECT l_suppkey, season, coalesce(sum(n) OVER (PARTITION BY l_suppkey {PRIOR}), 0) >= 200 AS known FROM c),
j AS (SELECT g.*, known FROM g JOIN k USING (l_suppkey, season)), y AS (SELECT known, season, sum(x * r) AS xr, sum(x * x) AS xx FROM j GROUP BY 1, 2),
s AS (SELECT known, season, coalesce(sum(xr) OVER w, 0) / (coalesce(sum(xx) OVER w, 0) + 10.0) AS slope FROM y WINDOW w AS (PARTITION BY known {PRIOR}))
SELECT season, known, count(*) AS n, round(any_value(slope), 6) AS slope, round(avg((r - slope * x) ** 2), 6) AS loss FROM j JOIN s USING (known, season) GROUP BY 1, 2"""


def robust_groups(spark, d):
    """Weights of the years for a residual slope that is refitted four times, each time with more weight on the years it fits worst, no year above three times another."""
    f = states.demeaned(states.demeaned(facts(spark, d, "l_discount", "l_tax"), "target", "r"), "l_discount", "x")
    y = f.groupBy("season").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("r")).alias("xr"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("r") * F.col("r")).alias("rr")).withColumn("w", F.lit(1.0))
    everything = Window.partitionBy()  # a row for each year
    for _ in range(4):
        y = y.withColumn("slope", F.sum(F.col("w") * F.col("xr") / F.col("n")).over(everything) / (F.sum(F.col("w") * F.col("xx") / F.col("n")).over(everything) + 1e-4))
        y = y.withColumn("loss", (F.col("rr") - 2 * F.col("slope") * F.col("xr") + F.col("slope") * F.col("slope") * F.col("xx")) / F.col("n"))
        y = y.withColumn("raw", F.col("w") * F.exp(20.0 * (F.col("loss") - F.avg("loss").over(everything))))
        y = y.withColumn("raw", F.least(F.col("raw"), 3.0 * F.min("raw").over(everything)))
        y = y.withColumn("w", F.col("raw") / F.avg("raw").over(everything))
    return rounded(y.select("season", F.col("w").alias("weight"), "loss", "slope"), "weight", "loss", "slope")


def _robust_sql() -> str:
    parts = [f"""{FACTS}, g AS (SELECT season, target - avg(target) OVER w AS r, l_discount - avg(l_discount) OVER w AS x FROM f WINDOW w AS (PARTITION BY season)),
y0 AS (SELECT season, count(*) AS n, sum(x * r) AS xr, sum(x * x) AS xx, sum(r * r) AS rr, 1.0::DOUBLE AS w, 0.0::DOUBLE AS loss, 0.0::DOUBLE AS slope FROM g GROUP BY 1)"""]
    for i in range(4):
        parts.append(f"a{i} AS (SELECT * REPLACE (sum(w * xr / n) OVER () / (sum(w * xx / n) OVER () + 1e-4) AS slope) FROM y{i}), b{i} AS (SELECT * REPLACE ((rr - 2 * slope * xr + slope * slope * xx) / n AS loss) FROM a{i})")
        parts.append(f"c{i} AS (SELECT * REPLACE (w * exp(20.0 * (loss - avg(loss) OVER ())) AS w) FROM b{i}), d{i} AS (SELECT * REPLACE (least(w, 3.0 * min(w) OVER ()) AS w) FROM c{i}), y{i + 1} AS (SELECT * REPLACE (w / avg(w) OVER () AS w) FROM d{i})")
    return f"WITH {', '.join(parts)} SELECT season, round(w, 6) AS weight, round(loss, 6) AS loss, round(slope, 6) AS slope FROM y4"


STAGES = ("l_linenumber", "discount", "quantity")


def staged_effects(spark, d):
    """Effects of bins added one feature after the other, each on what is left of the years before; each year takes as many of them as did best on the year before."""
    f = facts(spark, d, "l_discount", "l_quantity")
    f = f.withColumns({"discount": F.floor(F.col("l_discount") * 100 + 0.5).cast("int"), "quantity": F.floor(F.col("l_quantity") / 10).cast("int")})
    stage = Stage(spark)  # the result reads it
    cells = stage(f.groupBy("season", *STAGES).agg(F.count("*").alias("n"), F.sum("target").alias("hits")))  # few bins a year
    mean = cells.groupBy("season").agg((F.sum("hits") / F.sum("n")).alias("m"))
    f = cells.join(F.broadcast(mean), "season").withColumn("p0", F.col("m"))
    for i, k in enumerate(STAGES):
        own = f.groupBy("season", k).agg(F.sum(F.col("hits") - F.col("n") * F.col(f"p{i}")).alias("s"), F.sum("n").alias("n"))
        w = Window.partitionBy(k).orderBy("season").rangeBetween(-3, -1)
        e = own.select("season", k, (0.5 * F.coalesce(F.sum("s").over(w), F.lit(0.0)) / (F.coalesce(F.sum("n").over(w), F.lit(0)) + 100.0)).alias("e"))
        f = f.join(F.broadcast(e), ["season", k]).withColumn(f"p{i + 1}", F.col(f"p{i}") + F.col("e")).drop("e")
    square = lambda p: F.sum(F.col("hits") * F.pow(1 - p, 2) + (F.col("n") - F.col("hits")) * F.pow(p, 2)) / F.sum("n")
    losses = f.groupBy("season").agg(*[F.round(square(F.col(f"p{i}")), 9).alias(f"l{i}") for i in range(len(STAGES) + 1)])
    names = [f"l{i}" for i in range(len(STAGES) + 1)]
    last = Window.orderBy("season")
    before = F.array(*[F.struct(F.lag(c).over(last).alias("l"), F.lit(i).alias("i")) for i, c in enumerate(names)])
    best = F.when(F.lag("l0").over(last).isNull(), 0).otherwise(F.array_min(before)["i"])
    out = losses.select("season", *names, best.alias("taken")).withColumn("loss", F.element_at(F.array(*names), F.col("taken") + 1))
    return out.select("season", "taken", F.round("l0", 6).alias("plain"), F.round("loss", 6).alias("loss"))


def _staged_sql() -> str:
    bins = {"l_linenumber": "l_linenumber", "discount": "floor(l_discount * 100 + 0.5)", "quantity": "floor(l_quantity / 10)"}
    parts = [f"{MEANS}, s0 AS (SELECT season, {', '.join(f'{v} AS {k}' for k, v in bins.items())}, residual AS r, residual AS r0 FROM fr)"]
    for i, k in enumerate(STAGES):
        parts.append(f"o{i} AS (SELECT season, {k}, sum(r) AS s, count(*) AS n FROM s{i} GROUP BY 1, 2), e{i} AS (SELECT season, {k}, 0.5 * coalesce(sum(s) OVER w, 0) / (coalesce(sum(n) OVER w, 0) + 100.0) AS e FROM o{i} WINDOW w AS (PARTITION BY {k} ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))")
        parts.append(f"s{i + 1} AS (SELECT s{i}.* REPLACE (r - e AS r) FROM s{i} JOIN e{i} USING (season, {k}))")
    n = len(STAGES)
    parts.append("l AS (SELECT * FROM " + " JOIN ".join(f"(SELECT season, round(avg(r * r), 9) AS l{i} FROM s{i} GROUP BY 1) q{i}" + (" USING (season)" if i else "") for i in range(n + 1)) + ")")
    structs = ", ".join(f"{{'l': lag(l{i}) OVER w, 'i': {i}}}" for i in range(n + 1))
    parts.append(f"t AS (SELECT *, CASE WHEN lag(l0) OVER w IS NULL THEN 0 ELSE list_min([{structs}]).i END AS taken FROM l WINDOW w AS (ORDER BY season))")
    return f"WITH {', '.join(parts)} SELECT season, taken, round(l0, 6) AS plain, round([{', '.join(f'l{i}' for i in range(n + 1))}][taken + 1], 6) AS loss FROM t"


def monotone_effects(spark, d):
    """Mean residuals of the quantity's bins made to rise: the greatest over starts of the least over ends of the means of runs of bins; recentred to a mean of 0."""
    f = states.demeaned(facts(spark, d, "l_quantity"), "target", "r").withColumn("bin", F.floor(F.col("l_quantity") / 5).cast("int"))
    c = f.groupBy("bin").agg(F.sum("r").alias("s"), F.count("*").alias("n"))  # eleven bins
    w = Window.orderBy("bin")
    c = c.select("bin", "s", "n", F.sum("s").over(w).alias("cs"), F.sum("n").over(w).alias("cn"))
    a, b = c.alias("a"), c.alias("b")
    runs = a.join(b, F.col("b.bin") >= F.col("a.bin")).select(F.col("a.bin").alias("first"), F.col("b.bin").alias("last"), ((F.col("b.cs") - F.col("a.cs") + F.col("a.s")) / (F.col("b.cn") - F.col("a.cn") + F.col("a.n"))).alias("mean"))
    low = runs.alias("r").join(c.select("bin", "n").alias("k"), (F.col("r.first") <= F.col("k.bin")) & (F.col("r.last") >= F.col("k.bin"))).groupBy(F.col("k.bin").alias("bin"), "first").agg(F.min("mean").alias("low"))
    iso = low.groupBy("bin").agg(F.max("low").alias("fitted")).join(c, "bin")
    everything = Window.partitionBy()
    centre = F.sum(F.col("n") * F.col("fitted")).over(everything) / F.sum("n").over(everything)
    return rounded(iso.select("bin", "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("fitted") - centre).alias("fitted")), "mean", "fitted")


MONOTONE_SQL = f"""WITH {MEANS}, c AS (SELECT floor(l_quantity / 5)::INTEGER AS bin, sum(residual) AS s, count(*) AS n FROM fr GROUP BY 1),
r AS (SELECT a.bin AS i, b.bin AS j, (SELECT sum(s) / sum(n) FROM c x WHERE x.bin BETWEEN a.bin AND b.bin) AS mean FROM c a JOIN c b ON b.bin >= a.bin),
l AS (SELECT k.bin, i, min(mean) AS low FROM c k JOIN r ON i <= k.bin AND j >= k.bin GROUP BY 1, 2), q AS (SELECT bin, max(low) AS fitted FROM l GROUP BY 1)
SELECT bin, n, round(s / n, 6) AS mean, round(fitted - (SELECT sum(n * fitted) / sum(n) FROM q JOIN c USING (bin)), 6) AS fitted FROM q JOIN c USING (bin)"""

#: A stored ensemble of trees: (feature, threshold, side of a missing value, left, right), leaves are numbers.
STORED_TREES = [
    ("l_discount", 0.045, "left", ("l_quantity", 20.0, "right", -0.02, 0.01), ("l_tax", 0.035, "left", 0.015, 0.03)),
    ("l_quantity", 37.0, "right", ("l_tax", 0.055, "right", 0.005, -0.01), -0.015),
]


def tree_score(node, features: dict[str, Column]) -> Column:
    """The leaf of a stored tree that a row falls to: at most the threshold goes left, a missing value to its side."""
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, threshold, missing, left, right = node
    x = features[name]
    goes_left = (x <= threshold) if missing == "right" else (x <= threshold) | x.isNull()
    return F.when(F.coalesce(goes_left, F.lit(False)), tree_score(left, features)).otherwise(tree_score(right, features))


def stored_trees(spark, d):
    """Scores of a stored ensemble of trees as one expression: counts, mean and mean outcome of each score."""
    f = facts(spark, d, "l_discount", "l_tax", "l_quantity")
    x = {"l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": F.nullif("l_tax", F.lit(0.0)), "l_quantity": F.col("l_quantity")}
    score = sum((tree_score(t, x) for t in STORED_TREES), F.lit(0.0))
    return rounded(f.groupBy(F.round(score, 6).alias("score")).agg(F.count("*").alias("n"), F.avg("target").alias("rate")), "rate")


def _tree_sql(node) -> str:
    if not isinstance(node, tuple):
        return str(float(node))
    name, threshold, missing, left, right = node
    x = name if name == "l_quantity" else f"nullif({name}, 0)"
    return f"CASE WHEN {x} <= {threshold}{f' OR {x} IS NULL' if missing == 'left' else ''} THEN {_tree_sql(left)} ELSE {_tree_sql(right)} END"


TREES_SQL = f"WITH {FACTS} SELECT round((0.0 + {' + '.join('(' + _tree_sql(t) + ')' for t in STORED_TREES)})::DOUBLE, 6) AS score, count(*) AS n, round(avg(target), 6) AS rate FROM f GROUP BY 1"


def random_slopes(spark, d):
    """Posterior mean slopes of each supplier on discount and quantity under a shared normal prior (each on its own), learned on earlier years, and the loss of the bounded score they give."""
    f = states.demeaned(facts(spark, d, "l_discount", "l_quantity"), "target", "r")
    f = f.withColumns({"x1": (F.col("l_discount") - 0.05) / 0.03, "x2": (F.col("l_quantity") - 25.5) / 14.4})
    own = f.groupBy("l_suppkey", "season").agg(*[F.sum(F.col(x) * F.col("r")).alias(f"{x}r") for x in ("x1", "x2")], *[F.sum(F.col(x) * F.col(x)).alias(f"{x}x") for x in ("x1", "x2")])
    w = Window.partitionBy("l_suppkey").orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    slope = lambda x: F.coalesce(F.sum(f"{x}r").over(w), F.lit(0.0)) / (F.coalesce(F.sum(f"{x}x").over(w), F.lit(0.0)) + 100.0)
    post = own.select("l_suppkey", "season", slope("x1").alias("b1"), slope("x2").alias("b2"))
    j = f.join(post, ["l_suppkey", "season"]).withColumn("effect", 0.03 * F.tanh((F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")) / 0.03))
    return rounded(j.groupBy("season").agg(F.avg(F.abs("b1")).alias("size1"), F.avg(F.abs("b2")).alias("size2"), F.avg(F.col("r") * F.col("r")).alias("plain"), F.avg(F.pow(F.col("r") - F.col("effect"), 2)).alias("loss")), "size1", "size2", "plain", "loss")


RANDOM_SQL = f"""WITH {MEANS}, g AS (SELECT l_suppkey, season, residual AS r, (l_discount - 0.05) / 0.03 AS x1, (l_quantity - 25.5) / 14.4 AS x2 FROM fr),
c AS (SELECT l_suppkey, season, sum(x1 * r) AS x1r, sum(x2 * r) AS x2r, sum(x1 * x1) AS x1x, sum(x2 * x2) AS x2x FROM g GROUP BY 1, 2),
p AS (SELECT l_suppkey, season, coalesce(sum(x1r) OVER w, 0) / (coalesce(sum(x1x) OVER w, 0) + 100.0) AS b1, coalesce(sum(x2r) OVER w, 0) / (coalesce(sum(x2x) OVER w, 0) + 100.0) AS b2 FROM c WINDOW w AS (PARTITION BY l_suppkey {PRIOR}))
SELECT season, round(avg(abs(b1)), 6) AS size1, round(avg(abs(b2)), 6) AS size2, round(avg(r * r), 6) AS plain, round(avg((r - 0.03 * tanh((b1 * x1 + b2 * x2) / 0.03)) ** 2), 6) AS loss FROM g JOIN p USING (l_suppkey, season) GROUP BY 1"""


def centred_composition(spark, d):
    """Two corrections composed along the leading direction of their centred products (a matrix of two by two, in closed form), with the best length for each year's earlier rows."""
    f = states.demeaned(facts(spark, d, "l_discount", "l_tax"), "target", "r")
    a, b = (F.col("l_discount") - 0.05) / 0.03, (F.col("l_tax") - 0.04) / 0.026
    f = f.withColumns({"a": a, "b": b})
    y = f.groupBy("season").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in {"sa": "a", "sb": "b", "saa": "a * a", "sbb": "b * b", "sab": "a * b", "sar": "a * r", "sbr": "b * r"}.items()])
    s = y.select("season", *[F.sum(c).over(earlier()).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab", "sar", "sbr")])
    c = F.col
    aa, bb, ab = c("saa") - c("sa") * c("sa") / c("n"), c("sbb") - c("sb") * c("sb") / c("n"), c("sab") - c("sa") * c("sb") / c("n")
    angle = 0.5 * F.atan2(2 * ab, aa - bb)
    s = s.select("season", "n", "sar", "sbr", aa.alias("aa"), bb.alias("bb"), ab.alias("ab"), angle.alias("angle"))
    u, v = F.cos("angle"), F.sin("angle")
    length = (u * c("sar") + v * c("sbr")) / (u * u * c("aa") + 2 * u * v * c("ab") + v * v * c("bb") + 1.0)
    s = s.select("season", F.coalesce(u * length, F.lit(0.0)).alias("wa"), F.coalesce(v * length, F.lit(0.0)).alias("wb"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    out = f.join(F.broadcast(s), "season").groupBy("season").agg(F.first("wa").alias("wa"), F.first("wb").alias("wb"), F.avg(F.pow(c("r") - c("wa") * c("a") - c("wb") * c("b"), 2)).alias("loss"))
    return out.select("season", F.round("wa", 5).alias("wa"), F.round("wb", 5).alias("wb"), F.round("loss", 6).alias("loss"))


CENTRED_SQL = f"""WITH {MEANS}, g AS (SELECT season, residual AS r, (l_discount - 0.05) / 0.03 AS a, (l_tax - 0.04) / 0.026 AS b FROM fr),
y AS (SELECT season, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab, sum(a * r) AS sar, sum(b * r) AS sbr FROM g GROUP BY 1),
s AS (SELECT season, {', '.join(f'sum({k}) OVER w AS {k}' for k in ('n', 'sa', 'sb', 'saa', 'sbb', 'sab', 'sar', 'sbr'))} FROM y WINDOW w AS ({PRIOR})),
t AS (SELECT season, sar, sbr, saa - sa * sa / n AS aa, sbb - sb * sb / n AS bb, sab - sa * sb / n AS ab FROM s), o AS (SELECT *, 0.5 * atan2(2 * ab, aa - bb) AS h FROM t),
l AS (SELECT season, h, (cos(h) * sar + sin(h) * sbr) / (cos(h) ** 2 * aa + 2 * cos(h) * sin(h) * ab + sin(h) ** 2 * bb + 1.0) AS z FROM o), w AS (SELECT season, coalesce(cos(h) * z, 0) AS wa, coalesce(sin(h) * z, 0) AS wb FROM l)
SELECT season, round(any_value(wa), 5) AS wa, round(any_value(wb), 5) AS wb, round(avg((r - wa * a - wb * b) ** 2), 6) AS loss FROM g JOIN w USING (season) GROUP BY 1"""


def candidate_switch(spark, d):
    """Scores of the published candidates, each a sum of base and looked-up corrections: strict, aggressive, consensus of both at .5 and .7, a shifted ensemble, and an auxiliary where the correction is missing."""
    p = predictions(spark, d)
    c, base = F.col("p") - F.col("base"), F.col("base")
    late = F.when(F.col("l_linenumber") > 4, 0.004).otherwise(-0.003)
    strict, aggressive = base + 0.5 * c, base + 1.25 * c
    nodes = {
        "strict": strict, "aggressive": aggressive, "consensus50": 0.5 * strict + 0.5 * aggressive, "consensus70": 0.7 * strict + 0.3 * aggressive,
        "shifted": 0.6 * F.col("p") + 0.4 * base + 0.001, "auxiliary": F.when(F.abs(c) > 1e-12, F.col("p")).otherwise(base + 0.5 * late), "direct": base + c + late,
    }
    wide = p.groupBy("season").agg(*[F.avg(F.pow(X.clip(v, 0.0, 1.0) - F.col("target"), 2)).alias(k) for k, v in nodes.items()])
    return rounded(wide.unpivot("season", list(nodes), "candidate", "brier"), "brier")


_LATE = "CASE WHEN l_linenumber > 4 THEN 0.004 ELSE -0.003 END"
_NODES = {
    "strict": "base + 0.5 * (p - base)", "aggressive": "base + 1.25 * (p - base)", "consensus50": "0.5 * (base + 0.5 * (p - base)) + 0.5 * (base + 1.25 * (p - base))", "consensus70": "0.7 * (base + 0.5 * (p - base)) + 0.3 * (base + 1.25 * (p - base))",
    "shifted": "0.6 * p + 0.4 * base + 0.001", "auxiliary": f"CASE WHEN abs(p - base) > 1e-12 THEN p ELSE base + 0.5 * ({_LATE}) END", "direct": f"base + (p - base) + {_LATE}",
}
SWITCH_SQL = f"WITH {predictions_sql()} " + " UNION ALL ".join(f"SELECT season, '{k}' AS candidate, round(avg((least(greatest({v}, 0), 1) - target) ** 2), 6) AS brier FROM predicted GROUP BY 1" for k, v in _NODES.items())


def prior_stack(spark, d):
    """A stack of the base and the correction with their product, fitted on the predictions of earlier years by three normal equations solved one after the other; the loss with and without it."""
    p = predictions(spark, d)
    f = p.select("season", (F.col("target") - F.col("base")).alias("r"), (F.col("p") - F.col("base")).alias("c"), ((F.col("p") - F.col("base")) * (F.col("base") - 0.3)).alias("q"))
    sums = {"cc": "c * c", "cq": "c * q", "qq": "q * q", "cr": "c * r", "qr": "q * r"}
    y = f.groupBy("season").agg(*[F.sum(F.expr(e)).alias(k) for k, e in sums.items()])
    s = y.select("season", *[F.coalesce(F.sum(k).over(earlier()), F.lit(0.0)).alias(k) for k in sums])
    cc, qq, cq = F.col("cc") + 0.1, F.col("qq") + 0.1, F.col("cq")
    det = cc * qq - cq * cq
    s = s.select("season", ((qq * F.col("cr") - cq * F.col("qr")) / det).alias("wc"), ((cc * F.col("qr") - cq * F.col("cr")) / det).alias("wq"))
    out = f.join(F.broadcast(s), "season").groupBy("season").agg(F.first("wc").alias("wc"), F.avg(F.pow(F.col("r") - F.col("c"), 2)).alias("plain"), F.avg(F.pow(F.col("r") - F.col("wc") * F.col("c") - F.col("wq") * F.col("q"), 2)).alias("stacked"))
    return out.select("season", F.round("wc", 4).alias("wc"), F.round("plain", 6).alias("plain"), F.round("stacked", 6).alias("stacked"))


STACK_SQL = f"""WITH {predictions_sql()}, g AS (SELECT season, target - base AS r, p - base AS c, (p - base) * (base - 0.3) AS q FROM predicted), y AS (SELECT season, sum(c * c) AS cc, sum(c * q) AS cq, sum(q * q) AS qq, sum(c * r) AS cr, sum(q * r) AS qr FROM g GROUP BY 1),
s AS (SELECT season, coalesce(sum(cc) OVER w, 0) + 0.1 AS cc, coalesce(sum(cq) OVER w, 0) AS cq, coalesce(sum(qq) OVER w, 0) + 0.1 AS qq, coalesce(sum(cr) OVER w, 0) AS cr, coalesce(sum(qr) OVER w, 0) AS qr FROM y WINDOW w AS ({PRIOR})),
t AS (SELECT season, (qq * cr - cq * qr) / (cc * qq - cq * cq) AS wc, (cc * qr - cq * cr) / (cc * qq - cq * cq) AS wq FROM s)
SELECT season, round(any_value(wc), 4) AS wc, round(avg((r - c) ** 2), 6) AS plain, round(avg((r - wc * c - wq * q) ** 2), 6) AS stacked FROM g JOIN t USING (season) GROUP BY 1"""


def soft_archetypes(spark, d):
    """Suppliers' profiles of a year against three fixed centres: squared distances, soft weights, the nearest, and the residual effect of each archetype given softly."""
    f = states.demeaned(facts(spark, d, "l_discount", "l_quantity"), "target", "r")
    p = f.groupBy("l_suppkey", "season").agg(F.avg((F.col("l_discount") - 0.05) / 0.03).alias("a"), F.avg((F.col("l_quantity") - 25.5) / 14.4).alias("b"), F.sum("r").alias("s"), F.count("*").alias("n"))
    far = F.array(*[F.pow(F.col("a") - x, 2) + F.pow(F.col("b") - y, 2) for x, y in CENTRES])
    p = p.withColumn("far", far).withColumn("raw", F.transform("far", lambda v: F.exp(-v / (2 * TAU * TAU)))).withColumn("all", F.aggregate("raw", F.lit(0.0), lambda t, x: t + x))
    p = p.withColumn("soft", F.transform("raw", lambda v: F.when(F.col("all") == 0, float("nan")).otherwise(v / F.col("all"))))  # too far from all centres: no number, as in SQL
    near = F.transform("far", lambda v: F.coalesce(v <= F.array_min("far") + TIE, F.lit(True)))  # equally near, or none known: the first, whatever order the means were added up in
    long = p.select("season", "s", "n", (F.array_position(near, True) - 1).cast("int").alias("nearest"), F.posexplode("soft").alias("archetype", "weight"))
    out = long.groupBy("season", "archetype").agg((F.sum(F.col("weight") * F.col("s")) / (F.sum(F.col("weight") * F.col("n")) + 50.0)).alias("effect"), F.sum("weight").alias("mass"), F.count_if(F.col("nearest") == F.col("archetype")).alias("hard"))
    return rounded(out, "effect", "mass")


CENTRES, TAU = ((-0.1, 0.0), (0.0, 0.1), (0.1, -0.1)), 0.15
#: Squared distances of means of hundredths and whole numbers are equal, or further apart than this, up to some 1e8 lines a profile.
TIE = 1e-12
SOFT_SQL = f"""WITH {MEANS}, p AS (SELECT l_suppkey, season, avg((l_discount - 0.05) / 0.03) AS a, avg((l_quantity - 25.5) / 14.4) AS b, sum(residual) AS s, count(*) AS n FROM fr GROUP BY 1, 2),
q AS (SELECT *, [{', '.join(f'(a - ({x})) ** 2 + (b - ({y})) ** 2' for x, y in CENTRES)}] AS far FROM p), r AS (SELECT *, list_transform(far, lambda v: exp(-v / {2 * TAU * TAU})) AS raw FROM q),
l AS (SELECT season, s, n, far, raw, i::INTEGER AS archetype, raw[i + 1] / list_sum(raw) AS weight FROM r, (SELECT unnest(range(0, 3)) AS i))
SELECT season, archetype, round(sum(weight * s) / (sum(weight * n) + 50.0), 6) AS effect, round(sum(weight), 6) AS mass, count(*) FILTER (list_position(far, list_min(far)) - 1 = archetype) AS hard FROM l GROUP BY 1, 2"""

QUERIES = {
    "affine_calibration": affine_calibration, "prior_ridge": prior_ridge, "cross_fitted_encoding": cross_fitted_encoding, "offset_effects": offset_effects, "weighted_factors": weighted_factors, "pair_factors": pair_factors,
    "source_similarity": source_similarity, "expert_mixture": expert_mixture, "minimax_weights": minimax_weights, "yearly_slopes": yearly_slopes, "two_experts": two_experts, "robust_groups": robust_groups, "staged_effects": staged_effects,
    "monotone_effects": monotone_effects, "stored_trees": stored_trees, "random_slopes": random_slopes, "centred_composition": centred_composition, "candidate_switch": candidate_switch, "prior_stack": prior_stack, "soft_archetypes": soft_archetypes,
}
ORACLES = {
    "affine_calibration": AFFINE_SQL, "prior_ridge": RIDGE_SQL, "cross_fitted_encoding": CROSS_SQL, "offset_effects": _offset_sql(), "weighted_factors": _factors_sql(), "pair_factors": _pair_sql(),
    "source_similarity": SIMILARITY_SQL, "expert_mixture": MIXTURE_SQL, "minimax_weights": MINIMAX_SQL, "yearly_slopes": SLOPES_SQL, "two_experts": EXPERTS_SQL, "robust_groups": _robust_sql(), "staged_effects": _staged_sql(),
    "monotone_effects": MONOTONE_SQL, "stored_trees": TREES_SQL, "random_slopes": RANDOM_SQL, "centred_composition": CENTRED_SQL, "candidate_switch": SWITCH_SQL, "prior_stack": STACK_SQL, "soft_archetypes": SOFT_SQL,
}
