"""Hidden regimes of suppliers over quarters: sticky Gaussian models by fold, their posteriors, and residual maps with and without transitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import regimes, states
from ..sources.io import Stage
from .base import facts, rounded

K, D, EFFECT_K, CAP = 3, 2, 400.0, 0.03


def observed_quarters(spark, d) -> tuple[DataFrame, int, int]:
    """((entity, periods, values), first year, periods): each supplier's logit of the rate of returns and log of lines by quarter; quarters without lines are missing."""
    f = facts(spark, d)
    q = f.groupBy("l_suppkey", "season", F.quarter("l_shipdate").alias("quarter")).agg(F.count("*").alias("n"), F.sum("target").alias("s"))
    span = q.agg(F.min("season").alias("a"), F.max("season").alias("b")).first()
    first, last = span["a"] or 0, span["b"] or 0
    at = ((F.col("season") - first) * 4 + F.col("quarter") - 1).cast("int")
    rate = F.ln((F.col("s") + 1.0) / (F.col("n") - F.col("s") + 2.0))
    value = F.array(rate + 0.6931471805599453, F.ln(F.col("n").cast("double")) - 3.0)
    o = q.where("l_suppkey IS NOT NULL").groupBy(F.col("l_suppkey").alias("entity")).agg(F.sort_array(F.collect_list(F.struct(at.alias("t"), value.alias("x")))).alias("o"))  # some dozens of quarters
    return o.select("entity", F.col("o.t").alias("periods"), F.col("o.x").alias("values")), first, 4 * (last - first + 1)


def fitted(spark, d, stage: Stage) -> tuple[DataFrame, int, int, dict[int, regimes.Regimes]]:
    """Sequences, first year, periods and a model for each year but the first, fitted on the quarters before it."""
    sequences, first, periods = observed_quarters(spark, d)
    sequences = stage(regimes.spread(sequences))
    return sequences, first, periods, regimes.fit(sequences, K, D, periods, range(4, periods, 4))


def regime_models(spark, d):
    """Parameters of the best model of each year, its rounds, whether it stalled, its last objective and its least rise of a round."""
    with Stage(spark) as stage:
        _, first, _, models = fitted(spark, d, stage)
    rows = []
    for upto, m in models.items():
        year = first + upto // 4
        rows += [(year, "move", i, j, float(v)) for i, r in enumerate(m.move) for j, v in enumerate(r)]
        rows += [(year, kind, i, j, float(v)) for kind, a in (("mean", m.mean), ("variance", m.var)) for i, r in enumerate(a) for j, v in enumerate(r)]
        rows += [(year, "stationary", i, 0, float(v)) for i, v in enumerate(m.stationary())]
        rows += [(year, "rounds", 0, 0, float(len(m.told))), (year, "stalled", 0, 0, float(m.stalled)), (year, "objective", 0, 0, m.told[-1]), (year, "least_rise", 0, 0, float(min(np.diff(m.told), default=0.0)))]
    return rounded(spark.createDataFrame(rows, "season int, kind string, i int, j int, value double"), "value")


def terminal(sequences: DataFrame, model: regimes.Regimes, first: int, periods: int) -> DataFrame:
    """(l_suppkey, season, posterior): at the end of each year the model may see."""
    p = regimes.posteriors(sequences, model, periods).where((F.col("period") % 4 == 3) & (F.col("period") < model.upto))
    return p.select(F.col("entity").alias("l_suppkey"), (F.lit(first) + F.floor(F.col("period") / 4)).cast("int").alias("season"), "posterior")


def regime_posteriors(spark, d):
    """Each supplier's terminal posteriors at the end of each year, under the model of the year after."""
    stage = Stage(spark)  # the result reads it
    sequences, first, periods, models = fitted(spark, d, stage)
    kinds = ", ".join(f"p{i} double" for i in range(K))
    out = spark.createDataFrame([], f"l_suppkey long, season int, {kinds}")
    for m in models.values():  # a model for each year
        last = terminal(sequences, m, first, periods).where(F.col("season") == first + m.upto // 4 - 1)
        out = out.unionByName(last.select(F.col("l_suppkey").cast("long").alias("l_suppkey"), "season", *[F.col("posterior")[i].alias(f"p{i}") for i in range(K)]))
    return rounded(out, *[f"p{i}" for i in range(K)])


def weighed(prior: Column, x: Column, model: regimes.Regimes) -> Column:
    """Posterior of each state from a prior (array) and the emission at x (array), a null number of which says nothing."""
    like = []
    for mean, var in zip(model.mean, model.var):
        each = [F.coalesce(-0.5 * (F.pow(x[j] - float(m), 2) / float(v) + float(np.log(v))), F.lit(0.0)) for j, (m, v) in enumerate(zip(mean, var))]
        like.append(sum(each[1:], each[0]))
    top = F.greatest(*like)
    joint = [prior[i] * F.exp(v - top) for i, v in enumerate(like)]
    total = sum(joint[1:], joint[0])
    return F.array(*[j / total for j in joint])


def moved(posterior: Column, model: regimes.Regimes, gap: int) -> Column:
    """The posterior after `gap` moves."""
    m = np.linalg.matrix_power(model.move, gap)
    return F.array(*[sum((posterior[i] * float(m[i, j]) for i in range(1, len(m))), posterior[0] * float(m[0, j])) for j in range(len(m))])


def season_cells(spark, d, sequences: DataFrame, first: int) -> DataFrame:
    """(l_suppkey, season, l_linestatus, n, s, residual, rate, x): lines of a quarter with the supplier's observation of the quarter before."""
    f = states.demeaned(facts(spark, d), "target", "residual")
    rate = states.prior_rate(f, F.col("target"))
    t = ((F.col("season") - first) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    cells = f.groupBy("l_suppkey", "season", "l_linestatus", t.alias("t")).agg(F.count("*").alias("n"), F.sum("target").alias("s"), F.sum("residual").alias("residual"))
    before = sequences.select(F.col("entity").alias("l_suppkey"), F.explode(F.arrays_zip("periods", "values")).alias("o")).select("l_suppkey", (F.col("o.periods") + 1).alias("t"), F.col("o.values").alias("x"))
    return cells.join(before, ["l_suppkey", "t"], "left").join(F.broadcast(rate), "season")  # a row for each year


def mapped_posteriors(cells: DataFrame, sequences: DataFrame, model: regimes.Regimes, first: int, periods: int) -> DataFrame:
    """Cells up to the model's year with two posteriors: by transition (the last terminal posterior strictly before the year, moved to it, and the emission) and by emission alone (the stationary distribution and the emission)."""
    year = first + model.upto // 4
    even = F.array(*[F.lit(float(v)) for v in model.stationary()])
    last = terminal(sequences, model, first, periods).select("l_suppkey", (F.col("season") + 1).alias("season"), moved(F.col("posterior"), model, 1).alias("prior"))
    j = cells.where(F.col("season") <= year).join(last, ["l_suppkey", "season"], "left")
    return j.withColumns({"transition": weighed(F.coalesce("prior", even), F.col("x"), model), "emission": weighed(even, F.col("x"), model), "fold": F.lit(year)})


def regime_residual_maps(spark, d):
    """Brier scores of each year's base rate, and with the effects of regimes x status by either posterior, fitted on the years before."""
    stage = Stage(spark)
    sequences, first, periods, models = fitted(spark, d, stage)
    cells = stage(season_cells(spark, d, sequences, first))
    parts = [mapped_posteriors(cells, sequences, m, first, periods) for m in models.values()]
    if not parts:
        return spark.createDataFrame([], "season int, n long, base double, by_transition double, by_emission double")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = stage(rows.select("fold", "season", "l_suppkey", "l_linestatus", "n", "s", "residual", "rate", "transition", "emission"))
    shift = {}
    for way in ("transition", "emission"):
        e = rows.where(F.col("season") < F.col("fold")).select("fold", "l_linestatus", "residual", "n", F.posexplode(way).alias("state", "p"))
        e = e.groupBy("fold", "l_linestatus", "state").agg((F.sum(F.col("p") * F.col("residual")) / (F.sum(F.col("p") * F.col("n")) + EFFECT_K)).alias("effect"))
        shift[way] = e.groupBy("fold", "l_linestatus").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "effect"))), lambda v: v["effect"]).alias(f"e_{way}"))  # years x statuses x states
    now = rows.where(F.col("season") == F.col("fold"))
    for way, e in shift.items():
        now = now.join(F.broadcast(e), ["fold", "l_linestatus"], "left")
        now = now.withColumn(way, X.clip(F.coalesce(X.dot(F.col(way), F.col(f"e_{way}")), F.lit(0.0)), -CAP, CAP))
    loss = lambda p: F.sum(F.col("s") * F.pow(1 - p, 2) + (F.col("n") - F.col("s")) * F.pow(p, 2)) / F.sum("n")
    at = lambda way: X.clip(F.col("rate") + F.col(way), 0.0, 1.0)
    out = now.groupBy("season").agg(F.sum("n").alias("n"), loss(F.col("rate")).alias("base"), loss(at("transition")).alias("by_transition"), loss(at("emission")).alias("by_emission"))
    return rounded(out, "base", "by_transition", "by_emission")


QUERIES = {"regime_models": regime_models, "regime_posteriors": regime_posteriors, "regime_residual_maps": regime_residual_maps}
ORACLES: dict[str, str] = {}
