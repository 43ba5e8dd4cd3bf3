"""Random slopes with a full covariance and two crossed intercepts, by blocks of a Gaussian variational fit.

Rows become cells of (fold, entity, other, context) with sums of products, or stay cells of their own, which is all the
blocks need. A block is a grouping of the cells by its key: the slopes of an entity are a small
solve, the intercepts a shrunk mean. The covariance of the slopes, the variances of the intercepts and
that of the noise are estimated again in each round. Means settle at those of the exact posterior.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import Stage, small


@dataclass
class Variances:
    """Of one fold: covariance of the slopes, variances of the other's and the context's intercepts, and of the noise."""

    slopes: np.ndarray
    other: float = 0.01
    context: float = 0.01
    noise: float = 0.2


def upper(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def product_cells(rows: DataFrame, fold: str, entity: str, other: str, context: str, z: Sequence[str], y: str) -> DataFrame:
    """(fold, entity, other, context, n, sy, syy, z_i, zy_i, zz_i_j): sums over the rows of a cell. Rows with a null key, slope or outcome are left out."""
    whole = F.lit(True)
    for c in (fold, entity, other, context, *z, y):
        whole = whole & F.col(c).isNotNull()
    sums = [F.count("*").cast("double").alias("n"), F.sum(y).cast("double").alias("sy"), F.sum(F.col(y) * F.col(y)).cast("double").alias("syy")]
    sums += [F.sum(c).cast("double").alias(f"z_{i}") for i, c in enumerate(z)] + [F.sum(F.col(c) * F.col(y)).cast("double").alias(f"zy_{i}") for i, c in enumerate(z)]
    sums += [F.sum(F.col(z[i]) * F.col(z[j])).cast("double").alias(f"zz_{i}_{j}") for i, j in upper(len(z))]
    return rows.where(whole).groupBy(F.col(fold).alias("fold"), F.col(entity).alias("entity"), F.col(other).alias("other"), F.col(context).alias("context")).agg(*sums)


def by_fold(values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for f, v in values.items():
        out = F.when(F.col("fold") == f, float(v)).otherwise(out)
    return out


def solved_slopes(sums: DataFrame, variances: dict[int, Variances], d: int) -> DataFrame:
    """(fold, entity, u_i, c_i_j): posterior mean and covariance of each entity's slopes."""
    inverse = {f: np.linalg.inv(v.slopes) for f, v in variances.items()}
    noise = {f: v.noise for f, v in variances.items()}

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            s2 = pdf["fold"].map(noise).to_numpy()
            g = np.zeros((len(pdf), d, d))
            for i, j in upper(d):
                g[:, i, j] = g[:, j, i] = pdf[f"zz_{i}_{j}"]
            cov = np.linalg.inv(g / s2[:, None, None] + np.stack([inverse[f] for f in pdf["fold"]])) if len(pdf) else g
            u = np.einsum("bij,bj->bi", cov, pdf[[f"t_{i}" for i in range(d)]].to_numpy() / s2[:, None])
            yield pd.DataFrame({"fold": pdf["fold"], "entity": pdf["entity"], **{f"u_{i}": u[:, i] for i in range(d)}, **{f"c_{i}_{j}": cov[:, i, j] for i, j in upper(d)}})

    schema = f"fold int, entity {sums.schema['entity'].dataType.simpleString()}, " + ", ".join([f"u_{i} double" for i in range(d)] + [f"c_{i}_{j} double" for i, j in upper(d)])
    return sums.mapInPandas(work, schema)


def product_rows(rows: DataFrame, period: str, entity: str, other: str, context: str, z: Sequence[str], y: str) -> DataFrame:
    """Each whole row as a cell of its own, with `period` in place of a fold, for `random_slopes` with folds."""
    whole = F.lit(True)
    for c in (period, entity, other, context, *z, y):
        whole = whole & F.col(c).isNotNull()
    y, x = F.col(y).cast("double"), [F.col(c).cast("double") for c in z]
    sums = [F.lit(1.0).alias("n"), y.alias("sy"), (y * y).alias("syy"), *[v.alias(f"z_{i}") for i, v in enumerate(x)], *[(v * y).alias(f"zy_{i}") for i, v in enumerate(x)]]
    sums += [(x[i] * x[j]).alias(f"zz_{i}_{j}") for i, j in upper(len(z))]
    return rows.where(whole).select(F.col(period).alias("period"), F.col(entity).alias("entity"), F.col(other).alias("other"), F.col(context).alias("context"), *sums)


def random_slopes(cells: DataFrame, d: int, stage: Stage, rounds: int = 12, settle: int = 0, folds: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, Variances], list[float]]:
    """(slopes, others, contexts, variances by fold, largest change of a mean in each round) from product_cells.

    slopes(fold, entity, u_i, c_i_j), others(fold, other, a, va), contexts(fold, context, b, vb). After `rounds` the variances
    stay, and `settle` further rounds move the means alone. The first slope belongs to a constant 1.

    With `folds`, cells have a period in place of a fold, and a fold sees those of the periods before it. If they are a table in buckets of the
    entity, no round moves them: it moves the slopes, and sums by (fold, other, context), from which both intercepts and the noise follow.
    """
    if folds is None:
        cells = stage.bucketed(cells, "entity")
        folds = [r[0] for r in cells.select("fold").distinct().collect()]
        seen, sees = (lambda df: df), F.col("fold") == F.col("fold_")
    else:
        seen = lambda df: df.withColumn("fold", F.explode(F.filter(F.array(*[F.lit(int(f)) for f in folds]), lambda f: f > F.col("period"))))
        sees = F.col("fold_") > F.col("period")
    own = [c for c in cells.columns if c not in ("fold", "period")]
    keys = lambda c: seen(cells.select(next(k for k in ("fold", "period") if k in cells.columns), c).distinct()).select("fold", c).distinct()
    zz = [f"zz_{i}_{j}" for i, j in upper(d)]
    others = stage(keys("other").withColumns({"a": F.lit(0.0), "va": F.lit(0.0)}))
    contexts = stage(keys("context").withColumns({"b": F.lit(0.0), "vb": F.lit(0.0)}))
    variances = {r[0]: Variances(np.eye(d) * 0.01) for r in contexts.select("fold").distinct().collect()}
    slopes, told = None, []
    linear = lambda: sum((F.col(f"u_{i}") * F.col(f"z_{i}") for i in range(d)), F.lit(0.0))
    quad = sum(((1 if i == j else 2) * F.col(f"zz_{i}_{j}") * (F.col(f"u_{i}") * F.col(f"u_{j}") + F.col(f"c_{i}_{j}")) for i, j in upper(d)), F.lit(0.0))
    for k in range(rounds + settle):
        if slopes is not None:
            others, contexts = levelled(slopes, others, contexts, variances, d)
        held = seen(cells).join(small(others), ["fold", "other"]).join(small(contexts), ["fold", "context"])
        rest = F.col("a") + F.col("b")
        sums = held.groupBy("fold", "entity").agg(*[F.sum(c).alias(c) for c in zz], *[F.sum(F.col(f"zy_{i}") - rest * F.col(f"z_{i}")).alias(f"t_{i}") for i in range(d)])
        before, slopes = slopes, stage.bucketed(solved_slopes(sums, variances, d), "entity")
        with_u = cells.join(slopes.withColumnRenamed("fold", "fold_").hint("shuffle_hash"), "entity").where(sees).select(F.col("fold_").alias("fold"), *own, *[c for c in slopes.columns if c not in ("fold", "entity")])
        zy = sum((F.col(f"u_{i}") * F.col(f"zy_{i}") for i in range(d)), F.lit(0.0))
        met = stage(with_u.groupBy("fold", "other", "context").agg(F.sum(F.col("sy") - linear()).alias("s"), F.sum("n").alias("n"), F.sum(F.col("syy") - 2 * zy + quad).alias("q")))

        def intercepts(key: str, mean: str, own: dict[int, float], beside: DataFrame, on: str, theirs: str) -> DataFrame:
            noise = by_fold({f: v.noise for f, v in variances.items()})
            s = met.join(small(beside), ["fold", on]).groupBy("fold", key).agg(F.sum(F.col("s") - F.col(theirs) * F.col("n")).alias("s"), F.sum("n").alias("n"))
            shrunk = F.col("n") + noise / by_fold(own)
            return stage(s.select("fold", key, (F.col("s") / shrunk).alias(mean), (noise / shrunk).alias(f"v{mean}")))

        others = intercepts("other", "a", {f: v.other for f, v in variances.items()}, contexts, "context", "b")
        contexts = intercepts("context", "b", {f: v.context for f, v in variances.items()}, others, "other", "a")
        if before is not None:
            gap = F.greatest(*[F.abs(F.col(f"u_{i}") - F.col(f"w_{i}")) for i in range(d)], F.lit(0.0))
            old = before.select("fold", "entity", *[F.col(f"u_{i}").alias(f"w_{i}") for i in range(d)])
            told.append(slopes.join(old, ["fold", "entity"]).agg(F.max(gap).alias("g")).first()["g"] or 0.0)
        if k < rounds:
            variances = estimated(met, slopes, others, contexts, d)
    return slopes, others, contexts, variances, told


def levelled(slopes: DataFrame, others: DataFrame, contexts: DataFrame, variances: dict[int, Variances], d: int) -> tuple[DataFrame, DataFrame]:
    """Both intercepts moved to the levels that the priors like best when the first slope takes the opposite: a direction that blocks alone follow slowly."""
    su = {r["fold"]: r for r in slopes.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(f"u_{i}").alias(f"u_{i}") for i in range(d)]).collect()}
    sa = {r["fold"]: r for r in others.groupBy("fold").agg(F.count("*").alias("n"), F.sum("a").alias("s")).collect()}
    sb = {r["fold"]: r for r in contexts.groupBy("fold").agg(F.count("*").alias("n"), F.sum("b").alias("s")).collect()}
    up, down = {}, {}
    for f, v in variances.items():
        p = np.linalg.inv(v.slopes)[0]
        force = float(sum(p[i] * su[f][f"u_{i}"] for i in range(d)))
        stiff = su[f]["n"] * p[0]
        h = np.array([[stiff + sa[f]["n"] / v.other, stiff], [stiff, stiff + sb[f]["n"] / v.context]])
        up[f], down[f] = np.linalg.solve(h, [force - sa[f]["s"] / v.other, force - sb[f]["s"] / v.context])
    return others.withColumn("a", F.col("a") + by_fold(up)), contexts.withColumn("b", F.col("b") + by_fold(down))


def estimated(met: DataFrame, slopes: DataFrame, others: DataFrame, contexts: DataFrame, d: int) -> dict[int, Variances]:
    """Variances of each fold from the present means and their uncertainty."""
    s = {r["fold"]: r for r in slopes.groupBy("fold").agg(*[F.avg(F.col(f"u_{i}") * F.col(f"u_{j}") + F.col(f"c_{i}_{j}")).alias(f"s_{i}_{j}") for i, j in upper(d)]).collect()}
    a = {r["fold"]: r["v"] for r in others.groupBy("fold").agg(F.avg(F.col("a") * F.col("a") + F.col("va")).alias("v")).collect()}
    b = {r["fold"]: r["v"] for r in contexts.groupBy("fold").agg(F.avg(F.col("b") * F.col("b") + F.col("vb")).alias("v")).collect()}
    m = F.col("a") + F.col("b")
    left = F.col("q") - 2 * m * F.col("s") + (m * m + F.col("va") + F.col("vb")) * F.col("n")
    j = met.join(small(others), ["fold", "other"]).join(small(contexts), ["fold", "context"])
    e = {r["fold"]: r["v"] for r in j.groupBy("fold").agg((F.sum(left) / F.sum("n")).alias("v")).collect()}
    out = {}
    for f, r in s.items():  # a fold each
        cov = np.zeros((d, d))
        for i, j_ in upper(d):
            cov[i, j_] = cov[j_, i] = r[f"s_{i}_{j_}"]
        out[f] = Variances(cov, max(a[f], 1e-9), max(b[f], 1e-9), max(e[f], 1e-9))
    return out
