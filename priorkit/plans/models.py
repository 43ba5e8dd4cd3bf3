"""Linear algebra on aggregated matrices, blends, resampling, and models of pyspark.ml."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import linalg, states
from ..sources.io import Stage, table
from .base import FACTS, facts, rounded
from .effects import KEYS, moved, predictions, predictions_sql, prior_cells

CONTEXTS = list(range(14))
RANK = 2


def effect_matrix(spark, d) -> DataFrame:
    """(l_suppkey, context, effect): shrunk residual sums by supplier and line number x status."""
    f = states.demeaned(facts(spark, d), "target", "residual")
    context = ((F.col("l_linenumber") - 1) * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("context")
    return f.groupBy("l_suppkey", context).agg((F.sum("residual") / (F.count("*") + 20.0)).alias("effect"), F.sum("residual").alias("s"), F.count("*").alias("n"))


MATRIX = f"""{FACTS}, e AS (SELECT l_suppkey, ((l_linenumber - 1) * 2 + (l_linestatus = 'O')::INTEGER)::INTEGER AS context, sum(residual) / (count(*) + 20.0) AS effect, sum(residual) AS s, count(*) AS n
  FROM (SELECT *, target - avg(target) OVER (PARTITION BY season) AS residual FROM f) GROUP BY 1, 2)"""


def effect_cells(spark, d):
    return rounded(effect_matrix(spark, d).select("l_suppkey", "context", "effect", "n"), "effect")


def lowrank_context(spark, d):
    """The matrix of effects and its reconstruction of rank RANK."""
    return rounded(linalg.low_rank(effect_matrix(spark, d), "l_suppkey", "context", "effect", CONTEXTS, RANK), "effect", "reconstructed")


def context_gram(spark, d):
    """Inner products of all pairs of contexts over suppliers: what the low-rank cut is made from."""
    cells = effect_matrix(spark, d).select("l_suppkey", "context", "effect")
    other = cells.select("l_suppkey", F.col("context").alias("other"), F.col("effect").alias("b"))
    return rounded(cells.join(other, "l_suppkey").groupBy("context", "other").agg(F.sum(F.col("effect") * F.col("b")).alias("product")), "product")


GRAM_SQL = f"WITH {MATRIX} SELECT a.context, b.context AS other, round(sum(a.effect * b.effect), 6) AS product FROM e a JOIN e b USING (l_suppkey) GROUP BY 1, 2"


def two_way_bias(spark, d):
    """Ridge biases of suppliers after three rounds against biases of contexts."""
    a, _ = linalg.two_way_bias(effect_matrix(spark, d), "l_suppkey", "context", "s", "n", 200.0, 50.0, 3)
    return rounded(a, "bias_a")


def _two_way_sql(rounds: int) -> str:
    parts = ["b0 AS (SELECT DISTINCT context, 0.0::DOUBLE AS v FROM e)"]
    for i in range(rounds):
        parts.append(f"a{i} AS (SELECT l_suppkey, sum(s - n * v) / (sum(n) + 200.0) AS bias_a FROM e JOIN b{i} USING (context) GROUP BY 1)")
        parts.append(f"b{i + 1} AS (SELECT context, sum(s - n * bias_a) / (sum(n) + 50.0) AS v FROM e JOIN a{i} USING (l_suppkey) GROUP BY 1)")
    return f"WITH {MATRIX}, {', '.join(parts)} SELECT l_suppkey, round(sum(s - n * v) / (sum(n) + 200.0), 6) AS bias_a FROM e JOIN b{rounds} USING (context) GROUP BY 1"


def candidates(spark, d) -> DataFrame:
    """Line items with four predictions: half, the prior rate, and effects at two strengths."""
    f = facts(spark, d)
    cells = prior_cells(spark, d).select("season", *KEYS, F.col("rate").alias("p2"), moved(50.0).alias("p3"), moved(800.0).alias("p4"))
    return f.join(cells, ["season", *KEYS]).select("season", "l_suppkey", "target", F.lit(0.5).alias("p1"), "p2", "p3", "p4")


NAMES = ["p1", "p2", "p3", "p4"]


def mean_products(spark, d) -> DataFrame:
    """One row: the mean product of the errors of each two of the candidates, from cells of equal predictions."""
    p = {"p1": F.lit(0.5), "p2": F.col("rate"), "p3": moved(50.0), "p4": moved(800.0)}
    product = lambda a, b: F.col("hits") * (p[a] - 1) * (p[b] - 1) + (F.col("n") - F.col("hits")) * p[a] * p[b]
    return prior_cells(spark, d).agg(*[(F.sum(product(a, b)) / F.sum("n")).alias(f"{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[i:]])


def error_gram(spark, d):
    """Mean products of the errors of the four candidates."""
    row = mean_products(spark, d)
    return row.unpivot([], row.columns, "pair", "product").withColumn("product", F.round("product", 6))


def _pred(k: float, name: str) -> str:
    return f"{name} AS (SELECT l_suppkey, l_linestatus, season, coalesce(sum(s) OVER w, 0) / (coalesce(sum(n) OVER w, 0) + {k}) AS {name} FROM cells WINDOW w AS (PARTITION BY l_suppkey, l_linestatus ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))"


ERRORS = f"""{predictions_sql()}, {_pred(50.0, 'weak')}, {_pred(800.0, 'strong')},
e AS (SELECT 0.5 - target AS p1, rate - target AS p2, least(greatest(rate + coalesce(weak, 0), 0), 1) - target AS p3, least(greatest(rate + coalesce(strong, 0), 0), 1) - target AS p4
  FROM f LEFT JOIN weak USING (l_suppkey, l_linestatus, season) LEFT JOIN strong USING (l_suppkey, l_linestatus, season) JOIN base USING (season))"""
ERROR_SQL = f"WITH {ERRORS} " + " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, round(avg({a} * {b}), 6) AS product FROM e" for i, a in enumerate(NAMES) for b in NAMES[i:])


def frank_wolfe_blend(spark, d):
    """Weights of the four candidates on the simplex with the least Brier score, and the certified gap."""
    row = mean_products(spark, d).first()
    if row[0] is None:  # no line
        return spark.createDataFrame([], "candidate string, weight double, brier double, certified boolean")
    g = np.array([[row[f"{min(a, b)}_{max(a, b)}"] for b in NAMES] for a in NAMES])
    w, gap = linalg.frank_wolfe(g)
    return spark.createDataFrame([(n, round(float(x), 6), round(float(w @ g @ w), 9), float(gap) < 1e-6) for n, x in zip(NAMES, w)], "candidate string, weight double, brier double, certified boolean")


def minimax_blend(spark, d):
    """Weights of the four candidates on the simplex for each year, with the least Brier score in the worst of the years before it; that score, how far it may be from the least, and this year's."""
    p = {"p1": F.lit(0.5), "p2": F.col("rate"), "p3": moved(50.0), "p4": moved(800.0)}
    product = lambda a, b: F.col("hits") * (p[a] - 1) * (p[b] - 1) + (F.col("n") - F.col("hits")) * p[a] * p[b]
    sums = prior_cells(spark, d).groupBy("season").agg(*[(F.sum(product(a, b)) / F.sum("n")).alias(f"{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[i:]])
    grams = {r["season"]: np.array([[r[f"{min(a, b)}_{max(a, b)}"] for b in NAMES] for a in NAMES]) for r in sums.collect() if r["season"] is not None}  # a row for each year
    rows = []
    for year in sorted(grams)[1:]:
        w, worst, gap = linalg.minimax_simplex(np.stack([g for y, g in grams.items() if y < year]))
        rows.append((year, *map(float, w), worst, gap, float(w @ grams[year] @ w)))
    out = spark.createDataFrame(rows, "season int, " + ", ".join(f"{n} double" for n in NAMES) + ", worst double, gap double, brier double")
    return rounded(out, *NAMES, "worst", "brier").withColumn("gap", F.round("gap", 9))


def additive_sweep(spark, d):
    """Brier scores of the base moved by a few weights of one correction, in one aggregation."""
    p = predictions(spark, d)
    weights = (0.0, 0.25, 0.5, 1.0)
    cols = [F.round(F.avg(F.pow(X.clip(F.col("base") + w * (F.col("p") - F.col("base")), 0.0, 1.0) - F.col("target"), 2)), 9).alias(f"w{i}") for i, w in enumerate(weights)]
    return p.groupBy("season").agg(*cols)


SWEEP_SQL = f"WITH {predictions_sql()} SELECT season, " + ", ".join(
    f"round(avg((least(greatest(base + {w} * (p - base), 0), 1) - target) ** 2), 9) AS w{i}" for i, w in enumerate((0.0, 0.25, 0.5, 1.0))) + " FROM predicted GROUP BY 1"


def block_sums(spark, d):
    """Paired losses summed by supplier and year: the blocks of the bootstrap."""
    p = predictions(spark, d)
    gap = F.pow(F.col("p") - F.col("target"), 2) - F.pow(F.col("base") - F.col("target"), 2)
    return rounded(p.groupBy("season", "l_suppkey").agg(F.sum(gap).alias("gap"), F.count("*").alias("n")), "gap")


BLOCK_SQL = f"WITH {predictions_sql()} SELECT season, l_suppkey, round(sum((p - target) ** 2 - (base - target) ** 2), 6) AS gap, count(*)::BIGINT AS n FROM predicted GROUP BY 1, 2"


def block_bootstrap(spark, d, replicates: int = 200):
    """Mean paired loss by year with a 95 % interval over Poisson-weighted blocks; weights are hashed, so runs agree."""
    b = block_sums(spark, d)
    u = (F.pmod(F.xxhash64("l_suppkey", "season", "replicate"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cdf = np.cumsum([1 / (np.e * float(np.prod(range(1, k + 1)) if k else 1)) for k in range(12)])
    weight = sum((u >= float(c)).cast("int") for c in cdf)
    r = b.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy("season", "replicate").agg((F.sum(weight * F.col("gap")) / F.nullif(F.sum(weight * F.col("n")), F.lit(0))).alias("m"))
    ci = r.groupBy("season").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = b.groupBy("season").agg((F.sum("gap") / F.sum("n")).alias("mean"))
    return rounded(mean.join(ci, "season").select("season", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), "mean", "low", "high")


FEATURES = ["l_quantity", "l_discount", "l_tax"]


def ridge_residual(spark, d):
    """Coefficients of the ridge of the outcome's residual on centred measures, from one Gram aggregation."""
    f = states.demeaned(facts(spark, d, *FEATURES), "target", "residual")
    means = f.agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    centred = f.select("residual", *[(F.col(c) - means[c]).alias(c) for c in FEATURES])
    beta = linalg.ridge(centred, FEATURES, "residual", 100.0)
    return spark.createDataFrame([(c, round(float(b), 9)) for c, b in zip(FEATURES, beta)], "feature string, coefficient double")


#: Years up to this one are fitted on, later ones scored.
LAST_FITTED = 1999


def weighted_rows(cells: DataFrame) -> DataFrame:
    """Two rows of each cell of fields: its hits under the label 1, the others under 0, as weights; the fields as a vector."""
    from pyspark.ml.feature import VectorAssembler

    from .learners import FIELDS

    each = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("hits").alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("hits")).alias("weight"))))
    rows = cells.select("season", "offset", *FIELDS, each.alias("e")).select("season", "offset", *FIELDS, "e.*").where("weight > 0")
    return VectorAssembler(inputCols=list(FIELDS), outputCol="features").transform(rows)


def scored_later(estimator, cells: DataFrame) -> DataFrame:
    """Of each year after LAST_FITTED: lines, Brier score of the earlier rate and of the model fitted on the years up to it, and the rate."""
    from pyspark.ml.functions import vector_to_array

    rows = weighted_rows(Stage(cells.sparkSession)(cells))  # a fit reads them many times; as many at most as the fields have values
    model = estimator.setWeightCol("weight").fit(rows.where(F.col("season") <= LAST_FITTED))
    p = model.transform(rows.where(F.col("season") > LAST_FITTED)).withColumn("p", vector_to_array("probability")[1])
    mean = lambda v: F.sum(F.col("weight") * v) / F.sum("weight")
    loss = lambda q: F.round(mean(F.pow(q - F.col("label"), 2)), 4)
    return p.groupBy("season").agg(F.sum("weight").cast("long").alias("n"), loss(X.expit(F.col("offset"))).alias("base"), loss(F.col("p")).alias("brier"), F.round(mean(F.col("label")), 4).alias("rate"))


def logistic(spark, d):
    """A logistic fit of the outcome on the binned fields of a line."""
    from pyspark.ml.classification import LogisticRegression

    from .learners import field_cells

    return scored_later(LogisticRegression(maxIter=50, regParam=1e-3), field_cells(spark, d))


def boosted_trees(spark, d):
    """Boosted trees of the outcome on the binned fields of a line."""
    from pyspark.ml.classification import GBTClassifier

    from .learners import field_cells

    return scored_later(GBTClassifier(maxIter=10, maxDepth=4, seed=7), field_cells(spark, d))


def random_forest(spark, d):
    """A random forest of the outcome on the binned fields of a line."""
    from pyspark.ml.classification import RandomForestClassifier

    from .learners import field_cells

    return scored_later(RandomForestClassifier(numTrees=20, maxDepth=6, seed=7), field_cells(spark, d))


def isotonic_bins(spark, d):
    """Effects of quantity bins made monotone by weighted isotonic regression, and recentred."""
    from pyspark.ml.regression import IsotonicRegression

    f = states.demeaned(facts(spark, d, "l_quantity"), "target", "residual")
    bins = f.groupBy(X.equal_width_bin(F.col("l_quantity"), 5.0).alias("bin")).agg((F.sum("residual") / (F.count("*") + 100.0)).alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight").fit(bins.withColumn("x", F.col("bin").cast("double")))
    out = model.transform(bins.withColumn("x", F.col("bin").cast("double")))
    mean = out.agg((F.sum(F.col("prediction") * F.col("weight")) / F.sum("weight")).alias("m")).first()["m"]
    return out.select("bin", F.round("label", 6).alias("effect"), F.round(F.col("prediction") - mean, 6).alias("monotone"))


ISOTONIC_SQL = f"""WITH {FACTS}, c AS (SELECT floor(l_quantity / 5)::INTEGER AS bin, sum(residual) / (count(*) + 100.0) AS label, count(*) AS w FROM (SELECT *, target - avg(target) OVER (PARTITION BY season) AS residual FROM f) GROUP BY 1),
r AS (SELECT a.bin AS i, b.bin AS j, (SELECT sum(w * label) / sum(w) FROM c x WHERE x.bin BETWEEN a.bin AND b.bin) AS mean FROM c a JOIN c b ON b.bin >= a.bin),
l AS (SELECT k.bin, i, min(mean) AS low FROM c k JOIN r ON i <= k.bin AND j >= k.bin GROUP BY 1, 2), q AS (SELECT bin, max(low) AS fitted FROM l GROUP BY 1)
SELECT bin, round(label, 6) AS effect, round(fitted - (SELECT sum(w * fitted) / sum(w) FROM q JOIN c USING (bin)), 6) AS monotone FROM q JOIN c USING (bin)"""


def kmeans_archetypes(spark, d):
    """Sizes and spreads of clusters of embeddings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label")
    model = KMeans(k=10, seed=7, maxIter=20).fit(e)
    return model.transform(e).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


def archetype_assignment(spark, d):
    """Each vector's nearest label centre, over centres as one short array; `soft_archetypes` has the soft weights."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    size = F.posexplode("x").alias("i", "v")
    centres = e.select("label", size).groupBy("label", "i").agg(F.avg("v").alias("c")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    known = centres.orderBy("label").collect()  # ten centres of 64 numbers
    distance = lambda c: F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.array(*[F.struct(distance(r["c"]).alias("d"), F.lit(r["label"]).alias("label")) for r in known]))
    return e.withColumn("near", near).groupBy("label", F.col("near.label").alias("assigned")).agg(F.count("*").alias("n"))


ASSIGN_SQL = """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS g, i, avg(v) AS c FROM u GROUP BY 1, 2),
dist AS (SELECT vec_id, label, g, sum((v - c) * (v - c)) AS d FROM u JOIN c USING (i) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, g) AS r FROM dist)
SELECT label, g AS assigned, count(*)::BIGINT AS n FROM r WHERE r = 1 GROUP BY 1, 2"""

QUERIES = {
    "effect_matrix": effect_cells, "lowrank_context": lowrank_context, "context_gram": context_gram, "two_way_bias": two_way_bias, "error_gram": error_gram,
    "frank_wolfe_blend": frank_wolfe_blend, "minimax_blend": minimax_blend, "additive_sweep": additive_sweep, "block_sums": block_sums, "block_bootstrap": block_bootstrap, "ridge_residual": ridge_residual,
    "logistic": logistic, "boosted_trees": boosted_trees, "random_forest": random_forest, "isotonic_bins": isotonic_bins,
    "kmeans_archetypes": kmeans_archetypes, "archetype_assignment": archetype_assignment,
}
ORACLES = {
    "effect_matrix": f"WITH {MATRIX} SELECT l_suppkey, context, round(effect, 6) AS effect, n::BIGINT AS n FROM e", "context_gram": GRAM_SQL, "two_way_bias": _two_way_sql(3),
    "error_gram": ERROR_SQL, "additive_sweep": SWEEP_SQL, "block_sums": BLOCK_SQL, "isotonic_bins": ISOTONIC_SQL, "archetype_assignment": ASSIGN_SQL,
}
