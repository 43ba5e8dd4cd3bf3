"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents, weight w and a wanted total T has the mean repetition
rate w*T/n. Each document's number of copies is the inverse of the Poisson
distribution with that mean at a uniform number hashed from (seed, doc_id), so it
is the same at every run and on every executor. Copies are dealt to partitions and
sorted by a hash of (seed, doc_id, copy): a global shuffle without a coordinator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged, table

ALPHA = 0.5
SEED = 17
#: Sources whose rates may be broadcast; with more, the join is shuffled by (source, salt).
MOST_BROADCAST = 10_000
SALTS = 32
OUT = ("n_copies", "copy_no", "shuffle_key")


def hashed(seed: int, *parts: str | Column) -> Column:
    """52 bits of an md5 over the parts as text, as a long; nulls read 'null'."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *text)), 1, 13), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as a double can tell it from 1."""
    terms = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    step = lambda acc, k: F.struct(
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("cdf"),
        (acc["log_p"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log_p"),
    )
    first = F.struct(F.array(F.exp(-rate)).alias("cdf"), (-rate).alias("log_p"))
    return F.aggregate(F.sequence(F.lit(1), terms), first, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """(source, n_docs, weight, rate) per source.

    `weights` are target shares by source (a source that is not named gets 0);
    without them a share is in proportion to n_docs ** alpha. `total` defaults to
    the number of documents. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        named = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()]
        share = F.coalesce(*named, F.lit(0.0))
    sizes = staged(sizes.withColumn("share", share))
    sums = sizes.agg(F.sum("n_docs").alias("n"), F.sum("share").alias("s")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    return sizes.select("source", "n_docs", (F.col("share") / F.lit(sums["s"] or 1.0)).alias("weight")).withColumn(
        "rate", F.col("weight") * F.lit(wanted) / F.col("n_docs")
    )


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Every document of `docs` as often as its drawn count says, in a shuffled order.

    Adds n_copies, copy_no (from 1) and shuffle_key; columns of these names in the
    input are replaced. A count of 0 leaves a document out: that is the draw of a
    source weighted below its share. Rows with the same doc_id draw the same count;
    null ids hash as 'null'; an empty table gives an empty one.
    """
    docs = docs.drop(*OUT)
    rates = source_rates(docs, weights, alpha, total).select(
        F.col("source").alias("__mix_source"), F.when(F.col("rate") > 0, poisson_cdf(F.col("rate"))).alias("__mix_cdf")
    )
    n = rates.count()
    if n <= MOST_BROADCAST:
        rated = docs.join(small_side(rates, n, MOST_BROADCAST), docs["source"].eqNullSafe(rates["__mix_source"]), "left")
    else:
        salted = docs.withColumn("__mix_salt", (hashed(seed, "doc_id", F.lit("salt")) % SALTS).cast("int"))
        spread = rates.withColumn("__mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = salted.join(
            spread, salted["source"].eqNullSafe(spread["__mix_source"]) & (salted["__mix_salt"] == spread["__mix_salt2"]), "left"
        ).drop("__mix_salt", "__mix_salt2")
    u = hashed(seed, "doc_id") / F.lit(float(1 << 52))
    count = F.coalesce(F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_u"))), F.lit(0))
    copies = (
        rated.withColumn("__mix_u", u)
        .withColumn("n_copies", F.when(F.col("__mix_cdf").isNull(), 0).otherwise(count))
        .drop("__mix_source", "__mix_cdf", "__mix_u")
        .where(F.col("n_copies") > 0)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", hashed(seed, F.lit("shuffle"), "doc_id", "copy_no"))
    )
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op3_mix_sources(spark, sf_dir):
    """All documents mixed by the square root of their source's size; nulls, ties and repeated rows as in mix_sources."""
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
totals AS (SELECT sum(n_docs) AS n, sum(power(n_docs::DOUBLE, {ALPHA})) AS s FROM sizes),
rates AS (SELECT source, (power(n_docs::DOUBLE, {ALPHA}) / s) * n / n_docs AS rate FROM sizes, totals),
terms AS (
  SELECT source, k, exp(sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p
  FROM rates, (SELECT unnest(range(0, 400))::BIGINT AS k)
  WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)),
cdfs AS (SELECT source, list(c ORDER BY k) AS cdf FROM (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, cdf
  FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT * EXCLUDE (u, cdf), len(list_filter(cdf, lambda x: x <= u))::INTEGER AS n_copies FROM drawn)
SELECT * EXCLUDE (r), (r + 1)::INTEGER AS copy_no,
  ('0x' || substr(md5('{SEED}:shuffle:' || coalesce(doc_id::VARCHAR, 'null') || ':' || (r + 1)), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS r FROM counted)
"""

QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES = {"op3_mix_sources": SQL}
