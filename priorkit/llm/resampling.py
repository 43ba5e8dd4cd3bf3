"""Target-distribution importance resampling in Spark SQL functions.

Runs of words are exploded and dealt to buckets by crc32; grouped counts of the
buckets over the corpus and over the target texts give a table of gains (log ratios
of smoothed frequencies), which is broadcast: it has as many rows as there are buckets.
A document's weight is the mean gain of its features. A Gumbel variate hashed from the id
is added, and the highest sums are drawn: a sample without replacement in proportion to
the exponentials of the weights. Ranks come from a distributed sort with offsets of
its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, table
from .ranks import ranked

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lowered
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case. Where all is ASCII the plain function does it."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, each joined by one space."""
    if longest == 1:
        return words
    runs = lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: i <= F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) > 0, F.concat(words, *[runs(k) for k in range(2, longest + 1)])).otherwise(words)


def worded(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep, __words): the words of each text, in their own case; null for a null text."""
    return texts.select(*keep, F.regexp_extract_all("text", F.lit(f"({_ANY})"), 1).alias("__words"))


def exploded(words: DataFrame, buckets: int, longest: int, *keep: str) -> DataFrame:
    """(keep, bucket): a row for each feature of each text; a text without features has one row with a null bucket."""
    features = words.select(*keep, F.explode_outer(ngrams(F.col("__words"), longest)).alias("__feature"))
    return features.select(*keep, (F.crc32(ascii_lower(F.col("__feature")).cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""
    return exploded(worded(texts), buckets, longest).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, scope: Scope, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, gain) of all buckets, in whole thousandths of a log ratio."""
    n = lambda df, name: scope(bucket_counts(df, buckets, longest).withColumnRenamed("n", name))  # noqa: E731  at most `buckets` rows
    corpus, wanted = n(docs, "s"), n(target, "t")
    total = lambda df, c: F.broadcast(df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}")))  # noqa: E731  one row
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(corpus), "bucket", "left").join(F.broadcast(wanted), "bucket", "left").na.fill(0, ["s", "t"])
    both = both.join(total(corpus, "s")).join(total(wanted, "t"))
    d = lambda c, k: F.col(c).cast("double") + k
    return both.select("bucket", F.floor(1000 * F.ln(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets)))).alias("gain"))


def importance_weights(docs: DataFrame, target: DataFrame, scope: Scope, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; weight is the floored mean gain, 0 without features."""
    gains = gain_table(docs, target, scope, buckets, longest)
    keyed = worded(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", "doc_id")  # rows of one id are rows of their own
    if longest > 1:  # else the features are the words
        keyed = keyed.withColumn("n_words", F.greatest(F.size("__words"), F.lit(0)).cast("long"))
    keep = ["__row", "doc_id", *(["n_words"] if longest > 1 else [])]
    found = exploded(keyed, buckets, longest, *keep).join(F.broadcast(gains), "bucket", "left")
    sums = found.groupBy("__row").agg(*[F.first(c).alias(c) for c in keep[1:]], F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("__sum"))
    if longest == 1:
        sums = sums.withColumn("n_words", F.col("n_features"))
    mean = F.when(F.col("n_features") > 0, F.expr("(__sum - pmod(__sum, n_features)) DIV n_features")).otherwise(F.lit(0).cast("long"))
    return sums.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def gumbel(seed: int) -> Column:
    """A variate in whole thousandths, hashed from doc_id; a null id reads 'null'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`.

    Of the rows with at least `least_words` words, `percent` hundredths are drawn: the highest
    scores, ties to the smaller doc_id, ranked from 1; the others have a null rank.
    Null and empty texts have no features and the weight 0. A null id draws as the text
    'null' and comes last among ties. Rows that repeat an id are rows of their own; where all of
    them tie, equal rows come in any order. Other columns are not read; an empty table gives
    an empty one, an empty target gains from the corpus alone.
    """
    scope, lasting = Scope(docs.sparkSession), Scope(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    scored = lasting(importance_weights(docs, target.select("text"), scope, buckets, longest).withColumn("score", F.col("weight") + gumbel(seed)))
    scope.close()
    fit = F.col("n_words") >= least_words
    wanted = F.floor(F.count("*") * percent / 100).alias("wanted")
    drawn = scored.where(fit).agg(wanted).first()["wanted"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    inside = ranked(scored.where(fit), order, "rank", lasting)
    number = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return inside.withColumn("rank", number).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark, sf_dir):
    """A tenth of all documents drawn after the texts of `benchmark`; nulls, empties, ties and repeated rows as in resample."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _features_sql(name: str, table: str, key: str) -> str:
    words = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    return f"{name} AS (SELECT {key} AS id, unnest({words}) AS w FROM {table})"


# crc32 of the distinct words: bytes from the hexadecimal digits, the usual table of 256 from its rule
SQL = rf"""WITH d AS (SELECT *, row_number() OVER () AS row FROM documents), {_features_sql('fd', 'd', 'row')}, {_features_sql('fb', 'benchmark', 'item_id')},
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
ws AS (SELECT w, list_transform(range(1, length(hex(w)), 2), lambda i: ('0x' || substr(hex(w), i::INTEGER, 2))::BIGINT) AS bytes FROM (SELECT w FROM fd UNION SELECT w FROM fb)),
bk AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM ws, tab),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN bk USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM fb JOIN bk USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT coalesce(sum(s), 0) + {BUCKETS} FROM s)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + {BUCKETS} FROM t)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
x AS (SELECT id, count(*) AS n, sum(gain) AS total FROM fd JOIN bk USING (w) JOIN g USING (bucket) GROUP BY 1),
k AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight, (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM d LEFT JOIN x ON d.row = x.id),
sc AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= floor({PERCENT} * n / 100) THEN r END AS rank FROM r"""

QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": SQL}
