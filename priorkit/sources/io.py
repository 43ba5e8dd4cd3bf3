"""Column-pruned scans with explicit schemas, contracts on inputs, and frozen states."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where it is unset, a session within one process (as in tests) takes a temporary folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="priorkit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stage:
    """Tables written to the shared folder and read back, which cuts lineage and survives lost executors; as a context, deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Like a call, but kept in buckets of `key`: joins of two such tables on it, and groupings by it, move no rows. Read it before `drop_tables`."""
        parts = 3 * max(self.spark.sparkContext.defaultParallelism, 1)
        name, path = f"stage_{uuid.uuid4().hex}", f"{shared_folder(self.spark)}/stage-{uuid.uuid4().hex}"
        self.paths.append(path)
        self.tables.append(name)
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def drop_tables(self) -> None:
        """Take the names of bucketed tables from the catalog."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.drop_tables()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths = []


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with header, UTF-8 with or without a byte-order mark, by an explicit schema; NaN becomes null."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).csv(path)
    return nan_to_null(df.select(*columns) if columns else df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def required_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df`, or a ValueError that names what is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def contract_report(rows: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """One row of violation counts: null keys, duplicate keys, keys missing from either side."""
    left, right = rows.select(key), template.select(key)
    nulls = left.agg(F.count_if(F.col(key).isNull()).alias("null_keys"))
    twice = left.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    missing = right.join(left, key, "left_anti").agg(F.count("*").alias("missing_keys"))
    extra = left.join(right, key, "left_anti").agg(F.count("*").alias("extra_keys"))
    parts = [p.withColumn("one", F.lit(1)) for p in (nulls, twice, missing, extra)]
    out = parts[0]
    for p in parts[1:]:  # joins of single rows
        out = out.join(p, "one")
    return out.drop("one")


def order_violations(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of each key, the rows whose ordinal is below the previous row's."""
    before = F.lag(ordinal).over(Window.partitionBy(key).orderBy("position"))
    return df.withColumn("before", before).groupBy(key).agg(F.count_if(F.col("before") > F.col(ordinal)).alias("violations"))


def save_state(state: DataFrame, path: str, through: int) -> None:
    """Freeze a state table with the last period it has seen."""
    state.withColumn("through_period", F.lit(through)).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """A frozen state; with `before`, an error unless all of it was seen before that period."""
    state = spark.read.parquet(path)
    if before is not None and state.where(F.coalesce(F.col("through_period") >= before, F.lit(True))).limit(1).count():
        raise ValueError(f"the state at {path} has seen period {before} or later")
    return state


def load_candidates(spark: SparkSession, path: str, season: int) -> DataFrame:
    """(row_id, candidate, p) of one season's stored predictions: only that season's folders are read; a prediction outside [0, 1] is an error."""
    stored = spark.read.parquet(path).where(F.col("season") == season)
    wild = F.raise_error(F.concat(F.lit("prediction out of range: "), F.coalesce(F.col("p").cast("string"), F.lit("null"))))
    return stored.select("row_id", "candidate", F.when(F.coalesce(F.col("p").between(0.0, 1.0), F.lit(False)), F.col("p")).otherwise(wild).alias("p"))


def write_predictions(template: DataFrame, predictions: DataFrame, key: str, value: str, path: str, position: str | None = None) -> None:
    """CSV parts of (key, value) for every row of `template`; a missing value or one outside [0, 1] fails the write.

    Repeated keys in `predictions` fail too, as which one counts is open. With `position`, the parts are ordered by it.
    """
    values = predictions.select(key, value).groupBy(key).agg(F.first(value).alias(value), F.count("*").alias("_rows"))
    joined = template.select(*dict.fromkeys([key, *([position] if position else [])])).join(values, key, "left")
    good = (F.col("_rows") == 1) & F.col(value).between(0.0, 1.0)
    checked = F.when(F.coalesce(good, F.lit(False)), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("no valid prediction for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    out = joined.withColumn(value, checked)
    (out.orderBy(position) if position else out).select(key, value).write.option("header", True).csv(path)


def write_candidates(predictions: DataFrame, path: str) -> None:
    """Stored predictions, one folder for each candidate and season, so that a reader of one scans no other."""
    predictions.write.partitionBy("candidate", "season").parquet(path)


#: A side is broadcast only when a count shows at most so many narrow rows.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `bound` rows, by a count that stops beyond them; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
