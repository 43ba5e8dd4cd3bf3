"""Streams scored against frozen states, sessionised by gaps, and folded into cumulative states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import shared_folder


def read_stream(spark: SparkSession, like: DataFrame, path: str, files: int = 1000) -> DataFrame:
    """A file stream of the same schema as the batch table `like`; `path` may be a glob."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def scored(stream: DataFrame, state: DataFrame, keys: list[str], default: float) -> DataFrame:
    """Rows with the value of a frozen state, `default` where it has none: independent of how rows fall into micro-batches."""
    return stream.join(state, keys, "left").withColumn("score", F.coalesce("value_of_state", F.lit(default))).drop("value_of_state")


def gap_sessions(stream: DataFrame, user: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions by a gap of inactivity, with a watermark for late rows."""
    w = F.session_window(F.col(ts), gap)
    return stream.withWatermark(ts, late).groupBy(user, w.alias("session")).agg(F.count("*").alias("n")).select(user, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def season_states(stream: DataFrame, entity: str, period: str, target: str) -> DataFrame:
    """(entity, period, n, s): cumulative counts of an entity at the end of each of its periods, from a drained stream.

    Each micro-batch leaves its counts by entity and period in a folder of its own, so a batch run
    again replaces them. Their sums, in the order of periods, do not depend on how rows fall into micro-batches.
    """
    spark = stream.sparkSession
    base = _folder(spark)

    def fold(batch: DataFrame, i: int) -> None:
        counts = batch.groupBy(entity, period).agg(F.count("*").alias("n"), F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("s"))
        counts.write.mode("overwrite").parquet(f"{base}/out/batch-{i}")

    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (entity, period))
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema(f"{kinds}, n long, s long").parquet(f"{base}/out/batch-*")
    w = Window.partitionBy(entity).orderBy(F.asc_nulls_last(period)).rowsBetween(Window.unboundedPreceding, 0)
    return parts.groupBy(entity, period).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumns({c: F.sum(c).over(w) for c in "ns"})


def _folder(spark: SparkSession) -> str:
    """A new folder for a drained stream in the shared one; an error on a cluster that names none."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Drain an append-mode stream into a table in the shared folder, and read it."""
    base = _folder(spark)
    schema = stream.schema
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")
