"""What the text operators share: reading, splits, staged tables, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count has shown it to have at most so many narrow rows (about 100 bytes each in memory).
BROADCAST_ROWS = 200_000
#: Texts in an Arrow batch at most, so that a Python worker holds few long texts at a time.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see, from spark.checkpoint.dir.

    Where it is unset, a session within one process (as in tests) takes a temporary
    folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="priorkit-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, scope: "Scope | None" = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    A `scope` remembers the table, so that it can be deleted when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scope is not None:
        scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """Staged tables of one computation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        return staged(df, self)

    def close(self) -> None:
        """Delete the tables: only once every result that reads them is itself written."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths = []


def small_side(df: DataFrame, rows: int, bound: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if bound is None else bound) else df


def lowest_hashes(ids: DataFrame, bound: int, *columns: str) -> DataFrame:
    """At most `bound` rows of `ids`: those with the lowest hashes of `columns`, ties by the columns.

    A threshold on the hash, taken from a count, leaves about twice the wanted rows
    to the sort, however many rows there are.
    """
    key = F.xxhash64(*columns)
    share = min(1.0, (2 * bound + 200) / max(1, ids.count()))
    low = ids.where(key <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))) if share < 1 else ids
    return low.orderBy(key, *columns).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows outside the held-out part.

    Rows are chosen by a hash of doc_id, so the choice is the same at every run.
    Null labels and null ids are never chosen; of repeated ids the smallest label and the
    smallest text count.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    found = docs.select("doc_id", "text").join(F.broadcast(lowest_hashes(ids, bound, "doc_id")), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def chunks(texts: list, most_chars: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) runs of about `most_chars` characters; null becomes empty. A longer text stands alone."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > most_chars:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run
