"""Ranks over a whole table by a distributed sort: positions within ranges plus the sizes of the ranges before.

The ordered rows are written once. No window runs over the table: only the counts of the
ranges, a row for each partition, are summed in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A partition's part of monotonically_increasing_id is above this many bits.
BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with the 0-based position of each row in `order` as the long `name`; rows that `order` leaves equal come in any order.

    `stage` writes a table to the shared folder. The last of `order` should tell rows of a hot value apart,
    so that no range is one value.
    """
    inside = stage(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", BITS), F.col("__at").bitwiseAND(F.lit((1 << BITS) - 1))
    sizes = inside.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = sizes.select("__part", before.alias("__before"))
    return inside.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + place).drop("__part", "__before", "__at")
