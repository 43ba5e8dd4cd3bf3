"""Shards of even size that keep linked documents together: balanced label propagation in DataFrame functions only.

Documents of one group (here equal texts) are linked. Each starts in a shard by a
hash. Copies in one shard are alike, so the state is a table of cells (group, shard, how many),
which has no row for each pair, nor for each copy. A round joins every cell with the best shard of its group:
that which holds most of it among the shards with room that no round has filled yet. The wanted moves are summed
by pair of shards, a matrix of shards x shards; from it quotas follow, the greatest shares of
the moves that leave no shard above its capacity, counting what leaves it. Moves are joined with
the quotas and taken in part. A group larger than a shard fills one after the other. It ends
when nothing worth a round moves.

Documents without a link may go anywhere: they fill what room is left. Last, all rows are
put in the order of their shards by a distributed sort, and cut at the exact
quotas, so that counts differ by one at most; the rows at the cuts are unlinked ones where there are any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scope, small_side, table
from .ranks import ranked

SHARDS, SEED = 24, 5
#: Rounds end when less than this share of the linked documents moves, or less than this share of a shard's capacity is free.
LEAST_MOVED, LEAST_ROOM = 0.001, 0.01
#: Groups with at least one in so many rows are joined by broadcast: there are no more of them than that.
HOT = 2000


def uniform(*columns: str | Column) -> Column:
    """A number in [0, 1) hashed from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11)).cast("double") / float(1 << 53)


def shares(wanted: np.ndarray, loads: np.ndarray, capacity: float) -> np.ndarray:
    """Which share of the moves into each shard to allow, at most 1, so that none exceeds `capacity`.

    `wanted[i, j]` is what would move from i to j. From all moves down: a share
    is what room there is, with what leaves under the present shares, over what wants in. The shares only
    fall, so this ends at the greatest ones that are feasible.
    """
    share = np.ones(len(loads))
    into = wanted.sum(axis=0)
    for _ in range(200):
        room = capacity - loads + wanted @ share
        now = np.minimum(share, np.where(into > 0, np.clip(room / np.maximum(into, 1), 0, 1), 1.0))
        if np.abs(now - share).max() < 1e-9:
            break
        share = now
    return share


def pick(values: np.ndarray, at: Column) -> Column:
    """The value of a short list at a shard number."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))


def by_shard(df: DataFrame, shards: int, *keys: str) -> np.ndarray:
    """Sums of n by one or two columns of shard numbers, as an array of `shards` to a side."""
    out = np.zeros([shards] * len(keys))
    for r in df.groupBy(*keys).agg(F.sum("n").alias("n")).collect():  # as many as shards, or pairs of them
        out[tuple(r[k] for k in keys)] = r["n"]
    return out


def propagated(cells: DataFrame, capacity: float, shards: int, scope: Scope) -> DataFrame:
    """(group, shard, n): the cells after balanced label propagation."""
    cells = scope(cells)
    loads = by_shard(cells, shards, "shard")
    linked = loads.sum()
    full = np.zeros(shards, bool)  # shards that rounds have filled
    for i in range(4 * shards):
        open_ = ~full & (capacity - loads > LEAST_ROOM * capacity)
        rank = F.struct("n", uniform("group", "shard").alias("tie"))
        best = cells.where(pick(open_, F.col("shard")) > 0).groupBy("group").agg(F.max(rank).alias("most"), F.max_by("shard", rank).alias("to"))
        own = F.struct(F.col("n"), uniform("group", "shard").alias("tie"))
        moves = scope(cells.join(best, "group").where(own < F.col("most")).select("group", "shard", "to", "n"))
        wanted = by_shard(moves, shards, "shard", "to")
        share = shares(wanted, loads, capacity)
        full |= (share < 1) & (capacity - loads + wanted @ share - wanted.sum(axis=0) * share < LEAST_ROOM * capacity)
        if (wanted * share).sum() <= LEAST_MOVED * linked:
            if not (full & open_).any():
                break
            continue
        taken = F.floor(F.col("n") * pick(share, F.col("to")) + uniform("group", "shard", F.lit(i))).cast("long")
        moves = moves.withColumn("n", F.least("n", taken)).where("n > 0")
        gone = moves.select("group", "shard", (-F.col("n")).alias("n"))
        come = moves.select("group", F.col("to").alias("shard"), "n")
        cells = scope(cells.unionByName(gone).unionByName(come).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        loads = by_shard(cells, shards, "shard")
    return cells


def interval(u: Column, ends: Column) -> Column:
    """In which of the intervals that end at ascending `ends` (the last at 1) u lies, from 0."""
    return F.size(F.filter(ends, lambda e: e <= u))


def balanced_shards(rows: DataFrame, group: str, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`rows` with shard (0 to shards - 1) and slot (from 0 in each shard), counts at most one apart; rows of a null group are linked with nothing.

    Rows of one `group` are linked. `key` tells rows apart where it can: rows of equal key and group start in
    one shard. The columns shard and slot are replaced if there. An empty table gives an empty one.
    """
    scope, lasting = Scope(rows.sparkSession), Scope(rows.sparkSession)
    rows = rows.drop("shard", "slot")
    rows = lasting(rows.withColumn("__key", F.xxhash64(F.lit(SEED), *key, group)).withColumn("__row", F.monotonically_increasing_id()))
    total = rows.count()
    grouped = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), (F.pmod("__key", F.lit(shards))).cast("int").alias("shard"))
    start = scope(grouped.groupBy("group", "shard").agg(F.count("*").alias("n")))
    sizes = start.groupBy("group").agg(F.sum("n").alias("size")).where("size > 1")
    sizes = scope(sizes)
    linked = start.join(small_side(sizes.select("group"), sizes.count()), "group", "left_semi")
    cells = propagated(linked, total / shards, shards, scope)

    room = np.maximum(total / shards - by_shard(cells, shards, "shard"), 0)
    room = room if room.sum() > 0 else np.ones(shards)
    ends = np.cumsum(room / room.sum())
    ends[-1] = 1.0
    # each group's shards, at most `shards` of them, with the shares of its rows that go there
    cell = F.sort_array(F.collect_list(F.struct("shard", "n")))
    mapped = cells.groupBy("group").agg(cell.alias("__cells"), F.sum("n").alias("__n"))
    running = F.transform("__cells", lambda c: F.aggregate(F.filter("__cells", lambda d: d["shard"] <= c["shard"]), F.lit(0).cast("long"), lambda a, d: a + d["n"]) / F.col("__n"))
    mapped = scope(mapped.select(F.col("group").alias("__group"), F.col("__cells.shard").alias("__to"), running.alias("__ends"), "__n"))
    on = F.col(group) == F.col("__group")
    hot = mapped.where(F.col("__n") * HOT >= total).drop("__n")
    cold = mapped.where(F.col("__n") * HOT < total).drop("__n")
    first = rows.join(F.broadcast(hot), on)  # at most HOT groups
    rest = rows.join(F.broadcast(hot.select("__group")), on, "left_anti")
    n_cold = cold.limit(BROADCAST_ROWS + 1).count()
    placed = first.unionByName(rest.join(small_side(cold, n_cold), on, "left"))
    u = uniform("__key", F.lit("cell"))
    to = F.element_at("__to", F.least(interval(u, F.col("__ends")) + 1, F.size("__to")))
    free = F.least(interval(uniform("__key", F.lit("free")), F.array(*map(F.lit, ends.tolist()))), F.lit(shards - 1))
    side = F.when(F.pmod(F.shiftright("__key", 8), F.lit(2)) == 0, 0).otherwise(2)  # unlinked rows to both ends of their shard
    label = placed.withColumns({
        "__shard": F.coalesce(to, free).cast("int"),
        "__zone": F.when(F.col("__to").isNull(), side).otherwise(1),
    }).drop("__to", "__ends", "__group")
    order = [F.asc("__shard"), F.asc("__zone"), F.when(F.col("__zone") == 1, F.col(group)).asc(), F.asc("__key"), F.asc("__row")]
    at = ranked(label, order, "__place", lasting)
    scope.close()
    place = F.col("__place")
    shard = F.expr(f"__place * {shards} DIV {max(total, 1)}").cast("int")
    first_place = F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")  # the least place that falls into the shard
    return at.withColumn("shard", shard).withColumn("slot", (place - first_place).cast("long")).drop("__key", "__row", "__shard", "__zone", "__place")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group): the group of a row is the digest of its text; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"))


def op13_sharding(spark, sf_dir):
    """All documents in SHARDS shards, equal texts together as far as shards hold them, counts at most one apart.

    Null and empty texts are equal; they have a size of 8. Null ids and repeated rows are
    rows like others; ties are broken by hashes; an empty table gives an empty one; other columns are not read.
    """
    out = balanced_shards(sized(table(spark, sf_dir, "documents")), "group")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_sharding": op13_sharding}
ORACLES = {}
