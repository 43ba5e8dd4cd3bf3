"""Joins that decide which keys of two sources are the same entity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


def sequence_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """(keys, n, sequence): the ordered values of each key as one text."""
    items = F.sort_array(F.collect_list(F.struct(*order, value.cast("string").alias("__v"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda s: s["__v"]), ",").alias("sequence"))


def unique_matches(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs of ids whose `on` columns are equal and belong to one id on either side."""
    one = lambda df, key: df.groupBy(*on).agg(F.min(key).alias(key), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return one(left, left_id).join(one(right, right_id), list(on)).select(left_id, right_id)


def majority_mapping(pairs: DataFrame, a: str, b: str, least_rows: int, purity: float) -> DataFrame:
    """(a, b, n, share): each a's most frequent b, the smallest on ties, if it has enough rows and share."""
    counts = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    best = counts.groupBy(a).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), F.col(b).alias("b"))).alias("m"))
    share = -F.col("m.neg") / F.col("total")
    return best.where((F.col("total") >= least_rows) & (share >= purity)).select(a, F.col("m.b").alias(b), (-F.col("m.neg")).alias("n"), share.alias("share"))


def mutual_best(scored: DataFrame, a: str, b: str, score: str, within: Sequence[str] = ()) -> DataFrame:
    """Pairs that are each other's best, in each block of `within`; ties go to the smaller key. With the margin to a's runner-up."""
    wa, wb = Window.partitionBy(*within, a).orderBy(F.desc(score), b), Window.partitionBy(*within, b).orderBy(F.desc(score), a)
    ranked = scored.withColumns({"__ra": F.row_number().over(wa), "__rb": F.row_number().over(wb), "__next": F.lead(score).over(wa)})
    return ranked.where("__ra = 1 AND __rb = 1").select(*within, a, b, score, (F.col(score) - F.col("__next")).alias("margin"))


def least_cost(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the one-to-one assignment of least total cost (shortest augmenting paths); needs rows <= columns."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while row_of[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row_of[j] - 1, free - 1] - u[row_of[j]] - v[free]
            closer = slack < least[free]
            least[free[closer]], way[free[closer]] = slack[closer], j
            k = free[np.argmin(least[free])]
            step = least[k]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = np.zeros(n, np.int64)
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def assign_within(costs: DataFrame, block: str, a: str, b: str, cost: str) -> DataFrame:
    """(block, a, b, cost): the least-cost one-to-one assignment inside every block of a blocking key.

    As many pairs as can be are made; missing pairs are left out. With k keys on the smaller side of
    a block, only the k cheapest partners of each can be in a best assignment: the others take
    k - 1 of them at most. So at most k * k costs of a block meet in one task.
    """
    known = F.col(cost).isNotNull() & ~F.isnan(F.col(cost).cast("double")) & F.col(a).isNotNull() & F.col(b).isNotNull()
    schema = costs.select(block, a, b, cost).schema
    costs = costs.where(known).groupBy(block, a, b).agg(F.min(cost).alias(cost))
    sides = [costs.select(block, c).distinct().groupBy(block).agg(F.count("*").alias(f"__{n}")) for c, n in ((a, "na"), (b, "nb"))]
    sizes = sides[0].join(sides[1], sides[0][block].eqNullSafe(sides[1][block])).select(sides[0][block].alias("__block"), "__na", "__nb")
    most = sizes.agg(F.max(F.least("__na", "__nb"))).first()[0] or 0
    sized = costs.join(sizes, costs[block].eqNullSafe(F.col("__block"))).drop("__block")

    def cheapest(rows: DataFrame, few: str, many: str) -> DataFrame:  # a literal bound, so that ranks are cut before the shuffle
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(block, few).orderBy(cost, many))).where(F.col("__r") <= most).where(F.col("__r") <= F.least("__na", "__nb"))

    near = cheapest(sized.where("__na >= __nb"), b, a).unionByName(cheapest(sized.where("__na < __nb"), a, b))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=a, columns=b, values=cost, aggfunc="min").sort_index()
        flip = table.shape[0] > table.shape[1]
        x = (table.T if flip else table).to_numpy(float)
        dear = np.nanmax(np.abs(x)) * (min(x.shape) + 1) * 2 + 1
        j = least_cost(np.where(np.isnan(x), dear, x))
        rows = [(i, k) if not flip else (k, i) for i, k in enumerate(j) if not np.isnan(x[i, k])]
        return pd.DataFrame([(pdf[block].iat[0], table.index[i], table.columns[k], table.iat[i, k]) for i, k in rows], columns=[block, a, b, cost])

    return near.select(block, a, b, cost).groupBy(block).applyInPandas(solve, schema)


def symbols_of(sequence: Column) -> Column:
    """Each character of a text with the number of its occurrence, in the order of characters: texts share as many as their characters match at most."""
    c = F.array_sort(F.split(sequence, ""))
    return F.transform(c, lambda x, i: F.concat(x, (i - F.array_position(c, x)).cast("string")))


def alike_sequences(rows: DataFrame, block: Sequence[str], key: str, sequence: str, ratio: float) -> DataFrame:
    """(a, b, ratio): all pairs of keys in a block whose ordered sequences match to `ratio`. Quadratic in the keys of one sequence: `alike_classes` has a row for each."""
    block = list(block)
    classes, members = _matched(rows, block, key, sequence, ratio)
    sides = [members.select(*block, F.col("class").alias(f"class_{k}"), F.col("key").alias(k)) for k in "ab"]
    same = sides[0].withColumn("class_b", F.col("class_a")).join(sides[1], [*block, "class_b"]).where("a < b").withColumn("ratio", F.lit(1.0))
    unlike = classes.withColumnsRenamed({"a": "class_a", "b": "class_b"}).join(sides[0], [*block, "class_a"]).join(sides[1], [*block, "class_b"]).where("a < b")
    return same.select("a", "b", "ratio").unionByName(unlike.select("a", "b", "ratio"))


def alike_classes(rows: DataFrame, block: Sequence[str], key: str, sequence: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(block, a, b, ratio) and (block, class, key): classes of keys of a block with one sequence, under their smallest key, and pairs of classes, a < b, whose sequences match to `ratio` by longest matching blocks.

    Null keys, blocks and sequences are left out.
    """
    pairs, members = _matched(rows, list(block), key, sequence, ratio)
    return pairs.where("a < b"), members


def shared_symbols(a: str, b: str) -> Column:
    """How many characters two texts share, their order aside."""
    times = lambda text, c: F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def _symbols_allow(ratio: float) -> Column:
    """Whether lengths and characters of kind_a and kind_b, their order aside, allow the ratio."""
    n = F.length("kind_a") + F.length("kind_b")
    enough = n * F.lit(ratio) - 1e-9
    return F.when(2 * F.least(F.length("kind_a"), F.length("kind_b")) < enough, False).otherwise(2 * shared_symbols("kind_a", "kind_b") >= enough)


def _met_kinds(left: DataFrame, right: DataFrame, block: list[str], ratio: float) -> DataFrame:
    """(block, kind_a, kind_b): kinds of either side of a block whose symbols allow the ratio."""
    kinds = left.select("kind").union(right.select("kind")).distinct().withColumn("n", F.length("kind"))
    each = kinds.select("kind", "n", F.explode(symbols_of(F.col("kind"))).alias("symbol"))
    often = each.groupBy("symbol").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("often", "symbol"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(ratio / (2 - ratio)) - 1e-9) + 1  # of n symbols a partner shares the others at least
    prefix = each.join(often, "symbol").withColumn("rank", rank).where(F.col("rank") <= first)
    sides = [held.select(*block, "kind").distinct().join(prefix, "kind") for held in (left, right)]
    x, y = (side.select(*block, "symbol", F.col("kind").alias(f"kind_{k}"), F.col("n").alias(f"n_{k}")) for k, side in zip("ab", sides))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(ratio / (2 - ratio)) - 1e-9
    return x.join(y, [*block, "symbol"]).where(near).select(*block, "kind_a", "kind_b").distinct().where(_symbols_allow(ratio))


def _matched(rows: DataFrame, block: list[str], key: str, sequence: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes in both orders, as the matcher's ratio depends on it, and the members.

    A pair reaches the matcher if `_near_texts` lets it: by segments, or if its characters, their order aside, allow the ratio. Texts with
    the same characters make one kind; kinds of a large block meet on their rarest symbols, one of which a partner has to share.
    """
    members = rows.select(*block, F.col(key).alias("key"), F.col(sequence).alias("s")).where("s IS NOT NULL AND key IS NOT NULL")
    first = held_classes(members, block)
    near = _near_texts(first, first, block, ratio).where("sa != sb")
    return matched(near, ratio).select(*block, "a", "b", "ratio"), members.join(first, [*block, "s"]).select(*block, "class", "key")


def held_classes(members: DataFrame, block: list[str]) -> DataFrame:
    """(block, s, class): the smallest key of each sequence of a block."""
    return members.where(F.col("key").isNotNull()).groupBy(*block, "s").agg(F.min("key").alias("class"))


#: Texts of this length at most meet on segments, if the ratio is high enough for segments of some letters; others on their rarest symbols.
SEGMENTED, SEGMENT_RATIO = 48, 0.85
#: Texts of a block with at most so many pairs are held against each other as they are.
PAIRS_OF_A_BLOCK = 4096


def segment_plans(ratio: float, longest: int = SEGMENTED) -> tuple[list[tuple], list[tuple]]:
    """Rows (n, other, i, at, size) of the left and of the right side: where a text of length n is cut for partners of length `other`.

    Texts of lengths a and b that match to `ratio` are at most d = (1 - ratio) * (a + b) deletions and insertions apart, of the parity
    of a - b. Of d + 1 segments of the left one some segment i is whole in the right one, with exactly i of them before it
    and at most d - i behind: it is moved by -i, -i + 2, ... or i.
    """
    left, right = [], []
    for a in range(1, longest + 1):
        for b in range(int(a * ratio / (2 - ratio)), int(a * (2 - ratio) / ratio) + 2):
            d = int((1 - ratio) * (a + b) + 1e-9)
            d -= (d - abs(a - b)) % 2
            if b < 1 or d < abs(a - b):
                continue
            for i in range(d + 1):
                at, end = i * a // (d + 1), (i + 1) * a // (d + 1)
                left.append((a, b, i, at, end - at))
                right += [(b, a, i, at + m, end - at) for m in range(-i, i + 1, 2) if abs(b - a - m) <= d - i and 0 <= at + m <= b - (end - at)]
    return left, right


def symbol_bits(text: Column) -> Column:
    """A bit for each character of a text, up to twelve of each of five groups by code point: texts d deletions and insertions apart differ in d bits at most."""
    group = lambda g: F.size(F.filter(F.split(text, ""), lambda c: F.ascii(c) % 5 == g))
    return sum((F.pow(F.lit(2.0), F.least(group(g), F.lit(12))) - 1).cast("long") * (1 << 12 * g) for g in range(5))


def _near_texts(left: DataFrame, right: DataFrame, block: list[str], ratio: float) -> DataFrame:
    """(block, a, b, sa, sb): classes (block, class, s) of either side whose texts may match to `ratio`."""
    named = [side.select(*block, F.col("class").alias(k), F.col("s").alias(f"s{k}")) for k, side in zip("ab", (left, right))]
    longer = F.length("sa") > (SEGMENTED if ratio >= SEGMENT_RATIO else 0)
    kinds = [side.withColumn("kind", F.array_join(F.array_sort(F.split(f"s{k}", "")), "")) for k, side in zip("ab", named)]
    kinds[0] = kinds[0].where(longer)
    if ratio >= SEGMENT_RATIO:
        kinds[1] = kinds[1].where(F.length("sb") > int(SEGMENTED * ratio / (2 - ratio)))
    sizes = [side.groupBy(*block).agg(F.count("*").alias(f"n_{k}")) for k, side in zip("ab", kinds)]
    large = sizes[0].join(sizes[1], block).where(F.col("n_a") * F.col("n_b") > PAIRS_OF_A_BLOCK).select(*block)
    a, b = (h.withColumnRenamed("kind", f"kind_{k}") for h, k in zip(kinds, "ab"))
    few = a.join(large, block, "left_anti").join(b, block).where(_symbols_allow(ratio))
    kinds = [side.join(large, block, "left_semi") for side in kinds]
    met = _met_kinds(*kinds, block, ratio)
    a, b = (h.withColumnRenamed("kind", f"kind_{k}") for h, k in zip(kinds, "ab"))
    many = a.join(met, [*block, "kind_a"]).join(b, [*block, "kind_b"])
    near = few.select(*block, "a", "b", "sa", "sb").unionByName(many.select(*block, "a", "b", "sa", "sb"))
    if ratio < SEGMENT_RATIO:
        return near
    cut = []
    for k, side, plan in zip("ab", named, segment_plans(ratio)):
        rows = side.sparkSession.createDataFrame(plan, "n int, other int, i int, at int, size int")
        lengths = ("n", "other") if k == "a" else ("other", "n")
        held = side.withColumns({"n": F.length(f"s{k}"), f"bits_{k}": symbol_bits(F.col(f"s{k}"))}).join(F.broadcast(rows), "n")  # bounded by the lengths
        cut.append(held.select(*block, k, f"s{k}", f"bits_{k}", *[F.col(c).alias(x) for c, x in zip(lengths, ("na", "nb"))], "i", F.substring(F.col(f"s{k}"), F.col("at") + 1, F.col("size")).alias("piece")))
    most = f"int((na + nb) * {float(1 - ratio)!r}D + 1e-9D)"  # deletions and insertions
    close = F.expr(f"bit_count(bits_a ^ bits_b) <= {most} AND levenshtein(sa, sb, {most}) >= 0")  # in the join itself: pairs that meet grow with the square of a block and are not to be written
    short = cut[0].join(cut[1], [*block, "na", "nb", "i", "piece"]).where(close).select(*block, "a", "b", "sa", "sb").distinct()
    return near.unionByName(short)


def matched(pairs: DataFrame, ratio: float) -> DataFrame:
    """The rows of `pairs` whose texts sa and sb match to `ratio`, with it. A task keeps what it has found of pairs of texts that come again."""

    def match(batches):
        from difflib import SequenceMatcher

        known: dict[tuple[str, str], float] = {}
        for pdf in batches:
            if len(known) > 200_000:
                known.clear()
            r = []
            for pair in zip(pdf["sa"], pdf["sb"]):
                if pair not in known:
                    known[pair] = 1.0 if pair[0] == pair[1] else SequenceMatcher(None, *pair, autojunk=False).ratio()
                r.append(known[pair])
            out = pdf.assign(ratio=r)
            yield out[out["ratio"] >= ratio]

    return pairs.mapInPandas(match, StructType([*pairs.schema.fields, StructField("ratio", DoubleType())]))


def with_blocks(pairs: DataFrame) -> DataFrame:
    """`pairs` with the longest matching blocks of the texts sa and sb: n characters from i of the one and j of the other."""

    def match(batches):
        from difflib import SequenceMatcher

        for pdf in batches:
            found = (SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for a, b in zip(pdf["sa"], pdf["sb"]))
            yield pdf.assign(blocks=[[{"i": x.a, "j": x.b, "n": x.size} for x in f if x.size] for f in found])

    piece = StructType([StructField(c, IntegerType()) for c in "ijn"])
    return pairs.mapInPandas(match, StructType([*pairs.schema.fields, StructField("blocks", ArrayType(piece))]))


def aligned_classes(left: DataFrame, right: DataFrame, block: Sequence[str], ratio: float, size: float = 0.75, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rows of two sources aligned where the sequences of two keys are each other's best match in a block.

    Either side has (block, key, pos, symbol): positions from 0 and one character for each. Keys of a block with one
    sequence are a class under the smallest. Classes of both sides meet if their lengths' ratio is `size` or more
    and their sequences match to `ratio`; a pair is kept if each is the other's best (ties: the smaller key) and the runner-up
    of the left one lies `margin` behind or is not there. Returns (block, a, b, ratio, margin, pos_a, pos_b), a row for
    each aligned position of the two representatives, and (block, side, class, key), as all keys of a class align alike.
    Rows with a null in block, key, pos or symbol are left out.
    """
    block = list(block)
    held, members = [], []
    for side, rows in (("left", left), ("right", right)):
        known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*block, "key", "pos", "symbol"]))
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda s: s["symbol"]), "")
        own = known.groupBy(*block, "key").agg(text.alias("s"))
        first = held_classes(own, block)
        members.append(own.join(first, [*block, "s"]).select(*block, F.lit(side).alias("side"), "class", "key"))
        held.append(first)
    near = _near_texts(*held, block, ratio).where(F.least(F.length("sa"), F.length("sb")) >= F.lit(size) * F.greatest(F.length("sa"), F.length("sb")))
    best = mutual_best(matched(near, ratio), "a", "b", "ratio", block).where(F.col("margin").isNull() | (F.col("margin") >= margin))
    for k, h in zip("ab", held):
        best = best.join(h.withColumnsRenamed({"s": f"s{k}", "class": k}), [*block, k])
    pieces = with_blocks(best).select(*block, "a", "b", "ratio", "margin", F.inline("blocks"))
    step = pieces.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return step.select(*block, "a", "b", "ratio", "margin", (F.col("i") + F.col("step")).alias("pos_a"), (F.col("j") + F.col("step")).alias("pos_b")), members[0].unionByName(members[1])
