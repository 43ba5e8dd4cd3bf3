"""Exact Jaccard join of documents on word shingles, and its connected components.

Documents are sets of hashed shingles; two link when 100 * |both| >= PERCENT * |either|.

1. Classes. Rows with equal sets, by a digest of 128 bits, become one class with a
   number of its own; a class keeps the smallest (doc_id, hash of the text) of its rows.
2. Counts. For half of all shingles (by a bit of the hash) document counts are taken
   over the whole corpus; those of the other half are estimated from one class in
   OTHER_HALF. A set with partners may miss at most a quarter of its shingles
   elsewhere; classes with more shingles of their own than that have no partner and
   leave. Each task adds up what it sees of a shingle before anything is shuffled, so
   that a shingle of every text is a few numbers from each task.
3. Index. Every shingle in LEAST_FREQUENT documents or more comes last in the order of
   every set, by its count. Their number grows with the corpus: up to MOST_HELD they
   are sent to the tasks, beyond that they are joined. Each remaining set enters the lists
   of its first n - ceil(PERCENT n / 100) + 1 shingles. Linked sets meet in at least
   one list, at positions that leave room for the overlap they need.
4. Answers from relations of sets. Every list is cut by set length, and each cut has a
   pivot, the set whose shingles are the most listed. A set is compared with the pivot
   it meets in the most lists: a row for a set, never a pair for two. Links found join
   sets into components; then a set meets its other pivots in reach, but for those of
   its own component.
5. What is left. Members of different components in a list have to be told apart. The
   answer for a pair follows from both sets' answers to their pivot where
   possible: |x & y| <= min(|x & c|, |y & c|) + min(|x - c|, |y - c|) drops a pair, and
   |x & c| + |y & c| - |c| proves a link. Lists of more than BLOCK entries are split
   into blocks by length, component and overlap with the pivot. A block knows the
   longest partner that its positions leave in reach and its largest overlap; blocks
   meet only where their length cells reach each other, and pairs of blocks out
   of reach are skipped before a pair of entries exists. The few pairs that remain
   are compared exactly.

Nothing grows with the square of a group: texts of near copies meet their pivot, and
groups of copies of a text are one class. Texts of the remaining classes are staged
once; texts, not sets, are shuffled for the comparisons. Sides of more than
BROADCAST_ROWS rows are joined by shuffles.

Rows that repeat a doc_id are rows of their own, each judged by its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, bound_batches, chunks, small_side, table
from .words import WordHasher, shingle_sets

SHINGLE, PERCENT = 5, 75
#: Shingles in so many documents or more are ordered by their counts.
LEAST_FREQUENT = 32
#: So many of them at most are sent to every task (16 bytes each); with more they are joined.
MOST_HELD = 400_000
#: Of one class in so many the other half of the shingles is counted too: an estimate that only orders shingles.
OTHER_HALF = 16
FLUSH = 1_000_000
#: About so many partners of a pivot are compared in one group.
CHUNK = 48
#: Longer lists are taken in blocks of about so many entries.
BLOCK = 64
#: Length cells of blocks grow by this factor.
CELL = 1.125


def digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def needed(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """The least overlap with which sets of n and m link."""
    return F.ceil((percent * (n + m)).cast("double") / (100 + percent))


def cell(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(CELL))).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells texts of one doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def set_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, th, n, half, high, low): set size, size of its sampled half, digest."""

    def work(batches):
        hasher = WordHasher()
        for pdf in batches:
            rows = []
            for _, run in chunks(pdf["text"].tolist()):
                for s in shingle_sets(hasher, run, size):
                    rows.append((len(s), int((s & np.uint64(1) == 0).sum()), *digest(s)))
            out = pd.DataFrame(rows, columns=["n", "half", "high", "low"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "th", pdf["th"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInPandas(work, f"doc_id {kind}, th long, n long, half long, high long, low long")


def shared_counts(docs: DataFrame, buckets: int, size: int = SHINGLE) -> DataFrame:
    """(token, key, n): token false: a set by half of its digest, and how many sampled shingles of it are elsewhere too, at least; token true: a frequent shingle and its count.

    A flush of a task sends shingles seen once with their owner, those seen in several
    sets with their count alone, and what it credits to their owners. A set that
    several tasks meet may be credited twice: it is then kept, never lost.
    """
    bits = int(buckets).bit_length() - 1
    shift = np.uint64(64 - bits)
    lowest = np.uint64((1 << 48) - 1)
    schema = "p int, tokens binary, owners binary, many binary, counts binary, credited binary, credits binary"

    def six(tokens):
        return np.ascontiguousarray((tokens & lowest).view(np.uint8).reshape(-1, 8)[:, :6])

    def wide(parts):
        packed = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
        out = np.zeros((len(packed), 8), np.uint8)
        out[:, :6] = packed
        return out.view(np.uint64).ravel()

    def pack(sets, owners):
        tokens = np.concatenate(sets)
        own = np.repeat(np.array(owners, np.int64), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, own = tokens[order], own[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        n = np.diff(np.append(first, len(tokens)))
        credited, credits = np.unique(own[np.repeat(n > 1, n) & (tokens & np.uint64(1) == 0)], return_counts=True)
        one, several = first[n == 1], first[n > 1]
        tokens_1, own_1, tokens_n, n = tokens[one], own[one], tokens[several], n[n > 1].astype(np.uint32)
        borders = np.arange((1 << bits) + 1, dtype=np.uint64)
        e1, en = np.searchsorted(tokens_1 >> shift, borders), np.searchsorted(tokens_n >> shift, borders)
        packed_1, packed_n, nothing = six(tokens_1), six(tokens_n), b""
        rows = [
            (p, packed_1[a:b].tobytes(), own_1[a:b].tobytes(), packed_n[c:d].tobytes(), n[c:d].tobytes(), nothing, nothing)
            for p, (a, b, c, d) in enumerate(zip(e1[:-1], e1[1:], en[:-1], en[1:])) if b > a or d > c
        ]
        if len(credited):
            p = int(credited[0]) % (1 << bits)
            rows.append((p, nothing, nothing, nothing, nothing, credited.tobytes(), credits.astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["p", "tokens", "owners", "many", "counts", "credited", "credits"])

    def runs(batches):
        hasher, seen, sets, owners, held = WordHasher(), set(), [], [], 0
        for pdf in batches:
            for _, run in chunks(pdf["text"].tolist()):
                for s in shingle_sets(hasher, run, size):
                    if not len(s):
                        continue
                    _, low = digest(s)
                    if low in seen:  # a task counts a copied set once
                        continue
                    seen.add(low)
                    if (low >> 40) % OTHER_HALF:
                        s = s[s & np.uint64(1) == 0]
                    if len(s):
                        sets.append(s)
                        owners.append(low)
                        held += len(s)
                if held > FLUSH:
                    yield pack(sets, owners)
                    sets, owners, held = [], [], 0
        if sets:
            yield pack(sets, owners)

    def count(key, pdf):
        tokens, owners = wide(pdf["tokens"]), np.frombuffer(b"".join(pdf["owners"]), np.int64)
        many, counts = wide(pdf["many"]), np.frombuffer(b"".join(pdf["counts"]), np.uint32)
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        tokens, owners = tokens[fresh], owners[fresh]
        every, at = np.unique(np.concatenate([tokens, many]), return_inverse=True)
        n = np.bincount(at[: len(tokens)], minlength=len(every)) + np.bincount(at[len(tokens) :], counts, len(every)).astype(np.int64)
        odd = every & np.uint64(1) == 1
        own, shared = np.unique(owners[((n > 1) & ~odd)[at[: len(tokens)]]], return_counts=True)
        extra, credits = np.frombuffer(b"".join(pdf["credited"]), np.int64), np.frombuffer(b"".join(pdf["credits"]), np.uint32)
        total = np.where(odd, n * OTHER_HALF, n)
        often = (total >= LEAST_FREQUENT) & (n > 2)
        keys = np.concatenate([own, extra, ((np.uint64(key[0]) << shift) | every[often]).view(np.int64)])
        return pd.DataFrame({
            "token": np.arange(len(keys)) >= len(own) + len(extra), "key": keys,
            "n": np.concatenate([shared, credits.astype(np.int64), total[often]]).astype(np.int64),
        })

    packed = docs.select("text").mapInPandas(runs, schema)
    counted = packed.groupBy("p").applyInPandas(count, "token boolean, key long, n long")
    return counted.groupBy("token", "key").agg(F.sum("n").alias("n"))


def prefix(n: Column, percent: int) -> Column:
    """How many shingles of a set of n are listed."""
    return n - F.ceil((percent * n).cast("double") / 100) + 1


def postings(texts: DataFrame, often: DataFrame, n_often: int, buckets: int, percent: int, size: int) -> DataFrame:
    """(token, id, n, pos) for the first shingles of each class: unknown ones by their hash, then frequent ones by their count."""
    # a counted token has the bits of its bucket and its lowest 48
    seen_bits = np.uint64((1 << 64) - (1 << (64 - int(buckets).bit_length() + 1)) | (1 << 48) - 1)
    held = n_often <= MOST_HELD
    known = often.toPandas() if held else pd.DataFrame({"key": [], "n": []}, dtype=np.int64)
    tokens = known["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], known["n"].to_numpy(np.int64)[order]

    def work(batches):
        hasher = WordHasher()
        for pdf in batches:
            rows = []
            for start, run in chunks(pdf["text"].tolist()):
                for k, s in enumerate(shingle_sets(hasher, run, size), start):
                    n = len(s)
                    last = np.where(s & np.uint64(1) == 0, -2, -1)
                    if held:
                        if len(tokens):
                            at = np.searchsorted(tokens, s & seen_bits)
                            at[at == len(tokens)] = 0
                            last = np.where(tokens[at] == s & seen_bits, counts[at], last)
                        first = np.lexsort((s, last))[: n + (-percent * n // 100) + 1]
                        rows.append(pd.DataFrame({"token": s[first].view(np.int64), "id": pdf["id"].iat[k], "n": n, "pos": np.arange(len(first))}))
                    else:  # all shingles, to be ordered when their counts are joined
                        rows.append(pd.DataFrame({"token": s.view(np.int64), "id": pdf["id"].iat[k], "n": n, "pos": last}))
            if rows:
                yield pd.concat(rows)

    rows = texts.select("id", "text").mapInPandas(work, "token long, id long, n int, pos int")
    if held:
        return rows
    rows = rows.withColumn("key", F.col("token").bitwiseAND(F.lit(int(seen_bits.view(np.int64)))))
    rows = rows.join(often.withColumnRenamed("n", "count"), "key", "left")
    order = Window.partitionBy("id").orderBy(F.coalesce("count", "pos"), "token")
    placed = rows.select("token", "id", "n", (F.row_number().over(order) - 1).alias("pos"))
    return placed.where(F.col("pos") < prefix(F.col("n"), percent))


def overlaps(texts: DataFrame, pairs: DataFrame, scope: Scope, size: int) -> DataFrame:
    """(a, b, both, n_a, n_b) for each of the distinct `pairs`(a, b): the exact size of their intersection, and their sizes.

    A pivot's text goes to each chunk of its partners, a partner's text to its pivot.
    """
    pairs = scope(pairs)
    many = scope(pairs.groupBy("a").agg(F.count("*").alias("partners")).where(F.col("partners") > CHUNK))
    pairs = pairs.join(small_side(many, many.count()), "a", "left")
    pairs = pairs.withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("partners") / CHUNK)), F.lit(0)).cast("int"))
    places = scope(
        pairs.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("side")).unionByName(
            pairs.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("side")).distinct()
        )
    )
    placed = texts.select("id", "text").join(small_side(places, places.count()), "id")
    laid = placed.repartition("a", "part").sortWithinPartitions("a", "part", "side", "id")

    def work(batches):
        hasher, key, pivot = WordHasher(), None, None
        for pdf in batches:
            rows = []
            ids, a, part, side = (pdf[c].to_numpy() for c in ("id", "a", "part", "side"))
            for start, run in chunks(pdf["text"].tolist()):
                for k, s in enumerate(shingle_sets(hasher, run, size), start):
                    if side[k] == 0:
                        key, pivot = (a[k], part[k]), s
                    elif key == (a[k], part[k]):
                        rows.append((a[k], ids[k], len(np.intersect1d(pivot, s, assume_unique=True)), len(pivot), len(s)))
            yield pd.DataFrame(rows, columns=["a", "b", "both", "n_a", "n_b"])

    return laid.select("id", "a", "part", "side", "text").mapInPandas(work, "a long, b long, both int, n_a int, n_b int")


def components(edges: DataFrame, scope: Scope) -> DataFrame:
    """(id, label) for every id in `edges`(a, b): the smallest id reachable. Labels spread to neighbours and jump along labels until none changes."""
    both = scope(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = scope(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("lower"))
        moved = scope(met.join(jump, "low", "left").select("id", F.col("label").alias("old"), F.least("low", F.coalesce("lower", "low")).alias("label")))
        changed = moved.where("old != label").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels


def in_reach(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Whether sets of n and m whose first common shingle is at these positions may link."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - pos, m - at) >= needed(n, m, percent))


def may_link(x: Column, y: Column, percent: int) -> Column:
    """Whether two entries of a list are of different components, in reach, and not told apart by their answers to a common pivot."""
    n, m = x["n"], y["n"]
    upper = F.least(x["both"], y["both"]) + F.least(n - x["both"], m - y["both"])
    apart = (x["pivot"] == y["pivot"]) & F.coalesce(upper < needed(n, m, percent), F.lit(False))
    return (x["label"] != y["label"]) & in_reach(n, x["pos"], m, y["pos"], percent) & ~apart


def met_in_blocks(entries: DataFrame, scope: Scope, percent: int) -> DataFrame:
    """Pairs (x, y) of entries of long lists that may link.

    Blocks of a list hold about BLOCK entries with one length cell, component (or none), pivot and eighth of overlap with it.
    """
    keys = ["token", "cell", "owner", "pivot", "level"]
    entries = entries.withColumns({
        "cell": cell(F.col("n")), "level": F.coalesce(F.floor(8 * F.col("both") / F.col("n")), F.lit(-1)).cast("int"),
        "owner": F.when(F.col("alone"), F.lit(-1)).otherwise(F.col("label")),
    })
    sizes = entries.groupBy(keys).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    sizes = scope(sizes)
    sliced = entries.join(small_side(sizes, sizes.count()), keys, "left")
    sliced = sliced.withColumn("slice", F.coalesce(F.pmod(F.xxhash64("id"), 1 + F.floor(F.col("m") / BLOCK)), F.lit(0)).cast("int"))
    top = F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")  # the longest partner in reach
    blocks = scope(
        sliced.withColumn("top", top).groupBy(*keys, "slice").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max("top").alias("top"), F.max("both").alias("both"), F.max(F.col("n") - F.col("both")).alias("rest"),
            F.count("both").alias("known"), F.count("*").alias("m"), F.collect_list(F.struct("id", "n", "pos", "both", "label", "pivot")).alias("held"),
        ).withColumn("block", F.monotonically_increasing_id())
    )
    # each pair of blocks meets once, in its (smaller cell, larger cell)
    shorter = F.ceil(percent * F.col("least") / 100)
    down = blocks.where(F.col("top") >= shorter).withColumn("low", F.explode(F.sequence(cell(shorter), F.col("cell")))).withColumn("high", F.col("cell"))
    up = blocks.where(cell(F.col("top")) >= F.col("cell")).withColumn("high", F.explode(F.sequence(F.col("cell"), cell(F.col("top"))))).withColumn("low", F.col("cell"))
    x, y = down.where(F.col("low") <= cell(F.col("top"))).alias("x"), up.alias("y")
    c = F.col
    full = (c("x.known") == c("x.m")) & (c("y.known") == c("y.m")) & (c("x.pivot") == c("y.pivot"))
    upper = F.least("x.both", "y.both") + F.least("x.rest", "y.rest")
    may = (
        ((c("x.owner") != c("y.owner")) | (c("x.owner") == -1))
        & ((c("x.cell") != c("y.cell")) | (c("x.block") <= c("y.block")))
        & (c("x.top") >= c("y.least")) & (c("y.top") >= c("x.least")) & (100 * c("y.most") >= percent * c("x.least"))
        & (~full | (upper >= needed(c("x.least"), c("y.least"), percent)))
    )
    met = x.join(y, (c("x.token") == c("y.token")) & (c("x.low") == c("y.low")) & (c("x.high") == c("y.high")) & may)
    met = met.select(F.explode(c("x.held")).alias("x"), c("y.held").alias("held"))
    # what is told apart never becomes a row
    return met.select("x", F.explode(F.filter("held", lambda y: may_link(F.col("x"), y, percent))).alias("y"))


def links_of(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, Scope]:
    """(sets, found, scope): set_table of all rows; (high, low, first, first_th, copies) of each class that has a link or several rows: the smallest (doc_id, th) reachable."""
    spark = docs.sparkSession
    bound_batches(spark)
    scope, lasting = Scope(spark), Scope(spark)
    sets = lasting(set_table(docs, size))
    named = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # rows of one id and text first, then classes
    rows = named.groupBy("high", "low", "doc_id", "th").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("half").alias("half"))
    own = F.struct("doc_id", "th")
    classes = scope(
        rows.groupBy("high", "low")
        .agg(F.min(F.struct("doc_id", "th", "times")).alias("own"), F.sum("times").alias("rows"), F.first("n").alias("n"), F.first("half").alias("half"))
        .select(F.monotonically_increasing_id().alias("id"), "high", "low", "own.*", "rows", "n", "half")
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << min(16, max(8, (16 * partitions - 1).bit_length()))
    counted = scope(shared_counts(docs.where(F.col("doc_id").isNotNull()), buckets, size))
    often = counted.where("token").select("key", "n")
    miss = F.col("n") - F.ceil(percent * F.col("n") / 100)
    shared = counted.where(~F.col("token")).select(F.col("key").alias("low"), F.col("n").alias("shared"))
    kept = scope(
        classes.join(shared, "low", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("half") - miss).select("id", "doc_id", "th", "times")
    )
    texts = keyed(docs).join(small_side(kept, kept.count()), ["doc_id", "th"]).select("id", "text", "times")
    once, again = texts.where("times = 1").select("id", "text"), texts.where("times > 1").select("id", "text")
    repeated = kept.where("times > 1").limit(1).count()
    texts = scope(once.unionByName(again.groupBy("id").agg(F.first("text").alias("text"))) if repeated else once)

    cut = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    entries = scope(postings(texts, often, often.count(), buckets, percent, size))
    listed = entries.groupBy("token").agg(F.count("*").alias("listed")).where("listed > 1")
    entries = scope(entries.join(listed, "token").withColumn("cut", cut))
    # the set that the others of a list are most likely near copies of: its own shingles are the most listed
    weight = entries.groupBy("id").agg(F.sum("listed").alias("weight"))
    best = F.max_by(F.struct(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("pos").alias("pivot_pos")), F.struct("weight", "n", "id"))
    pivots = entries.join(weight, "id").groupBy("token", "cut").agg(best.alias("p")).select("token", "cut", "p.*")
    lists = scope(entries.join(pivots, ["token", "cut"]))

    shared_lists = scope(
        lists.where("id != pivot").groupBy("id", "pivot")
        .agg(F.count("*").alias("lists"), F.max(in_reach(*map(F.col, ("n", "pos", "pivot_n", "pivot_pos")), percent)).alias("reach")).where("reach")
    )
    linked = F.col("both") >= needed(F.col("n_a"), F.col("n_b"), percent)
    nearest = shared_lists.groupBy(F.col("id").alias("b")).agg(F.max_by("pivot", F.struct("lists", "pivot")).alias("a"))
    answers = scope(overlaps(texts, nearest.select("a", "b"), scope, size).withColumn("linked", linked))
    labels = components(answers.where("linked").select("a", "b"), scope)
    # the other pivots of a set, where they are not of its component yet
    n_labels = labels.count()
    la, lb = (small_side(labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")), n_labels) for c in "ab")
    others = shared_lists.select(F.col("pivot").alias("a"), F.col("id").alias("b")).join(answers.select("a", "b"), ["a", "b"], "left_anti")
    others = others.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    answers = scope(answers.unionByName(overlaps(texts, others, scope, size).withColumn("linked", linked)))
    labels = components(answers.where("linked").select("a", "b"), scope)
    n_labels = labels.count()

    # lists whose members are of several components
    side = small_side(labels.withColumnRenamed("label", "label_"), n_labels)
    entries = lists.select("token", "id", "n", "pos", "pivot", "listed").join(side, "id", "left")
    entries = entries.select("*", F.coalesce("label_", "id").alias("label"), F.col("label_").isNull().alias("alone")).drop("label_")
    by_token = entries.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1")
    known = answers.select(F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("both"))
    mixed = entries.join(by_token.select("token"), "token").join(small_side(known, known.count()), ["pivot", "id"], "left")
    mixed = scope(mixed.withColumn("both", F.when(F.col("pivot") == F.col("id"), F.col("n")).otherwise(F.col("both"))))
    short = mixed.where(F.col("listed") <= BLOCK)
    x, y = short.alias("x"), short.alias("y")
    # a short list has at most BLOCK entries
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") < F.col("y.label")))
    pair = lambda k: F.struct(*(F.col(f"{k}.{c}") for c in ("id", "n", "pos", "both", "label", "pivot"))).alias(k)
    met = met.select(pair("x"), pair("y")).where(may_link(F.col("x"), F.col("y"), percent))
    met = met.unionByName(met_in_blocks(mixed.where(F.col("listed") > BLOCK), scope, percent))
    least = needed(F.col("x.n"), F.col("y.n"), percent)
    through = F.when(F.col("x.pivot") == F.col("y.pivot"), F.col("x.both") + F.col("y.both"))
    left = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.col("x.pivot").alias("id"), (through - least).alias("spare")).distinct()
    size_of = lists.select(F.col("pivot").alias("id"), F.col("pivot_n")).distinct()
    left = left.join(size_of, "id").groupBy("a", "b").agg(F.coalesce(F.max(F.col("spare") >= F.col("pivot_n")), F.lit(False)).alias("proven"))
    left = scope(left)
    rest = overlaps(texts, left.where(~F.col("proven")).select("a", "b"), scope, size).where(linked).select("a", "b")
    more = scope(left.where("proven").select("a", "b").unionByName(rest))
    if more.limit(1).count():
        label = lambda c: F.coalesce(F.col(f"l{c}"), F.col(c)).alias(c)
        la, lb = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        joined = components(more.join(la, "a", "left").join(lb, "b", "left").select(label("a"), label("b")), scope)
        over = joined.select(F.col("id").alias("label"), F.col("label").alias("over"))
        labels = labels.join(over, "label", "left").select("id", F.coalesce("over", "label").alias("label"))
        labels = scope(labels.unionByName(joined.select("id", "label").join(labels, "id", "left_anti")))

    together = classes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    firsts = scope(together.join(labels, "id", "left_semi").groupBy("label").agg(F.min(own).alias("first")))
    found = together.join(small_side(firsts, firsts.count()), "label", "left").withColumn("first", F.coalesce("first", own))
    found = found.where((F.col("rows") > 1) | (F.col("first") != own)).select(
        "high", "low", F.col("first.doc_id").alias("first"), F.col("first.th").alias("first_th"), F.col("times").alias("copies")
    )
    found = lasting(found)
    scope.close()
    return sets, found, lasting


def link_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`, whose other columns are not read.

    n_shingles is the size of the row's set; a null or empty text and one without
    words have an empty set, which links with nothing. component_id is the smallest
    doc_id reachable by links, the row's own included. Rows that repeat a doc_id are
    rows of their own: a link of one text of an id is no link of its others. A row
    without an id has no component; it links nothing. An empty table gives an empty one.
    """
    sets, found, _ = links_of(docs.select("doc_id", "text"), percent, size)
    out = sets.join(small_side(found, found.count()), ["high", "low"], "left")
    mine = F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), mine).alias("component_id"))


def op10_ngram_join(spark, sf_dir):
    """Links of all documents at the contract's settings; nulls, empties, ties and repeated ids as in link_components."""
    return link_components(table(spark, sf_dir, "documents"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of `docs`, with its columns: that of the smallest doc_id, of one id's texts that of the smallest hash.

    Of rows with one id and text, one stays. Rows without a word and rows without an
    id link with nothing and stay, all of them. Texts of one id are judged apart.
    """
    sets, found, _ = links_of(docs.select("doc_id", "text"))
    members = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).join(small_side(found, found.count()), ["high", "low"])
    first = (F.col("doc_id") == F.col("first")) & (F.col("th") == F.col("first_th"))
    scope = Scope(spark)
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    gone = scope(named(members.where(~first)))
    twice = scope(named(members.where(first & (F.col("copies") > 1))))
    same = lambda df: (docs["doc_id"] == df["__id"]) & (F.xxhash64(docs["text"]) == df["__th"])
    gone = small_side(gone, gone.count())
    kept = docs.join(gone, same(gone), "left_anti")
    if not twice.limit(1).count():
        return kept
    twice = small_side(twice, twice.count())
    alone = kept.join(twice, same(twice), "left_anti")
    several = kept.join(twice, same(twice), "left_semi")
    one = several.groupBy("doc_id", F.xxhash64("text").alias("__th")).agg(F.first(F.struct(*map(F.col, docs.columns))).alias("row"))
    return alone.unionByName(one.select("row.*"))


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {}
