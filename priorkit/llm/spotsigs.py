"""SpotSigs fingerprints: chains of content words after common-word anchors.

A signature is the hash of an anchor with the next CHAIN content words, skipping
common ones. A text without a signature has the hashes of its runs of CHAIN + 1
words in their place, and with fewer words the hash of them all. The fingerprint
lists the distinct signatures. Likeness is their Jaccard. `near_pairs` finds the
alike fingerprints of a whole table, partitioned by set length and pruned.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, chunks, staged, table
from .words import WordHasher, mix, windows

CHAIN = 2
#: Common words of four languages, the anchors.
ANCHORS = (
    "a an the is was are be been of to in and that it for on with as by this from at or not "
    "der die das den dem des ein eine und ist im mit von zu auf für sich nicht auch es "
    "le la les un une de du et est en que qui dans pour par sur pas au il elle avec "
    "el los las una y no se lo con su al del por es"
).split()
_NONE = np.zeros(0, np.uint64)


class Signer:
    """Signature sets of texts."""

    def __init__(self, anchors=ANCHORS, chain: int = CHAIN):
        self.hasher, self.chain = WordHasher(), chain
        words, _ = self.hasher([" ".join(anchors)])
        self.common = np.unique(words)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct signatures of each text."""
        words, bounds = self.hasher(texts)
        if not len(words):
            return [_NONE] * len(texts)
        spot = np.searchsorted(self.common, words)
        spot[spot == len(self.common)] = 0
        common = self.common[spot] == words
        content = np.flatnonzero(~common)
        anchors = np.flatnonzero(common)
        after = np.searchsorted(content, anchors)  # the first content word after each anchor
        fits = after + self.chain <= len(content)
        anchors, after = anchors[fits], after[fits]
        signed = words[anchors].copy()
        for k in range(self.chain):
            signed = mix(signed * np.uint64(0x9FB21C651E98DF25) + words[content[after + k]])
        last = content[after + self.chain - 1] if len(after) else after
        runs = windows(words, self.chain + 1)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            i, j = np.searchsorted(anchors, (a, b))
            own = signed[i:j][last[i:j] < b]  # chains end inside their text
            if not len(own):
                own = runs[a : b - self.chain] if b - a > self.chain else windows(words[a:b], b - a) if b > a else _NONE
            out.append(np.unique(own))
        return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(signatures: np.ndarray) -> str:
    """The fingerprint: signatures as 16 hexadecimal digits each, ascending, without a separator."""
    return signatures.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; texts that are null or have no word have an empty fingerprint."""

    def work(batches):
        sign = Signer()
        for pdf in batches:
            prints = [as_text(s) for _, run in chunks(pdf["text"].tolist()) for s in sign(run)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": prints})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, fingerprint string")


def least_length(n: int, percent: int) -> int:
    """The smallest set that can be alike to a set of n."""
    return -(-percent * n // 100)


def length_partitions(percent: int, longest: int = 1 << 31) -> list[int]:
    """Upper bounds of set lengths such that a set's partners lie in its own or a neighbouring partition."""
    bounds, at = [], 1
    while at < longest:
        bounds.append(at)
        at = max(at + 1, 100 * at // percent + 1)
    return bounds


def near_pairs(prints: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Class representatives with a likeness of `percent` hundredths or more, and the membership.

    Returns (pairs, members): pairs(left_id, right_id, both, either) between the smallest
    ids of classes of equal fingerprints; members(doc_id, class_id). Sets are partitioned
    by length; sets of a common or neighbouring partition meet on a common signature of
    their prefixes: the n - ceil(percent n / 100) + 1 signatures in the fewest sets, the
    frequent ones last. A pair is compared only if its lengths and the places of that
    signature leave room for the likeness. Empty fingerprints are alike to nothing and
    make no class; null ids are left out; repeated ids are taken by their fingerprints.
    """
    scope = Scope(prints.sparkSession)
    prints = staged(prints.where(F.col("doc_id").isNotNull()))  # the members read them too
    filled = prints.where(F.length("fingerprint") > 0)
    classes = staged(filled.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).withColumn("id", F.monotonically_increasing_id()))
    members = prints.join(classes, "fingerprint", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    bounds = length_partitions(percent)
    kind = prints.schema["doc_id"].dataType.simpleString()

    def index(batches):
        edges = np.array(bounds)
        for pdf in batches:
            sets = [from_text(text) for text in pdf["fingerprint"]]
            n = np.array([len(s) for s in sets], np.int64)
            each = np.repeat(np.arange(len(sets)), n)
            yield pd.DataFrame({"token": np.concatenate([_NONE, *sets]).view(np.int64), "id": pdf["id"].to_numpy()[each], "n": n[each], "own": np.searchsorted(edges, n)[each]})

    found = scope(classes.select("id", "fingerprint").mapInPandas(index, "token long, id long, n int, own int"))
    often = found.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")  # a signature of one set finds nothing
    order = Window.partitionBy("id").orderBy("sets", "token")
    shared = found.join(often, "token").withColumn("pos", F.col("n") - F.count("*").over(Window.partitionBy("id")) + F.row_number().over(order) - 1)
    first = scope(shared.where(F.col("pos") <= F.col("n") - F.ceil((percent * F.col("n")).cast("double") / 100)).select("token", "id", "n", "own", "pos"))
    a = first.withColumn("part", F.explode(F.array("own", F.col("own") + 1))).alias("a")
    b = first.withColumn("part", F.col("own")).alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    least = F.ceil((percent * (n + m)).cast("double") / (100 + percent))
    smaller = (F.col("a.own") < F.col("b.own")) | (F.col("a.id") < F.col("b.id"))
    room = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - F.col("a.pos"), m - F.col("b.pos")) >= least)
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.token") == F.col("b.token")) & smaller & room)
    pairs = scope(met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct())
    full = lambda k: classes.select(F.col("id").alias(k), F.col("class_id").alias(f"i{k}"), F.col("fingerprint").alias(f"f{k}"))
    compared = pairs.join(full("x"), "x").join(full("y"), "y")

    def compare(batches):
        for pdf in batches:
            rows = []
            for i, j, x, y in zip(pdf["ix"], pdf["iy"], pdf["fx"], pdf["fy"]):
                x, y = from_text(x), from_text(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if 100 * both >= percent * either:
                    rows.append((min(i, j), max(i, j), both, either))
            yield pd.DataFrame(rows, columns=["left_id", "right_id", "both", "either"])

    alike = staged(compared.mapInPandas(compare, f"left_id {kind}, right_id {kind}, both int, either int"))
    scope.close()
    return alike, members


def placed_by_id(docs: DataFrame, parts: int) -> tuple[DataFrame, list]:
    """Rows of `docs` with (named, key, part), and the first (named, key) of each part.

    The order is by doc_id; rows without an id come first, by a hash of their text. The
    borders of the parts are quantiles, looked up by bisection.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text").withColumn("named", F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("text").cast(kind)))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = docs.groupBy("named").agg(F.percentile_approx("key", shares, 100 * parts).alias("q")).collect()
    borders = {r["named"]: sorted(set(r["q"] or [])) for r in found}

    def place(values: list):
        if not values:
            return F.lit(0)
        table, bits = F.from_json(F.lit(json.dumps(values)), f"array<{kind.simpleString()}>"), len(values).bit_length()
        step = lambda at, k: at + F.when(F.try_element_at(table, at + k) <= F.col("key"), k).otherwise(0)
        return F.aggregate(F.array(*(F.lit(1 << b) for b in reversed(range(bits)))), F.lit(0), step)

    unnamed = borders.get(False)
    offset = len(unnamed) + 1 if unnamed is not None else 0
    placed = docs.withColumn("part", F.when(F.col("named"), place(borders.get(True, [])) + offset).otherwise(place(unnamed or [])))
    first = placed.groupBy("part").agg(F.min(F.struct("named", "key")).alias("first")).orderBy("part").collect()  # at most 2 * parts rows
    return placed, [(r["part"], *r["first"]) for r in first]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, named, key, text, guest): the rows of each part, each part ending with the first row of the next one as a guest.

    One row for each part is read twice; no window over the whole table is needed, and texts are shuffled once.
    """
    placed, first = placed_by_id(docs, parts)
    rows = placed.select("part", "named", "key", "text").withColumn("guest", F.lit(0))
    if not first:
        return rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    follow = [(named, key, first[i - 1][0]) for i, (_, named, key) in enumerate(first)]  # the last part's guest is the first row of all
    hosts = docs.sparkSession.createDataFrame(follow, f"named boolean, key {kind}, host int")
    guests = placed.join(F.broadcast(hosts), ["named", "key"]).select(F.col("host").alias("part"), "named", "key", "text", F.lit(1).alias("guest"))
    laid = rows.unionByName(guests).repartitionById(first[-1][0] + 1, F.col("part"))
    return laid.sortWithinPartitions("part", "guest", "named", "key", "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op7_spotsigs(spark, sf_dir):
    """Fingerprints of every row and its edited text. The next document is by ascending doc_id.

    Rows without an id come before all others, ordered by a hash of their text; rows of
    one id are ordered by their text, null first. Null texts are empty; an empty text has
    an empty fingerprint, alike (1) to an empty one and unlike (0) any other. An only row
    is its own next. An empty table gives an empty one; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    laid = with_next(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def row(sign, named, key, text, following):
        new = edited(text, following)
        own, other, near = sign([text, new, following])
        return named, key, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), as_text(own), as_text(other), jaccard(own, other), jaccard(own, near)

    columns = ["named", "key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches):
        sign = Signer()
        last = None  # the row that waits for its successor; a part ends with its guest
        for pdf in batches:
            rows = []
            for p, named, key, text, guest in zip(pdf["part"], pdf["named"], pdf["key"], pdf["text"], pdf["guest"]):
                text = text or ""
                if last is not None and last[0] == p:
                    rows.append(row(sign, *last[1:], text))
                last = None if guest else (p, named, key, text)
            yield pd.DataFrame(rows, columns=columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = laid.select("part", "named", "key", "text", "guest").mapInPandas(
        work, f"named boolean, key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return done.select(F.when(F.col("named"), F.col("key")).alias("doc_id"), *columns[2:])


def spotsigs_near(spark, sf_dir):
    """(doc_id, class_id, n_near) of every row with an id: its class of equal fingerprints, and how many other classes are alike to it."""
    pairs, members = near_pairs(fingerprints(table(spark, sf_dir, "documents")))
    ends = pairs.select(F.col("left_id").alias("class_id")).unionByName(pairs.select(F.col("right_id").alias("class_id")))
    counted = ends.groupBy("class_id").agg(F.count("*").alias("n_near"))
    return members.join(counted, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


QUERIES = {"op7_spotsigs": op7_spotsigs, "spotsigs_near": spotsigs_near}
ORACLES = {}
