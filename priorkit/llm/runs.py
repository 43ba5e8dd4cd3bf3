"""Runs: maximal stretches of words that repeat with a period, found in linear time from Lyndon arrays.

The alphabet is ordered, and all the algorithm does with words is to compare two of
them: no suffix structure and no hash of a stretch is made. One pass from left to right keeps
a stack of positions whose suffixes ascend. At a new position r the top l is popped
while its suffix is greater; then the next smaller suffix of l starts at r, and the words from l to r
are the longest Lyndon word at l. Each comparison asks how far the suffixes at l and r
match. Of the match that reaches furthest, of (l', r') and up to e, three things are known:

- r >= e: nothing; words are compared one by one from r.
- l >= r': the same comparison was made at (l - d, r - d), d = r' - l'. If its match ended
  before e - r, so does this one; else words are compared from e on.
- l < r': then r = r' and l was compared with l' before. If that match ended before e - r,
  so does this one; else words are compared from e on.

So every successful comparison of words moves e, and the pass takes linear time. By a
pass under the order and one under its inverse (the end is the least in both), every run has
a Lyndon word of one period whose next smaller suffix starts a period later, with the match up to the run's end.
The first such word of a run is less than a period from its start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, table

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
RUN = "array<struct<start:long,length:long,period:long>>"


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """(nss, match) for x, whose last number is less than all others: where the next smaller suffix of each position starts, and how far the two match."""
    n = len(x) - 1
    nss, match = [n] * n, [0] * n
    pss, match_before = [-1] * n, [0] * n  # the previous smaller suffix, and how far it matches
    stack: list[int] = []
    left = right = end = 0  # the match that reaches furthest
    for r in range(n):
        while stack:
            l = stack[-1]
            at = r
            if r < end:
                if l >= right:
                    d = right - left
                    k = match[l - d] if nss[l - d] == r - d else match_before[r - d]
                else:
                    k = match_before[left]
                if k < end - r:
                    at = -1
                else:
                    at = end
            if at >= 0:
                k = at - r
                a = l + k
                while x[a] == x[at]:
                    a += 1
                    at += 1
                k = at - r
                left, right, end = l, r, at
            if x[l + k] < x[r + k]:
                pss[r], match_before[r] = l, k
                break
            nss[l], match[l] = r, k
            stack.pop()
        stack.append(r)
    while stack:  # suffixes greater than the end
        nss[stack[-1]] = n
        stack.pop()
    return nss, match


def lyndon_runs(x: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` numbers and `times` (2 or more) periods, by start and period."""
    n = len(x)
    found = set()
    for signed in (list(x), [-v for v in x]):
        signed.append(min(signed, default=0) - 1)
        nss, match = next_smaller(signed)
        for k in range(n):
            end = nss[k]
            q = end - k
            if match[k] < (times - 2) * q or (k >= q and nss[k - q] == k and match[k - q] >= q):
                continue  # too short, or not the first of its run
            start = k
            while start and signed[start - 1] == signed[start - 1 + q]:
                start -= 1
            length = end + match[k] - start
            if length >= least and length >= times * q:
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def frequent_stretches(x: np.ndarray, times: int, least: int, rounds: int = 3) -> list[tuple[int, int]]:
    """(start, end) of stretches outside which no run of `times` periods can lie.

    Every word of such a run, and one that would extend it, occurs in it `times` times. So a word
    that is rarer in its stretch divides it; `rounds` times.
    """
    stretches = [(0, len(x))]
    for _ in range(rounds):
        out = []
        for a, b in stretches:
            part = x[a:b]
            _, code, count = np.unique(part, return_inverse=True, return_counts=True)
            rare = np.flatnonzero(count[code] < times)
            if not len(rare):
                out.append((a, b))
                continue
            cuts = np.concatenate([[-1], rare, [b - a]])
            wide = np.flatnonzero(np.diff(cuts) > least)
            out += [(a + int(cuts[i]) + 1, a + int(cuts[i + 1])) for i in wide]
        if out == stretches:
            break
        stretches = out
    return [s for s in stretches if s[1] - s[0] >= least]


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `words`, which have an order, by start and period."""
    if len(words) < least:
        return []
    rank = {w: i for i, w in enumerate(sorted(set(words)))}
    x = np.fromiter(map(rank.__getitem__, words), np.int64, len(words))
    found = []
    for a, b in frequent_stretches(x, times, least):
        found += [(a + s, length, q) for s, length, q in lyndon_runs(x[a:b].tolist(), least, times)]
    return found


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """`words` without those that a run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, k in zip(words, keep) if k]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) of each row: its runs by start and period, and its words without repeats, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. Null and empty texts and those
    without words have no runs and collapse to an empty text. Rows with a null id and repeated
    rows are rows of their own; other columns are not read; an empty table gives an empty one.
    A text is read whole; memory is a small multiple of the longest text.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in batches:
            runs, texts = [], []
            for t in batch.column("text"):
                words = (t.as_py() or "").encode("utf-8", "replace").split()  # bytes split at [\x20\x09-\x0D] alone
                found = runs_of(words, least, times)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapse(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, spans), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, runs {RUN}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about a tenth of the texts made periodic from some word on, by a hash of the id, as the query's contract says. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", chosen.alias("__on"), F.floor(h / 10).alias("__g"), F.when(chosen, words).alias("__w"))
    n = F.size("__w")
    some = some.withColumn("__a", F.when(n > 0, F.col("__g") % n).cast("int")).withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    again = F.transform(F.sequence(F.col("__a"), n - 1), lambda i: F.element_at("__w", (F.col("__a") + (i - F.col("__a")) % F.col("__p") + 1).cast("int")))
    made = F.array_join(F.concat(F.slice("__w", 1, F.col("__a")), again), " ")
    return some.select("doc_id", F.when(F.col("__on") & (n > 0), made).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length, of equal ones that of the smallest start, then period; null where there is none."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)


def op12_runs(spark, sf_dir):
    """Runs of every whole text, a tenth of them made periodic; nulls, empties, ties and repeated rows as in periodic_runs."""
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    length = -F.col("best.l")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_runs": op12_runs}
ORACLES = {}
