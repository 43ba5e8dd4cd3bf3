"""Quality rules as a short-circuit cascade.

Every rule says whether a text fails. On a bounded sample each rule's cost and
share of rejections are measured; the cascade then asks the rules in the order of
most rejections for the least time, and stops at the first that fails. The order
changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, table
from .words import WordHasher, windows

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Texts on which costs and selectivities are estimated, chosen by a hash of the id.
SAMPLE = 400


class Doc:
    """What rules ask of a text; each part is found when it is first asked for."""

    def __init__(self, text: str | None, hasher: WordHasher):
        self.text = text or ""
        self.hasher = hasher

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()  # bytes split at [\x20\x09-\x0D] alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of WINDOW words that occur twice or more."""
        if self.n_words <= WINDOW:
            return 0
        hashes, _ = self.hasher([self.text])
        seen = windows(hashes, WINDOW)
        order = np.argsort(seen, kind="stable")
        same = seen[order][1:] == seen[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(seen), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(self.n_words + 1, np.int64)
        at = np.flatnonzero(twice)
        edge[at] += 1
        edge[at + WINDOW] -= 1
        return int((np.cumsum(edge) > 0).sum())


#: The rules of the production cascade. The first two are the base contract's.
RULES: dict[str, Callable[[Doc], bool]] = {
    "few_words": lambda d: d.n_words < 20,
    "repeated_windows": lambda d: 100 * d.n_repeat_words > 30 * d.n_words,
    "odd_word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "many_symbols": lambda d: 4 * d.n_symbols > d.n_words,
    "repeated_lines": lambda d: 10 * d.n_dup_lines > 3 * len(d.lines),
    "shouting": lambda d: 2 * sum(map(bytes.isupper, d.words)) > d.n_words and sum(map(str.isupper, d.text)) > 3 * sum(map(str.islower, d.text)),
}
BASE_RULES = ("few_words", "repeated_windows")


def order_of(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, sample: int = SAMPLE) -> list[str]:
    """Names of `rules` by falling share of rejections per second, as measured on at most `sample` texts.

    Texts are chosen by a hash of id and text, so a repeated id does not fill the sample;
    null ids and null texts may be in it. On an empty table the order is that of `rules`;
    rules with equal rates keep it too.
    """
    some = lowest_hashes(docs.select("doc_id", "text"), sample, "doc_id", "text")

    def measure(batches):
        hasher = WordHasher(lower=False)
        for pdf in batches:
            rows = []
            for name, rule in rules.items():
                fresh = [Doc(t, hasher) for t in pdf["text"]]  # nothing found for another rule is reused
                began = time.perf_counter()
                rejected = sum(map(rule, fresh))
                rows.append((name, time.perf_counter() - began, rejected))
            yield pd.DataFrame(rows, columns=["rule", "seconds", "rejected"])

    measured = some.mapInPandas(measure, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).toPandas()
    gain = {r.rule: r.r / max(r.s, 1e-9) for r in measured.itertuples()}
    return sorted(rules, key=lambda name: -gain.get(name, 0.0))


def first_failed(doc: Doc, order: list[str], rules: dict[str, Callable[[Doc], bool]]) -> str | None:
    return next((name for name in order if rules[name](doc)), None)


def cascade(docs: DataFrame, rules: dict[str, Callable[[Doc], bool]] = RULES, order: list[str] | None = None, measures: bool = False) -> DataFrame:
    """(doc_id, kept) of each row, and with `measures` the numbers the rules look at.

    Null and empty texts have no words: they fail 'few_words'. Rows with the same
    doc_id are judged each by its own text; an empty table gives an empty one.
    """
    order = order or order_of(docs, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []

    def judge(batches):
        hasher = WordHasher(lower=False)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                doc = Doc(text, hasher)
                rows.append((first_failed(doc, order, rules) is None, *(getattr(doc, n) for n in names)))
            out = pd.DataFrame(rows, columns=["kept", *names])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(judge, ", ".join([f"doc_id {kind}", "kept boolean", *(f"{n} long" for n in names)]))


def op5_quality_rules(spark, sf_dir):
    """Measures and verdict of every row; nulls, empties, ties and repeated rows as in cascade.

    The contract wants all measures of every row, so here the cascade saves only the rules
    after the first that fails; `quality_kept` is the cascade alone.
    """
    judged = cascade(table(spark, sf_dir, "documents"), measures=True)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def quality_kept(spark, sf_dir):
    """(doc_id, kept): the cascade's verdict alone, where a text that fails costs no later rule."""
    return cascade(table(spark, sf_dir, "documents"))


QUERIES = {"op5_quality_rules": op5_quality_rules, "quality_kept": quality_kept}
ORACLES = {}
