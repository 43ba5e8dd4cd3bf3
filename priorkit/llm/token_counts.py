"""Token counts under a unigram model, with forward scores shared along a trie.

Pre-tokens are a run of meta spaces with the characters up to the next one, as in
SentencePiece. The pieces are those of a public vocabulary and stay as they are;
their scores are log probabilities in whole millionths, so that sums are exact,
estimated from the documents: starting from a Zipf law of their rank, ROUNDS times the
best segmentation of every distinct pre-token is counted with the number of times the
pre-token occurs. The distinct pre-tokens of the corpus are dealt to ranges and walked in
sorted order, which is the depth-first order of their trie: the best scores of a prefix are
computed once for each range and kept on the path while longer words share it, so no node of the
trie is ever held but those of the path. At a terminal node the number of tokens of the best segmentation is
stored. The pass that counts the tokens of documents walks the pre-tokens that are new to its task in the same way.

Of segmentations with equal scores the one with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from functools import cached_property
from itertools import tee

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, bound_batches, chunks, table
from .sentencepiece_bpe import _SEGMENT, NORMAL, SPACE, model_path

MOST_CACHED, ROUNDS = 500_000, 2


class Unigram:
    """Pieces with scores; a character no piece covers costs `unknown` and as many tokens as it has bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = sorted((p for p in model.pieces if p.type == NORMAL), key=lambda p: -p.score)
        self.score = {p.piece: -round(1e6 * math.log(rank + 2)) for rank, p in enumerate(pieces)}
        self.unknown = min(self.score.values()) - 10_000_000

    def reestimated(self, counts: dict[str, int]) -> "Unigram":
        """The same pieces, scored by their counts plus one half."""
        out = copy(self)
        out.__dict__.pop("endings", None)
        total = sum(counts.values()) + 0.5 * len(self.score)
        out.score = {p: round(1e6 * math.log((counts.get(p, 0) + 0.5) / total)) for p in self.score}
        out.unknown = min(out.score.values()) - 10_000_000
        return out

    @cached_property
    def endings(self) -> dict[str, int | None]:
        """Every ending of a piece: with the score of the piece it is, or None."""
        out: dict[str, int | None] = {}
        for p in self.score:
            for k in range(1, len(p)):
                out.setdefault(p[k:], None)
        out.update(self.score)
        return out

    def segmentations(self, words: Iterable[str]) -> Iterator[tuple[str, int, list[int], int]]:
        """(word, tokens of its best segmentation, starts, new nodes) of each of the distinct `words`, which come in sorted order.

        starts[end] is where the last piece of the best segmentation up to `end` begins. The nodes of a prefix that the
        word before has too are not computed again.
        """
        find, unknown = self.endings.get, self.unknown
        score, tokens, starts = [0], [0], [0]  # the best of each node from the root to here
        before = ""
        for w in words:
            shared = 0
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :], starts[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                at = end - 1
                c = w[at]
                piece = find(c)
                if piece is not None:
                    best, n = score[at] + piece, tokens[at] + 1
                else:
                    best, n = score[at] + unknown, tokens[at] + len(c.encode("utf-8", "replace"))
                for start in range(end - 2, -1, -1):
                    piece = find(w[start:end], 0)
                    if piece is None:
                        continue
                    if piece == 0:  # no piece ends so
                        break
                    s = score[start] + piece
                    if s > best or (s == best and tokens[start] + 1 < n):
                        best, n, at = s, tokens[start] + 1, start
                score.append(best)
                tokens.append(n)
                starts.append(at)
            before = w
            yield w, tokens[len(w)], starts, len(w) - shared

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "endings"}  # built again where it is used

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of the best segmentation of each of the distinct `words`."""
        return {w: n for w, n, _, _ in self.segmentations(sorted(words))}

    def piece_counts(self, words: Iterable[tuple[str, int]]) -> tuple[Counter, int, int]:
        """(pieces, nodes, characters): how often each piece stands in the best segmentations of the sorted `words`, which occur so many times; nodes of their trie, and the sum of their lengths."""
        found: Counter = Counter()
        each, times = tee(words)
        nodes = characters = 0
        for (w, _, starts, new), (_, n) in zip(self.segmentations(w for w, _ in each), times):
            nodes, characters, end = nodes + new, characters + len(w), len(w)
            while end:
                start = starts[end]
                found[w[start:end]] += n
                end = start
        return found, nodes, characters


def pretokens(text: str | None) -> list[str]:
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct pre-tokens of all texts and how often they occur."""

    def work(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for _, run in chunks(pdf["text"].tolist()):
                for t in run:
                    seen.update(pretokens(t))
                if len(seen) > MOST_CACHED:
                    yield pd.DataFrame(seen.items(), columns=["word", "n"])
                    seen = Counter()
        yield pd.DataFrame(seen.items(), columns=["word", "n"])

    return docs.select("text").mapInPandas(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sorted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, in ranges of words that are sorted each: a prefix is in one range, or at the border of two. The order is that of UTF-8 bytes, which is that of code points."""
    return pretoken_counts(docs).repartitionByRange("word").sortWithinPartitions("word")


def piece_sums(words: DataFrame, model: Unigram) -> tuple[dict[str, int], int, int]:
    """(pieces, nodes, characters) over all words of sorted_words: one pass over the trie of each range, whatever the batches."""

    def use(batches):
        rows = ((w, n) for pdf in batches for w, n in zip(pdf["word"], pdf["n"]))
        found, nodes, characters = model.piece_counts(rows)
        yield pd.DataFrame([(None, nodes, characters), *((p, n, 0) for p, n in found.items() if p in model.score)], columns=["piece", "n", "characters"])

    sums = words.mapInPandas(use, "piece string, n long, characters long").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("characters").alias("c")).collect()  # as many as the vocabulary has
    trie = next((r for r in sums if r["piece"] is None), None)
    return {r["piece"]: r["n"] for r in sums if r["piece"] is not None}, trie["n"] if trie else 0, trie["c"] if trie else 0


def fitted(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> Unigram:
    """The vocabulary's pieces with scores from all texts of `docs`; no text leaves the scores of the ranks."""
    model = Unigram(path or model_path())
    scope = Scope(docs.sparkSession)
    try:
        words = scope(sorted_words(docs))
        for _ in range(rounds):
            found, _, _ = piece_sums(words, model)
            if found:
                model = model.reestimated(found)
    finally:
        scope.close()
    return model


def count_tokens(docs: DataFrame, model: Unigram | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each row under `model`, fitted on `docs` where none is given. Null and empty texts have none."""
    bound_batches(docs.sparkSession)
    model = model or fitted(docs)

    def work(batches):
        known: dict[str, int] = {}
        for pdf in batches:
            parts = [pretokens(t) for t in pdf["text"]]  # a batch is bounded in bytes
            if len(known) > MOST_CACHED:
                known.clear()
            known.update(model.counts({w for p in parts for w in p if w not in known}))
            pre = [len(p) for p in parts]
            tokens = [sum(map(known.__getitem__, p)) for p in parts]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_pretokens": pre, "n_tokens": tokens})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op9_token_counts(spark, sf_dir):
    """Token counts of every row under scores from all rows. Null and empty texts have none.

    Rows with a null id and repeated rows are counted like others; texts of any length are
    read whole; an empty table gives an empty one; other columns are not read.
    """
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES = {}
