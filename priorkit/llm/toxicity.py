"""Toxicity of documents by a subsequence string-kernel SVM with Nystroem landmarks.

A unit is a token in lower case, or a run of single characters written apart
("i d i o t") joined up. The kernel of two units counts the subsequences of four
symbols they share, each weighted DECAY ** span in either unit; a subsequence may
skip symbols up to a span of SPAN, so inserted and gapped letters cost weight, not
the match. Signs only make gaps; digits and signs that stand for letters are read
as those; letters outside a to z share a few symbols. The kernel of two sentences is
the mean over the pairs of their units, scaled by the root of their lengths.

Training: labelled documents are cut into sentences of at most SENTENCE units, which
carry the label of their document. Not every sentence of a toxic document is toxic,
so the SVM is fitted in rounds: from each toxic document the sentence that scores
highest stands for it, from each clean one its highest and another. The first round
scores by how many different units a unit follows in toxic and in clean documents,
the later ones by the SVM of the round before. Copies of a sentence count once.
Landmarks are units of those sentences. Because the kernel is a dot product of
subsequence weights, the fitted sum over landmarks folds into one weight for each
subsequence, and a unit is scored in one pass over its symbols.

A document shows its largest sentence margin, how many sentences have a positive one,
their share, and its largest unit; a logistic curve over these, fitted on the sample,
gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, chunks, labelled_sample, remainder, table

#: Bounds of the fit: labelled documents, clean sentences, landmarks; the sentences of toxic documents are one for each.
MOST_DOCS, MOST_CLEAN, LANDMARKS, ROUNDS = 6000, 4000, 240, 3
SENTENCE = 24
#: With fewer different toxic sentences nothing is learned.
LEAST_TOXIC = 3
LENGTH, SPAN, DECAY = 4, 7, 0.75
GAP, FIRST, LAST, FOREIGN = 26, 27, 28, 29
SYMBOLS = FOREIGN + 4
#: Signs written in place of letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
TRIM = ".,;:!?#*$%&|\"'()[]"
MOST_CACHED = 1_000_000
THRESHOLD = 0.3

_CODE = {**{chr(97 + i): i for i in range(26)}, **{k: ord(v) - 97 for k, v in LOOKALIKE.items()}}
_COMBOS = [c for c in combinations(range(1, SPAN), LENGTH - 1)]
_APART = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def units_of(text: str) -> list[str]:
    """Units of a lower-cased text, in order; joined runs come last."""
    return [w.strip(TRIM) for w in text.split()] + ["".join(m.split()) for m in _APART.findall(text)]


def sentences_of(text: str) -> list[list[str]]:
    """Sentences of a text, as lists of at most SENTENCE units; those without a unit are left out."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        units = [u for u in units_of(sentence) if u]
        out += [units[i : i + SENTENCE] for i in range(0, len(units), SENTENCE)]
    return out


def symbol(c: str) -> int:
    return _CODE[c] if c in _CODE else FOREIGN + ord(c) % 4 if c.isalpha() else GAP


def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all units in one array, with SPAN gaps after each; starts of the units."""
    flat, starts = [], []
    for u in units:
        starts.append(len(flat))
        flat.append(FIRST)
        flat += map(symbol, u)
        flat.append(LAST)
        flat += [GAP] * SPAN
    return np.array(flat, np.int32), np.array(starts, np.int64)


def features(symbols: np.ndarray, n: int):
    """For each shape of subsequence: its codes at the first n positions, its weight, and where no symbol is a gap."""
    s = [symbols[k : k + n] for k in range(SPAN)]
    real = [x != GAP for x in s]
    for a, b, c in _COMBOS:
        yield ((s[0] * SYMBOLS + s[a]) * SYMBOLS + s[b]) * SYMBOLS + s[c], DECAY ** (c + 1), real[0] & real[a] & real[b] & real[c]


def dot(units: list[str], weights: np.ndarray) -> np.ndarray:
    """Product of each unit's subsequence weights, scaled to length 1, with `weights`."""
    if not units:
        return np.zeros(0, np.float32)
    symbols, starts = encode(units)
    n = len(symbols) - SPAN
    at, squares = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for code, w, real in features(symbols, n):
        at += np.float32(w) * (weights[code] * real)
        squares += np.float32(w * w) * real
    scale = np.sqrt(np.add.reduceat(squares, starts))
    return np.add.reduceat(at, starts) / np.where(scale > 0, scale, 1)


def rows_of(units: list[str], columns: np.ndarray) -> np.ndarray:
    """A dense row of scaled weights for each unit, over the subsequences in the sorted `columns`."""
    out = np.zeros((len(units), len(columns)), np.float32)
    symbols, starts = encode(units)
    n = len(symbols) - SPAN
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    squares = np.zeros(len(units))
    for code, w, real in features(symbols, n):
        i = np.flatnonzero(real)
        squares += np.bincount(owner[i], minlength=len(units)) * (w * w)
        col = np.searchsorted(columns, code[i])
        col[col == len(columns)] = 0
        there = columns[col] == code[i]
        np.add.at(out, (owner[i][there], col[there]), np.float32(w))
    return out / np.sqrt(np.where(squares > 0, squares, 1))[:, None].astype(np.float32)


def subsequences(units: list[str]) -> np.ndarray:
    symbols, _ = encode(units)
    return np.unique(np.concatenate([code[real] for code, _, real in features(symbols, len(symbols) - SPAN)]))


@dataclass
class Model:
    weights: np.ndarray  # by subsequence
    bias: float
    curve: np.ndarray  # of the four features and 1
    constant: float | None = None  # the score of every text, where nothing could be learned

    def answers(self, units: list[str]) -> np.ndarray:
        out = [dot(units[i : i + 20_000], self.weights) for i in range(0, len(units), 20_000)]
        return np.concatenate(out) if out else np.zeros(0)

    def margins(self, units: list[str]) -> np.ndarray:
        """Of sentences of one unit each."""
        return self.answers(units) + self.bias

    def look_up(self, sentences: list[list[str]], cache: dict[str, float]) -> np.ndarray:
        """The answer of each unit, sentence after sentence."""
        if len(cache) > MOST_CACHED:
            cache.clear()
        new = list({u for s in sentences for u in s if u not in cache})
        cache.update(zip(new, self.answers(new).tolist()))
        return np.array([cache[u] for s in sentences for u in s])

    def sentence_margins(self, sentences: list[list[str]], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each sentence, answer of each unit)."""
        if not sentences:
            return np.zeros(0), np.zeros(0)
        answers = self.look_up(sentences, cache)
        sizes = np.array([len(s) for s in sentences])
        return np.add.reduceat(answers, np.cumsum(sizes) - sizes) / np.sqrt(sizes) + self.bias, answers

    def features(self, texts: list[str], cache: dict[str, float]) -> np.ndarray:
        """Of each text: its largest sentence margin, the log of how many are positive, of their share, and the largest unit. A text without units has the least of each."""
        parts = [sentences_of(t) for t in texts]
        margins, answers = self.sentence_margins([s for p in parts for s in p], cache)
        out, i, k = np.empty((len(parts), 4)), 0, 0
        for row, p in enumerate(parts):
            j, n = i + len(p), k + sum(map(len, p))
            hits = (margins[i:j] > 0).sum()
            out[row] = np.clip(margins[i:j].max(initial=-2), -2, 3), np.log1p(hits), np.log((hits + 0.3) / (len(p) + 5)), np.clip(answers[k:n].max(initial=-2), -2, 6)
            i, k = j, n
        return out

    def scores(self, texts: list, cache: dict[str, float]) -> np.ndarray:
        """The score of each text; nulls are empty texts."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        rows = [self.features(run, cache) for _, run in chunks(texts)]
        return self.score(np.concatenate(rows)) if rows else np.zeros(0)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, pos, neg): different preceding units in toxic and in clean documents."""

    def pairs(batches):
        for pdf in batches:
            seen = set()
            for text, label in zip(pdf["text"], pdf["label"]):
                for sentence in _SENTENCE.split((text or "").lower()):
                    before = ""
                    for u in units_of(sentence):
                        if u:
                            seen.add((u, before, int(label)))
                        before = u
            yield pd.DataFrame(list(seen), columns=["unit", "before", "label"])

    found = sample.mapInPandas(pairs, "unit string, before string, label int")
    by_place = found.groupBy("unit", "before").agg(F.max("label").alias("toxic"), F.min("label").alias("least"))
    return by_place.groupBy("unit").agg(
        F.sum("toxic").cast("long").alias("pos"), F.sum((F.col("least") == 0).cast("long")).alias("neg")
    )


def fit_svm(positive: list, negative: list, landmarks: int = LANDMARKS, c: float = 2000.0, steps: int = 60, marks: list[str] | None = None) -> Model:
    """A squared-hinge SVM on Nystroem features of sentences (lists of units; a string is a sentence of one); both classes weigh the same in sum.

    `marks` are the landmarks; without them the first units of either class are.
    """
    if not positive or not negative:
        return Model(np.zeros(SYMBOLS**LENGTH, np.float32), -1.0, np.zeros(5))
    positive, negative = ([[s] if isinstance(s, str) else s for s in x] for x in (positive, negative))
    if marks is None:
        first, second = (list(dict.fromkeys(u for s in x for u in s)) for x in (positive, negative))
        marks = first[: landmarks // 2] + second[: landmarks - min(landmarks // 2, len(first))]
    columns = subsequences(marks)
    basis = rows_of(marks, columns).T.astype(np.float64)
    values, vectors = np.linalg.eigh(basis.T @ basis)
    keep = values > 1e-6 * values.max()
    project = vectors[:, keep] / np.sqrt(values[keep])
    sentences = positive + negative
    units = list(dict.fromkeys(u for s in sentences for u in s))
    at = {u: i for i, u in enumerate(units)}
    fold = (basis @ project).astype(np.float32)
    z = np.concatenate([rows_of(units[i : i + 200], columns) @ fold for i in range(0, len(units), 200)])
    sizes = np.array([len(s) for s in sentences])
    x = np.add.reduceat(z[[at[u] for s in sentences for u in s]], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
    x = np.hstack([x.astype(np.float64), np.ones((len(sentences), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.r_[np.full(len(positive), c / len(positive)), np.full(len(negative), c / len(negative))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):  # Newton's method: the active rows settle in a few rounds
        act = y * (x @ w) < 1
        xa = x[act] * cost[act, None]
        new = np.linalg.solve(ridge + xa.T @ x[act], xa.T @ y[act])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    weights = np.zeros(SYMBOLS**LENGTH, np.float32)
    weights[columns] = basis @ (project @ w[:-1])
    return Model(weights, float(w[-1]), np.zeros(5))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x and of 1, by Newton steps with a small ridge."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chosen_sentences(sample: DataFrame, model: Model | None, evidence: dict[str, float]) -> pd.DataFrame:
    """(label, units, unit) of the sentences that stand for the documents: of each the one that scores highest, of clean ones another too; `unit` is its highest. Copies count once."""

    def choose(batches):
        cache: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for text, label in zip(pdf["text"], pdf["label"]):
                sentences = sentences_of(text or "")
                if not sentences:
                    continue
                if model is None:
                    answers = np.array([evidence.get(u, 0.0) for s in sentences for u in s])
                    sizes = np.array([len(s) for s in sentences])
                    margins = np.maximum.reduceat(answers, np.cumsum(sizes) - sizes)
                else:
                    margins, answers = model.sentence_margins(sentences, cache)
                for i in {int(margins.argmax())} | ({crc32(" ".join(sentences[0]).encode("utf-8", "replace")) % len(sentences)} if not label else set()):
                    start = sum(map(len, sentences[:i]))
                    own = answers[start : start + len(sentences[i])]
                    rows.append((int(label), sentences[i], sentences[i][int(own.argmax())]))
            yield pd.DataFrame(rows, columns=["label", "units", "unit"])

    found = sample.select("text", "label").mapInPandas(choose, "label int, units array<string>, unit string")
    return found.groupBy("label", "units").agg(F.min("unit").alias("unit")).orderBy("label", F.xxhash64("units"), "units").toPandas()  # two for each document of the sample at most


def train(docs: DataFrame, labels: DataFrame, held_out, most_docs: int = MOST_DOCS) -> Model:
    """Fit on at most `most_docs` labelled documents.

    Where fewer than LEAST_TOXIC different sentences stand for toxic documents, or none for
    clean ones, every score is the smoothed rate of the sample, 0 for an empty one; it
    stays below the threshold, as no document stands out.
    """
    scope = Scope(docs.sparkSession)
    sample = scope(labelled_sample(docs, labels, "toxic", held_out, most_docs))
    counts = unit_counts(sample).where("pos > neg").withColumn("gain", F.col("pos") * F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5)))
    evidence = {r["unit"]: r["gain"] for r in counts.select("unit", "gain").collect()}  # units of the bounded sample
    model = None
    for _ in range(ROUNDS):
        found = chosen_sentences(sample, model, evidence)
        toxic, clean = found[found["label"] == 1], found[found["label"] == 0].head(MOST_CLEAN)
        if len(toxic) < LEAST_TOXIC or not len(clean):
            n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
            scope.close()
            rate = float(min((positive + 0.5) / (n + 1), np.nextafter(THRESHOLD, 0))) if n else 0.0
            return Model(np.zeros(SYMBOLS**LENGTH, np.float32), -1.0, np.zeros(5), rate)
        shown = [list(dict.fromkeys(pd.Series(units).value_counts(sort=False).sort_values(ascending=False, kind="stable").index)) for units in (toxic["unit"], clean["units"].explode())]
        marks = shown[0][: LANDMARKS // 2]
        marks += [u for u in shown[1] if u not in set(marks)][: LANDMARKS - len(marks)]
        model = fit_svm([list(u) for u in toxic["units"]], [list(u) for u in clean["units"]], marks=marks)

    def show(batches):
        cache: dict[str, float] = {}
        for pdf in batches:
            rows = np.concatenate([model.features(run, cache) for _, run in chunks(pdf["text"].tolist())] or [np.zeros((0, 4))])
            yield pd.DataFrame({"x": list(rows), "label": pdf["label"]})

    seen = sample.select("text", "label").mapInPandas(show, "x array<double>, label int").toPandas()
    model.curve = fit_logistic(np.stack(seen["x"]), seen["label"].to_numpy(float))
    scope.close()
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row. Null and empty texts score as texts without units; null ids stay null."""

    def rate(batches):
        cache: dict[str, float] = {}
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.scores(pdf["text"].tolist(), cache)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(rate, f"doc_id {kind}, score double")


def held(modulus: int, value: int):
    return remainder("doc_id", modulus) == value


def op1_toxicity(spark, sf_dir):
    """Toxicity of every row. Null, empty and unitless texts score alike, as texts without a sentence.

    Null labels and ids are not learned from; without enough to learn from every score is
    one constant below the threshold (see train). A null id has a null held_out. Repeated
    rows are scored each; very long texts are read whole; an empty table gives an empty
    one; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), held(4, 2))
    return score_documents(docs, model).select(
        "doc_id", held(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns as they are.

    Each row is judged by its text alone: rows with a null id, null or empty text, and
    repeated rows too. Where nothing can be learned all rows stay; an empty table stays empty.
    """
    model = train(docs, table(spark, sf_dir, "labels"), held(4, 2))

    def keep(batches):
        cache: dict[str, float] = {}
        for batch in batches:  # Arrow rows pass as they are, whatever their types and nulls
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(model.scores(texts, cache) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES = {}
