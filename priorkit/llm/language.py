"""Language of documents by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points of the lower-cased text are hashed to BUCKETS.
Inverse document frequencies count every training document. Weights are learned by
follow-the-regularised-leader steps with an L1 and an L2 penalty, which leaves most
of them zero; a temperature fitted on a part kept out of the steps calibrates the
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lowest_hashes, remainder, table

BUCKETS = 1 << 15
#: The steps run over at most so many training documents, chosen by a hash of the id.
MOST_DOCS = 4000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
BATCH, EPOCHS = 16, 3
NONE = "und"


def counts_of(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return np.zeros(BUCKETS)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    shift = np.uint32(32 - 15)
    out = np.bincount(one * np.uint32(0x27D4EB2F) >> shift, minlength=BUCKETS)
    out += np.bincount((two ^ (two >> np.uint32(16))) * np.uint32(0x165667B1) >> shift, minlength=BUCKETS)
    out += np.bincount((three ^ (three >> np.uint32(16))) * np.uint32(0x7FEB352D) >> shift, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = counts_of(text)
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of `train` each bucket occurs, and the number of texts."""

    def count(batches):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen += counts_of(text or "") > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.r_[at, -1], "n": np.r_[seen[at], n]})

    rows = train.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    real = rows[rows["bucket"] >= 0]
    df[real["bucket"]] = real["n"]
    return df, int(rows.loc[rows["bucket"] == -1, "n"].sum())


def ftrl(vectors: list, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after EPOCHS passes of FTRL-proximal steps over batches."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[at == BUCKETS] = -z[BUCKETS] * ALPHA / (BETA + np.sqrt(n[BUCKETS]))
        return w

    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(vectors))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            ats = [np.append(vectors[r][0], BUCKETS) for r in rows]
            at, inverse = np.unique(np.concatenate(ats), return_inverse=True)
            x = np.zeros((len(rows), len(at)))
            x[np.repeat(np.arange(len(rows)), [len(a) for a in ats]), inverse] = np.concatenate([np.append(vectors[r][1], 1.0) for r in rows])
            w = weights(at)
            p = softmax(x @ w)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = x.T @ p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, g = np.log(0.02), np.log(10), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_model(docs: DataFrame, held_out) -> Model | None:
    """Learn from rows outside the held-out part with a language; None if there is no such row.

    Document frequencies count all of them. The steps and the temperature see at most
    MOST_DOCS rows, so that a language none of them has is never predicted.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    df, total = document_frequencies(known)
    idf = np.log((1 + total) / (1 + df)) + 1

    ids = lowest_hashes(known.select("doc_id", "lang", F.xxhash64("text").alias("th")), MOST_DOCS, "doc_id", "lang", "th").dropDuplicates()
    blank = Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))

    def vectors(batches):
        for pdf in batches:
            v = [blank.vector(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "at": [a.astype(np.uint16).tobytes() for a, _ in v], "x": [x.astype(np.float32).tobytes() for _, x in v]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = (
        known.select("doc_id", "lang", "text", F.xxhash64("text").alias("th")).join(F.broadcast(ids), ["doc_id", "lang", "th"])
        .groupBy("doc_id", "lang", "th").agg(F.first("text").alias("text"))
        .mapInPandas(vectors, f"doc_id {kind}, lang string, at binary, x binary")
        .toPandas().sort_values(["doc_id", "lang", "at", "x"], ignore_index=True)
    )
    if sample.empty:
        return None
    languages = sorted(sample["lang"].unique())
    y = sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    v = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(sample["at"], sample["x"])]
    aside = np.arange(len(v)) % 5 == 4
    w, b = ftrl([v[i] for i in np.flatnonzero(~aside)], y[~aside], len(languages))
    model = Model(languages, idf, w, b)
    if aside.any() and len(languages) > 1:
        model.temperature = best_temperature(np.stack([model.logits(*v[i]) for i in np.flatnonzero(aside)]), y[aside])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; 'und' with score 0 for texts that are null or have no letter, or without a model."""

    def guess(batches):
        for pdf in batches:
            named, scores = [], []
            for _, run in chunks(pdf["text"].tolist()):
                for text in run:
                    if model is None or not any(map(str.isalpha, text)):
                        named.append(NONE)
                        scores.append(0.0)
                        continue
                    p = softmax(model.logits(*model.vector(text)) / model.temperature)
                    named.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": named, "score": scores})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(guess, f"doc_id {kind}, lang_pred string, score double")


def op2_language(spark, sf_dir):
    """Language of every row. Null, empty and letterless texts are 'und' with score 0, as is all where nothing can be learned.

    A null id is not held out by its null remainder, and held_out is null for it. Repeated
    rows are predicted each; ties go to the first language of the alphabet; very long texts
    are read whole; an empty table gives an empty one; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 3) == 1
    return predict(docs, train_model(docs, held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
ORACLES = {}
