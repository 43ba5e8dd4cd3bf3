"""Quality of documents by supervised subword embeddings.

Each word is its own hashed vector and those of its character n-grams (code points)
with word ends; a
document is the average of all of them, and a softmax layer reads it. Vectors and
layer are learned together by stochastic gradient descent. To score, the product of
vectors and layer is one number for each bucket, and a word's sum is kept while a
task meets it again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, labelled_sample, remainder, table
from .words import mix

BUCKETS, DIM = 1 << 16, 8
GRAMS = (2, 3, 4)
#: The fit takes at most so many labelled documents, chosen by a hash of the id.
MOST_DOCS, EPOCHS, RATE = 3000, 8, 0.5
MOST_CACHED = 1_000_000
THRESHOLD = 0.3
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def buckets_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners): the hashed n-grams of all words, then the words themselves; owners index `words`."""
    spelled = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    flat = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in spelled])
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[owner] - place
    found, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for k in range(max(GRAMS)):
        h[: len(flat) - k] = (h[: len(flat) - k] + flat[k:] + np.uint64(1)) * np.uint64(0x100000001B3)
        if k + 1 in GRAMS:
            fits = left >= k + 1
            found.append(mix(h[fits] + _SALT[k]))
            owners.append(owner[fits])
    # a whole word: its characters by place, summed
    whole = mix((flat + np.uint64(1)) * _SALT[0] ^ (place.astype(np.uint64) * _SALT[1]))
    found.append(mix(np.add.reduceat(whole, np.cumsum(sizes) - sizes)))
    owners.append(np.arange(len(words)))
    return (np.concatenate(found) >> np.uint64(48)).astype(np.int64), np.concatenate(owners)


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


@dataclass
class Model:
    by_bucket: np.ndarray  # the gain of class 1 over class 0
    bias: float

    def scores(self, texts: list[str], cache: dict[bytes, tuple[float, int]]) -> np.ndarray:
        parts = [split(t) for t in texts]
        if len(cache) > MOST_CACHED:
            cache.clear()
        new = list({w for p in parts for w in p if w not in cache})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            at, owner = buckets_of(some)
            total = np.bincount(owner, self.by_bucket[at], len(some))
            cache.update(zip(some, (total + 1j * np.bincount(owner, minlength=len(some))).tolist()))
        out = np.empty(len(parts))
        for i, p in enumerate(parts):
            s = sum(map(cache.__getitem__, p), 0j)
            out[i] = s.real / s.imag if s.imag else 0.0
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Stochastic gradient descent over bags of (buckets, shares)."""
    rng = np.random.default_rng(3)
    e = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    w, b = np.zeros((DIM, 2)), np.zeros(2)
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            rows = e[at]
            h = share @ rows
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= rate * p
            e[at] = rows - (rate * len(at) ** 0.5) * share[:, None] * back
    gain = w[:, 1] - w[:, 0]
    return Model(e @ gain, float(b[1] - b[0]))


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """Fit on at most MOST_DOCS labelled rows; with fewer than two classes the score is their smoothed rate."""
    sample = labelled_sample(docs, labels, "quality", held_out, MOST_DOCS)

    def bags(batches):
        for pdf in batches:
            at, share = [], []
            for text in pdf["text"]:
                words = split(text or "")
                found = np.bincount(buckets_of(words)[0], minlength=BUCKETS) if words else np.zeros(BUCKETS, np.int64)
                i = np.flatnonzero(found)
                at.append(i.astype(np.uint16).tobytes())
                share.append((found[i] / max(1, found.sum())).astype(np.float32).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "at": at, "share": share})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInPandas(bags, f"doc_id {kind}, label int, at binary, share binary").toPandas().sort_values("doc_id", ignore_index=True)
    y = rows["label"].to_numpy(dtype=np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    return fit([(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(s, np.float32).astype(float)) for a, s in zip(rows["at"], rows["share"])], y)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row; null and empty texts get the score of the bias alone."""

    def rate(batches):
        cache: dict = {}
        for pdf in batches:
            out = np.concatenate([model.scores(run, cache) for _, run in chunks(pdf["text"].tolist())] or [np.zeros(0)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": out})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(rate, f"doc_id {kind}, score double")


def op6_quality(spark, sf_dir):
    """Quality of every row. Null, empty and wordless texts get the score of the bias alone.

    Null labels and ids are not learned from; without both classes every score is the
    smoothed rate of the sample (0.5 without any). A null id has a null held_out. Repeated
    rows are scored each; very long texts are read whole; an empty table gives an empty
    one; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels"), held)
    return score_documents(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op6_quality": op6_quality}
ORACLES = {}
