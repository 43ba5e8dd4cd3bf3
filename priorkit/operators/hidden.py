"""A hidden Markov model of discrete observations, fitted by rounds of expectation over all sequences.

Sequences are rows; each task turns its sequences into sums of expected counts, which
are added up by Spark, so that a round sends a few dozen numbers to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_counts(observed: list[int | None], start: np.ndarray, move: np.ndarray, show: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of one sequence, and its log likelihood, by a scaled forward and backward pass.

    A period without an observation (None) says nothing of its state: all states show it alike, and it counts as no emission.
    """
    n, k = len(observed), len(start)
    seen = np.stack([np.ones(k) if o is None else show[:, o] for o in observed])
    forward, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a = seen[t] * (start if t == 0 else forward[t - 1] @ move)
        scale[t] = a.sum()
        forward[t] = a / scale[t]
    backward = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        backward[t] = move @ (seen[t + 1] * backward[t + 1]) / scale[t + 1]
    state = forward * backward
    moves = sum((forward[t][:, None] * move * (seen[t + 1] * backward[t + 1])[None, :] / scale[t + 1] for t in range(n - 1)), np.zeros((k, k)))
    shown = np.zeros_like(show)
    for t, o in enumerate(observed):
        if o is not None:
            shown[:, o] += state[t]
    return state[0], moves, shown, float(np.log(scale).sum())


def updated(starts: np.ndarray, moves: np.ndarray, shown: np.ndarray, sticky: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters from expected counts, with one count more everywhere and `sticky` more for staying."""
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    return share(starts + 1), share(moves + 1 + sticky * np.eye(len(starts))), share(shown + 1)


def fit(sequences: DataFrame, column: str, start, move, show, rounds: int, sticky: float = 4.0):
    """(start, move, show, log likelihoods) after `rounds` over all rows with a non-empty array in `column`, whose nulls are periods without an observation; states in ascending order of the last symbol's share."""
    start, move, show = (np.array(x, float) for x in (start, move, show))
    k, m = show.shape
    told = []
    for _ in range(rounds):

        def count(batches, start=start, move=move, show=show):
            total = np.zeros(k + k * k + k * m + 1)
            for pdf in batches:
                for x in pdf[column]:
                    if x is not None and len(x):
                        s, t, e, ll = expected_counts([None if v is None or v != v else int(v) for v in x], start, move, show)
                        total += np.concatenate([s, t.ravel(), e.ravel(), [ll]])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        sums = sequences.select(column).mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        if not len(sums):
            break
        start, move, show = updated(sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k : -1].reshape(k, m), sticky)
        told.append(float(sums[-1]))
    order = np.argsort(show[:, -1], kind="stable")
    return start[order], move[order][:, order], show[order], told
