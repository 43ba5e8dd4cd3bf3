"""Boosted trees over cells of binned fields, and ensembles stored as a table of nodes.

A level of a tree is one aggregate: tasks sum the residuals of their cells by node, field and code,
and Spark adds the histograms up, for all folds in one pass. A histogram has as many numbers as there are
nodes and codes, however many cells. Node tables are small: trees times nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "fold int, tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, leaf double"
NAMES = [c.split()[0] for c in NODES.split(", ")]
CLOSED = -1.0


def save_ensemble(spark: SparkSession, nodes: list[dict], path: str) -> None:
    """Write the nodes as JSON lines: a split has feature, threshold (values up to it go left), the side of missing values and both children; a leaf has its value alone."""
    spark.createDataFrame([tuple(n.get(c) for c in NAMES) for n in nodes], NODES).coalesce(1).write.mode("overwrite").json(path)


def load_ensemble(spark: SparkSession, path: str) -> list[dict]:
    """Read and check stored nodes: every child exists and comes after its parent, every node is a split or a leaf."""
    nodes = [{k: v for k, v in r.asDict().items() if v is not None} for r in spark.read.schema(NODES).json(path).collect()]
    known = {(n["fold"], n["tree"], n["node"]) for n in nodes}
    if len(known) < len(nodes):
        raise ValueError(f"{path}: a node is there twice")
    for n in nodes:
        if "leaf" in n:
            continue
        if not {"feature", "threshold", "missing_left", "left", "right"} <= n.keys():
            raise ValueError(f"{path}: node {n['node']} of tree {n['tree']} is neither a split nor a leaf")
        for side in ("left", "right"):
            if n[side] <= n["node"] or (n["fold"], n["tree"], n[side]) not in known:
                raise ValueError(f"{path}: node {n['node']} of tree {n['tree']} has no child {n[side]}")
    return nodes


class Ensemble:
    """Trees of one fold as arrays, walked for all rows at once."""

    def __init__(self, nodes: list[dict], features: Sequence[str]):
        column = {f: i for i, f in enumerate(features)}
        self.trees = []
        for t in sorted({n["tree"] for n in nodes}):
            own = sorted((n for n in nodes if n["tree"] == t), key=lambda n: n["node"])
            place = {n["node"]: i for i, n in enumerate(own)}
            get = lambda n, key, default: n[key] if "leaf" not in n else default
            self.trees.append((
                np.array([column[n["feature"]] if "leaf" not in n else -1 for n in own]), np.array([get(n, "threshold", 0.0) for n in own]), np.array([get(n, "missing_left", True) for n in own], bool),
                np.array([place[n["left"]] if "leaf" not in n else 0 for n in own]), np.array([place[n["right"]] if "leaf" not in n else 0 for n in own]), np.array([n.get("leaf", 0.0) for n in own]),
            ))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf each row reaches in each tree; NaN is missing."""
        out = np.zeros((len(x), len(self.trees)))
        for t, (feature, threshold, missing_left, left, right, leaf) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            while True:
                on = np.flatnonzero(feature[at] >= 0)
                if not len(on):
                    break
                node = at[on]
                v = x[on, feature[node]]
                goes_left = np.where(np.isnan(v), missing_left[node], v <= threshold[node])
                at[on] = np.where(goes_left, left[node], right[node])
            out[:, t] = leaf[at]
        return out


def ensembles(nodes: list[dict], features: Sequence[str], folds: Sequence[int]) -> dict[int, Ensemble]:
    return {f: Ensemble([n for n in nodes if n["fold"] == f], features) for f in folds}


def codes_of(pdf: pd.DataFrame, fields: Sequence[str]) -> np.ndarray:
    return pdf[list(fields)].to_numpy(float)


def pile(total: np.ndarray, x: np.ndarray, node: np.ndarray, values: np.ndarray, sizes: Sequence[int]) -> None:
    """Add the rows' `values` to `total` (nodes, codes, 2) by node and by the code of each field; rows of a negative node are left out."""
    on, start = node >= 0, 0
    for k, s in enumerate(sizes):
        code = np.where(np.isnan(x[:, k]) | (x[:, k] < 0) | (x[:, k] >= s), s, x[:, k]).astype(np.int64)
        np.add.at(total, (node[on], start + code[on]), values[on])
        start += s + 1


def node_of(tree: list[dict], fields: Sequence[str], x: np.ndarray) -> np.ndarray:
    """Slot of the open node each row reaches in a growing tree."""
    return Ensemble(tree, fields).contributions(x)[:, 0].astype(np.int64) if tree else np.zeros(len(x), np.int64)


def added_up(parts: DataFrame, key: str, keys: Sequence, width: int, sizes: Sequence[int]) -> dict:
    """{key: (nodes, codes, 2)}: the sums of the tasks' histograms, rows of (`key`: place in `keys`, i, v)."""
    wide = sum(s + 1 for s in sizes)
    out = np.zeros((len(keys), width * wide * 2))
    for r in parts.where("v != 0").groupBy(key, "i").agg(F.sum("v").alias("v")).toPandas().itertuples(index=False):
        out[int(r[0]), r[1]] = r[2]
    return {k: v.reshape(width, wide, 2) for k, v in zip(keys, out)}


def histograms(cells: DataFrame, fields: Sequence[str], sizes: Sequence[int], period: str, growing: dict[int, list[dict]], ready: list[dict], depth: int) -> dict[int, np.ndarray]:
    """{fold: (nodes, codes, 2)}: lines and residuals, less what `ready` explains, by the node of the growing tree and the code of each field; the last code of a field is missing."""
    width, folds = 2**depth, list(growing)
    frozen = ensembles(ready, fields, folds)

    def work(batches):
        total = np.zeros((len(folds), width, sum(s + 1 for s in sizes), 2))
        for pdf in batches:
            x, when = codes_of(pdf, fields), pdf[period].to_numpy(float)
            n, rest = pdf["n"].to_numpy(float), pdf["rest"].to_numpy(float)
            for i, f in enumerate(folds):
                seen = when < f
                if not seen.any():
                    continue
                y = x[seen]
                left = rest[seen] - n[seen] * frozen[f].contributions(y).sum(axis=1)
                pile(total[i], y, node_of(growing[f], fields, y), np.column_stack([n[seen], left]), sizes)
        for i, v in enumerate(total):
            yield pd.DataFrame({"fold": i, "i": np.arange(v.size), "v": v.ravel()})

    return added_up(cells.mapInPandas(work, "fold int, i int, v double"), "fold", folds, width, sizes)


def best_split(h: np.ndarray, sizes: Sequence[int], ridge: float, least: float) -> tuple[float, int, float, bool] | None:
    """(gain, field, threshold, missing goes left) of one node's histogram (codes, 2), or None where no split gains."""
    score = lambda v: v[..., 1] ** 2 / (v[..., 0] + ridge)
    found, at = None, 0
    for k, s in enumerate(sizes):
        own, missing = h[at : at + s], h[at + s]
        whole = own.sum(axis=0) + missing
        run = np.cumsum(own, axis=0)[:-1]
        for side in (True, False):
            left = run + missing if side else run
            right = whole - left
            gain = np.where((left[:, 0] >= least) & (right[:, 0] >= least), score(left) + score(right) - score(whole), -1.0)
            if len(gain) and gain.max() > (found[0] if found else 1e-9):
                found = (float(gain.max()), k, float(gain.argmax()), side)
        at += s + 1
    return found


def grow(sums: Callable[[dict, int], dict], keys: Sequence, number: int, fields: Sequence[str], sizes: Sequence[int], depth: int, rate: float, ridge: float, least: float) -> list[dict]:
    """Nodes of one tree for each key, level by level; `sums` gives the histograms of the growing trees at a level."""
    trees: dict = {f: [] for f in keys}
    growing: dict = {f: [] for f in keys}
    open_: dict = {f: {0: 0} for f in keys}  # leaf of the growing tree: its node
    for level in range(depth + 1):
        found = sums(growing, level)
        for f in keys:
            place: dict[int, int] = {}
            for slot, node in open_[f].items():
                h = found[f][slot]
                lines, left = h[: sizes[0] + 1].sum(axis=0)  # every field holds all lines of the node
                split = best_split(h, sizes, ridge, least) if level < depth else None
                if split is None:
                    trees[f].append({"fold": f, "tree": number, "node": node, "leaf": float(rate * left / (lines + ridge))})
                    continue
                _, k, threshold, side = split
                trees[f].append({"fold": f, "tree": number, "node": node, "feature": fields[k], "threshold": threshold, "missing_left": side, "left": 2 * node + 1, "right": 2 * node + 2})
                place |= {len(place): 2 * node + 1, len(place) + 1: 2 * node + 2}
            open_[f] = place
            # the tree so far, with leaves that name the slot of an open node, or CLOSED
            growing[f] = [n if "leaf" not in n else {**n, "leaf": CLOSED} for n in trees[f]]
            growing[f] += [{"fold": f, "tree": number, "node": node, "leaf": float(slot)} for slot, node in place.items()]
        if not any(open_.values()):
            break
    return [n for f in keys for n in trees[f]]


def boost(cells: DataFrame, fields: Sequence[str], sizes: Sequence[int], folds: Sequence[int], period: str = "season", rounds: int = 10, depth: int = 2, rate: float = 0.3, ridge: float = 200.0, least: float = 20.0) -> list[dict]:
    """Nodes of `rounds` trees for each fold, each fitted to the residuals that those before leave in the cells of periods before the fold.

    `cells` has the fields' codes (null is missing), n, rest (the sum of outcomes less their base) and `period`. A leaf is
    `rate` times the residuals over lines plus `ridge`; a split needs `least` lines on either side.
    """
    cells = cells.select(period, *fields, F.col("n").cast("double"), F.col("rest").cast("double"))
    ready: list[dict] = []
    for t in range(rounds):
        sums = lambda growing, level: histograms(cells, fields, sizes, period, growing, ready, level)
        ready += grow(sums, folds, t, fields, sizes, depth, rate, ridge, least)
    return ready


def staged_losses(cells: DataFrame, nodes: list[dict], fields: Sequence[str], folds: Sequence[int], rounds: int, period: str = "season") -> dict[int, np.ndarray]:
    """{fold: (rounds + 1)}: squared error sums of the fold's own period after 0, 1, ... trees, less the part no prediction changes."""
    models = ensembles(nodes, fields, folds)

    def work(batches):
        total = {f: np.zeros(rounds + 1) for f in folds}
        for pdf in batches:
            x, when = codes_of(pdf, fields), pdf[period].to_numpy(float)
            for f in folds:
                own = when == f
                if own.any():
                    p = np.cumsum(models[f].contributions(x[own]), axis=1)
                    n, rest = (pdf[c].to_numpy(float)[own][:, None] for c in ("n", "rest"))
                    total[f][1 : p.shape[1] + 1] += (n * p * p - 2 * rest * p).sum(axis=0)
        for f, v in total.items():
            yield pd.DataFrame({"fold": f, "i": np.arange(rounds + 1), "v": v})

    out = {f: np.zeros(rounds + 1) for f in folds}
    for r in cells.select(period, *fields, "n", "rest").mapInPandas(work, "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():
        out[r["fold"]][r["i"]] = r["v"]
    return out


def counts_from_prior(losses: dict[int, np.ndarray], default: int) -> dict[int, int]:
    """Trees for each fold: as many as lost least in the period of the fold before; `default` for the first."""
    folds = sorted(losses)
    return {f: default if i == 0 else int(np.argmin(np.round(losses[folds[i - 1]], 9))) for i, f in enumerate(folds)}


def scored(cells: DataFrame, nodes: list[dict], fields: Sequence[str], counts: dict[int, int], period: str = "season") -> DataFrame:
    """The cells with `shift`: the sum of the first `counts` trees of their period's fold; null where there is none. A row's shift depends on no other row."""
    models = ensembles(nodes, fields, list(counts))

    def work(batches):
        for pdf in batches:
            x, when, out = codes_of(pdf, fields), pdf[period].to_numpy(float), np.full(len(pdf), np.nan)
            for f, k in counts.items():
                own = when == f
                if own.any():
                    out[own] = models[f].contributions(x[own])[:, :k].sum(axis=1)
            yield pdf.assign(shift=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInPandas(work, f"{schema}, shift double").withColumn("shift", F.when(~F.isnan("shift"), F.col("shift")))
