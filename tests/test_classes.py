import numpy as np
import pytest

from priorkit.operators import classes
from priorkit.plans import taxonomies

SF = "/root/testdata/sf0.001"
SIZES, FIELDS, GROUPS = [4, 3], ["a", "b"], [["u", "v", "w"], ["yes", "no"]]
SCHEMA = "season int, a int, b int, u double, v double, w double, yes double, no double"


def made(n=160, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = int(rng.integers(4)), int(rng.integers(3))
        size = int(rng.integers(20, 60)) * (3 if i % 4 == 0 else 1)
        p = [0.6, 0.2, 0.2] if a >= 2 else [0.2, 0.3, 0.5]
        u, v, w = rng.multinomial(size, p)
        yes = rng.binomial(size, 0.7 if b == 1 else 0.4)
        rows.append((1995 + i % 4, None if rng.random() < 0.1 else a, b, float(u), float(v), float(w), float(yes), float(size - yes)))
    return rows


def plain(rows, fold, group, rounds, depth, rate, ridge, least):
    """Softmax boosting by recursion over lists: probabilities of all rows."""
    x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows], float)
    at = [SCHEMA.split(", ").index(f"{c} double") for c in group]
    y, when = np.array([[r[i] for i in at] for r in rows]), np.array([r[0] for r in rows])
    seen, n = when < fold, y.sum(axis=1)
    years = sorted(set(when[seen]))
    w = np.zeros(len(rows))
    for year in years:
        w[when == year] = n[seen].sum() / len(years) / n[when == year].sum()
    counts = (w[:, None] * y)[seen].sum(axis=0) + 0.5
    z = np.tile(np.log(counts / counts.sum()), (len(rows), 1))
    for _ in range(rounds):
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        for k in range(len(group)):
            g, h, out = w * (y[:, k] - n * p[:, k]), w * n * p[:, k] * (1 - p[:, k]), np.zeros(len(rows))

            def spread(mask, level):
                own, best = mask & seen, None
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)  # noqa: B023, E731
                for f, s in enumerate(SIZES) if level < depth else ():
                    for side in (True, False):
                        for t in range(s - 1):
                            goes = np.where(np.isnan(x[:, f]), side, x[:, f] <= t)
                            left, right = own & goes, own & ~goes
                            if h[left].sum() >= least and h[right].sum() >= least:
                                gain = score(left) + score(right) - score(own)
                                if gain > (best[0] + 1e-9 if best else 1e-9):
                                    best = (gain, goes)
                if best is None:
                    out[mask] = rate * g[own].sum() / (h[own].sum() + ridge)  # noqa: B023
                else:
                    spread(mask & best[1], level + 1)
                    spread(mask & ~best[1], level + 1)

            spread(np.ones(len(rows), bool), 0)
            z[:, k] += out
    return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)


def test_class_trees_equal_plain_ones_and_find_the_planted_split(spark):
    rows = made()
    cells = spark.createDataFrame(rows, SCHEMA).repartition(3)
    args = dict(rounds=3, depth=2, rate=0.5, ridge=10.0, least=5.0)
    model = classes.boost_classes(cells, FIELDS, SIZES, GROUPS, [1997, 1998], **args)
    got = {tuple(r)[:8]: r for r in classes.class_scored(cells, model).collect()}
    for fold in (1997, 1998):
        for group in GROUPS:
            want = plain(rows, fold, group, **args)
            for r, p in zip(rows, want):
                if r[0] == fold:
                    found = [got[r][f"p_{c}"] for c in group]
                    assert found == pytest.approx(list(p), abs=1e-9) and sum(found) == pytest.approx(1, abs=1e-12)
    assert all(r["p_u"] is None for k, r in got.items() if k[0] < 1997)
    high, low = (np.mean([r["p_u"] for k, r in got.items() if k[0] == 1998 and k[1] in a]) for a in ((2, 3), (0, 1)))
    assert high > 0.5 > 0.3 > low


def test_no_fold_sees_its_own_or_later_periods(spark):
    rows = made()
    other = [(*r[:3], *r[3:6][::-1], r[7], r[6]) if r[0] >= 1997 else r for r in rows]
    fit = lambda x: classes.boost_classes(spark.createDataFrame(x, SCHEMA).coalesce(1), FIELDS, SIZES, GROUPS, [1997], rounds=2)
    a, b = fit(rows), fit(other)
    assert a.shares == b.shares and a.nodes == b.nodes


def test_null_counts_empty_tables_and_unseen_periods(spark):
    empty = classes.boost_classes(spark.createDataFrame([], SCHEMA), FIELDS, SIZES, GROUPS, [1996])
    assert empty.nodes == [] and classes.class_scored(spark.createDataFrame([], SCHEMA), empty).count() == 0
    rows = [(1995, 0, None, 5.0, None, 1.0, 3.0, 3.0), (None, 1, 1, 9.0, 9.0, 9.0, 20.0, 7.0), (1996, 9, 2, 1.0, 1.0, 1.0, 2.0, 1.0)]
    cells = spark.createDataFrame(rows, SCHEMA)
    model = classes.boost_classes(cells, FIELDS, SIZES, GROUPS, [1995, 1996], rounds=1)
    assert list(model.shares) == [1996] and model.shares[1996]["u"] == pytest.approx(5.5 / 7.5)
    assert {r["season"]: r["p_u"] is not None for r in classes.class_scored(cells, model).collect()} == {1995: False, None: False, 1996: True}


def test_periods_weigh_alike():
    import pandas as pd

    w = classes.period_weights(pd.DataFrame({"season": [1995, 1996, 1997], "n": [30.0, 10.0, 99.0]}), "season", [1997])
    assert w == {1997: {1995: pytest.approx(20 / 30), 1996: pytest.approx(2.0)}}


def test_rolling_ridge_equals_plain_solves(spark):
    rng = np.random.default_rng(2)
    rows = [(1995 + i % 3, *map(float, rng.normal(size=2)), float(rng.normal()), float(rng.integers(1, 9))) for i in range(60)] + [(1995, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    got = classes.rolling_ridge(spark.createDataFrame(rows, "season int, x double, y double, rest double, n double"), ["x", "y"], "rest", "n", 3.0)
    assert sorted(got) == [1996, 1997]
    for year, w in got.items():
        a = np.array([r for r in rows if None not in r and r[0] < year])
        want = np.linalg.solve((a[:, 1:3] * a[:, 4:]).T @ a[:, 1:3] + 3 * np.eye(2), a[:, 1:3].T @ a[:, 3])
        assert w == pytest.approx(want, abs=1e-9)


def test_queries_beat_earlier_shares_and_stay_near_the_base(spark):
    got = taxonomies.class_taxonomy(spark, SF).collect()
    assert len(got) >= 5 and all(r["off"] < 1e-9 and r["model"] < r["base"] for r in got)  # a class holds the discount, which is a field
    stack = {r["season"]: r for r in taxonomies.auxiliary_stack(spark, SF).collect()}
    first = min(stack)
    assert stack[first]["size"] is None and stack[first]["brier"] == stack[first]["base"]
    assert all(r["size"] > 0 and abs(r["brier"] - r["base"]) < 0.01 for y, r in stack.items() if y != first)
