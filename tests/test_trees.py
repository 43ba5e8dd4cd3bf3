import numpy as np
import pytest
from pyspark.sql import functions as F

from priorkit.operators import trees

SIZES, FIELDS = [4, 3, 5], ["a", "b", "c"]
SCHEMA = "season int, a int, b int, c int, n double, rest double"


def made(n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (int(rng.integers(s)) for s in SIZES)
        effect = (0.2 if a >= 2 else -0.2) if b == 1 else 0.0
        size = int(rng.integers(20, 60))
        rows.append((1995 + i % 5, a, None if rng.random() < 0.1 else b, c, float(size), float(size * effect + rng.normal())))
    return rows


def plain_boost(rows, upto, rounds, depth, rate, ridge, least):
    """Exact greedy trees by recursion over lists; (rounds, rows) of contributions to all rows."""
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], float)
    n, rest, seen = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), np.array([r[0] < upto for r in rows])
    out = []
    for _ in range(rounds):
        p = np.zeros(len(rows))

        def grow(mask, level):
            at = mask & seen
            score = lambda m: rest[m].sum() ** 2 / (n[m].sum() + ridge)  # noqa: B023, E731
            best = None
            if level < depth:
                for k, s in enumerate(SIZES):
                    for side in (True, False):
                        for t in range(s - 1):
                            goes = np.where(np.isnan(x[:, k]), side, x[:, k] <= t)
                            left, right = at & goes, at & ~goes
                            if n[left].sum() >= least and n[right].sum() >= least:
                                gain = score(left) + score(right) - score(at)
                                if gain > (best[0] + 1e-9 if best else 1e-9):
                                    best = (gain, goes)
            if best is None:
                p[mask] = rate * rest[at].sum() / (n[at].sum() + ridge)
            else:
                grow(mask & best[1], level + 1)
                grow(mask & ~best[1], level + 1)

        grow(np.ones(len(rows), bool), 0)
        rest = rest - n * p
        out.append(p)
    return np.array(out)


def test_trees_equal_plain_greedy_ones(spark):
    rows = made()
    cells = spark.createDataFrame(rows, SCHEMA).repartition(3)
    args = dict(rounds=4, depth=2, rate=0.5, ridge=10.0, least=30.0)
    nodes = trees.boost(cells, FIELDS, SIZES, [1997, 1999], **args)
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], float)
    for fold in (1997, 1999):
        got = trees.ensembles(nodes, FIELDS, [fold])[fold].contributions(x).T
        assert np.allclose(got, plain_boost(rows, fold, **args), atol=1e-9)


def test_counts_come_from_the_year_before_and_beat_the_base(spark):
    rows = made(500)
    cells = spark.createDataFrame(rows, SCHEMA)
    nodes = trees.boost(cells, FIELDS, SIZES, [1996, 1997, 1998, 1999], rounds=6, rate=0.5, ridge=10.0)
    losses = trees.staged_losses(cells, nodes, FIELDS, [1996, 1997, 1998, 1999], 6)
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], float)
    for f, model in trees.ensembles(nodes, FIELDS, list(losses)).items():
        own = np.array([r[0] == f for r in rows])
        n, rest = (np.array([r[i] for r in rows])[own] for i in (4, 5))
        p = np.cumsum(model.contributions(x[own]), axis=1)
        assert np.allclose(losses[f][1:], (n[:, None] * p * p - 2 * rest[:, None] * p).sum(axis=0)) and losses[f][0] == 0
    counts = trees.counts_from_prior(losses, 2)
    assert counts[1996] == 2 and all(counts[f + 1] == np.argmin(losses[f]) for f in (1996, 1997, 1998))
    assert all(losses[f][counts[f]] < 0 for f in (1997, 1998, 1999))  # better than no tree
    other = [r if r[0] < 1998 else (*r[:5], -r[5]) for r in rows]
    again = trees.boost(spark.createDataFrame(other, SCHEMA), FIELDS, SIZES, [1998], rounds=2, rate=0.5, ridge=10.0)
    assert again == [n for n in nodes if n["fold"] == 1998 and n["tree"] < 2]  # no year sees itself


def test_stored_ensembles_score_alike_row_by_row(spark, tmp_path):
    rows = made(120)
    cells = spark.createDataFrame(rows, SCHEMA)
    nodes = trees.boost(cells, FIELDS, SIZES, [1998], rounds=3, depth=3, ridge=5.0, least=5.0)
    trees.save_ensemble(spark, nodes, f"{tmp_path}/e")
    stored = trees.load_ensemble(spark, f"{tmp_path}/e")
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    score = lambda df, n: sorted(map(tuple, trees.scored(df, n, FIELDS, {1998: 3}).collect()), key=key)
    whole = score(cells, nodes)
    assert whole == score(cells.repartition(5), stored) == sorted((r for part in (cells.where("c < 2"), cells.where("c >= 2")) for r in score(part, stored)), key=key)
    assert all((r[-1] is None) == (r[0] != 1998) for r in whole)
    for broken in ([n for n in nodes if n["node"] != 1], nodes + nodes[:1], [{k: v for k, v in n.items() if k != "threshold"} for n in nodes]):
        trees.save_ensemble(spark, broken, f"{tmp_path}/broken")
        with pytest.raises(ValueError):
            trees.load_ensemble(spark, f"{tmp_path}/broken")


def test_empty_cells_give_single_leaves(spark):
    nodes = trees.boost(spark.createDataFrame([], SCHEMA), FIELDS, SIZES, [1998], rounds=2)
    assert [n["leaf"] for n in nodes] == [0.0, 0.0]
    cells = spark.createDataFrame(made(10), SCHEMA)
    assert trees.scored(cells, nodes, FIELDS, {1998: 2}).agg(F.sum("shift")).first()[0] == 0.0


def test_queries_cover_the_later_years(spark):
    from priorkit.plans import learners
    from tests.conftest import SF

    boosted = learners.residual_boosting(spark, SF).collect()
    assert {r.season for r in boosted} == set(range(1996, 2002)) and all(0 <= r.trees <= learners.ROUNDS for r in boosted)
    assert all(r.equal and r.nodes >= r.leaves for r in learners.stored_ensemble(spark, SF).collect())
