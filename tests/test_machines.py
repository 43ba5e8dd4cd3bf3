from itertools import combinations

import numpy as np
import pytest

from priorkit.operators import machines
from priorkit.plans import learners
from tests.conftest import SF

SIZES, FIELDS = [4, 3, 5, 2], ["a", "b", "c", "d"]
KINDS = [machines.Factorisation(SIZES), machines.CrossNetwork(SIZES)]


def made(n=400, seed=2, strength=2.0):
    """Cells whose logit is an interaction of three fields; one code is null, one is out of range."""
    rng = np.random.default_rng(seed)
    codes = np.column_stack([rng.integers(0, s, n) for s in SIZES])
    logit = strength * np.where((codes[:, 0] < 2) ^ (codes[:, 1] == 1) ^ (codes[:, 3] == 1), 1, -1)
    size = rng.integers(5, 60, n)
    hits = rng.binomial(size, machines.expit(logit))
    rows = [(1995 + i % 4, *map(int, c), float(s), float(h), 0.1) for i, (c, s, h) in enumerate(zip(codes, size, hits))]
    rows[5] = (rows[5][0], None, *rows[5][2:])
    rows[6] = (rows[6][0], 77, *rows[6][2:])
    return rows


SCHEMA = "season int, a int, b int, c int, d int, n double, hits double, offset double"


def test_anova_kernel_equals_all_subsets():
    z = np.random.default_rng(0).normal(size=(5, 6, 2))
    for order in (1, 2, 3):
        want = sum(np.prod(z[:, list(s)], axis=1) for s in combinations(range(6), order)).sum(axis=1)
        assert np.allclose(machines.anova(z, order)[0], want)


@pytest.mark.parametrize("machine", KINDS, ids=["factorisation", "cross"])
def test_gradients_equal_finite_differences(machine):
    rng = np.random.default_rng(1)
    start = machine.start(3)
    vector = machines.flat(start) + 0.1 * rng.normal(size=machines.flat(start).size)
    at = np.column_stack([rng.integers(0, s, 30) for s in SIZES]) + np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    x = (rng.random(at.shape) < 0.9).astype(float)
    n = rng.integers(1, 9, 30).astype(float)
    hits, offset = np.minimum(n, rng.integers(0, 9, 30)), rng.normal(size=30)
    of = lambda v: machines.loss_and_gradient(machine, machines.shaped(v, start), at, x, n, hits, offset)
    got = of(vector)[1:]
    for i in rng.choice(len(vector), 40, replace=False):
        step = np.zeros(len(vector))
        step[i] = 1e-5
        assert abs((of(vector + step)[0] - of(vector - step)[0]) / 2e-5 - got[i]) < 1e-4 * max(1, abs(got[i]))


@pytest.mark.parametrize("machine", KINDS, ids=["factorisation", "cross"])
def test_steps_equal_plain_numpy(spark, machine):
    rows = made(120)
    fitted = machines.train(spark.createDataFrame(rows, SCHEMA).repartition(3), machine, FIELDS, [1997, 1995], steps=4)
    assert fitted[1995][1] == []  # nothing is before it
    seen = [r for r in rows if r[0] < 1997]
    starts = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    good = np.array([[c is not None and 0 <= c < s for c, s in zip(r[1:5], SIZES)] for r in seen])
    at = np.array([[c if g else 0 for c, g in zip(r[1:5], ok)] for r, ok in zip(seen, good)]) + starts
    n, hits, offset = (np.array([r[i] for r in seen]) for i in (5, 6, 7))
    p = machine.start(7)
    v, m1, m2 = machines.flat(p), 0.0, 0.0
    free = machines.flat({k: np.full_like(x, k != "w0") for k, x in p.items()})
    for t in range(1, 5):
        g = (machines.loss_and_gradient(machine, machines.shaped(v, p), at, good.astype(float), n, hits, offset)[1:] + free * v) / n.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v = v - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(machines.flat(fitted[1997][0]), v, atol=1e-9)


@pytest.mark.parametrize("machine", KINDS, ids=["factorisation", "cross"])
def test_an_interaction_is_learned(spark, machine):
    cells = spark.createDataFrame(made(600), SCHEMA).repartition(2)
    fitted = machines.train(cells, machine, FIELDS, [1998], steps=120, rate=0.05, penalty=0.1)
    row = learners.losses(machines.scored(cells, machine, FIELDS, fitted), fitted).first()
    assert row.season == 1998 and row.brier < row.base - 0.05 and row["last"] < row["first"]


def test_a_year_does_not_see_itself(spark):
    rows = made(200)
    other = [r if r[0] < 1998 else (*r[:6], 0.0, r[7]) for r in rows]
    machine = KINDS[0]
    a, b = (machines.train(spark.createDataFrame(x, SCHEMA), machine, FIELDS, [1998], steps=3)[1998][0] for x in (rows, other))
    assert np.allclose(machines.flat(a), machines.flat(b))


def test_empty_cells(spark):
    cells = spark.createDataFrame([], SCHEMA)
    fitted = machines.train(cells, KINDS[0], FIELDS, [1998], steps=2)
    assert fitted[1998][1] == [] and machines.scored(cells, KINDS[0], FIELDS, fitted).count() == 0


@pytest.mark.parametrize("name", sorted(set(learners.QUERIES) - {"residual_boosting", "stored_ensemble"}))
def test_queries_cover_the_later_years(spark, name):
    rows = learners.QUERIES[name](spark, SF).collect()
    assert {r.season for r in rows} == set(range(1996, 2002))
    if name == "bounded_logit":
        assert all(r.kkt < 1e-6 and learners.BOUNDED[r.feature][0] <= r.coefficient <= learners.BOUNDED[r.feature][1] for r in rows)
    else:
        assert all(abs(r.brier - r.base) < 0.05 for r in rows)


def test_models_of_spark_beat_the_base_on_later_years(spark):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    from priorkit.plans import models

    rng = np.random.default_rng(4)
    rows = []
    for season in range(1995, 2002):
        for _ in range(300):
            codes = [int(rng.integers(s)) for s in learners.FIELDS.values()]
            rows.append((season, *codes, 20.0, float(rng.binomial(20, 0.15 + 0.1 * codes[0])), -0.2))
    cells = spark.createDataFrame(rows, "season int, " + ", ".join(f"{c} int" for c in learners.FIELDS) + ", n double, hits double, offset double")
    for estimator in (LogisticRegression(maxIter=20), GBTClassifier(maxIter=3, seed=1), RandomForestClassifier(numTrees=5, seed=1)):
        got = models.scored_later(estimator, cells).collect()
        assert {r.season for r in got} == {2000, 2001} and all(r.n == 6000 and r.brier < r.base - 0.02 for r in got)


def test_fits_of_spark_read_staged_cells_and_effects_come_from_sums(spark):
    from pyspark.sql import functions as F

    from priorkit.operators import states
    from priorkit.plans import base, models
    from priorkit.sources.io import Stage

    plan = models.random_forest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan  # no line is read again for the scores
    f = base.facts(spark, "/root/testdata/sf0.001")
    effect, rate = base.supplier_state(Stage(spark), f)
    want = {(r[0], r[1]): r[2] for r in states.prior_effects(states.demeaned(f, "target", "r"), ["l_suppkey"], F.col("r"), 200.0, 3).collect()}
    got = {(r[0], r[1]): r[2] for r in effect.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {tuple(r) for r in rate.collect()} == {tuple(r) for r in states.prior_rate(f, F.col("target")).collect()}
