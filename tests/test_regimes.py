from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorkit.operators import regimes
from priorkit.plans import regimes as plans
from tests.conftest import SF

SCHEMA = "entity long, periods array<int>, values array<array<double>>"


def model(k=2, d=2):
    rng = np.random.default_rng(1)
    move = np.array([[0.8, 0.2], [0.3, 0.7]]) if k == 2 else (1 + 8 * np.eye(k)) / (k + 8)
    return regimes.Regimes(4, np.full(k, 1 / k), move, rng.normal(size=(k, d)), 0.5 + rng.random((k, d)))


def density(m, k, x):
    out = 1.0
    for v, mean, var in zip(x, m.mean[k], m.var[k]):
        if not np.isnan(v):
            out *= np.exp(-((v - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)
    return out


def test_counts_equal_enumeration_with_missing_periods():
    m = model()
    x = np.array([[0.3, -1.0], [np.nan, np.nan], [1.2, np.nan], [-0.4, 0.8]])
    total, start, moves, last = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros(2)
    weight, first, second = np.zeros((3, 2, 2))
    for path in product(range(2), repeat=4):
        p = m.start[path[0]]
        for t, k in enumerate(path):
            p *= density(m, k, x[t]) * (m.move[path[t - 1], k] if t else 1.0)
        total += p
        start[path[0]] += p
        last[path[-1]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for t, k in enumerate(path):
            here = ~np.isnan(x[t])
            weight[k] += p * here
            first[k] += p * np.nan_to_num(x[t])
            second[k] += p * np.nan_to_num(x[t]) ** 2
    want = np.concatenate([v.ravel() / total for v in (start, moves, weight, first, second)])
    got = regimes.expected(m, np.stack([x, x]))
    assert np.allclose(got[:-1], 2 * want) and abs(got[-1] - 2 * np.log(total)) < 1e-10
    assert np.allclose(regimes.filtered(m, x[None])[0][0, -1], last / total)


def planted(spark, n=120, periods=24):
    """Two regimes with means -1.5 and 1.5 that last; some periods and numbers are missing."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        z, at, values = int(rng.integers(2)), [], []
        for t in range(periods):
            if rng.random() < 0.1:
                z = 1 - z
            if rng.random() < 0.85:
                at.append(t)
                values.append([float(3 * z - 1.5 + 0.6 * rng.normal()), None if rng.random() < 0.1 else float(0.5 * rng.normal())])
        rows.append((i, at, values))
    return spark.createDataFrame(rows + [(9999, [], [])], SCHEMA).repartition(3)


def test_objectives_never_fall_and_regimes_are_found(spark):
    seen = {}
    for fold, m in regimes.fit(planted(spark), 2, 2, 24, [12, 24], starts=2, rounds=40).items():
        seen[fold] = m
        assert all(b >= a - 1e-8 * abs(a) for a, b in zip(m.told, m.told[1:])) and m.stalled
        assert np.allclose(m.mean[:, 0], [-1.5, 1.5], atol=0.2) and np.allclose(m.var[:, 0], 0.36, atol=0.12)
        assert (np.abs(np.diag(m.move) - 0.9) < 0.05).all() and np.allclose(m.move.sum(axis=1), 1)
        assert np.allclose(m.stationary() @ m.move, m.stationary()) and abs(m.stationary().sum() - 1) < 1e-12
    assert set(seen) == {12, 24}


def test_the_best_start_is_kept(spark):
    sequences = planted(spark, 40, 8)
    one = [regimes.fit(sequences, 3, 2, 8, [8], starts=s, rounds=15)[8].told[-1] for s in (1, 4)]
    assert one[1] >= one[0] - 1e-9


def test_posteriors_see_no_later_period(spark):
    sequences = planted(spark, 20, 12)
    m = model(2, 2)
    cut = sequences.select("entity", F.filter("periods", lambda t: t < 6).alias("periods"), F.slice("values", 1, F.size(F.filter("periods", lambda t: t < 6))).alias("values"))
    get = lambda df: {(r.entity, r.period): r.posterior for r in regimes.posteriors(df, m, 12).where("period < 6").collect()}
    a, b = get(sequences), get(cut)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_empty_sequences(spark):
    none = spark.createDataFrame([], SCHEMA)
    fitted = regimes.fit(none, 2, 2, 4, [4], starts=1, rounds=2)
    assert np.isfinite(fitted[4].mean).all()
    assert regimes.posteriors(none, fitted[4], 4).count() == 0


def test_weighed_posteriors_equal_numpy(spark):
    m = model(3, 2)
    rows = [([0.2, 0.3, 0.5], [0.4, -1.0]), ([0.2, 0.3, 0.5], [None, 2.0]), ([0.1, 0.1, 0.8], None)]
    df = spark.createDataFrame(rows, "p array<double>, x array<double>")
    got = df.select(plans.weighed(F.col("p"), F.col("x"), m).alias("w"), plans.moved(F.col("p"), m, 3).alias("m")).collect()
    for (p, x), r in zip(rows, got):
        x = np.array([np.nan, np.nan] if x is None else [np.nan if v is None else v for v in x])
        joint = np.array(p) * [density(m, k, x) for k in range(3)]
        assert np.allclose(r.w, joint / joint.sum())
        assert np.allclose(r.m, np.array(p) @ np.linalg.matrix_power(m.move, 3))


def test_maps_find_an_effect_that_is_there(spark, monkeypatch):
    """Suppliers switch between two rates for years on; the effects of their regimes beat the base rate."""
    rng = np.random.default_rng(6)
    rows = []
    for s in range(30):
        high = s % 2
        for year in range(1995, 2000):
            for month in range(1, 13):
                if month % 3 == 1 and rng.random() < 0.02:
                    high = 1 - high
                rows += [(s, year, month, "F", int(rng.random() < (0.7 if high else 0.15))) for _ in range(6)]
    made = spark.createDataFrame(rows, "l_suppkey long, season int, month int, l_linestatus string, target int")
    made = made.withColumn("l_shipdate", F.make_date("season", "month", F.lit(5))).drop("month").cache()
    monkeypatch.setattr(plans, "facts", lambda *_: made)
    monkeypatch.setattr(plans, "CAP", 0.5)
    got = {r.season: r for r in plans.regime_residual_maps(spark, SF).collect()}
    assert set(got) == {1996, 1997, 1998, 1999}
    for year in (1997, 1998, 1999):
        assert got[year].by_transition < got[year].base - 0.03 and got[year].by_emission < got[year].base - 0.03


@pytest.mark.parametrize("name", plans.QUERIES)
def test_queries_cover_every_year(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    assert {r.season for r in rows} >= set(range(1996, 2001))
    if name == "regime_models":
        assert all(r.value >= -1e-6 for r in rows if r.kind == "least_rise")
    if name == "regime_posteriors":
        assert all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-5 for r in rows)


def test_tasks_get_flat_arrays_and_every_core_a_part(spark):
    rows = [(1, [0, 3], [[1.0, None], None]), (2, [], []), (3, [1], [[None, 2.0]])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    flat = regimes.packed(df, 2).orderBy("entity")
    assert flat.schema["values"].dataType.simpleString() == "array<double>"
    want = np.full((3, 4, 2), np.nan)
    want[0, 0, 0], want[2, 1, 1] = 1.0, 2.0
    assert np.array_equal(regimes.dense(flat.toPandas(), 4, 2), want, equal_nan=True)
    assert regimes.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = regimes.posteriors(df, model(), 4)
    assert got.count() == 12 and got.where("entity = 2 AND period = 3 AND abs(posterior[0] + posterior[1] - 1) < 1e-9").count() == 1
