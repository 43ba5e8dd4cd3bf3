"""Frozen lookups, gates, stored models and fits on small tables made by hand, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorkit.functions import exprs as X
from priorkit.operators.quantiles import counted_quantiles
from priorkit.plans import fits, lookups, recovered, rows


def test_fallback_and_cap(spark):
    mapping = spark.createDataFrame([(10, 100)], "pitcher_id long, mapped long")
    entity = spark.createDataFrame([(100, 0.48)], "mapped long, fallback double")
    query = [(10, 2, 1, 0.5), (10, 7, 2, 0.5), (999, 2, 1, 0.5), (None, 2, 1, 0.5)]
    schema = "pitcher_id long, count_index int, batter_hand int, rate double"

    def ask(value, fallback, base, picked):
        context = spark.createDataFrame([(100, 2, 1, value)], "mapped long, count_index int, batter_hand int, value double")
        own = spark.createDataFrame([(100, fallback)], "mapped long, fallback double")
        out = lookups.fallback_correction(spark.createDataFrame([query[i] for i in picked], schema), mapping, context, own, ["count_index", "batter_hand"], 0.03, base)
        return sorted((str(r.pitcher_id), r.count_index, round(r.correction, 9)) for r in out.collect())

    want = [("10", 2, 0.03), ("10", 7, -0.02), ("999", 2, 0.0), ("None", 2, 0.0)]
    assert ask(0.55, 0.48, F.col("rate"), [0, 1, 2, 3]) == want == ask(0.55, 0.48, F.col("rate"), [3, 2, 1, 0])
    assert ask(0.55, 0.48, F.col("rate"), [0]) == want[:1]
    assert ask(0.02, -0.012, None, [0, 1, 2, 0]) == [("10", 2, 0.02), ("10", 2, 0.02), ("10", 7, -0.012), ("999", 2, 0.0)]
    assert entity.count() == 1


def test_history_and_its_cutoff(spark):
    seen = spark.createDataFrame([(2023, 100, 2, 1, 0.4), (2023, 100, 2, 1, 0.6), (2024, 100, 7, 2, 0.8)], "season int, id long, count_index int, hand int, y double")
    own, context = lookups.history_state(lookups.guarded(seen, 2024), "id", ["count_index", "hand"], "y", 100.0)
    assert abs(own.first()["fallback"] - 0.6) < 1e-12
    value = {(r.count_index, r.hand): r.value for r in context.collect()}
    assert abs(value[2, 1] - (1.0 + 100 * 0.6) / 102) < 1e-12
    with pytest.raises(ValueError):
        lookups.guarded(spark.createDataFrame([(2025, 1)], "season int, id int"), 2024)


def test_stable_runner_lookup(spark):
    state = spark.createDataFrame([(0, 0, 2, 0.012), (5, 2, 6, -0.009)], "count int, runners int, pbin int, effect double")
    query = [(0, 0, 0.40), (5, 2, 0.50), (0, 0, 0.40), (11, 0, 0.40)]

    def ask(picked):
        q = spark.createDataFrame([query[i] for i in picked], "count int, runners int, p double").withColumn("pbin", X.truncated_bin(F.col("p"), 0.35, 0.025, 12).cast("int"))
        return sorted((r["count"], r.effect) for r in lookups.frozen_lookup(q, state, ["count", "runners", "pbin"], "effect").collect())

    assert ask([0, 1, 2, 3]) == ask([3, 2, 1, 0]) == [(0, 0.012), (0, 0.012), (5, -0.009), (11, 0.0)]


def test_source_rows_of_an_unseen_period(spark):
    df = spark.createDataFrame([("a", 2023, 1, 7, 0.5, 1), ("b", 2024, 2, 9, None, 0)], "row_id string, season int, pitcher long, n int, rate double, hit int")
    out = rows.source_fixture(df, {"pitcher": 9_100_000}, ["n"], "hit").collect()
    assert {r.season for r in out} == {2025} and {r.n for r in out} == {0} and min(r.pitcher for r in out) > 9_100_000 and "hit" not in out[0]


def test_gates_and_whitelist(spark):
    df = spark.createDataFrame([(0.4, 0.52, True), (0.4, 0.9, False), (0.4, 0.5, None)], "base double, p double, gate boolean")
    assert [r[0] for r in df.select(rows.gated(F.col("p"), F.col("base"), F.col("gate"))).collect()] == [0.52, 0.4, 0.4]
    assert [r[0] for r in df.select(rows.uncertain(F.col("p"), 0.1)).collect()] == [True, False, True]
    assert rows.allowed(df, ["p"], "target").columns == ["p"]
    for wanted in (["gate", "base_target"], ["nothing"]):
        with pytest.raises(ValueError):
            rows.allowed(df, wanted, "target|^gate$")


def test_bounded_step_stays_in_its_cap(spark):
    df = spark.createDataFrame([(b, r) for b in (0.0, 0.01, 0.5, 1.0) for r in (-50.0, -0.3, 0.0, 0.2, 80.0)], "b double, r double")
    for r in df.select("b", "r", X.bounded_step(F.col("b"), F.col("r"), 0.5, 0.03).alias("s")).collect():
        assert abs(r.s - min(1.0, max(0.0, r.b + 0.5 * 0.03 * math.tanh(r.r)))) < 1e-12 and abs(r.s - r.b) <= 0.015 + 1e-12


def test_six_digits_read_like_printf(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, 1 / 3, 2 / 3, 1 / 7, 123 / 456, 0.5, 1 / 699, 3 / 700] + [rng.randint(0, n) / n for n in [rng.randint(1, 700) for _ in range(300)]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(recovered.six_digits(F.col("x"))).collect()]
    assert all(abs(g - float(f"{v:.6g}")) < 1e-15 for g, v in zip(got, values))


def test_joint_denominators_are_the_first_triple(spark):
    """Against nested loops in plain Python on a few true windows."""
    rng = random.Random(4)
    six = lambda x: float(f"{x:.6g}")
    for _ in range(3):
        n = [rng.randint(5, 12)]
        n += [n[0] + rng.randint(2, 9)]
        n += [n[1] + rng.randint(2, 9)]
        s, t = [rng.randint(1, n[0] - 1)], [rng.randint(1, n[0] - 1)]
        for i in (1, 2):
            s.append(s[-1] + rng.randint(0, 2))
            t.append(t[-1] + rng.randint(0, 2))
        a, b = [six(x / y) for x, y in zip(s, n)], [six(x / y) for x, y in zip(t, n)]
        fits_one = lambda m, i: six(round(a[i] * m) / m) == a[i] and six(round(b[i] * m) / m) == b[i]
        lists = [[m for m in range(1, most + 1) if fits_one(m, i)] for i, most in enumerate((180, 450, 700))]
        first = next(
            (x, y, z) for x in lists[0] for y in lists[1] if y >= x + 2 and round(a[1] * y) >= round(a[0] * x) and round(b[1] * y) >= round(b[0] * x)
            for z in lists[2] if z >= y + 2 and round(a[2] * z) >= round(a[1] * y) and round(b[2] * z) >= round(b[1] * y)
        )
        pairs = spark.createDataFrame([(a[0], b[0], a[1], b[1], a[2], b[2])], "a1 double, b1 double, a3 double, b3 double, a5 double, b5 double")
        for i, (k, most) in enumerate(recovered.MOST.items()):
            found = sorted(r[f"m{k}"] for r in recovered.fitting(pairs, f"a{k}", f"b{k}", most, f"m{k}").collect())
            assert found == lists[i]
        assert first <= tuple(n)


def test_stored_trees_route_missing_values(spark):
    df = spark.createDataFrame([(None, 10.0, 0.01), (0.04, 30.0, None), (0.09, 40.0, None), (0.09, 40.0, 0.05)], "l_discount double, l_quantity double, l_tax double")

    def leaf(node, row):
        if not isinstance(node, tuple):
            return node
        name, threshold, missing, left, right = node
        x = row[name]
        return leaf(left if (missing == "left" if x is None else x <= threshold) else right, row)

    for tree in fits.STORED_TREES:
        got = df.select("*", fits.tree_score(tree, {c: F.col(c) for c in df.columns}).alias("s")).collect()
        assert [r.s for r in got] == [leaf(tree, r.asDict()) for r in got]


def test_counted_quantiles(spark):
    rng = random.Random(3)
    data = [(k, rng.choice([None, *range(30)])) for k in "ab" for _ in range(101 if k == "a" else 40)] + [("c", 5), ("d", None)]
    got = {r.k: r for r in counted_quantiles(spark.createDataFrame(data, "k string, v int"), "k", "v", {"q": 0.1, "m": 0.5}).collect()}
    for k in "abc":
        v = [x for key, x in data if key == k and x is not None]
        assert abs(got[k].q - np.quantile(v, 0.1)) < 1e-9 and abs(got[k].m - np.quantile(v, 0.5)) < 1e-9
    assert got["d"].q is None


def test_stored_ridge(spark):
    df = spark.createDataFrame([(None, 0.04, 20.0), (0.1, None, 1.0)], "l_discount double, l_tax double, l_quantity double")
    got = [r[0] for r in df.select(recovered.stored_ridge({c: F.col(c) for c in df.columns}, recovered.STORED_RIDGE)).collect()]
    for value, row in zip(got, df.collect()):
        want = sum((fill if row[k] is None else row[k]) * 1.0 * c / s - m * c / s + (flag if row[k] is None else 0) for k, (fill, m, s, c, flag) in recovered.STORED_RIDGE.items())
        assert abs(value - want) < 1e-12


def test_hidden_state_rounds_equal_enumeration(spark):
    """Expected counts against the sum over all paths of states, and a likelihood that never falls."""
    from itertools import product

    from priorkit.operators import hidden
    from priorkit.plans.pools import HIDDEN_START

    start, move, show = (np.array(x) for x in HIDDEN_START)
    observed = [0, 2, 2, 1, 0]
    s, t, e, total = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), 0.0
    for path in product(range(2), repeat=len(observed)):
        p = start[path[0]] * math.prod(move[a, b] for a, b in zip(path, path[1:])) * math.prod(show[a, o] for a, o in zip(path, observed))
        total += p
        s[path[0]] += p
        for a, b in zip(path, path[1:]):
            t[a, b] += p
        for a, o in zip(path, observed):
            e[a, o] += p
    got = hidden.expected_counts(observed, start, move, show)
    assert all(np.allclose(x, y / total) for x, y in zip(got, (s, t, e))) and abs(got[3] - math.log(total)) < 1e-12
    rng = random.Random(5)
    rows_ = [(i, [rng.choice((0, 0, 1) if (k // 8 + i) % 2 else (1, 2, 2)) for k in range(rng.randint(0, 30))]) for i in range(40)] + [(99, None)]
    a, m, b, told = hidden.fit(spark.createDataFrame(rows_, "i int, o array<int>"), "o", *HIDDEN_START, rounds=6, sticky=0.0)
    assert all(y > x - 1.0 for x, y in zip(told, told[1:])) and told[-1] > told[0]
    assert b[0, 2] < b[1, 2] and m[0, 0] > 0.5 and abs(a.sum() - 1) < 1e-12


def test_hidden_states_of_missing_periods(spark):
    from priorkit.operators import hidden

    start, move, show = (np.array(x) for x in HIDDEN_START)
    total, shown = 0.0, np.zeros((2, 3))
    for path in product(range(2), repeat=4):
        p = start[path[0]] * math.prod(move[a, b] for a, b in zip(path, path[1:])) * show[path[0], 0] * show[path[3], 2]
        total += p
        shown[path[0], 0] += p
        shown[path[3], 2] += p
    got = hidden.expected_counts([0, None, None, 2], start, move, show)
    assert np.allclose(got[2], shown / total) and abs(got[3] - math.log(total)) < 1e-12
    rows_ = [(1, [0, None, 2]), (2, [None]), (3, []), (4, None), (5, [1, 1, None])]
    told = hidden.fit(spark.createDataFrame(rows_, "i int, o array<int>"), "o", *HIDDEN_START, rounds=3)[3]
    assert all(math.isfinite(x) for x in told)


def test_residual_composition_joins_its_rows_with_no_effects(spark):
    from priorkit.plans import lookups
    from tests.conftest import SF

    plan = lookups.residual_composition(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the mean of each year


def test_clipped_lookup_of_missing_values_equals_its_sql(spark, tmp_path):
    import duckdb

    con, path = duckdb.connect(), tmp_path / "lineitem.parquet"
    gone = lambda c, k: f"CASE WHEN hash(l_orderkey, l_linenumber, {k}) % 9 = 0 THEN NULL ELSE {c} END AS {c}"
    columns = ["l_returnflag", "l_shipdate", "l_suppkey", "l_linestatus"]
    con.execute(f"COPY (SELECT * REPLACE ({', '.join(gone(c, k) for k, c in enumerate(columns))}) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    got = lookups.clipped_lookup(spark, str(tmp_path))
    names = ["season", "l_suppkey", "l_linenumber", "n", "correction"]
    key = lambda rows: {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    have, want = key(got.select(*names).collect()), key(con.execute(f"SELECT {', '.join(names)} FROM ({lookups.CLIPPED_SQL})").fetchall())
    assert have.keys() == want.keys() and len(want) > 300
    assert all(have[k][0] == want[k][0] and abs(have[k][1] - want[k][1]) < 2e-6 for k in want)
    assert any(v[1] for v in want.values())
