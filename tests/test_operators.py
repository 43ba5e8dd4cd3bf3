import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorkit.functions import exprs as X
from priorkit.operators import linalg, resolve, states
from priorkit.sources import io


def test_expressions(spark):
    df = spark.createDataFrame([(0.40, 10.0, None), (None, None, 2.0), (0.9, 40.0, 0.0)], "p double, x double, n double")
    out = df.select(
        X.truncated_bin(F.col("p"), 0.35, 0.025, 12).alias("bin"), X.equal_width_bin(F.col("x"), 5.0).alias("width"), X.left_closed_bin(F.col("x"), [10.0, 20.0]).alias("edge"),
        X.right_closed_bin(F.col("x"), [10.0]).alias("right"), X.shrunk_rate(F.col("n"), F.col("p"), 10.0, 0.5).alias("shrunk"), X.clip(F.col("p"), 0.5, 0.6).alias("clip"),
        X.expit(X.logit(F.col("p"))).alias("p2"),
    ).collect()
    assert [r.bin for r in out][::2] == [2, 12] and [r.width for r in out] == [2, -1, 8]
    assert [r.edge for r in out][::2] == [1, 2] and [r.right for r in out] == [0, None, 1]
    assert out[0].shrunk == 0.5 and out[1].shrunk == 0.5 and [r.clip for r in out] == [0.5, None, 0.6]
    assert abs(out[0].p2 - 0.4) < 1e-12


def test_entropy_and_products(spark):
    x = [1.0, 2.0, 0.0, 5.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    r = df.select(X.entropy(F.col("x")).alias("e"), X.pairwise_products(F.col("x")).alias("p"), X.triple_products(F.col("x")).alias("t")).first()
    p = np.array([v for v in x if v]) / sum(x)
    assert abs(r.e + (p * np.log(p)).sum()) < 1e-12
    assert abs(r.p - sum(a * b for a, b in itertools.combinations(x, 2))) < 1e-9 and abs(r.t - sum(a * b * c for a, b, c in itertools.combinations(x, 3))) < 1e-9


def test_packed_key_rejects_values_outside(spark):
    df = spark.createDataFrame([(1,), (9,)], "v int")
    with pytest.raises(Exception, match="domain"):
        df.select(X.packed_key([(F.col("v"), 4)])).collect()


def test_states_see_earlier_periods_alone(spark):
    rows = [(e, s, t) for e in (1, 2) for s in (2019, 2020, 2022) for t in (e % 2, 1)]
    df = spark.createDataFrame(rows, "e int, season int, target int")
    future = spark.createDataFrame(rows + [(1, 2023, 0)] * 9, "e int, season int, target int")
    pick = lambda d: sorted(map(tuple, states.prior_sums(d, ["e"], F.col("target")).where("season < 2023").collect()))
    assert pick(df) == pick(future)
    assert (1, 2022, 4, 4) in pick(df) and (2, 2019, 0, 0) in pick(df)
    one = {(r.e, r.season): r.n for r in states.prior_sums(df, ["e"], F.col("target"), width=1).collect()}
    assert one[(1, 2022)] == 0 and one[(1, 2020)] == 2


def test_asof_takes_the_latest_state_before(spark):
    state = spark.createDataFrame([(1, 2019, 10), (1, 2021, 30)], "e int, season int, n int")
    rows = spark.createDataFrame([(1, s) for s in (2018, 2019, 2020, 2021, 2022, 2025)] + [(2, 2022)], "e int, season int")
    got = {(r.e, r.season): r.state_n for r in states.asof(rows, state, "e").collect()}
    assert got == {(1, 2018): None, (1, 2019): None, (1, 2020): 10, (1, 2021): 10, (1, 2022): 30, (1, 2025): 30, (2, 2022): None}


def test_rows_do_not_depend_on_each_other(spark):
    """A prediction is the same for one row, a permutation, a split and a repetition."""
    state = spark.createDataFrame([(1, 2019, 10), (2, 2020, 20)], "e int, season int, n int")
    rows = [(1, 2020), (2, 2021), (1, 2022), (3, 2022)]
    score = lambda r: sorted(map(tuple, states.asof(spark.createDataFrame(r, "e int, season int"), state, "e").select("e", "season", "state_n").collect()), key=str)
    whole = score(rows)
    assert score(rows[::-1]) == whole
    assert sorted((x for r in rows for x in score([r])), key=str) == whole
    assert score(rows * 2) == sorted(whole * 2, key=str)


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 6)):
        for _ in range(20):
            cost = rng.random((n, m))
            found = resolve.least_cost(cost)
            best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
            assert len(set(found)) == n and abs(cost[np.arange(n), found].sum() - best) < 1e-9


def test_assign_within_blocks(spark):
    df = spark.createDataFrame([("x", 1, "a", 1.0), ("x", 1, "b", 0.5), ("x", 2, "b", 0.1), ("y", 3, "a", 2.0), ("y", 4, "a", 1.0)], "block string, a int, b string, cost double")
    got = {tuple(r) for r in resolve.assign_within(df, "block", "a", "b", "cost").collect()}
    assert got == {("x", 1, "a", 1.0), ("x", 2, "b", 0.1), ("y", 4, "a", 1.0)}


def test_assign_within_large_block(spark):
    """A block with many keys on one side, and pairs missing: as many pairs as can be, at the least cost."""
    rng = np.random.default_rng(4)
    rows = [("x", i, f"s{j}", float(rng.integers(0, 3000))) for i in range(2500) for j in range(4)]
    rows += [("y", i, f"s{j}", float(rng.integers(0, 30))) for i in range(3) for j in range(9) if rng.random() < 0.6]
    rows += [("z", 0, "s0", 0.0), ("z", 1, "s0", 900.0), ("z", 0, "s1", 900.0)]
    got = resolve.assign_within(spark.createDataFrame(rows, "block string, a int, b string, cost double"), "block", "a", "b", "cost").toPandas()
    for name, part in got.groupby("block"):
        assert part["a"].is_unique and part["b"].is_unique
        cost = {(a, b): c for k, a, b, c in rows if k == name}
        few, many = sorted(({a for a, _ in cost}, {b for _, b in cost}), key=len)
        x = np.array([[cost.get((i, j), cost.get((j, i), 1e6)) for j in sorted(many)] for i in sorted(few)])
        best = x[np.arange(len(x)), resolve.least_cost(x)]
        assert part["cost"].sum() == best[best < 1e6].sum() and len(part) == (best < 1e6).sum()
    assert set(got["block"]) == {"x", "y", "z"}


def test_alike_sequences_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(5)
    rows = [(1, 1, "1,2,3,4,5"), (2, 1, "1,2,3,4,5,6,7"), (3, 1, ""), (4, 1, ""), (5, 1, "1"), (6, 2, None), (7, None, "1")]
    rows += [(10 + i, int(rng.integers(0, 4)), ",".join(map(str, rng.integers(1, 8 if i % 3 else 13, rng.integers(1, 9))))) for i in range(240)]
    want = {}
    for ratio in (0.8, 0.5):
        for i, g, s in rows:
            for j, h, t in rows:
                if i < j and g == h and None not in (g, s, t) and (r := SequenceMatcher(None, s, t, autojunk=False).ratio()) >= ratio:
                    want[ratio, i, j] = r
    df = spark.createDataFrame(rows, "k int, g int, s string")
    got = [(ratio, r.a, r.b, r.ratio) for ratio in (0.8, 0.5) for r in resolve.alike_sequences(df, ["g"], "k", "s", ratio).collect()]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    assert (0.8, 1, 2) in want and (0.8, 3, 4) in want


def test_solvers():
    rng = np.random.default_rng(11)
    for k in (2, 3, 4):
        e = rng.normal(size=(60, k)) * [1.0, 1.3, 0.9, 1.1][:k] + 0.2
        g = e.T @ e / 60
        w, gap = linalg.frank_wolfe(g)
        steps = [p for p in itertools.product(range(21), repeat=k) if sum(p) == 20]
        best = min(np.array(p) / 20 @ g @ (np.array(p) / 20) for p in steps)
        assert abs(w.sum() - 1) < 1e-9 and (w >= -1e-12).all() and w @ g @ w <= best + 1e-9 and gap < 1e-3
    wanted = np.array([1.7, 0.6, -2.2])
    w = linalg.bounded_weights(np.diag([1.0, 1.0, 1.0]), wanted, 1.5)
    assert np.allclose(w, [1.3, 0.2, 0.0], atol=1e-6)  # the projection on the bounded part


def test_ridge_and_low_rank(spark):
    rng = np.random.default_rng(2)
    a, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    x = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(a, y)], "a double, b double, y double")
    for alpha in (1e-9, 2.5):
        assert np.allclose(linalg.ridge(x, ["a", "b"], "y", alpha), np.linalg.solve(a.T @ a + alpha * np.eye(2), a.T @ y), atol=1e-9)
    m = rng.normal(size=(6, 2)) @ rng.normal(size=(2, 4))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(4)], "e int, c int, v double")
    r = linalg.low_rank(cells, "e", "c", "v", list(range(4)), 2).collect()
    assert all(abs(row.v - row.reconstructed) < 1e-9 for row in r)
    one = {(row.e, row.c): row.reconstructed for row in linalg.low_rank(cells, "e", "c", "v", list(range(4)), 1).collect()}
    u, s, v = np.linalg.svd(m)
    assert all(abs(one[i, j] - s[0] * u[i, 0] * v[0, j]) < 1e-9 for i in range(6) for j in range(4))


def test_csv_scan_and_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,x\n1,0.5\n2,NaN\n".encode())
    from pyspark.sql.types import DoubleType, StructField, StructType, StringType

    df = io.read_csv(spark, str(tmp_path / "a.csv"), StructType([StructField("id", StringType()), StructField("x", DoubleType())]))
    assert [r.x for r in df.collect()] == [0.5, None]
    with pytest.raises(ValueError, match="missing columns: y"):
        io.required_columns(df, ["id", "y"])
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "k string")
    template = spark.createDataFrame([("a",), ("b",)], "k string")
    assert io.contract_report(rows, template, "k").first().asDict() == {"null_keys": 1, "duplicate_keys": 1, "missing_keys": 1, "extra_keys": 2}


def test_frozen_state_round_trip(spark, tmp_path):
    state = spark.createDataFrame([(1, 3)], "e int, n int")
    io.save_state(state, str(tmp_path / "s"), 2024)
    assert io.load_state(spark, str(tmp_path / "s")).first().asDict() == {"e": 1, "n": 3, "through_period": 2024}
    assert io.load_state(spark, str(tmp_path / "s"), before=2025).count() == 1
    with pytest.raises(ValueError):
        io.load_state(spark, str(tmp_path / "s"), before=2024)


def test_majority_and_sequences(spark):
    pairs = spark.createDataFrame([("u", "x")] * 9 + [("u", "y")] + [("v", "y")] * 2 + [("w", "x"), ("w", "y")] * 3, "a string, b string")
    got = {(r.a, r.b, r.n) for r in resolve.majority_mapping(pairs, "a", "b", 5, 0.5).collect()}
    assert got == {("u", "x", 9), ("w", "x", 3)}
    rows = spark.createDataFrame([(1, "abcabc"), (2, "abcabd"), (3, "zzzzzz"), (4, "abc")], "k int, s string").withColumn("g", F.lit(1))
    assert {(r.a, r.b) for r in resolve.alike_sequences(rows, ["g"], "k", "s", 0.8).collect()} == {(1, 2)}


def test_splines_and_piecewise_codes(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.9,), (1.0,), (None,), (1.5,)], "x double")
    rows = df.select(F.array(*X.spline_basis(F.col("x"), [0.3, 0.5])).alias("b"), F.array(*X.piecewise_codes(F.col("x"), [0.0, 0.5, 1.0])).alias("c")).collect()
    assert all(len(r.b) == 6 and abs(sum(r.b) - 1) < 1e-12 and min(r.b) >= 0 for r in rows[:5])
    assert rows[5].b == [None] * 6 and rows[6].b == [0.0] * 6
    assert [r.c for r in rows[:3]] == [[0.0, 0.0], [0.5, 0.0], [1.0, 0.0]] and rows[5].c == [None, None]


def test_bounded_weights_equal_a_grid():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2))
    y = x @ [0.9, -0.4] + 0.5 * x[:, 0]
    g, c = x.T @ x, x.T @ y
    w = linalg.bounded_weights(g, c, 1.0)
    grid = [(a / 100, b / 100) for a in range(101) for b in range(101 - a)]
    best = min(grid, key=lambda v: np.array(v) @ g @ v - 2 * c @ v)
    assert np.allclose(w, best, atol=0.011)


def test_prediction_sinks(spark, tmp_path):
    template = spark.createDataFrame([("b", 0), ("a", 1)], "row_id string, pos int")
    good = spark.createDataFrame([("a", 0.2), ("b", 0.4), ("z", 3.0)], "row_id string, p double")
    io.write_predictions(template, good, "row_id", "p", str(tmp_path / "good"), "pos")
    assert [(r.row_id, float(r.p)) for r in spark.read.option("header", True).csv(str(tmp_path / "good")).collect()] == [("b", 0.4), ("a", 0.2)]
    for i, bad in enumerate(([("a", 0.2)], [("a", 0.2), ("b", 1.4)], [("a", 0.2), ("b", None)], [("a", 0.1), ("b", 0.4), ("b", 0.5)])):
        with pytest.raises(Exception, match="no valid prediction"):
            io.write_predictions(template, spark.createDataFrame(bad, "row_id string, p double"), "row_id", "p", str(tmp_path / f"bad{i}"))
    io.write_candidates(good.selectExpr("row_id", "p", "'one' AS candidate", "2024 AS season"), str(tmp_path / "stored"))
    assert spark.read.parquet(str(tmp_path / "stored")).where("candidate = 'one' AND season = 2024").count() == 3
    with pytest.raises(Exception, match="out of range"):
        io.load_candidates(spark, str(tmp_path / "stored"), 2024).collect()
    assert io.load_candidates(spark, str(tmp_path / "stored"), 2023).count() == 0


def test_alike_classes_have_a_row_for_each_key(spark):
    rows = spark.createDataFrame([(i, 1, "1,2") for i in range(2000)] + [(5000, 1, "1,2,3"), (5001, 1, "9"), (5002, None, "9"), (None, 1, "1,2")], "k int, g int, s string")
    pairs, members = resolve.alike_classes(rows, ["g"], "k", "s", 0.7)
    assert [tuple(r) for r in pairs.collect()] == [(1, 0, 5000, 0.75)]
    got = {r.key: r["class"] for r in members.collect()}
    assert len(got) == 2002 and {got[i] for i in range(2000)} == {0} and got[5000] == 5000 and got[5001] == 5001


def test_two_way_biases_of_any_number_of_contexts(spark):
    rng = np.random.default_rng(8)
    cells = [(int(a), int(b), float(s), int(n)) for a, b, s, n in zip(rng.integers(0, 30, 900), rng.integers(0, 400, 900), rng.normal(size=900), rng.integers(1, 9, 900))]
    got_a, got_b = linalg.two_way_bias(spark.createDataFrame(cells, "a int, b int, s double, n int"), "a", "b", "s", "n", 3.0, 2.0, 3)
    bias_b = {c[1]: 0.0 for c in cells}

    def solved(own, other, k, values):
        out = {}
        for key in {c[own] for c in cells}:
            mine = [c for c in cells if c[own] == key]
            out[key] = sum(c[2] - c[3] * values[c[other]] for c in mine) / (sum(c[3] for c in mine) + k)
        return out

    for _ in range(3):
        bias_b = solved(1, 0, 2.0, solved(0, 1, 3.0, bias_b))
    assert all(abs(r.bias_b - bias_b[r.b]) < 1e-9 for r in got_b.collect())
    assert all(abs(r.bias_a - v) < 1e-9 for r, v in zip(got_a.orderBy("a").collect(), [x for _, x in sorted(solved(0, 1, 3.0, bias_b).items())]))


def test_minimax_weights_equal_a_grid_with_a_certified_gap():
    rng = np.random.default_rng(13)
    for years in (1, 2, 5):
        e = rng.normal(size=(years, 50, 3)) * rng.uniform(0.5, 1.5, (years, 1, 3))
        grams = np.einsum("yni,ynj->yij", e, e) / 50
        w, worst, gap = linalg.minimax_simplex(grams)
        steps = [np.array(p) / 60 for p in itertools.product(range(61), repeat=3) if sum(p) == 60]
        best = min(float((grams @ p @ p).max()) for p in steps)
        assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and 0 <= gap < 1e-6
        assert worst <= best + 1e-9 and best <= worst + 0.01 and abs(worst - (grams @ w @ w).max()) < 1e-12
    near = 0.22 + 1e-4 * rng.normal(size=(4, 1, 1)) + np.zeros((4, 4, 4))  # candidates that hardly differ
    assert linalg.minimax_simplex(near + 1e-5 * np.eye(4))[2] < 1e-6


def test_minimax_blend_of_every_later_year(spark):
    from priorkit.plans import models

    rows = models.minimax_blend(spark, "/root/testdata/sf0.001").collect()
    assert {r.season for r in rows} == set(range(1996, 2002))
    assert all(0 <= r.gap < 1e-6 and abs(r.p1 + r.p2 + r.p3 + r.p4 - 1) < 1e-5 for r in rows)
