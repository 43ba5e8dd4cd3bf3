import numpy as np

from priorkit.operators import factors
from priorkit.sources.io import Stage


def matrix(seed=5, rows=40, columns=25, share=0.4):
    rng = np.random.default_rng(seed)
    full = rng.normal(size=(rows, 3)) * [5, 3, 1.5] @ rng.normal(size=(3, columns)) + 0.3 * rng.normal(size=(rows, columns))
    return np.where(rng.random(full.shape) < share, full, 0.0), rng


def cells_of(spark, a, weights=None):
    rows = [(int(i), int(j), float(a[i, j]), float(weights[i, j]) if weights is not None else 1.0) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "r int, c int, value double, weight double").repartition(3)


def dense(df, key, n, rank):
    out = np.zeros((n, rank))
    for x in df.collect():
        out[x[key]] = [x[f"x{i}"] for i in range(rank)]
    return out


def test_singular_values_and_product_equal_numpy(spark):
    a, _ = matrix()
    extra = spark.createDataFrame([(None, 1, 5.0), (1, None, 5.0), (1, 1, None)], "r int, c int, value double")
    left, sigma, right, residual = factors.truncated_svd(cells_of(spark, a).drop("weight").unionByName(extra), "r", "c", 3, Stage(spark))
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(sigma, s[:3], atol=1e-6) and residual <= 1e-8
    x, y = dense(left, "r", 40, 3), dense(right, "c", 25, 3)
    assert np.allclose(x * sigma @ y.T, u[:, :3] * s[:3] @ v[:3], atol=1e-6)
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6) and np.allclose(y.T @ y, np.eye(3), atol=1e-6)
    unseen = spark.createDataFrame([(0, 0), (999, 0)], "r int, c int")
    fit = {r.r: r.fit for r in factors.fitted_products(unseen, left, right, "r", "c", sigma).collect()}
    assert fit[999] == 0.0 and abs(fit[0] - (x * sigma @ y.T)[0, 0]) < 1e-9


def test_a_matrix_of_lower_rank_than_asked(spark):
    a = np.outer(np.arange(1, 7), [1.0, 2.0, -1.0])
    left, sigma, right, residual = factors.truncated_svd(cells_of(spark, a).drop("weight"), "r", "c", 2, Stage(spark))
    assert abs(sigma[0] - np.linalg.norm(a)) < 1e-6 and sigma[1] < 1e-6 and residual <= 1e-8
    assert np.allclose(dense(left, "r", 6, 2) * sigma @ dense(right, "c", 3, 2).T, a, atol=1e-6)


def test_alternating_solves_equal_numpy_and_never_rise(spark):
    a, rng = matrix(9, 20, 12, 0.6)
    w = np.where(a != 0, rng.integers(1, 9, a.shape), 0)
    left, right, told = factors.weighted_als(cells_of(spark, a, w), "r", "c", 2, 0.5, Stage(spark), rounds=25)
    assert len(told) > 1 and all(y <= x + 1e-9 * x for x, y in zip(told, told[1:]))
    x, y = dense(left, "r", 20, 2), dense(right, "c", 12, 2)
    # the right side is the exact answer to the left, and the left nearly that to the right
    for j in range(12):
        want = np.linalg.solve((x * w[:, [j]]).T @ x + 0.5 * np.eye(2), (x * w[:, [j]]).T @ a[:, j])
        assert np.allclose(y[j], want, atol=1e-8)
    loss = (w * (a - x @ y.T) ** 2).sum() + 0.5 * ((x**2).sum() + (y**2).sum())
    assert abs(loss - told[-1]) < 1e-6 * loss
    plain = None
    u, s, v = np.linalg.svd(a)
    p, q = None, v[:2].T * np.sqrt(s[:2])
    for _ in range(60):
        p = np.array([np.linalg.solve((q * w[i][:, None]).T @ q + 0.5 * np.eye(2), (q * w[i][:, None]).T @ a[i]) for i in range(20)])
        q = np.array([np.linalg.solve((p * w[:, [j]]).T @ p + 0.5 * np.eye(2), (p * w[:, [j]]).T @ a[:, j]) for j in range(12)])
        plain = (w * (a - p @ q.T) ** 2).sum() + 0.5 * ((p**2).sum() + (q**2).sum())
    assert told[-1] <= 1.01 * plain


def test_staged_tables_go_with_their_context(spark):
    with Stage(spark) as stage:
        a, _ = matrix(1, 8, 6, 0.9)
        factors.truncated_svd(cells_of(spark, a).drop("weight"), "r", "c", 1, stage, rounds=2)
        paths = list(stage.paths)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert paths and not any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def test_queries_equal_numpy_on_the_whole_table(spark):
    from priorkit.plans import lowrank
    from tests.conftest import SF

    cells = lowrank.pair_cells(spark, SF).collect()
    rows, columns = sorted({r.l_suppkey for r in cells}), sorted({r.l_partkey for r in cells})
    a = np.zeros((len(rows), len(columns)))
    for r in cells:
        a[rows.index(r.l_suppkey), columns.index(r.l_partkey)] = r.value
    u, s, v = np.linalg.svd(a, full_matrices=False)
    rest = (a - u[:, :3] * s[:3] @ v[:3]) * (a != 0)
    got = {r.l_suppkey: r for r in lowrank.pair_svd(spark, SF).collect()}
    for i, key in enumerate(rows):
        assert abs(got[key].rest - (rest[i] ** 2).sum()) < 0.1 and np.allclose([got[key][f"sigma{k}"] for k in range(3)], s[:3], rtol=2e-4)
        assert got[key].residual <= lowrank.TOLERANCE


def test_cells_in_buckets_stay_where_they_are(spark):
    a, _ = matrix()
    with Stage(spark) as stage:
        cells = stage.bucketed(cells_of(spark, a).drop("weight"), "c")
        side = stage.bucketed(factors.seeded(cells.select("c").distinct(), "c", 2), "c")
        ahead = factors.multiplied(cells, side, 10**9, "c", "r", 2)
        plan = ahead._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(r#" in plan  # the sums alone
        back = factors.multiplied(cells, factors.seeded(cells.select("r").distinct(), "r", 2), 10, "r", "c", 2)
        assert "Exchange hashpartitioning(c#" not in back._jdf.queryExecution().executedPlan().toString()
        x = dense(side, "c", 25, 2)
        assert np.allclose(dense(ahead, "r", 40, 2), a @ x)
        names = list(stage.tables)
    assert names and not any(spark.catalog.tableExists(n) for n in names)
