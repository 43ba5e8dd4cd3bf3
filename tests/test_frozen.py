import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorkit.operators import frozen
from priorkit.plans import pipelines

SF = "/root/testdata/sf0.001"
SCHEMA = "season int, x double, y double, z double, rest double"


def made(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = float(rng.normal(3, 2)), float(rng.normal(-1, 5))
        rest = 0.4 * x + float(rng.normal(0, 0.1)) + (0.7 if i % 7 == 0 else 0.0)
        rows.append((1995 + i % 4, x, None if i % 7 == 0 else y, 2.0, rest))
    return rows


def plain(rows, fold, alpha):
    """Imputation, scale and ridge by numpy on the rows; predictions of all rows."""
    a = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    seen = a[:, 0] < fold
    v, gone = a[:, 1:4].copy(), np.isnan(a[:, 1:4]).astype(float)
    for k in range(3):
        v[np.isnan(v[:, k]), k] = np.nanmean(a[seen, 1 + k])
    mean, scale = v[seen].mean(axis=0), v[seen].std(axis=0)
    design = np.column_stack([np.ones(len(a)), (v - mean) / np.where(scale > 1e-9, scale, 1.0), gone])
    penalty = alpha * np.eye(7)
    penalty[0, 0] = 0
    w = np.linalg.solve(design[seen].T @ design[seen] + penalty, design[seen].T @ a[seen, 4])
    return design @ w


def test_pipeline_equals_numpy_before_and_after_storing(spark, tmp_path):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stored = frozen.fit(df, ["x", "y", "z"], "rest", [1995, 1997, 1998], alpha=2.0)
    assert {r["fold"] for r in stored} == {1997, 1998}
    frozen.save(spark, stored, str(tmp_path / "p"))
    back = frozen.load(spark, str(tmp_path / "p"))
    assert back == stored
    got = {tuple(r)[:5]: r["p"] for r in frozen.apply(df, back, "p").collect()}
    for fold in (1997, 1998):
        for r, p in zip(rows, plain(rows, fold, 2.0)):
            if r[0] == fold:
                assert got[r] == pytest.approx(p, abs=1e-8)
    assert all(p is None for r, p in got.items() if r[0] < 1997)


def test_a_rows_prediction_depends_on_no_other_row(spark):
    rows = made(80)
    df = spark.createDataFrame(rows, SCHEMA)
    stored = frozen.fit(df, ["x", "y", "z"], "rest", [1998])
    whole = {tuple(r)[:5]: r["p"] for r in frozen.apply(df, stored, "p").where("season = 1998").collect()}
    one = spark.createDataFrame([next(iter(whole))], SCHEMA)
    assert frozen.apply(one, stored, "p").first()["p"] == whole[next(iter(whole))]


def test_later_periods_change_nothing_and_odd_values_are_missing(spark):
    rows = made(120)
    fit = lambda r: frozen.fit(spark.createDataFrame(r, SCHEMA).coalesce(1), ["x", "y", "z"], "rest", [1997])
    changed = [(*r[:4], r[4] + 9) if r[0] >= 1997 else r for r in rows]
    assert fit(rows) == fit(changed)
    assert fit([*rows, (1996, 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0, 1.0)]) == fit(rows)
    odd = [(1995, float("nan"), float("inf"), None, 1.0), (1996, None, None, None, 3.0), (1997, None, float("nan"), 1.0, 0.0)]
    stored = fit(odd)
    assert [r["fill"] for r in stored] == [0, 0, 0] and stored[0]["intercept"] == pytest.approx(2.0, abs=0.5)
    p = frozen.apply(spark.createDataFrame(odd, SCHEMA), stored, "p").where("season = 1997").first()["p"]
    assert np.isfinite(p)
    assert fit([]) == []


def test_broken_files_are_errors(spark, tmp_path):
    stored = frozen.fit(spark.createDataFrame(made(60), SCHEMA), ["x", "y", "z"], "rest", [1998])
    for i, change in enumerate(({"scale": 0.0}, {"coefficient": None}, {"place": 5}, {"intercept": 7.0})):
        path = tmp_path / str(i)
        path.mkdir()
        (path / "part.json").write_text("\n".join(json.dumps(r | change if r["place"] == 1 else r) for r in stored))
        with pytest.raises(ValueError):
            frozen.load(spark, str(path))
    with pytest.raises(ValueError):
        frozen.fit(spark.createDataFrame(made(9), SCHEMA), ["x"], "rest", [1998], alpha=0.0)


def test_queries_stay_near_the_base_on_later_years(spark):
    rows = pipelines.residual_rows(spark, SF)
    for q, most in ((pipelines.frozen_pipeline, rows.count()), (pipelines.side_log_residual, rows.count() - 1)):
        got = q(spark, SF).collect()
        assert got and sum(r["n"] for r in got) <= most
        assert all(abs(r["brier"] - r["base"]) < 0.02 for r in got)
    side = pipelines.side_rows(spark, SF)
    assert side.where("season = 1995 OR brand_rate IS NULL").count() == 0 and side.count() < rows.count()
    want = side.groupBy("season", "l_suppkey").agg(F.countDistinct("brand").alias("b")).where("b > 1").count()
    assert want == 0


def test_side_rows_meet_their_parts_once(spark):
    """The log's join of lines and parts is staged: what reads the side rows scans the lines once and no part; the summaries are those of the lines."""
    side = pipelines.side_rows(spark, SF)
    plan = side._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_returnflag#") and "p_brand" not in plan and "p_size" not in plan
    log = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    want = {tuple(r)[:2]: r for r in log.groupBy(F.year("l_shipdate") + 1, "p_brand").agg(F.avg((F.col("l_returnflag") == "R").cast("int")), F.avg(F.col("l_extendedprice") / F.col("l_quantity")), F.avg("p_size")).collect()}
    for r in side.select("season", "brand", "brand_rate", "brand_price", "brand_size").distinct().collect():
        assert tuple(r)[2:] == pytest.approx(tuple(want[r[0], r[1]])[2:])
