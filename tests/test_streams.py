import datetime as dt

from pyspark.sql import functions as F

from priorkit.streaming import streams


def test_scores_do_not_depend_on_micro_batches(spark, tmp_path):
    rows = [(i, "ab"[i % 2]) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "id int, k string").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    like = spark.read.parquet(str(tmp_path / "in0"))
    state = spark.createDataFrame([("a", 0.25)], "k string, value_of_state double")
    out = [streams.run_to_end(streams.scored(streams.read_stream(spark, like, str(tmp_path / "in*"), n), state, ["k"], 0.5), spark).collect() for n in (1, 100)]
    assert sorted(map(tuple, out[0])) == sorted(map(tuple, out[1])) and len(out[0]) == 40
    assert {r.score for r in out[0] if r.k == "b"} == {0.5}


def test_states_do_not_depend_on_micro_batches(spark, tmp_path):
    """A day split over batches gives one row, and a day that comes late counts in its place."""
    parts = [[("u", "d3", 1), ("v", "d1", 0)], [("u", "d1", 1), ("u", "d3", 0)], [("u", "d2", None), ("v", "d1", 1)], [(None, "d1", 1)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "u string, day string, hit int").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    like = spark.read.parquet(str(tmp_path / "in0"))
    want = [("None", "d1", 1, 1), ("u", "d1", 1, 1), ("u", "d2", 2, 1), ("u", "d3", 4, 2), ("v", "d1", 2, 1)]
    for n in (1, 2, 100):
        got = streams.season_states(streams.read_stream(spark, like, str(tmp_path / "in*"), n), "u", "day", "hit")
        got = (streams.run_to_end(got, spark) if got.isStreaming else got).collect()
        assert sorted((str(r.u), r.day, r.n, r.s) for r in got) == want


def test_gap_sessions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 1, 2, 20, 21, 500]
    spark.createDataFrame([(1, t0 + dt.timedelta(hours=h)) for h in at], "u int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    got = streams.run_to_end(streams.gap_sessions(streams.read_stream(spark, like, str(tmp_path / "in")), "u", "ts", "6 hours", "1 hour"), spark)
    assert sorted(r.n for r in got.where(F.col("start") < "2024-01-10").collect()) == [2, 3]


def test_a_cluster_has_to_name_the_shared_folder():
    import pytest

    from priorkit.sources.io import shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
