"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.io import table
from ..streaming import streams


def stream_scores(spark, d):
    """All events scored, as a stream, with the mean value of their type as the batch table has it; `stream_scores_by_day` freezes the state before each day."""
    events = table(spark, d, "events")
    state = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value_of_state"))
    stream = streams.read_stream(spark, events, f"{d}/events*.parquet")
    return streams.run_to_end(streams.scored(stream, F.broadcast(state), ["event_type"], 0.0).select("event_id", "event_type", "score"), spark)  # a row for each type


SCORES_SQL = """WITH s AS (SELECT event_type, round(avg(value), 6) AS v FROM events GROUP BY 1)
SELECT event_id, event_type, coalesce(v, 0.0)::DOUBLE AS score FROM events LEFT JOIN s USING (event_type)"""


def stream_scores_by_day(spark, d):
    """All events scored, as a stream, with the mean value of their type over all earlier days, frozen as of each day; 0 where there is none."""
    events = table(spark, d, "events")
    day = F.to_date("ts")
    daily = events.groupBy("event_type", day.alias("day")).agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("v"), F.count("value").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.sum("v").over(w).cast("double") / F.nullif(F.sum("n").over(w), F.lit(0))
    state = daily.where("day IS NOT NULL").select("event_type", "day", F.round(mean, 6).alias("value_of_state"))
    stream = streams.read_stream(spark, events, f"{d}/events*.parquet").withColumn("day", day)
    return streams.run_to_end(streams.scored(stream, state, ["event_type", "day"], 0.0).select("event_id", "event_type", "score"), spark)


BY_DAY_SQL = """WITH c AS (SELECT event_type, ts::DATE AS day, sum(value::DECIMAL(18, 6)) AS v, count(value) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT event_type, day, round((sum(v) OVER w)::DOUBLE / nullif(sum(n) OVER w, 0), 6) AS m FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, e.event_type, coalesce(m, 0.0)::DOUBLE AS score FROM events e LEFT JOIN s ON e.event_type = s.event_type AND e.ts::DATE = s.day"""


def stream_states(spark, d):
    """Users' cumulative counts and purchases by day, folded from the counts of each micro-batch."""
    events = table(spark, d, "events")
    stream = streams.read_stream(spark, events, f"{d}/events*.parquet").select("user_id", F.to_date("ts").cast("string").alias("day"), (F.col("event_type") == "purchase").cast("int").alias("hit"))
    return streams.season_states(stream, "user_id", "day", "hit")


STATES_SQL = """SELECT user_id, day, (sum(n) OVER w)::BIGINT AS n, (sum(s) OVER w)::BIGINT AS s FROM (
  SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS s FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY day)"""

QUERIES = {"stream_scores": stream_scores, "stream_scores_by_day": stream_scores_by_day, "stream_states": stream_states}
ORACLES = {"stream_scores": SCORES_SQL, "stream_scores_by_day": BY_DAY_SQL, "stream_states": STATES_SQL}
