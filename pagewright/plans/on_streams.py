"""Streaming queries over the events: windows, sessions, keys that come once. An extension of what the batch stages do."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.named import query, shared_folder, table
from pagewright.streaming import incremental

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; its time as a timestamp. The parent folder holds all tables, so the file is picked by name."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _read(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    return incremental.read_once(spark, stream, f"{shared_folder(spark)}/stream-{os.urandom(6).hex()}", mode)


@query("SELECT time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, incremental.windows(_events(spark, sf_dir), "6 hours"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS start, event_type, value FROM events)
SELECT start::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _read(spark, incremental.windows(_events(spark, sf_dir), "12 hours", "6 hours"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n_requests, round(sum(value), 4) AS cost FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("cost", F.col("value")).withColumn("tokens", F.col("event_id"))
    out = _read(spark, incremental.sessions(rows, "4 hours", "1 hour", page="user_id"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_requests", F.round("cost", 4).alias("cost"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS page_id, event_type AS model FROM events")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("page_id"), F.col("event_type").alias("model"))
    return _read(spark, incremental.new_keys(rows))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS page_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def stream_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("page_id"))
    rows = _events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("page_id"))
    return _read(spark, incremental.not_done(rows, done, "page"))


@query(
    """WITH l AS (SELECT 'run ' || user_id AS run, CASE event_type WHEN 'signup' THEN 'launching' WHEN 'error' THEN NULL ELSE event_type END AS phase, ts FROM events),
last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, phase DESC NULLS LAST) = 1)
SELECT run, ts AS since, CAST(epoch(date_trunc('second', (SELECT max(ts) FROM l))) - epoch(date_trunc('second', ts)) AS BIGINT) AS age FROM last WHERE phase = 'launching' AND age > 900"""
)
def stale_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs, their events as phases; as of the last event of all."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("run "), "user_id").alias("run"), F.when(kind == "signup", "launching").when(kind != "error", kind).alias("phase"), F.col("ts").cast("timestamp").alias("ts"))
    last = rows.agg(F.max("ts")).first()[0]
    return incremental.stale(rows, F.lit(last)).select("run", F.col("since").cast("timestamp_ntz").alias("since"), "age")
