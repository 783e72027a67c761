"""Stages that follow growing folders, and costs of requests as they come in."""

from __future__ import annotations

from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright import schemas
from pagewright.sources import artifacts


def follow(spark: SparkSession, path: str, kind, files_at_once: int = 100) -> DataFrame:
    """A stream over a folder of parquet files that grows."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_at_once).parquet(path)


def new_keys(stream: DataFrame, mode: str = "page_model", event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come before. With an event time keys are forgotten once it lies ``late`` behind; without one the state grows with the keys."""
    keys = schemas.RESUME_KEYS[mode]
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def not_done(stream: DataFrame, done: DataFrame, mode: str = "page_model") -> DataFrame:
    """Rows of the stream that a finished artifact doesn't have."""
    return artifacts.unseen(stream, done, mode)


def sessions(requests: DataFrame, gap: str = "10 minutes", late: str = "30 minutes", time: str = "ts", page: str = "page_id") -> DataFrame:
    """Costs by page and session of requests: a page is closed when nothing came for ``gap``."""
    w = F.session_window(time, gap)
    held = requests.withWatermark(time, late).groupBy(page, w).agg(F.count("*").alias("n_requests"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"))
    return held.select(page, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_requests", "cost", "tokens")


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by key in tumbling or sliding windows; what comes more than ``late`` behind is dropped."""
    held = events.withWatermark(time, late).groupBy(F.window(time, size, slide) if slide else F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return held.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a folder, each row once, until what is there now has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stage_by_batch(stream: DataFrame, folder: str, stage: str, checkpoint: str, mode: str = "page_model") -> StreamingQuery:
    """Each batch's new rows appended to an artifact. A batch that is run again after a failure finds its rows there and adds none."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        own = batch.dropDuplicates(schemas.RESUME_KEYS[mode])
        artifacts.append(artifacts.unseen(own, artifacts.read(spark, folder, stage), mode), folder, stage)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_once(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its result, which lies below folder, a new one that all executors share.

    Each batch has a folder of its own, written anew if the batch is run again; in mode 'complete' the last one holds the result.
    """
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        written.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{folder}/rows")
    return (rows.filter(F.col("batch") == max(written)) if mode == "complete" else rows).drop("batch")


def stale(launches: DataFrame, now: Column, key: str = "run", phase: str = "phase", time: str = "ts", silent: int = 900) -> DataFrame:
    """(key, since, age) of keys whose last row says 'launching' and is more than ``silent`` seconds old. Ties in time go to the greater phase; rows without a key or time say nothing."""
    last = launches.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key).agg(F.max(F.struct(time, phase)).alias("last"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(f"last.{time}"))
    return last.filter((F.col(f"last.{phase}") == "launching") & (age > silent)).select(key, F.col(f"last.{time}").alias("since"), age.alias("age"))


def stale_as_they_fall_silent(launches: DataFrame, key: str = "run", phase: str = "phase", time: str = "ts", silent: float = 900) -> DataFrame:
    """The stream of (key, since): a key that said 'launching' last and then nothing for ``silent`` seconds on the clock, each time once.

    The state of a key is its last launch with a timer, and is gone when another phase comes or the timer has rung. launches: string key, phase, timestamp.
    """

    def last(own: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield pd.DataFrame({key: [own[0]], "since": [pd.Timestamp(since, unit="us")]})
            return
        rows = pd.concat(list(batches)).dropna(subset=[time]).sort_values([time, phase], na_position="first")
        if len(rows) and rows[phase].iloc[-1] == "launching":
            state.update((int(rows[time].iloc[-1].value // 1000),))
            state.setTimeoutDuration(int(silent * 1000))
        elif len(rows) and state.exists:
            state.remove()

    own = launches.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), phase, F.col(time).cast("timestamp").alias(time))
    return own.groupBy(key).applyInPandasWithState(last, f"{key} string, since timestamp", "since long", "append", GroupStateTimeout.ProcessingTimeTimeout)


PROGRESS = "query string, name string, batch long, at timestamp, rows long, rows_per_second double, seconds double, state_rows long, ended boolean, error string"


class ProgressTable(StreamingQueryListener):
    """Writes a row to a table for every batch of every streaming query of the session, and one when a query ends. Add it with spark.streams.addListener.

    Rows go to a folder as JSON lines, one file a row, so that what a driver wrote before it was lost stays readable.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _write(self, **row) -> None:
        names = [x.split()[0] for x in PROGRESS.split(", ")]
        self._spark.createDataFrame([tuple(row.get(n) for n in names)], PROGRESS).coalesce(1).write.mode("append").json(self._folder)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = sum(o.numRowsTotal for o in p.stateOperators)
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        self._write(query=str(p.id), name=p.name, batch=p.batchId, at=at, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, seconds=p.batchDuration / 1000, state_rows=state, ended=False)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write(query=str(event.id), ended=True, at=datetime.now(UTC), error=event.exception)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that a ProgressTable has written."""
    return spark.read.schema(PROGRESS).json(folder)


def status(rows: DataFrame) -> DataFrame:
    """From progress rows one a query: state (running, ended, failed), batches, rows done, mean rows a second of busy time, time of the last batch."""
    at = F.when(~F.col("ended"), F.col("at"))
    held = rows.groupBy("query").agg(
        F.max("name").alias("name"), F.max("ended").alias("ended"), F.max("error").alias("error"), F.count_distinct("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("seconds").alias("seconds"), F.max(at).alias("last_batch"),
    )
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("ended"), "ended").otherwise("running")
    return held.select("query", "name", state.alias("state"), "batches", "rows", (F.col("rows") / F.nullif(F.col("seconds"), F.lit(0.0))).alias("rows_per_second"), "last_batch")
