"""What has been fetched, by entity tag: an unchanged source isn't read again, and one that wasn't there is remembered."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.durable import durable
from pagewright.sources.artifacts import _paths

LEDGER = "key string, url string, tag string, state string, content string, error string, version bigint"
#: What a fetch can come to; the first two are remembered.
HELD, MISSING, FAILED = "held", "missing", "failed"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The latest entry of each key."""
    if not _paths(spark, f"{folder}/version=*"):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).option("basePath", folder).parquet(f"{folder}/version=*")
    last = Window.partitionBy("key").orderBy(F.desc("version"))
    return rows.withColumn("__at", F.row_number().over(last)).filter("__at = 1").drop("__at")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text) of all that is held."""
    return read(spark, folder).filter(F.col("state") == HELD).select("key", F.col("content").alias("text"))


def refresh(wanted: DataFrame, folder: str, tag_of: Callable[[str], str | None], fetch: Callable[[str], bytes], force: bool = False, ask_again: bool = False) -> dict[str, int]:
    """Bring the ledger up to date with wanted (key, url); gives how many keys are unchanged, held anew, missing, failed.

    tag_of gives a url's entity tag, null where there is nothing; fetch its bytes, which are read as UTF-8 with replacements. Both run in tasks, once
    a key. A key whose tag is the one on record isn't fetched, and one on record as missing isn't asked for, unless ``force``, or
    ``ask_again`` for the latter. What raises is a failed entry of this version; the content that was held before stays with it. Entries go to a version of their own, which
    must not exist yet: of two refreshers that began with the same ledger the second one to finish fails and changes nothing.
    """
    spark = wanted.sparkSession
    known = read(spark, folder)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    old = known.select("key", F.col("tag").alias("old_tag"), F.col("state").alias("old_state"), F.col("content").alias("old_content"))
    due = wanted.select("key", "url").filter(F.col("key").isNotNull() & F.col("url").isNotNull()).groupBy("key").agg(F.min("url").alias("url"))
    due = due.join(old, "key", "left")
    if not (force or ask_again):
        due = due.filter(F.coalesce(F.col("old_state") != MISSING, F.lit(True)))

    def one(url: str, tag: str | None, state: str | None, content: str | None) -> tuple:
        try:
            now = tag_of(url)
            if now is None:
                return None, MISSING, None, None
            if now == tag and content is not None and not force:
                return tag, "unchanged", None, None
            return now, HELD, fetch(url).decode("utf-8", "replace"), None
        except FileNotFoundError:
            return None, MISSING, None, None
        except Exception as e:  # noqa: BLE001  whatever a source raises is the key's entry
            return tag, HELD if content is not None else FAILED, content, f"{type(e).__name__}: {e}"

    def work(batches):
        for batch in batches:
            rows = [(r["key"], r["url"], *one(r["url"], r["old_tag"], r["old_state"], r["old_content"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], ["key", "url", "tag", "state", "content", "error"])

    kind = LEDGER.rpartition(",")[0]
    found = durable(due.repartition("key").mapInArrow(work, kind))
    found.filter("state <> 'unchanged'").write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/version={version}")
    n = {r.state: r["count"] for r in found.groupBy(F.when(F.col("error").isNotNull(), FAILED).otherwise(F.col("state")).alias("state")).count().collect()}
    return {s: n.get(s, 0) for s in ("unchanged", HELD, MISSING, FAILED)}
