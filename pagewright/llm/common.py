"""Helpers that the operators share: tables, durable intermediate results, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most three longs that may be broadcast: about 24 MB at the most.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A temporary folder is set only where the session names none and its executors are
    this process (tests); on a cluster they would each write to a disk of their own, so that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, for rows that are read by a filter again and again: sorted ones are skipped by their statistics."""
    path = f"{_checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(small: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcasting if it has at most ``bound`` rows (it should be durable: it is counted here); beyond that Spark shuffles."""
    return F.broadcast(small) if small.count() <= bound else small


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it what no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id and text, by its xxhash64, aren't in dropped (id, h; durable). So rows that share an id alone stay."""
    i, h = free_name(df, "dropped_id"), free_name(df, "dropped_h")
    own = narrow(dropped.select(F.col("id").alias(i), F.col("h").alias(h)))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(whole_text(text_col)) == F.col(h))
    return df.join(own, same, "left_anti")


def sql_crc32(number: str) -> str:
    """DuckDB SQL for the crc32 of a number's decimal digits, bit by bit."""
    digits = f"{number}::VARCHAR"
    mixed = f"xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr({digits}, i // 8 + 1, 1)) ELSE 0 END)"
    step = f"xor({mixed} >> 1, CASE WHEN {mixed} & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length({digits}))), lambda c, i: {step}), 4294967295)"
