"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import BROADCAST_ROWS, durable, narrow, table, whole_text

PREFIX_CHARS = 256
#: A bitmap stands for groups beyond a broadcast: bits a group, so that one in as many other rows hits it by chance, and at most so many in all (as a power of two: 256 MB).
GROUP_BITS, BITMAP_BITS = 16, 31
#: Groups with their digests are wider than ids; fewer of them are broadcast.
BROADCAST_GROUPS = 100_000


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the number of bytes stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _survivors(rows: DataFrame, groups: DataFrame, bound: int) -> DataFrame:
    """rows whose keys are in groups (its columns); where groups has over ``bound`` rows, rows that hit the bitmap of its keys, sized by their count.

    A row that hits the bitmap by chance is hashed in vain and forms no group; no text is moved, and the result is the same.
    """
    n = groups.count()
    if n <= bound:
        return rows.join(F.broadcast(groups), groups.columns, "left_semi")
    bits = min(BITMAP_BITS, max(15, (GROUP_BITS * n - 1).bit_length()))
    bit = F.xxhash64(*groups.columns).bitwiseAND((1 << bits) - 1)
    set_ = groups.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("__page")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__at", 3).bitwiseAND(4095).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(__at & 7 as int)) & 1") == 1
    found = rows.withColumn("__at", bit).join(F.broadcast(durable(set_)), F.shiftright("__at", 15) == F.col("__page")).withColumn("__byte", byte)
    return found.filter(hit).drop("__at", "__page", "__bits", "__byte")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with lazy keys (id, text, size, prefix, digest), those that get as far as the digest, and the durable table of groups of two rows or more: size, prefix, digest, keep_id, group_size.

    Each step counts rows by the keys so far, partly before the shuffle, and only rows of groups of two or more come to
    the next step; so the prefix is cut and the full text hashed for those alone.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).withColumn("size", F.octet_length(text))
    sizes = durable(rows.groupBy("size").count().filter("count > 1").select("size"))
    rows = rows.withColumn("prefix", F.xxhash64(normalised(F.substring(text, 1, prefix_chars))))
    alike = durable(_survivors(rows, sizes, bound).groupBy("size", "prefix").count().filter("count > 1").select("size", "prefix"))
    rows = rows.withColumn("digest", F.sha2(normalised(text).cast("binary"), 256))
    left = _survivors(rows, alike, bound)
    groups = left.groupBy("size", "prefix", "digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows, left, durable(groups.filter("group_size > 1"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(id, h, keep_id, group_size) for the rows of groups of two or more alone, h: xxhash64 of the text as it is; the full text of other rows is never hashed. What counts as equal, and for odd rows: as in exact_duplicates."""
    _, left, groups = duplicate_groups(docs, id_col, text_col, prefix_chars, bound)
    own = left.withColumn("h", F.xxhash64("text")).drop("text")
    return own.join(narrow(groups, BROADCAST_GROUPS), ["size", "prefix", "digest"]).select(F.col("id").alias(id_col), "h", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and all empty texts are one
    group. The largest id of a group stays; repeated rows of that id all stay, as an id stands for a document. Rows
    without an id stay, with the largest id of their group, if any, as keep_id. Texts that tie on length and prefix are told apart by their full
    hash. Long texts are hashed where they are read; no text is moved. Other columns aren't read. An empty table gives an empty result.
    """
    rows, _, groups = duplicate_groups(docs, id_col, text_col, prefix_chars, bound)
    found = rows.drop("text").join(narrow(groups, BROADCAST_GROUPS), ["size", "prefix", "digest"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("id").isNull() | F.coalesce(F.col("id") == keep, F.lit(False))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
