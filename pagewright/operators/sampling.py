"""Deterministic stratified samples of pages by volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.durable import durable

SEED = 42


def rank_key(column: str | Column, seed: int = SEED) -> Column:
    """A text whose order is random but fixed by value and seed, alike in any SQL engine."""
    return F.md5(F.concat(F.col(column) if isinstance(column, str) else column, F.lit(str(seed))).cast("binary"))


def check_sizes(sample: int | None, volumes: int | None, pages_per_volume: int | None, year_range: tuple[int, int] | None = None) -> None:
    """Refuse samples that can't be filled and ranges that end before they start."""
    if volumes and pages_per_volume and sample and volumes * pages_per_volume < sample:
        raise ValueError(f"{volumes} volumes of {pages_per_volume} pages can't give {sample} pages")
    if year_range and year_range[1] < year_range[0]:
        raise ValueError(f"the year range {year_range} is empty")


def eligible_volumes(volumes: DataFrame, rights: str | None = None, languages: list[str] | None = None, year_range: tuple[int, int] | None = None) -> DataFrame:
    """Volumes by rights, language (given in any case) and inclusive year range; of several rows of an item the first by title and barcode, nulls last. No languages: all."""
    own = volumes
    if rights is not None:
        own = own.filter(F.col("rights") == rights)
    if languages:
        own = own.filter(F.col("language").isin([x.upper() for x in languages]))
    if year_range is not None:
        own = own.filter(F.col("year").between(*year_range))
    first = Window.partitionBy("item_id").orderBy(F.col("title_id").asc_nulls_last(), F.col("barcode").asc_nulls_last())
    return own.withColumn("__at", F.row_number().over(first)).filter("__at = 1").drop("__at")


def stratified_sample(
    volumes: DataFrame, pages: DataFrame, *, sample: int, volumes_n: int | None = None, pages_per_volume: int = 10, rights: str | None = None,
    languages: list[str] | None = None, year_range: tuple[int, int] | None = None, seed: int = SEED, ties: tuple[str, ...] = (),
) -> DataFrame:
    """Pages of randomly ranked volumes, filled volume by volume: at most pages_per_volume of each, ranked at random too.

    volumes: item_id, title_id, barcode, rights, language, year; pages: page_id, item_id and further columns, of which ``ties``
    decide between rows of one page_id. Equal page_ids use up places of a volume and are dropped afterwards, keeping the
    first by volume and page rank. No step ranks all rows in one task: volumes are ordered by their key itself.
    """
    check_sizes(sample, volumes_n, pages_per_volume, year_range)
    chosen = eligible_volumes(volumes, rights, languages, year_range)
    joined = pages.join(chosen, "item_id")
    pool = joined.select("item_id").distinct().withColumn("vkey", rank_key("item_id", seed))
    if volumes_n is not None:
        pool = pool.orderBy("vkey", "item_id").limit(volumes_n)
    w = Window.partitionBy("item_id").orderBy(rank_key("page_id", seed), "page_id", *ties)
    capped = joined.join(pool, "item_id").withColumn("prank", F.row_number().over(w)).filter(F.col("prank") <= pages_per_volume)
    once = Window.partitionBy("page_id").orderBy("vkey", "item_id", "prank")
    return capped.withColumn("__at", F.row_number().over(once)).filter("__at = 1").drop("__at").orderBy("vkey", "item_id", "prank").limit(sample)


def sampled_volumes(rows: DataFrame, link: str = "https://example.org/item/%s") -> DataFrame:
    """A volume for each item of a sample: its first page's data, how many of its pages were sampled, its author if any."""
    w = Window.partitionBy("item_id")
    first = rows.withColumn("__at", F.row_number().over(w.orderBy("prank"))).withColumn("page_count", F.count("*").over(w)).filter("__at = 1")
    author = F.nullif(F.trim("author"), F.lit(""))
    return first.select(
        F.coalesce(F.nullif(F.col("barcode"), F.lit("")), F.col("item_id")).alias("barcode"), "title",
        F.when(author.isNotNull(), F.array(author)).otherwise(F.array().cast("array<string>")).alias("creators"),
        "language", "year", "rights", "page_count", F.format_string(link, "item_id").alias("source_uri"),
    )


def index_window(df: DataFrame, order: list[str], start: int, end: int | None) -> DataFrame:
    """The rows with an index from start up to, not including, end in the given order. Only rows before end are ranked; without an end all are, in as many tasks as they fill."""
    if end is not None and end < start:
        raise ValueError("end lies before start")
    if end is None:
        return indexed(df, order).filter(F.col("index") >= start)
    ranked = df.orderBy(*order).limit(end).withColumn("index", F.row_number().over(Window.orderBy(*order)) - 1)
    return ranked.filter(F.col("index") >= start)


def indexed(df: DataFrame, order: list[str], column: str = "index") -> DataFrame:
    """df with each row's place in order, from 0; nulls first, equal rows one after another in no particular order.

    Rows are sorted by range, so that no task has more than its share even of equal ones; a task counts its own rows, and only one number a task
    is summed up over all of them.
    """
    keys = [*order, "__from"]
    ranges = df.withColumn("__from", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__from")
    kept = durable(ranges.withColumn("__row", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__row", 33))
    parts = kept.groupBy("__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    index = F.col("__before") + F.col("__row") - F.col("__first")
    return kept.join(F.broadcast(parts), "__part").withColumn(column, index).drop("__part", "__row", "__first", "__before")


def rank_slice(total: int, ranks: int, rank: int) -> tuple[int, int]:
    """The index range of one of several workers; the last one takes what is left over."""
    step = total // ranks
    return rank * step, total if rank == ranks - 1 else (rank + 1) * step


def random_subset(df: DataFrame, column: str, k: int, seed: int = SEED) -> DataFrame:
    """k rows at random, the same ones for the same seed: the least by rank key."""
    return df.orderBy(rank_key(column, seed), column).limit(k)
