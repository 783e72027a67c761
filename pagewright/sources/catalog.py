"""Bibliographic catalogs: text dumps to parquet, rights combinations, and the item-title-rights table made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import scalars

RIGHTS = ("CopyrightStatus", "RightsStatement", "LicenseType", "RightsHolder")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated dump with a header: every column text, \\N null, quotes ordinary characters."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="\\N", quote="", escape="\0", emptyValue="")


def ingest(spark: SparkSession, dump: str, target: str) -> DataFrame:
    """The dump as zstd parquet. Spark's committer makes the folder appear whole or not at all."""
    read_dump(spark, dump).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def is_fresh(spark: SparkSession, dump: str, target: str, force: bool = False) -> bool:
    """Whether target was made after dump was last changed; always stale if forced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def changed(path: str) -> int | None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

    made, source = changed(f"{target}/_SUCCESS"), changed(dump)
    return not force and made is not None and source is not None and made >= source


def filled(column: str | Column) -> Column:
    """The column with '' as null."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def rights_combinations(items: DataFrame, columns: tuple[str, ...] = RIGHTS) -> DataFrame:
    """Each combination of the rights columns as it stands, with its count and its JSON, where '' is null too. Null and '' are combinations of their own with equal JSON."""
    body = F.to_json(F.struct(*[filled(c).alias(c) for c in columns]), {"ignoreNullFields": "false"})
    return items.groupBy(*columns).agg(F.count("*").alias("Count")).withColumn("rights_json", body)


def by_count(combinations: DataFrame) -> DataFrame:
    """Combinations, the commonest first, ties by their JSON and then by columns."""
    return combinations.orderBy(F.desc("Count"), "rights_json", *[F.col(c).asc_nulls_first() for c in combinations.columns if c not in ("Count", "rights_json")])


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """All parquet files below root, however deep, as one table; a column that only some have is null in the others."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(root)


def json_list(column: str | Column) -> Column:
    """A JSON list of texts; an empty one where the JSON is broken, something else, or missing."""
    return F.coalesce(F.filter(F.from_json(column, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def json_object(column: str | Column) -> Column:
    """A JSON object as a map of texts; an empty one where the JSON is broken, something else, or missing."""
    return F.coalesce(F.from_json(column, "map<string, string>"), F.create_map().cast("map<string, string>"))


def volumes(rows: DataFrame, order: tuple[str, ...], barcode: str = "barcode") -> DataFrame:
    """A row for each barcode, the last by ``order`` and then by its other columns; its creators as a list and its rights as a map. Rows without a barcode are left out."""
    rest = [c for c in rows.columns if c != barcode and c not in order and not rows.schema[c].dataType.simpleString().startswith("map")]
    last = rows.filter(filled(barcode).isNotNull()).groupBy(barcode).agg(F.max_by(F.struct(*[c for c in rows.columns if c != barcode]), F.struct(*order, *rest)).alias("__last"))
    out = last.select(barcode, "__last.*")
    return out.withColumns({c: f(c) for c, f in (("creators", json_list), ("rights", json_object)) if c in out.columns})


def with_volumes(pages: DataFrame, volumes: DataFrame, barcode: str = "barcode") -> DataFrame:
    """Every page with what is known of its volume; volumes has a row a barcode."""
    return pages.join(volumes, barcode, "left")


def one_verdict(rights: DataFrame, columns: tuple[str, ...] = RIGHTS) -> DataFrame:
    """The parsed verdicts, one for each combination once '' is null: the first by name, so that two raw combinations of one meaning can't double an item."""
    good = rights.filter(F.col("parsing_success")).select(*[filled(c).alias(c) for c in columns], "classification")
    return good.groupBy(*columns).agg(F.min("classification").alias("classification"))


def volumes_table(items: DataFrame, titles: DataFrame, rights: DataFrame, columns: tuple[str, ...] = RIGHTS) -> DataFrame:
    """item left join title, joined null-safely with the verdicts on all rights columns; one row an item, the first by title and barcode as text."""
    verdict = one_verdict(rights, columns).select(*[F.col(c).alias(f"r_{c}") for c in columns], "classification")
    joined = items.join(titles, "TitleID", "left")
    same = [filled(joined[c]).eqNullSafe(F.col(f"r_{c}")) for c in columns]
    kept = joined.join(verdict, same, "inner")
    first = Window.partitionBy("ItemID").orderBy(F.col("TitleID").asc_nulls_last(), F.col("BarCode").asc_nulls_last())
    kept = kept.withColumn("__at", F.row_number().over(first)).filter("__at = 1")
    return kept.select(
        "ItemID", "BarCode", "TitleID", *columns,
        F.col("LanguageCode").alias("Language"), F.coalesce("FullTitle", "ShortTitle").alias("Title"), "MARCBibID", "TL2Author",
        F.col("Year").alias("ItemYear"), year_in("Year").alias("Year"), F.col("classification").alias("Rights"),
    )


def year_in(column: str) -> Column:
    """The first four digits in a row, as a number; null without any."""
    return F.regexp_extract(column, r"(\d{4})", 1).try_cast("int")


def number_in(column: str) -> Column:
    """Text as a whole number once trimmed; null where it isn't one ('', '\\N' and 'NULL' too)."""
    return F.trim(column).try_cast("bigint")


def page_rows(rows: DataFrame, prefix: str = "s3://archive/images") -> DataFrame:
    """Catalog rows as pages: page_id, file_id, barcode, sequence, source_uri and what else the catalog says. Rows without an item, page or barcode ('' counts as none) or with a sequence that isn't a whole number are left out."""
    sequence = number_in("SequenceOrder")
    own = rows.filter(filled("ItemID").isNotNull() & filled("PageID").isNotNull() & filled("BarCode").isNotNull() & sequence.isNotNull())
    uri, name = scalars.archive_image(F.col("BarCode"), sequence, prefix)
    more = [c for c in ("PageTypeName", "PagePrefix", "PageNumber") if c in rows.columns]
    return own.select(F.col("PageID").alias("page_id"), name.alias("file_id"), F.col("BarCode").alias("barcode"), sequence.alias("sequence"), uri.alias("source_uri"), "ItemID", *more)


# What a classifier is told, with and without reasoning.
REASONING = (
    "You are a helpful classification assistant that thinks step by step.",
    "Classify this text into one of these categories:\n\n%s\n\nText: %s\n\nThink through your classification step by step, then provide your final answer in this JSON format:\n{\"label\": \"your_chosen_label\"}",
)
PLAIN = ("You are a helpful classification assistant. /no_think", "Classify this text as one of: %s\n\nText: %s\n\nLabel:")


def classifier_messages(text: Column, labels: list[str], descriptions: dict[str, str] | None = None, reasoning: bool = True) -> Column:
    """The chat that asks for a text's label: array of (role, content). With reasoning, labels are listed with their descriptions, one a line, if any label has one."""
    if reasoning and descriptions:
        listed = "Categories:\n" + "\n".join(f"- {x}: {descriptions[x]}" if descriptions.get(x) else f"- {x}" for x in labels)
    else:
        listed = f"Categories: {', '.join(labels)}" if reasoning else ", ".join(labels)
    system, user = REASONING if reasoning else PLAIN
    before, after = (user % (listed, "\0")).split("\0")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(before), text, F.lit(after))))


def rule_for_rights(text: Column) -> Column:
    """A rule in place of a language model: what a rights statement allows, by its words; null where it says nothing of it."""
    low = F.lower(text)
    return F.when(low.rlike("public domain|no known copyright|cc0"), "public_domain").when(low.rlike("creative commons|cc[ -]by|licen[sc]ed under"), "licensed").when(low.rlike("in copyright|all rights reserved|permission"), "in_copyright")


def classified(combinations: DataFrame, rule=rule_for_rights, column: str = "rights_json") -> DataFrame:
    """The combinations with their classification and whether there is one. rule: a function of a column, a Python function wrapped as one included."""
    return combinations.withColumn("classification", rule(F.col(column))).withColumn("parsing_success", F.col("classification").isNotNull())


def write_classified(combinations: DataFrame, path: str, rule=rule_for_rights, column: str = "rights_json") -> DataFrame:
    """The classified combinations, with all of their columns, as a compressed parquet table at path in place of an earlier one; gives the table as written."""
    classified(combinations, rule, column).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return combinations.sparkSession.read.parquet(path)


def parsed_share(verdicts: DataFrame) -> DataFrame:
    """How many combinations there are, and how many of them have a verdict."""
    return verdicts.agg(F.count("*").alias("n"), F.count_if("parsing_success").alias("parsed"))
