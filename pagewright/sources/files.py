"""Pages, references and layouts that lie as files: images by listing, texts by name, detections by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagewright import schemas
from pagewright.functions import scalars
from pagewright.operators.sampling import random_subset
from pagewright.sources.artifacts import last_by

#: Columns that may hold a row's id, the first one that is there.
ID_COLUMNS = ("page_id", "id", "name", "filename", "file_name")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, length): image files below root, at any depth, by their extension. The bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length").filter(scalars.is_image(F.col("path")))


def image_pages(spark: SparkSession, root: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Page identities of the images below root: file_id is the last folder of root and the file name."""
    listed = list_images(spark, root)
    if sample is not None:
        listed = random_subset(listed, "path", sample, seed)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parent = F.lit(root.rstrip("/").rpartition("/")[2])
    return listed.select(name.alias("page_id"), scalars.file_id(parent, F.col("path"), name).alias("file_id"), F.col("path").alias("source_uri"))


def with_bytes(pages: DataFrame, root: str) -> DataFrame:
    """image: struct(bytes, path) of each page's source_uri, null where there is no such file; each file is read once."""
    wanted = pages.select("source_uri").distinct()
    held = pages.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bytes_ = held.join(wanted, held.path == wanted.source_uri, "left_semi").select(F.col("path").alias("source_uri"), F.struct(F.col("content").alias("bytes"), "path").alias("image"))
    return pages.join(bytes_, "source_uri", "left")


def image_column(df: DataFrame) -> str | None:
    """The first binary column, or struct with bytes."""
    for f in df.schema.fields:
        if isinstance(f.dataType, BinaryType) or "bytes" in getattr(f.dataType, "names", ()):
            return f.name
    return None


def id_column(df: DataFrame, but: str | None = None) -> str | None:
    return next((c for c in ID_COLUMNS if c in df.columns and c != but), None)


def row_pages(df: DataFrame, parent: str, index: str, path: str | None = None) -> DataFrame:
    """Page identities of table rows, in an explicit order given by the column ``index``. Rows of an image column that has neither bytes nor a path are passed over."""
    image = image_column(df)
    if image is not None:
        held = F.col(image) if isinstance(df.schema[image].dataType, BinaryType) else F.col(image)["bytes"]
        inner = F.col(image)["path"] if "path" in getattr(df.schema[image].dataType, "names", ()) else F.lit(None)
        df = df.filter(held.isNotNull() | inner.isNotNull() | (F.col(path).isNotNull() if path else F.lit(False)))
    where = F.col(path) if path else F.lit(None).cast("string")
    given = id_column(df, but=path)
    page = scalars.page_id(F.col(given).cast("string") if given else F.lit(None).cast("string"), where, F.col(index))
    return df.select(page.alias("page_id"), scalars.file_id(F.lit(parent), F.coalesce(where, F.lit("")), page).alias("file_id"), where.alias("source_uri"))


def text_references(pages: DataFrame, root: str) -> DataFrame:
    """reference_text of each page from <root>/<page id with .txt for its suffix>, else <root>/<stem>.txt; null without either."""
    reader = pages.sparkSession.read.option("recursiveFileLookup", True)
    base = root.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    relative = lambda path: F.substring_index(path, base, -1)
    listed = reader.format("binaryFile").option("pathGlobFilter", "*.txt").load(root).select(relative("path").alias("rel"))  # names alone
    texts = reader.option("wholetext", True).option("pathGlobFilter", "*.txt").text(root).select(relative("_metadata.file_path").alias("__rel"), F.col("value").alias("reference_text"))
    full = F.concat(F.regexp_replace("page_id", r"\.[^./]*$", ""), F.lit(".txt"))
    stem = F.concat(F.regexp_replace(F.regexp_extract("page_id", r"([^/]+)$", 1), r"\.[^./]*$", ""), F.lit(".txt"))
    a, b = listed.toDF("__a"), listed.toDF("__b")
    named = pages.join(a, full == F.col("__a"), "left").join(b, stem == F.col("__b"), "left").withColumn("__rel", F.coalesce("__a", "__b"))
    return named.drop("__a", "__b").join(texts, "__rel", "left").drop("__rel")


def archive_references(pages: DataFrame, texts: DataFrame, item: str = "item_id") -> DataFrame:
    """reference_text from an archive's texts (path, text), and that it comes from OCR; null for pages without whole-number ids or text."""
    key = scalars.ocr_text_path(F.col(item), F.col("page_id"), F.col("sequence"))
    held = texts.select(F.col("path").alias("__path"), F.col("text").alias("reference_text"))
    out = pages.withColumn("__key", key).join(held, F.col("__key") == F.col("__path"), "left").drop("__key", "__path")
    return out.withColumn("reference_provenance", F.when(F.col("reference_text").isNotNull(), F.struct(F.lit("ocr").alias("method"))))


def parsed_regions(column: str | Column) -> Column:
    """A JSON list of regions; entries that aren't regions (no category, no four-number box) are passed over one by one."""
    raw = F.from_json(column, "array<string>")
    shape = schemas.REGION.replace(f"bbox: {schemas.BBOX}", "bbox: array<double>").replace("polygon: array<struct<x: double, y: double>>", "polygon: array<array<double>>")
    each = F.filter(F.transform(raw, lambda x: F.from_json(x, shape)), lambda r: r["category"].isNotNull() & (F.size(r["bbox"]) == 4) & F.forall(r["bbox"], lambda v: v.isNotNull()))
    box = lambda r: F.struct(*[r["bbox"][i].alias(k) for i, k in enumerate("ltrb")])
    points = lambda r: F.transform(r["polygon"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.coalesce(F.transform(each, lambda r: F.struct(r["id"].alias("id"), r["category"].alias("category"), box(r).alias("bbox"), r["score"].alias("score"), points(r).alias("polygon"), r["reading_order"].alias("reading_order"), r["parent_id"].alias("parent_id"))), F.array().cast(f"array<{schemas.REGION}>"))


def precomputed_regions(pages: DataFrame, layout: DataFrame, order: list[str]) -> DataFrame:
    """regions of each page from an earlier detection, the last one by ``order``; none for pages without."""
    last = last_by(layout, ["page_id"], order).select("page_id", parsed_regions("regions_json").alias("regions"))
    return pages.join(last, "page_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{schemas.REGION}>")))
