"""Small expressions: identifiers, links, sizes, buckets, lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions, size suffixes, bytes a parameter takes.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".bmp", ".gif", ".jp2", ".j2k", ".jpx")
BYTE_SUFFIXES = {"": 1, "k": 1000, "K": 1024, "m": 1000**2, "M": 1024**2, "g": 1000**3, "G": 1024**3, "t": 1000**4, "T": 1024**4}
PARAMETER_SUFFIXES = {"K": 10**3, "M": 10**6, "B": 10**9, "T": 10**12}
BYTES_PER_PARAMETER = {"auto": 2, "bfloat16": 2, "bf16": 2, "float16": 2, "fp16": 2, "half": 2, "float32": 4, "fp32": 4, "float": 4, "fp8": 1, "float8": 1, "fp8_e4m3": 1, "fp8_e5m2": 1, "int8": 1, "int4": 0.5, "uint4": 0.5}
SIZE_BUCKETS = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"), (10_000_000, "1M<n<10M"))


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a small fixed table."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def page_id(id_value: Column, path: Column, index: Column) -> Column:
    """The given id, else the last part of the path, else row_ and the index; '' is like null."""
    base = F.regexp_extract(path, r"([^/\\?#]+)(?:[?#].*)?$", 1)
    return F.coalesce(F.nullif(id_value, F.lit("")), F.nullif(base, F.lit("")), F.format_string("row_%06d", index))


def file_id(parent: Column, path: Column, page: Column) -> Column:
    """parent/file name; the page id where the path names no file."""
    return F.concat_ws("/", parent, F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("")), page))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*IMAGE_EXTENSIONS)


def archive_image(barcode: Column, sequence: Column, root: str = "s3://archive/images") -> tuple[Column, Column]:
    """(uri, file id) of a page image of an archive."""
    name = F.format_string("%s/%s_%04d.jp2", barcode, barcode, sequence)
    return F.concat(F.lit(f"{root}/"), name), name


def web_image(uri: Column, root: str = "s3://archive/images", web: str = "https://archive.example/web", size: str = "medium") -> Column:
    """The web picture of an archive image; null for other links, which the folder and the file name must agree on."""
    form = rf"^{root.replace('.', chr(92) + '.')}/([^/]+)/\1_(\d{{4}})\.jp2$"
    bar, number = F.regexp_extract(uri, form, 1), F.regexp_extract(uri, form, 2)
    return F.when(uri.rlike(form), F.concat(F.lit(f"{web}/"), bar, F.lit("/"), bar, F.lit("_"), number, F.lit(f"_{size}.jpg")))


def ocr_text_path(item: Column, page: Column, sequence: Column) -> Column:
    """Where the archive keeps a page's text; null unless item and page are whole numbers."""
    i, p = item.try_cast("bigint"), page.try_cast("bigint")
    return F.when(i.isNotNull() & p.isNotNull(), F.format_string("item-%06d/item-%06d-%08d-%04d.txt", i, i, p, sequence))


def size_bucket(rows: Column) -> Column:
    out = F.lit("n>10M")
    for limit, name in reversed(SIZE_BUCKETS):
        out = F.when(rows < limit, name).otherwise(out)
    return out


def byte_count(text: Column) -> Column:
    """'12G' and the like in bytes: lower-case suffixes decimal, upper-case ones binary, a final b or B ignored; null if it isn't a size."""
    body = F.regexp_replace(F.trim(text), "[bB]$", "")
    form = r"^(\d+(?:\.\d+)?)\s*([kKmMgGtT]?)$"
    return F.when(body.rlike(form), F.floor(F.regexp_extract(body, form, 1).try_cast("double") * lookup(F.regexp_extract(body, form, 2), BYTE_SUFFIXES)))


def parameter_count(text: Column) -> Column:
    """'1.7B' and the like; billions without a suffix; null if it isn't a count."""
    form = r"^(\d+(?:\.\d+)?)\s*([KkMmBbTt])?$"
    suffix = F.coalesce(F.nullif(F.upper(F.regexp_extract(F.trim(text), form, 2)), F.lit("")), F.lit("B"))
    return F.when(F.trim(text).rlike(form), F.floor(F.regexp_extract(F.trim(text), form, 1).try_cast("double") * lookup(suffix, PARAMETER_SUFFIXES)))


def human_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return (
        F.when(seconds.isNull(), F.lit(None))
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dm%02ds", F.floor(s / 60), F.pmod(s, F.lit(60))))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)))
    )


def snippet(texts: Column, length: int) -> Column:
    """Stripped non-empty texts joined by a dot until they make up the length, on one line, cut with an ellipsis."""
    own = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(a["n"] >= length, a).otherwise(F.struct(F.when(a["n"] == 0, x).otherwise(F.concat(a["s"], F.lit(" · "), x)).alias("s"), (a["n"] + F.length(x)).alias("n")))
    line = F.replace(F.aggregate(own, start, step)["s"], F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length - 1), F.lit("…"))).when(line == "", F.lit("(no text items)")).otherwise(line)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def elapsed(start: Column, end: Column) -> Column:
    """Seconds from start to end, never below 0."""
    return F.greatest(F.lit(0.0), end - start)


def with_size(template: Column, width: Column, height: Column) -> Column:
    """The template with {width} and {height} filled in."""
    return F.replace(F.replace(template, F.lit("{width}"), width.cast("string")), F.lit("{height}"), height.cast("string"))


def prompt_mode(category: Column, by_category: Column, preferred: Column, templates: Column) -> Column:
    """A region's prompt: by category, else the preferred one, else the first template; passed over where there is no such template."""
    has = lambda name: F.when(F.map_contains_key(templates, name), name)
    return F.coalesce(has(F.coalesce(F.try_element_at(by_category, category), F.lit(""))), has(F.coalesce(preferred, F.lit(""))), F.try_element_at(F.map_keys(templates), F.lit(1)))


def allowed(args: Column, names: list[str]) -> tuple[Column, Column]:
    """Arguments split by an allow-list into those on it and the others; null values are dropped."""
    inside = lambda k: k.isin(names)
    return F.map_filter(args, lambda k, v: v.isNotNull() & inside(k)), F.map_filter(args, lambda k, v: v.isNotNull() & ~inside(k))


def flat_metric(comparisons: str, name: str, key: str, kind: str = "double") -> Column:
    """comparisons[name].summary[key] of a JSON envelope, null where it isn't there."""
    return F.get_json_object(F.col(comparisons), f"$.{name}.summary.{key}").try_cast(kind)
