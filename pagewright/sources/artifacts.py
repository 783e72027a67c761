"""Reading and writing stage artifacts: typed parquet parts in <folder>/data/<stage>-*.parquet, resumed by anti join."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright import schemas

#: Rows of one output file.
SHARD_ROWS = 1000


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match, on whatever file system the pattern names, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(str(s.getPath()) for s in path.getFileSystem(conf).globStatus(path) or [])


def shards(spark: SparkSession, folder: str, stage: str) -> list[str]:
    """The stage's files: in data/ if there are any there, else in the folder itself. Spark's own part files in a folder of the stage's name count too."""
    for pattern in (f"{folder}/data/{stage}-*.parquet", f"{folder}/{stage}-*.parquet", f"{folder}/data/{stage}/*.parquet"):
        if found := _paths(spark, pattern):
            return found
    return []


def resolve(spark: SparkSession, path: str) -> list[str]:
    """The parquet files that a path means: a file, a glob, or a folder, where the first stage that has files counts."""
    if path.endswith(".parquet") or any(c in path for c in "*?["):
        return _paths(spark, path)
    return next((found for stage in schemas.STAGES if (found := shards(spark, path, stage))), [])


def read(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """A stage with its schema: the union of its files. Columns that a file lacks are null, further columns are left out."""
    found = shards(spark, folder, stage)
    kind = schemas.schema(stage)
    return spark.read.schema(kind).parquet(*found) if found else spark.createDataFrame([], kind)


def footers(spark: SparkSession, paths: list[str], *columns: str, files_a_task: int = 50) -> DataFrame:
    """(path, rows, reason) of each file, its footer read in tasks: reason says why the file can't be read or which of the columns it lacks, and is null for a usable one."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // files_a_task)), "path")

    def one(path: str) -> tuple[int | None, str | None]:
        try:
            store, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
            with store.open_input_file(place) as held:
                footer = pq.ParquetFile(held)
                lacks = [c for c in columns if c not in footer.schema_arrow.names]
                return footer.metadata.num_rows, f"lacks {', '.join(lacks)}" if lacks else None
        except Exception as e:  # noqa: BLE001  a damaged file is what this is about
            return None, f"{type(e).__name__}: {e}"

    def work(batches):
        for batch in batches:
            rows = [one(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["path", "rows", "reason"])

    return listed.mapInArrow(work, "path string, rows bigint, reason string")


def read_projected(spark: SparkSession, paths: list[str], *columns: str) -> DataFrame:
    """Some columns of all files; files that can't be read or lack one of the columns are passed over, footers says which and why."""
    usable = sorted(r.path for r in footers(spark, paths, *columns).filter("reason is null").select("path").collect()) if paths else []
    kind = ", ".join(f"{c} string" for c in columns)
    return spark.read.option("ignoreCorruptFiles", True).parquet(*usable).select(*columns) if usable else spark.createDataFrame([], kind)


def is_stage(spark: SparkSession, source: str | None) -> bool:
    """Whether a source is a stage artifact that lies here: a parquet file or a folder with shards. What another store holds, by its scheme, never is."""
    return bool(source) and "://" not in source and (source.endswith(".parquet") or not any(c in source for c in "*?[")) and bool(resolve(spark, source))


def route(spark: SparkSession, source: str | None, name: str = "images", **options) -> tuple[str, dict]:
    """(adapter, options) for a source: stage artifacts go to 'pages', other paths to 'images'; an adapter that is named otherwise gets no path. Options that are null are left out."""
    held = {k: v for k, v in options.items() if v is not None}
    if name != "images":
        return name, held
    return "pages" if is_stage(spark, source) else name, held | {"path": source}


def results_at(spark: SparkSession, output: str) -> DataFrame:
    """The result rows of a run, wherever its output lies: <output>/data/train-*.parquet on any store that Spark reads."""
    found = shards(spark, output.rstrip("/"), "train")
    if not found:
        raise FileNotFoundError(f"no results in {output}")
    return spark.read.schema(schemas.schema("train")).parquet(*found)


def identities(df: DataFrame) -> DataFrame:
    """The page columns that df has, file_id falling back to page_id, extra_json as a map (empty where there is none)."""
    kind = schemas.schema("pages")
    own = df.select(*[c for c in kind.names if c in df.columns])
    if "page_id" in own.columns:
        own = own.withColumn("file_id", F.coalesce(F.nullif(F.col("file_id"), F.lit("")), F.col("page_id")) if "file_id" in own.columns else F.col("page_id"))
    if "extra_json" in own.columns:
        own = own.withColumn("extra", decoded("extra_json")).drop("extra_json")
    return own


def decoded(column: str, kind: str = "map<string, string>") -> Column:
    """JSON text as a map; null, empty or broken text gives an empty one."""
    return F.coalesce(F.from_json(F.col(column), kind), F.from_json(F.lit("{}"), kind))


def encoded(value: Column) -> Column:
    """A map or array as JSON text; null where it is empty."""
    return F.when(F.size(value) > 0, F.to_json(value))


def with_defaults(df: DataFrame) -> DataFrame:
    """Result rows as readers want them: metrics as a map, the empty file_id and model replaced, the required columns there."""
    return (
        df.filter(F.col("page_id").isNotNull())
        .withColumn("file_id", F.coalesce(F.nullif(F.col("file_id"), F.lit("")), F.col("page_id")))
        .withColumn("metrics", decoded("metrics_json"))
        .withColumn("error", F.nullif(F.col("error"), F.lit("")))
    )


def valid(df: DataFrame, stage: str) -> DataFrame:
    """The rows that have what their stage requires."""
    return reduce(lambda d, c: d.filter(F.col(c).isNotNull()), schemas.REQUIRED[stage], df)


def conform(df: DataFrame, stage: str) -> DataFrame:
    """df with exactly the stage's columns and types; missing ones are null, zero width and height too."""
    kind = schemas.schema(stage)
    out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    for c in ("width", "height"):
        if c in kind.names:
            out = out.withColumn(c, F.nullif(F.col(c), F.lit(0).cast("bigint")))
    return out


def append(df: DataFrame, folder: str, stage: str, shard_rows: int = SHARD_ROWS) -> None:
    """Add df's rows to the stage; what is there stays."""
    conform(df, stage).write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").mode("append").parquet(f"{folder}/data/{stage}")


def write_volumes(df: DataFrame, folder: str) -> None:
    """The volumes of a sample in place of earlier ones, one row a barcode; nothing is written if there are none."""
    own = last_by(conform(df, "volumes"), ["barcode"], ["source_uri", "title"])
    if not own.isEmpty():
        own.write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/data/volumes")


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last one by the order columns (nulls first)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


def unseen(new: DataFrame, done: DataFrame, mode: str = "page") -> DataFrame:
    """The rows of new whose key isn't in done; done keys with a null are passed over, and mode 'off' keeps all."""
    keys = schemas.RESUME_KEYS[mode]
    if not keys:
        return new
    seen = done.select(*keys)
    for k in keys:
        seen = seen.filter(F.col(k).isNotNull())
    return new.join(seen, keys, "left_anti")


#: Where marked notes whether a row is done.
SEEN = "__seen"


def marked(new: DataFrame, done: DataFrame, mode: str = "page") -> DataFrame:
    """new with SEEN: whether unseen would drop the row."""
    keys = schemas.RESUME_KEYS[mode]
    if not keys:
        return new.withColumn(SEEN, F.lit(False))
    seen = done.select(*keys).dropna().distinct().withColumn(SEEN, F.lit(True))
    return new.join(seen, keys, "left").withColumn(SEEN, F.coalesce(SEEN, F.lit(False)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
