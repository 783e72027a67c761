"""Staging results as a dataset: files, manifest, card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars, text
from pagewright.operators import stats
from pagewright.sources import artifacts, files


def manifest(rows: DataFrame, k: int = 10) -> dict:
    """Counts, per-model figures and the pages of most disagreement; a handful of rows each."""
    own = artifacts.with_defaults(rows)
    pages = text.disagreement(own.withColumn("body", F.coalesce("markdown", "text")), "file_id", "model", "body").cache()
    whole = stats.overall(own, pages).withColumn("size_category", scalars.size_bucket(F.col("n_rows")))
    return {"overall": whole.first().asDict(), "models": [r.asDict() for r in stats.per_model(own).collect()], "top": [r.asDict() for r in stats.top_disagreement(pages, k).collect()]}


def _table(rows: list[dict], columns: list[str]) -> str:
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)])


def card(name: str, held: dict, columns: list[str], config: str | None = None) -> str:
    """The dataset card as markdown."""
    o = held["overall"]
    parts = [
        f"---\nsize_categories:\n- {o['size_category']}\n---", f"# {name}",
        f"{o['n_rows']} rows: {o['n_pages']} pages by {o['n_models']} models, {o['n_pages_with_errors']} pages with errors.",
        "## Models", _table(held["models"], ["model", "output_format", "pages_ok", "pages_errored", "total_tokens", "mean_tokens", "mean_text_length"]),
        "## Most disagreement", _table(held["top"], ["page", "disagreement", "n_models"]),
        "## Columns", "\n".join(f"- `{c}`" for c in columns),
    ]
    return "\n\n".join([*parts, f"## Job\n\n```json\n{config}\n```"] if config else parts) + "\n"


def stage(spark: SparkSession, source: str, target: str, name: str, images: str | None = None, config: str | None = None, one_file: bool = False) -> dict:
    """Write the results in source to target with their card. images: a folder from which each page's image is attached. one_file only suits small results."""
    rows = artifacts.read(spark, source, "train")
    if not artifacts.shards(spark, source, "train"):
        raise FileNotFoundError(f"{source} holds no results")
    out = files.with_bytes(rows, images) if images else rows
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/data")
    held = manifest(rows)
    body = card(name, held, out.columns, config)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{target}/README.md")
    stream = path.getFileSystem(conf).create(path, True)
    stream.write(bytearray(body.encode()))
    stream.close()
    return held
