"""Comparing predictions with references: text, document structure, layout; and the flat metrics of the results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import scalars, text
from pagewright.operators import documents

ALL = ("text", "document", "layout")
#: Flat columns: name, comparison, summary key, type.
FLAT = (
    ("text_similarity", "text", "similarity", "double"),
    ("text_cer", "text", "cer", "double"),
    ("text_wer", "text", "wer", "double"),
    ("document_heading_count_delta", "document", "heading_count_delta", "bigint"),
    ("document_table_count_delta", "document", "table_count_delta", "bigint"),
    ("document_picture_count_delta", "document", "picture_count_delta", "bigint"),
    ("layout_iou_mean", "layout", "iou_mean", "double"),
)


def chosen(names: list[str] | None, has_reference: bool) -> tuple[str, ...]:
    """The comparisons to make: all if there is a reference and none are named; ['none'] means none."""
    if not has_reference or names == ["none"]:
        return ()
    if unknown := set(names or ()) - set(ALL):
        raise ValueError(f"no such comparison: {sorted(unknown)}")
    return ALL if names is None else tuple(names)


def compare(rows: DataFrame, names: tuple[str, ...] = ALL, pred_text: str = "text", base_text: str = "reference_text", pred_doc: str = "document", base_doc: str | None = "reference_document", extra: dict[str, Callable] | None = None) -> DataFrame:
    """A ``comparisons`` struct: one field a comparison, null where a side lacks what it needs.

    extra: comparisons of one's own by name, Python functions from the two texts (prediction, baseline; null where there is none) to a summary
    of numbers, or None. One that raises leaves no summary but its ``error`` in its field of that row; the other comparisons and rows are as they would be without it.
    """
    parts = []
    if clash := set(extra or ()) & set(ALL):
        raise ValueError(f"there are such comparisons: {sorted(clash)}")
    if "text" in names:
        rows = rows.withColumn("__diff", text.text_comparison(base_text, pred_text))
        summary = F.struct(F.col("__diff.similarity").alias("similarity"), text.cer(base_text, pred_text).alias("cer"), text.wer(base_text, pred_text).alias("wer"))
        parts.append(F.when(F.col("__diff").isNotNull(), F.struct(F.lit("text").alias("comparison"), summary.alias("summary"), F.col("__diff").alias("payload"))).alias("text"))
    for name, function in (extra or {}).items():
        rows = rows.withColumn(f"__{name}", isolated(function)(pred_text, base_text))
        held = F.struct(F.lit(name).alias("comparison"), F.col(f"__{name}.summary").alias("summary"), F.col(f"__{name}.error").alias("error"))
        parts.append(F.when(F.col(f"__{name}").isNotNull(), held).alias(name))
    if base_doc is not None and "document" in names:
        d = documents.deltas(F.col(pred_doc), F.col(base_doc))
        summary = F.struct(*[d[k].alias(k) for k in ("heading_count_delta", "table_count_delta", "picture_count_delta")])
        parts.append(F.when(d.isNotNull(), F.struct(F.lit("document").alias("comparison"), summary.alias("summary"), d.alias("payload"))).alias("document"))
    if base_doc is not None and "layout" in names:
        m = documents.layout_comparison(documents.regions(F.col(pred_doc)), documents.regions(F.col(base_doc)))
        parts.append(F.when(m.isNotNull(), F.struct(F.lit("layout").alias("comparison"), F.struct(m["iou_mean"].alias("iou_mean")).alias("summary"), m.alias("payload"))).alias("layout"))
    out = rows.withColumn("comparisons", F.struct(*parts) if parts else F.lit(None).cast("struct<none: string>"))
    return out.drop("__diff", *(f"__{name}" for name in extra or ()))


def isolated(function: Callable) -> Callable:
    """function from two texts to a summary, as a column function whose failures are values: struct of summary and error, null where function gives None."""

    def one(pred: str | None, base: str | None) -> dict | None:
        try:
            found = function(pred, base)
            return None if found is None else {"summary": {str(k): float(v) for k, v in found.items()}, "error": None}
        except Exception as e:  # noqa: BLE001  whatever a comparison raises belongs to this row
            return {"summary": None, "error": f"{type(e).__name__}: {e}"}

    def work(pred: pd.Series, base: pd.Series) -> pd.DataFrame:
        rows = [one(*(None if x is None or x is pd.NA else x for x in pair)) for pair in zip(pred, base, strict=True)]
        return pd.DataFrame({k: pd.Series([r and r[k] for r in rows], dtype="object") for k in ("summary", "error")}).assign(given=[r is not None for r in rows])

    udf = F.pandas_udf(work, "summary map<string, double>, error string, given boolean")

    def of(pred: str | Column, base: str | Column) -> Column:
        return F.transform(F.array(udf(pred, base)), lambda s: F.when(s["given"], F.struct(s["summary"].alias("summary"), s["error"].alias("error"))))[0]

    return of


def flattened(rows: DataFrame, envelope: str = "comparisons_json") -> DataFrame:
    """The seven flat metrics from a JSON envelope; null where there is none."""
    return rows.withColumns({name: scalars.flat_metric(envelope, c, key, kind) for name, c, key, kind in FLAT})
