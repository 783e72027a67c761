"""Queries behind the views of a run: pages with their volumes, indexes and orders of pages, legends, lookups, small expressions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.durable import durable
from pagewright.functions import scalars, text
from pagewright.operators import documents, sampling, stats
from pagewright.plans import pipeline
from pagewright.plans.named import query, shared_folder, table
from pagewright.plans.on_text import _TOKENS
from pagewright.sources import catalog

_VOLUMES = """WITH v AS (SELECT CAST(c_nationkey AS VARCHAR) AS barcode, c_custkey, c_name FROM customer WHERE c_nationkey % 5 <> 0),
last AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY c_custkey DESC) = 1) """


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of volumes, many a barcode."""
    k = F.col("c_custkey") % 4
    creators = F.when(k == 0, F.to_json(F.array("c_name", F.lit("b")))).when(k == 1, '{"x": 1}').when(k == 2, "[broken")
    rights = F.when(k == 0, F.to_json(F.create_map(F.lit("by"), "c_name"))).when(k == 1, "nothing").when(k == 2, "[1]")
    rows = table(spark, sf_dir, "customer").withColumn("barcode", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).otherwise(""))
    return catalog.volumes(rows.select("barcode", "c_custkey", "c_name", creators.alias("creators"), rights.alias("rights")), ("c_custkey",))


@query(
    _VOLUMES
    + """SELECT barcode, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_name || ',b' ELSE '' END AS creators, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS n_rights, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS owner FROM last"""
)
def volumes_by_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("barcode", "c_name", F.array_join("creators", ",").alias("creators"), F.size("rights").alias("n_rights"), F.try_element_at("rights", F.lit("by")).alias("owner"))


@query(_VOLUMES + "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS barcode, c_name FROM supplier LEFT JOIN last ON last.barcode = CAST(s_nationkey AS VARCHAR)")
def page_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("barcode"))
    return catalog.with_volumes(pages, _volumes(spark, sf_dir)).select("s_suppkey", "barcode", "c_name")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as results of models on pages."""
    summary = F.concat(F.lit('{"text": {"summary": {"similarity": '), F.col("turn") * 10, F.lit(', "cer": '), F.col("turn") / 8, F.lit(', "why": "x"}}}'))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("file_id"), F.concat(F.lit("p"), "conv_id").alias("page_id"), F.concat(F.lit("m"), "turn").alias("model"), "text",
        F.when(F.col("turn") % 3 == 2, "failed").alias("error"), F.when(F.col("turn") > 0, F.concat(F.lit("b"), F.col("conv_id") % 7)).alias("barcode"), F.when(F.col("turn") > 1, F.col("conv_id")).alias("sequence"),
        F.lit("").alias("source_uri"), F.when(F.col("turn") == 1, F.col("text")).alias("reference_text"), F.create_map(F.lit("text_length"), F.length("text").cast("string")).alias("metrics"),
        F.when(F.col("turn") != 3, summary).otherwise("{broken").alias("comparisons_json"), "turn", "conv_id",
    )


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return stats.page_view(rows, text.disagreement(rows, "file_id", "model", "text")).withColumn("disagreement", F.round("disagreement", 9))


_VIEW = (
    _TOKENS
    + """, w AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, conv_id, turn, 'm' || turn AS model, text, turn % 3 = 2 AS bad FROM conversations),
v AS (SELECT file_id, any_value(conv_id) AS ord, 'p' || file_id AS page_id, CASE WHEN max(turn) > 0 THEN 'b' || (any_value(conv_id) % 7) END AS barcode, CASE WHEN max(turn) > 1 THEN any_value(conv_id) END AS sequence,
  string_agg(model, ',' ORDER BY model) AS models, coalesce(string_agg(model, ',' ORDER BY model) FILTER (bad), '') AS error_models, count(*) FILTER (bad) AS n_errors, coalesce(bool_or(text <> '') FILTER (turn = 1), false) AS has_reference,
  max(length(text)) AS char_count, min(turn / 8) FILTER (turn <> 3) AS best_cer, max(turn * 10.0) FILTER (turn <> 3) AS best_similarity FROM w GROUP BY file_id),
i AS (SELECT v.*, round(coalesce(d.disagreement, 0.0), 9) AS disagreement, d.n_models FROM v LEFT JOIN d ON d.page = v.file_id) """
)


@query(_VIEW + "SELECT file_id, page_id, barcode, sequence, models, error_models, has_reference, char_count, disagreement, n_models, CAST(best_cer AS DOUBLE) AS best_cer, CAST(best_similarity AS DOUBLE) AS best_similarity FROM i")
def page_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda k: F.try_element_at("best", F.lit(k)).alias(f"best_{k.split('_')[1]}")
    return _view(spark, sf_dir).select(
        "file_id", "page_id", "barcode", "sequence", F.array_join("models", ",").alias("models"), F.array_join("error_models", ",").alias("error_models"), F.coalesce("has_reference", F.lit(False)).alias("has_reference"),
        "char_count", "disagreement", "n_models", best("text_cer"), best("text_similarity"),
    )


_ORDERS = {"file_id": "file_id", "chars": "char_count DESC, file_id", "errors": "n_errors DESC, file_id", "disagreement": "disagreement DESC, file_id", "parquet": "ord, file_id"}


@query(_VIEW + " UNION ALL ".join(f"(SELECT '{by}' AS sorting, file_id FROM i ORDER BY {keys} LIMIT 20)" for by, keys in _ORDERS.items()))
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pages in each order that a list of pages has."""
    index = durable(_view(spark, sf_dir).withColumn("ord", F.col("file_id").cast("bigint")))  # worked out once for all orders
    parts = [stats.ordered_pages(index, by).limit(20).select(F.lit(by).alias("sorting"), "file_id") for by in _ORDERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("SELECT CAST(conv_id AS VARCHAR) AS file_id, 'm' || turn AS model, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN CAST(conv_id AS VARCHAR) ELSE '' END AS shown_file_id FROM conversations")
def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.page_table(_rows(spark, sf_dir)).select("file_id", "model", "shown_file_id")


@query("SELECT p_brand AS label, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_brand")
def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.legend(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("SELECT model, CASE WHEN bad THEN 'failed' END AS error FROM (SELECT 'm' || turn AS model, turn % 3 = 2 AS bad FROM conversations)")
def stat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stat_columns(_rows(spark, sf_dir)).drop("metrics")


@query("SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS Count FROM orders GROUP BY ALL ORDER BY Count DESC, a, b LIMIT 8")
def rights_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return catalog.by_count(catalog.rights_combinations(rows, ("a", "b"))).limit(8).drop("rights_json")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS c_name FROM customer")
def rights_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in folders of different depths, one of them with a column more, read as one table."""
    root, rows = f"{shared_folder(spark)}/shards-{os.urandom(6).hex()}", table(spark, sf_dir, "customer")
    for at, folder in enumerate(("", "/a", "/a/b")):
        own = rows.filter(F.col("c_custkey") % 3 == at).select("c_custkey", "c_mktsegment", *(["c_name"] if at == 0 else []))
        own.write.parquet(f"{root}{folder}/part{at}")
    return catalog.read_shards(spark, root).select("c_custkey", "c_mktsegment", "c_name")


@query("SELECT CAST(conv_id AS VARCHAR) AS file_id, 'm' || turn AS model FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def found_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    wanted = rows.agg(F.min("conv_id")).first()[0]
    return stats.find_page(rows, f"p{wanted}").select("file_id", "model")


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS pages_ok, CAST(sum(l_linenumber) AS BIGINT) AS pages_failed, CAST(max(l_discount) AS DOUBLE) AS gpu_peak_mb, round(sum(l_quantity) * 3600 / sum(l_linenumber), 6) AS pages_per_hour FROM lineitem")
def merged_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("pages_ok"), F.col("l_linenumber").alias("pages_failed"), F.lit(1).cast("bigint").alias("tokens"), F.col("l_discount").cast("double").alias("gpu_peak_mb"), F.col("l_linenumber").cast("double").alias("seconds"))
    return stats.merged_metrics(parts).select(F.col("tokens").alias("n"), "pages_ok", F.col("pages_failed").cast("bigint").alias("pages_failed"), "gpu_peak_mb", F.round("pages_per_hour", 6).alias("pages_per_hour"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE CAST(p_size + p_partkey AS DOUBLE) / 2 END AS score FROM part")
def canonical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.create_map().cast("map<string, double>")
    summary = F.when(F.col("p_size") % 5 == 0, none).otherwise(F.create_map(F.lit("a"), F.col("p_size").cast("double"), F.lit("b"), F.col("p_partkey").cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", stats.canonical_score(summary).alias("score"))


_RULES = "CASE c_custkey % 4 WHEN 0 THEN 'public_domain' WHEN 1 THEN 'licensed' WHEN 2 THEN 'in_copyright' END"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, "No known copyright restrictions").when(k == 1, "Licensed under CC BY").when(k == 2, "All rights reserved").otherwise("-")
    return catalog.classified(table(spark, sf_dir, "customer").select("c_custkey", said.alias("rights_json")))


@query(f"SELECT c_custkey, {_RULES} AS classification, c_custkey % 4 <> 3 AS parsing_success FROM customer")
def rights_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("c_custkey", "classification", "parsing_success")


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 4 <> 3) AS parsed FROM customer")
def parsed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parsed_share(_verdicts(spark, sf_dir))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS number, CASE WHEN o_orderkey % 2 = 0 THEN CAST(strftime(o_orderdate, '%Y') AS INTEGER) END AS year FROM orders")
def catalog_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and years in the texts of a catalog, and what isn't one."""
    k = F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(k % 3 == 1, "\\N").otherwise("")
    dated = F.when(k % 2 == 0, F.concat(F.lit("c. "), F.year("o_orderdate"), F.lit("-05"))).otherwise("n.d.")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("w"), dated.alias("d"))
    return rows.select("o_orderkey", catalog.number_in("w").alias("number"), catalog.year_in("d").alias("year"))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', CAST(s AS DOUBLE)) WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dh%02dm', s // 3600, s % 3600 // 60) END AS shown
FROM (SELECT event_id, CAST(event_id * 37 % 9000 AS BIGINT) AS s FROM events)"""
)
def human_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.human_duration((F.col("event_id") * 37 % 9000).cast("double")).alias("shown"))


@query("SELECT s_suppkey, 'a=' || s_name AS inside, 'c=' || s_nationkey AS rest FROM supplier")
def allowed_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = F.create_map(F.lit("a"), "s_name", F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.col("s_nationkey").cast("string"))
    shown = lambda m, name: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(name)
    inside, rest = scalars.allowed(args, ["a", "b"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", shown(inside, "inside"), shown(rest, "rest"))


@query("SELECT p_partkey, p_size % 2 = 0 AS has_layout FROM part")
def layout_capable(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(*[F.lit(float(i)).alias(c) for i, c in enumerate("ltrb")])
    items = F.array(F.struct(F.when(F.col("p_size") % 2 == 0, box).alias("bbox")), F.struct(F.lit(None).cast("struct<l: double, t: double, r: double, b: double>").alias("bbox")))
    return table(spark, sf_dir, "part").select("p_partkey", documents.has_layout(F.struct(items.alias("items"))).alias("has_layout"))


@query(
    """SELECT page_id FROM (SELECT CAST(c_custkey AS VARCHAR) AS page_id, c_custkey % 4 AS k, c_custkey % 6 AS done FROM customer ORDER BY page_id LIMIT 100) WHERE k > 1 AND done <> 0"""
)
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pages, those with a link and not yet there."""
    sampling.check_sizes(100, 10, 10)
    k = F.col("c_custkey") % 4
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("page_id"), F.when(k > 1, "u").when(k == 1, "").alias("source_uri"))
    done = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 6 == 0).select(F.col("c_custkey").cast("string").alias("page_id"))
    return pipeline.sample(pages, done, 100).select("page_id")
