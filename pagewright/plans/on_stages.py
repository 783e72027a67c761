"""Stage queries: what is left to do, answers and failures of a model, pages put together from regions, isolated comparisons, costs, image headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import scalars
from pagewright.operators import comparison
from pagewright.plans import inference, pipeline
from pagewright.plans.named import query, table
from pagewright.sources import artifacts, files, images


@query(
    """WITH p AS (SELECT p_partkey, 'store/' || p_name || CASE p_partkey % 9 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JP2' WHEN 2 THEN '.tiff' WHEN 3 THEN '.txt' WHEN 4 THEN '' WHEN 5 THEN '.png.gz' WHEN 6 THEN '.J2K' WHEN 7 THEN '.WebP' ELSE '.jpx' END AS path FROM part)
SELECT p_partkey, path FROM p WHERE p_partkey % 9 NOT IN (3, 4, 5)"""
)
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; those that are images by their extension, in any case."""
    ends = F.array(*map(F.lit, (".jpg", ".JP2", ".tiff", ".txt", "", ".png.gz", ".J2K", ".WebP", ".jpx")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("store/"), "p_name", F.element_at(ends, (F.col("p_partkey") % 9 + 1).cast("int"))).alias("path"))
    return rows.filter(scalars.is_image(F.col("path")))


@query(
    """SELECT 'p' || o_orderkey AS page_id, model, output_format FROM orders, (VALUES ('a', 'markdown'), ('b', 'layout_json')) AS m(model, output_format)
WHERE NOT (model = 'a' AND o_orderkey % 3 = 0) AND NOT (model = 'b' AND o_orderkey % 7 = 1)"""
)
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages, each by two models, without what is done; done rows with a null key say nothing."""
    key = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), key).alias("page_id"), key)
    done = pages.select("page_id", F.explode(F.array(F.when(key % 3 == 0, "a"), F.when(key % 7 == 1, "b"))).alias("model"))
    return artifacts.unseen(pipeline._by_model(pages, [("a", "markdown"), ("b", "layout_json")]), done, "page_model").select("page_id", "model", "output_format")


@query(
    """WITH pages AS (SELECT 'u' || c_custkey AS page_id FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT 'u' || user_id AS page_id, round(value / 100, 4) AS cost, event_id % 50 AS tin, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + event_id % 9 AS e FROM events WHERE event_id % 10 <> 0)
SELECT page_id, round(sum(cost), 6) AS litellm_cost, CAST(sum(tin) AS BIGINT) AS input_tokens, round(max(e) - min(s), 3) AS elapsed_seconds, round((max(e) - min(s)) / 3600 * 0.8925, 6) AS gpu_time_cost FROM pages LEFT JOIN r USING (page_id) GROUP BY page_id"""
)
def request_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, events as requests: unknown pages and requests without times don't count, pages without requests have no costs."""
    start, e = scalars.epoch_seconds(F.col("ts")), F.col("event_id")
    requests = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("page_id"), F.lit("m").alias("model"), F.round(F.col("value") / 100, 4).alias("cost"), (e % 50).alias("tokens_in"), (e % 3).alias("tokens_out"),
        F.when(e % 10 != 0, start).alias("start_s"), (start + e % 9).alias("end_s"),
    )
    pages = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("page_id"), F.lit("m").alias("model"))
    out = pipeline.with_costs(pages, requests, "L4")
    return out.select("page_id", F.round("litellm_cost", 6).alias("litellm_cost"), "input_tokens", F.round("elapsed_seconds", 3).alias("elapsed_seconds"), F.round("gpu_time_cost", 6).alias("gpu_time_cost"))


@query(
    """WITH last AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY user_id)
SELECT 'u' || c_custkey AS page_id, CAST(coalesce(e % 4, 0) AS INTEGER) AS n_regions, CASE WHEN e % 4 > 0 THEN 'kind ' || (e % 5) END AS category, CASE WHEN e % 4 > 0 THEN CAST(e % 100 AS DOUBLE) END AS left_edge FROM customer LEFT JOIN last ON user_id = c_custkey"""
)
def precomputed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections of customers' pages: the last one counts, entries that aren't regions are passed over one by one."""
    e = F.col("event_id")
    good = F.format_string('{"category": "kind %d", "bbox": [%d, 0, 200, 10], "score": 0.5}', e % 5, e % 100)
    bad = F.lit('{"category": "no box"}, {"bbox": [1, 2, 3, 4]}, {"category": "short", "bbox": [1, 2]}, 7')
    detections = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("page_id"), e, F.concat(F.lit("["), F.concat_ws(", ", bad, F.array_repeat(good, (e % 4).cast("int"))), F.lit("]")).alias("regions_json"))
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("page_id"))
    first = F.try_element_at("regions", F.lit(1))
    return files.precomputed_regions(pages, detections, ["event_id"]).select("page_id", F.size("regions").alias("n_regions"), first["category"].alias("category"), first["bbox"]["l"].alias("left_edge"))


def _answer(row: dict) -> tuple[str, int]:
    """Stands for a model: some pages have no answer however often it is asked."""
    if row["doc_id"] % 7 == 0:
        raise ValueError(f"page {row['doc_id']} is blank")
    return f"{row['lang']} {row['doc_id']}", row["doc_id"] % 100


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ' ' || doc_id END AS raw_payload, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 100 END AS tokens, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: page ' || doc_id || ' is blank' END AS error FROM documents"""
)
def answered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once, answered or with the error of its last attempt."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return inference.answered(pages, _answer, ("doc_id", "lang"), inference.Limits(in_flight=16, retries=1, backoff=0.0)).select("doc_id", "raw_payload", "tokens", "error")


@query(
    """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'no memory' END AS failed, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [NULL] ELSE range(o_orderkey % 4) END) AS slot FROM orders),
b AS (SELECT k, failed, slot, slot IS NOT NULL AND (k + slot) % 3 = 0 AS missing, slot IS NOT NULL AND (k + slot) % 3 <> 0 AND (k + slot) % 4 = 0 AS bad FROM s)
SELECT 'p' || k AS page_id, CASE WHEN failed IS NOT NULL THEN 'layout detector failed: ' || failed END AS error, CAST(CASE WHEN failed IS NULL THEN count(slot) ELSE 0 END AS INTEGER) AS n_blocks,
  CAST(CASE WHEN failed IS NULL THEN count(*) FILTER (missing OR bad) ELSE 0 END AS INTEGER) AS n_failed, CASE WHEN failed IS NULL THEN coalesce(string_agg(CASE WHEN missing OR bad THEN '' ELSE 'text ' || slot END, '|' ORDER BY slot) FILTER (slot IS NOT NULL), '') ELSE '' END AS texts
FROM b GROUP BY k, failed"""
)
def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of up to three regions; some slots get no answer, some a failed one, some detectors fail."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), k).alias("page_id"), k, F.when(k % 5 == 0, "no memory").alias("detect_error"))
    at = F.sequence(F.lit(0), F.greatest(k % 4, F.lit(1)).cast("int") - 1)
    region = lambda i: F.struct(i.cast("bigint").alias("id"), F.lit("Text").alias("category"), F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("ltrb", (0, 0, 9, 9), strict=True)]).alias("bbox")).cast("struct<id: bigint, category: string, bbox: struct<l: double, t: double, r: double, b: double>>")
    pages = rows.withColumn("regions", F.when(k % 4 > 0, F.from_json(F.to_json(F.transform(at, region)), f"array<{schemas.REGION}>")))
    said = rows.filter(k % 4 > 0).select("page_id", k, F.explode(at).alias("at")).filter((k + F.col("at")) % 3 != 0)
    bad = (k + F.col("at")) % 4 == 0
    said = said.select("page_id", "at", F.when(~bad, F.concat(F.lit("text "), "at")).otherwise("").alias("raw_payload"), F.lit(1).cast("bigint").alias("tokens"), F.when(bad, "TimeoutError").alias("error"))
    blocks = F.coalesce(F.from_json("raw_payload", "array<struct<text: string, error: string>>"), F.array().cast("array<struct<text: string, error: string>>"))
    return pipeline.assembled(pages, said, "m").select(
        "page_id", "error", F.size(blocks).alias("n_blocks"), F.size(F.filter(blocks, lambda b: b["error"].isNotNull())).alias("n_failed"), F.array_join(F.transform(blocks, lambda b: b["text"]), "|").alias("texts")
    )


def _lengths(pred: str | None, base: str | None) -> dict | None:
    """A comparison that can't cope with some texts."""
    if pred is None or base is None:
        return None
    if len(pred) % 5 == 0:
        raise ArithmeticError(f"{len(pred)} characters")
    return {"longer": len(pred) - len(base)}


@query(
    """SELECT x.conv_id, x.turn, CASE WHEN length(y.text) % 5 <> 0 THEN CAST(length(y.text) - length(x.text) AS DOUBLE) END AS longer, CASE WHEN length(y.text) % 5 = 0 THEN 'ArithmeticError: ' || length(y.text) || ' characters' END AS error
FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1"""
)
def isolated_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn compared with the next one by a function that raises for some: those rows have its error, and the job goes on."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("reference_text"))
    pairs = a.join(a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("reference_text").alias("text")), ["conv_id", "turn"])
    held = F.col("comparisons.lengths")
    return comparison.compare(pairs, (), base_doc=None, extra={"lengths": _lengths}).select("conv_id", "turn", F.try_element_at(held["summary"], F.lit("longer")).alias("longer"), held["error"].alias("error"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 6 <> 5 THEN 'png' END AS format, CASE WHEN p_partkey % 6 < 4 THEN p_partkey % 5000 + 1 END AS width, CASE WHEN p_partkey % 6 < 4 THEN CAST(p_size AS BIGINT) END AS height,
  CASE WHEN p_partkey % 6 < 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END END AS channels, CASE p_partkey % 6 WHEN 4 THEN 'the file ends within its header' WHEN 5 THEN 'not an image of a known format' END AS error FROM part"""
)
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as image files, some of them cut off or no images: what their headers tell."""
    key, number = F.col("p_partkey"), lambda x: F.lpad(F.hex(x.cast("bigint")), 8, "0")
    whole = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(key % 5000 + 1), number(F.col("p_size")), F.when(key % 2 == 0, "0802000000").otherwise("0806000000"))
    content = F.unhex(F.when(key % 6 == 5, F.lit("00112233445566")).when(key % 6 == 4, F.substring(whole, 1, 40)).otherwise(whole))
    return table(spark, sf_dir, "part").select("p_partkey", images.headers(content).alias("h")).select("p_partkey", "h.*")
