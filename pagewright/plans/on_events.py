"""Cost and statistics queries: events stand for requests and result rows, documents for pages by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import costs, stats
from pagewright.plans.named import query, table
from pagewright.sources import artifacts


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows from events, with nulls, zeros and empty texts where the roll-ups have to mind them."""
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), F.lpad((e % 700).cast("string"), 4, "0")).alias("file_id"), F.concat(F.lit("p"), e % 700).alias("page_id"), F.col("event_type").alias("model"), e.alias("event_id"),
        F.concat(F.lit("gpu"), F.col("user_id") % 3).alias("gpu_type"), F.when(F.col("user_id") % 4 == 0, "local").otherwise("cloud").alias("provider"), F.concat(F.lit("b"), F.col("user_id") % 10).alias("barcode"),
        F.when(e % 5 != 0, v).alias("elapsed_seconds"), (e % 97).alias("input_tokens"), F.when(e % 3 != 0, e % 89).alias("output_tokens"), F.when(e % 4 != 0, F.round(v / 100, 4)).alias("litellm_cost"),
        F.when(e % 6 != 0, F.round(v / 50, 4)).alias("gpu_time_cost"), F.when(e % 7 == 0, "failed").when(e % 7 == 1, "").alias("error"), F.when(e % 11 != 0, e % 13).alias("tokens"),
        F.when(e % 2 == 0, "markdown").when(e % 2 == 1, "layout_json").alias("output_format"), F.when(e % 9 != 0, F.lit(1.25)).alias("cost_per_hour"), (e % 2 * 4).alias("concurrent_requests"), (e % 3 * 8).alias("region_concurrency"),
        F.when(e % 10 == 0, F.lit("{broken")).otherwise(F.format_string('{"text_length": %d, "run_seconds_total": %d, "item_count": %d}', e % 1000, e % 333, e % 17)).alias("metrics_json"),
        F.when(e % 4 == 0, F.lit("reference")).otherwise(F.lit("")).alias("reference_text"), F.when(e % 3 == 0, e % 50).alias("sequence"), F.when(e % 2 == 0, F.concat(F.lit("s3://x/"), e % 700)).alias("source_uri"), (e % 5 * 1000).alias("kv_cache_memory_bytes"),
    )


_RESULTS = """
WITH t AS (SELECT 'f' || lpad(CAST(event_id % 700 AS VARCHAR), 4, '0') AS file_id, 'p' || (event_id % 700) AS page_id, event_type AS model, event_id, 'gpu' || (user_id % 3) AS gpu_type,
  CASE WHEN user_id % 4 = 0 THEN 'local' ELSE 'cloud' END AS provider, 'b' || (user_id % 10) AS barcode, CASE WHEN event_id % 5 <> 0 THEN value END AS elapsed_seconds, event_id % 97 AS input_tokens,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 89 END AS output_tokens, CASE WHEN event_id % 4 <> 0 THEN round(value / 100, 4) END AS litellm_cost, CASE WHEN event_id % 6 <> 0 THEN round(value / 50, 4) END AS gpu_time_cost,
  CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 7 = 1 THEN '' END AS error, CASE WHEN event_id % 11 <> 0 THEN event_id % 13 END AS tokens, CASE WHEN event_id % 2 = 0 THEN 'markdown' ELSE 'layout_json' END AS output_format,
  CASE WHEN event_id % 9 <> 0 THEN 1.25::DOUBLE END AS cost_per_hour, event_id % 2 * 4 AS concurrent_requests, event_id % 3 * 8 AS region_concurrency, CASE WHEN event_id % 10 <> 0 THEN event_id % 1000 END AS text_length,
  CASE WHEN event_id % 10 <> 0 THEN event_id % 333 END AS run_seconds_total, CASE WHEN event_id % 10 <> 0 THEN event_id % 17 END AS item_count, CASE WHEN event_id % 4 = 0 THEN 'reference' ELSE '' END AS reference_text,
  CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS sequence, CASE WHEN event_id % 2 = 0 THEN 's3://x/' || (event_id % 700) END AS source_uri, event_id % 5 * 1000 AS kv_cache_memory_bytes FROM events)
"""
_COSTS = """count(*) AS pages, round(sum(coalesce(elapsed_seconds, 0)), 4) AS gpu_seconds, round(avg(elapsed_seconds), 6) AS avg_seconds, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS tokens_in,
  CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS tokens_out, round(sum(coalesce(litellm_cost, 0)), 4) AS token_cost, round(sum(coalesce(gpu_time_cost, 0)), 4) AS infra_cost FROM t"""


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _cost_query(spark: SparkSession, sf_dir: str, *keys: str, tokens: bool = True) -> DataFrame:
    return _rounded(stats.cost_rollup(_results(spark, sf_dir), *keys, tokens=tokens), gpu_seconds=4, avg_seconds=6, token_cost=4, infra_cost=4)


@query(_RESULTS + "SELECT model, " + _COSTS + " GROUP BY model")
def costs_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cost_query(spark, sf_dir, "model")


@query(_RESULTS + "SELECT gpu_type, provider, " + _COSTS + " GROUP BY gpu_type, provider")
def costs_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cost_query(spark, sf_dir, "gpu_type", "provider")


@query(_RESULTS + "SELECT model, pages, gpu_seconds, avg_seconds, token_cost, infra_cost FROM (SELECT model, " + _COSTS + " GROUP BY model)")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cost_query(spark, sf_dir, "model", tokens=False)


@query(_RESULTS + "SELECT count(*) AS pages_done, round(sum(coalesce(litellm_cost, 0) + coalesce(gpu_time_cost, 0)), 4) AS cumulative_cost FROM t")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(costs.status(_results(spark, sf_dir)), cumulative_cost=4)


@query(
    _RESULTS
    + """SELECT CASE WHEN model = 'view' THEN '?' ELSE model END AS model, arg_min(output_format, event_id) AS output_format, count(*) FILTER (coalesce(error, '') = '') AS pages_ok, count(*) FILTER (coalesce(error, '') <> '') AS pages_errored,
  CAST(sum(coalesce(tokens, 0)) FILTER (coalesce(error, '') = '') AS BIGINT) AS total_tokens, round(avg(tokens) FILTER (coalesce(error, '') = '' AND tokens <> 0), 6) AS mean_tokens,
  round(avg(text_length) FILTER (coalesce(error, '') = ''), 6) AS mean_text_length, round(avg(item_count) FILTER (coalesce(error, '') = ''), 6) AS mean_item_count FROM t GROUP BY 1"""
)
def per_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.with_defaults(_results(spark, sf_dir)).withColumn("model", F.when(F.col("model") == "view", F.when(F.col("event_id") % 2 == 0, "")).otherwise(F.col("model")))
    return _rounded(stats.per_model(rows, ("text_length", "item_count"), ("event_id",)), mean_tokens=6, mean_text_length=6, mean_item_count=6)


@query(
    _RESULTS
    + """SELECT model, count(*) FILTER (coalesce(error, '') = '') AS succeeded, count(*) FILTER (coalesce(error, '') <> '') AS failed, CAST(max(run_seconds_total) AS DOUBLE) AS total, round(max(run_seconds_total) / count(*), 9) AS avg,
  arg_min(gpu_type, event_id) FILTER (gpu_type <> 'unknown') AS gpu_type, arg_min(provider, event_id) FILTER (provider <> 'local') AS provider, arg_min(cost_per_hour, event_id) FILTER (cost_per_hour <> 0) AS cost_per_hour,
  arg_min(coalesce(nullif(concurrent_requests, 0), nullif(region_concurrency, 0)), event_id) FILTER (coalesce(nullif(concurrent_requests, 0), nullif(region_concurrency, 0)) IS NOT NULL) AS concurrency,
  arg_min(kv_cache_memory_bytes, event_id) FILTER (kv_cache_memory_bytes <> 0) AS kv_bytes, round(max(run_seconds_total) / 3600 * 1.25, 9) AS est_cost FROM t GROUP BY model"""
)
def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.run_aggregate(artifacts.with_defaults(_results(spark, sf_dir)), ("event_id",)), avg=9, est_cost=9)


@query(
    _RESULTS
    + """, one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY file_id, model ORDER BY event_id) = 1)
SELECT file_id, arg_min(page_id, model) AS page_id, arg_min(barcode, model) AS barcode, arg_min(sequence, model) FILTER (sequence IS NOT NULL) AS sequence, arg_min(source_uri, model) FILTER (source_uri IS NOT NULL) AS source_uri,
  string_agg(model, ',' ORDER BY model) AS models, coalesce(string_agg(model, ',' ORDER BY model) FILTER (coalesce(error, '') <> ''), '') AS error_models, bool_or(reference_text <> '') AS has_reference, coalesce(max(text_length), 0) AS char_count
FROM one GROUP BY file_id"""
)
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.last_by(_results(spark, sf_dir).withColumn("first", -F.col("event_id")), ["file_id", "model"], ["first"])
    out = stats.page_index(artifacts.with_defaults(rows))
    return out.withColumn("models", F.array_join("models", ",")).withColumn("error_models", F.array_join("error_models", ","))


@query(_RESULTS + "SELECT model, CASE WHEN coalesce(error, '') <> '' THEN 'failed' ELSE 'written' END AS status, count(*) AS n FROM t GROUP BY 1, 2 UNION ALL SELECT NULL, CASE WHEN coalesce(error, '') <> '' THEN 'failed' ELSE 'written' END, count(*) FROM t GROUP BY 2")
def stage_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("status", F.when(stats.failed(), "failed").otherwise("written"))
    return stats.stage_tally(rows).select("model", "status", "n")


@query(
    """WITH r AS (SELECT user_id, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value - 20 AS end_s, event_id, value FROM events WHERE event_id % 8 <> 0),
c AS (SELECT CAST(user_id AS VARCHAR) AS page_id, round(sum(round(value / 1000, 5)), 5) AS cost, CAST(sum(event_id % 100) AS BIGINT) AS tokens_in, CAST(sum(event_id % 70) AS BIGINT) AS tokens_out, count(*) AS n_requests, greatest(0.0, max(end_s) - min(start_s)) AS e FROM r GROUP BY 1)
SELECT page_id, cost, tokens_in, tokens_out, n_requests, round(e, 3) AS elapsed_seconds, round(e / 3600 * 4.45, 4) AS gpu_time_cost FROM c"""
)
def page_request_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = scalars.epoch_seconds(F.col("ts"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("page_id"), F.round(F.col("value") / 1000, 5).alias("cost"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out"),
        start.alias("start_s"), F.when(F.col("event_id") % 8 != 0, start + F.col("value") - 20).alias("end_s"),
    )
    out = costs.page_costs(rows).withColumn("gpu_time_cost", costs.gpu_time_cost(F.col("elapsed_seconds"), F.lit(4.45)))
    return _rounded(out, cost=5, elapsed_seconds=3, gpu_time_cost=4)


_JSON = """'{"text": {"comparison": "text", "summary": {"similarity": ' || (event_id % 100) || ', "cer": ' || (event_id % 37) / 10.0 || CASE WHEN event_id % 3 = 0 THEN ', "wer": "high"' ELSE ', "wer": ' || (event_id % 41) / 10.0 END || '}}, "layout": {"summary": {"iou_mean": 0.' || (event_id % 9) || '}}}'"""


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    wer = F.when(e % 3 == 0, F.lit(', "wer": "high"')).otherwise(F.format_string(', "wer": %.1f', (e % 41) / 10))
    text = F.concat(F.format_string('{"text": {"comparison": "text", "summary": {"similarity": %d, "cer": %.1f', e % 100, (e % 37) / 10), wer, F.format_string('}}, "layout": {"summary": {"iou_mean": 0.%d}}}', e % 9))
    return table(spark, sf_dir, "events").select(e.alias("event_id"), F.col("user_id").cast("string").alias("file_id"), F.when(e % 10 == 0, "{broken").otherwise(text).alias("comparisons_json"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS page, event_id AS i FROM events WHERE event_id % 10 <> 0)
SELECT page, 'text_similarity' AS key, CAST(max(i % 100) AS DOUBLE) AS value FROM e GROUP BY 1 UNION ALL SELECT page, 'text_cer', min((i % 37) / 10.0) FROM e GROUP BY 1
UNION ALL SELECT page, 'text_wer', min((i % 41) / 10.0) FROM e WHERE i % 3 <> 0 GROUP BY 1 UNION ALL SELECT page, 'layout_iou_mean', max((i % 9) / 10.0) FROM e GROUP BY 1"""
)
def best_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.best_agreement(_envelopes(spark, sf_dir))


@query(
    """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS text_similarity, CASE WHEN event_id % 10 <> 0 THEN (event_id % 37) / 10.0 END AS text_cer,
 CASE WHEN event_id % 10 <> 0 AND event_id % 3 <> 0 THEN (event_id % 41) / 10.0 END AS text_wer, CAST(NULL AS BIGINT) AS document_heading_count_delta, CASE WHEN event_id % 10 <> 0 THEN (event_id % 9) / 10.0 END AS layout_iou_mean FROM events"""
)
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.operators.comparison import flattened

    return flattened(_envelopes(spark, sf_dir)).select("event_id", "text_similarity", "text_cer", "text_wer", "document_heading_count_delta", "layout_iou_mean")


@query(
    """SELECT k AS key, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT 'value' AS k, value AS v FROM events UNION ALL SELECT event_type, CAST(event_id % 10 AS DOUBLE) FROM events) GROUP BY k"""
)
def summary_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.create_map(F.lit("value"), F.col("value"), F.col("event_type"), (F.col("event_id") % 10).cast("double")).alias("summary"))
    return _rounded(stats.summary_means(rows), mean=6)


@query("SELECT user_id, event_id, coalesce(lag(event_id) OVER w, event_id) AS previous, coalesce(lead(event_id) OVER w, event_id) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def page_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.steps(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS shown FROM orders")
def blank_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_custkey").cast("string").alias("file_id"))
    return stats.blank_repeats(rows, "file_id", ("o_orderkey",)).select("o_custkey", "o_orderkey", F.col("shown_file_id").alias("shown"))


@query("SELECT c_custkey, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' WHEN n < 1000000 THEN '100K<n<1M' WHEN n < 10000000 THEN '1M<n<10M' ELSE 'n>10M' END AS bucket FROM (SELECT c_custkey, c_custkey * c_custkey * 7 AS n FROM customer)")
def size_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.size_bucket(F.col("c_custkey") * F.col("c_custkey") * 7).alias("bucket"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1073741824 END AS bytes, CASE p_size % 3 WHEN 0 THEN p_size * 1000000000 WHEN 1 THEN p_size * 1000000 ELSE p_size * 1000000000 END AS parameters FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)"""
)
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(size, F.when(size % 4 == 0, "KB").when(size % 4 == 1, "k").when(size % 4 == 2, " G").otherwise(" many")).alias("a"), F.concat(size, F.when(size % 3 == 0, "B").when(size % 3 == 1, "m").otherwise("")).alias("b"))
    return rows.select("p_partkey", scalars.byte_count(F.col("a")).alias("bytes"), scalars.parameter_count(F.col("b")).alias("parameters"))
