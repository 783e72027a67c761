"""Catalog and sampling queries: orders stand for volumes, line items for pages, customers for titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators import costs, sampling
from pagewright.plans.named import query, table
from pagewright.sources import artifacts, catalog


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_custkey").cast("string").alias("title_id"), F.concat(F.lit("B"), "o_orderkey").alias("barcode"),
        F.col("o_orderpriority").alias("rights"), F.col("o_orderstatus").alias("language"), F.year("o_orderdate").alias("year"),
        F.concat(F.lit("Title "), "o_custkey").alias("title"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit(" Author "), "o_custkey")).otherwise(" ").alias("author"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("page_id"), F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").cast("bigint").alias("sequence"), "l_partkey", "l_suppkey", "l_extendedprice"
    )


_TIES = ("l_partkey", "l_suppkey", "l_extendedprice")
_SAMPLE = """
WITH volumes AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id, CAST(o_custkey AS VARCHAR) AS title_id, 'B' || o_orderkey AS barcode, o_orderpriority AS rights, o_orderstatus AS language,
         year(o_orderdate) AS year, 'Title ' || o_custkey AS title, CASE WHEN o_custkey % 3 > 0 THEN ' Author ' || o_custkey ELSE ' ' END AS author FROM orders),
pages AS (
  SELECT l_orderkey || '-' || l_linenumber AS page_id, CAST(l_orderkey AS VARCHAR) AS item_id, CAST(l_linenumber AS BIGINT) AS sequence, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
eligible AS (
  SELECT * FROM volumes WHERE rights = '2-HIGH' AND language IN ('O', 'F') AND year BETWEEN 1996 AND 1999
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY title_id NULLS LAST, barcode NULLS LAST) = 1),
joined AS (SELECT p.*, e.* EXCLUDE (item_id) FROM pages p JOIN eligible e USING (item_id)),
pool AS (SELECT item_id, md5(item_id || '42') AS vkey FROM (SELECT DISTINCT item_id FROM joined) ORDER BY vkey, item_id LIMIT 60),
ranked AS (
  SELECT j.*, vkey, row_number() OVER (PARTITION BY item_id ORDER BY md5(page_id || '42'), page_id, l_partkey, l_suppkey, l_extendedprice) AS prank
  FROM joined j JOIN pool USING (item_id)),
final AS (
  SELECT * FROM ranked WHERE prank <= 3
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY vkey, item_id, prank) = 1 ORDER BY vkey, item_id, prank LIMIT 120)
"""


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(
        _volumes(spark, sf_dir), _pages(spark, sf_dir), sample=120, volumes_n=60, pages_per_volume=3, rights="2-HIGH", languages=["o", "F"], year_range=(1996, 1999), ties=_TIES
    )


@query(_SAMPLE + "SELECT item_id, page_id, sequence, l_partkey, title_id, vkey, CAST(prank AS INTEGER) AS prank FROM final")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).select("item_id", "page_id", "sequence", "l_partkey", "title_id", "vkey", "prank")


@query(
    _SAMPLE
    + """SELECT barcode, title, nullif(trim(author), '') AS creator, language, year, rights, n AS page_count, 'https://example.org/item/' || item_id AS source_uri
FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM final QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY prank) = 1)"""
)
def sample_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.sampled_volumes(_sample(spark, sf_dir))
    return out.select("barcode", "title", F.try_element_at("creators", F.lit(1)).alias("creator"), "language", F.col("year").cast("bigint").alias("year"), "rights", "page_count", "source_uri")


def _rights_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with rights columns in which null and '' both occur."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("ItemID"), F.col("p_partkey").cast("string").alias("TitleID"), F.concat(F.lit("B"), "p_partkey").alias("BarCode"),
        F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, F.lit("")).otherwise(F.col("p_type")).alias("CopyrightStatus"),
        F.when(size % 7 == 0, F.lit("")).otherwise(F.lit("stated")).alias("RightsStatement"), F.when(size % 2 == 0, F.col("p_brand")).alias("LicenseType"), F.lit(None).cast("string").alias("RightsHolder"),
        F.when(size % 3 == 0, F.concat(F.lit("v.1 "), 1800 + size, F.lit("-90"))).when(size % 3 == 1, (1800 + size).cast("string")).otherwise("none").alias("Year"),
    )


_ITEMS = """
WITH items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ItemID, CAST(p_partkey AS VARCHAR) AS TitleID, 'B' || p_partkey AS BarCode,
         CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE p_type END AS CopyrightStatus,
         CASE WHEN p_size % 7 = 0 THEN '' ELSE 'stated' END AS RightsStatement, CASE WHEN p_size % 2 = 0 THEN p_brand END AS LicenseType, CAST(NULL AS VARCHAR) AS RightsHolder,
         CASE WHEN p_size % 3 = 0 THEN 'v.1 ' || (1800 + p_size) || '-90' WHEN p_size % 3 = 1 THEN CAST(1800 + p_size AS VARCHAR) ELSE 'none' END AS Year FROM part),
combos AS (SELECT CopyrightStatus, RightsStatement, LicenseType, RightsHolder, count(*) AS n FROM items GROUP BY ALL)
"""


@query(
    _ITEMS
    + """SELECT CopyrightStatus, RightsStatement, LicenseType, RightsHolder, n AS "Count",
  CAST(to_json({'CopyrightStatus': nullif(CopyrightStatus, ''), 'RightsStatement': nullif(RightsStatement, ''), 'LicenseType': nullif(LicenseType, ''), 'RightsHolder': nullif(RightsHolder, '')}) AS VARCHAR) AS rights_json
FROM combos"""
)
def rights_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rights_combinations(_rights_items(spark, sf_dir))


def _classified(combos: DataFrame) -> DataFrame:
    """A rule in place of a model: what it says depends on the raw values, so null and '' may differ."""
    verdict = F.when(F.col("LicenseType").isNull(), "open").when(F.col("CopyrightStatus").isNull(), "unclear").otherwise("closed")
    return combos.withColumn("classification", verdict).withColumn("parsing_success", F.coalesce(F.col("LicenseType"), F.lit("")) != "Brand#7")


@query(
    _ITEMS
    + """, rights AS (
  SELECT nullif(CopyrightStatus, '') AS c, nullif(RightsStatement, '') AS s, nullif(LicenseType, '') AS l, nullif(RightsHolder, '') AS h,
         min(CASE WHEN LicenseType IS NULL THEN 'open' WHEN CopyrightStatus IS NULL THEN 'unclear' ELSE 'closed' END) AS classification
  FROM combos WHERE coalesce(LicenseType, '') <> 'Brand#7' GROUP BY ALL),
titles AS (SELECT CAST(c_custkey AS VARCHAR) AS TitleID, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS FullTitle, c_mktsegment AS ShortTitle, upper(substr(n_name, 1, 3)) AS LanguageCode
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT ItemID, BarCode, i.TitleID AS TitleID, coalesce(FullTitle, ShortTitle) AS Title, LanguageCode AS Language, Year AS ItemYear,
  TRY_CAST(regexp_extract(Year, '\\d{4}', 0) AS INTEGER) AS Year, classification AS Rights
FROM items i LEFT JOIN titles t ON i.TitleID = t.TitleID
JOIN rights r ON nullif(CopyrightStatus, '') IS NOT DISTINCT FROM c AND nullif(RightsStatement, '') IS NOT DISTINCT FROM s AND nullif(LicenseType, '') IS NOT DISTINCT FROM l AND nullif(RightsHolder, '') IS NOT DISTINCT FROM h
QUALIFY row_number() OVER (PARTITION BY ItemID ORDER BY i.TitleID NULLS LAST, BarCode NULLS LAST) = 1"""
)
def volumes_prejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _rights_items(spark, sf_dir)
    titles = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    titles = titles.select(
        F.col("c_custkey").cast("string").alias("TitleID"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("FullTitle"), F.col("c_mktsegment").alias("ShortTitle"),
        F.upper(F.substring("n_name", 1, 3)).alias("LanguageCode"), F.lit(None).cast("string").alias("MARCBibID"), F.lit(None).cast("string").alias("TL2Author"),
    )
    made = catalog.volumes_table(items, titles, _classified(catalog.rights_combinations(items)))
    return made.select("ItemID", "BarCode", "TitleID", "Title", "Language", "ItemYear", "Year", "Rights")


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS index
FROM orders QUALIFY index >= 100 AND index < 400"""
)
def index_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.index_window(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100, 400)


@query(
    """WITH n AS (SELECT count(*) AS n FROM supplier), r AS (SELECT unnest(range(7)) AS rank)
SELECT CAST(rank AS INTEGER) AS rank, CAST(rank * (n // 7) AS INTEGER) AS start_idx, CAST(CASE WHEN rank = 6 THEN n ELSE (rank + 1) * (n // 7) END AS INTEGER) AS end_idx FROM n, r"""
)
def rank_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").count()
    return spark.createDataFrame([(r, *sampling.rank_slice(n, 7, r)) for r in range(7)], "rank int, start_idx int, end_idx int")


@query("SELECT p_partkey FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || '42'), p_partkey LIMIT 50")
def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_subset(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda t: table(spark, sf_dir, t).withColumn("page_id", F.col("doc_id").cast("string"))
    return artifacts.unseen(page("documents"), page("labels"), "page").select("doc_id", "lang", "source")


@query(
    """SELECT event_id, CAST(user_id AS VARCHAR) AS page_id, event_type AS model FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.value > 30 AND d.event_type <> 'view' AND d.user_id = e.user_id AND d.event_type = e.event_type)"""
)
def resume_page_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("page_id"), F.col("event_type").alias("model"), "value")
    done = new.filter("value > 30").withColumn("model", F.when(F.col("model") != "view", F.col("model")))
    return artifacts.unseen(new, done, "page_model").select("event_id", "page_id", "model")


@query("SELECT doc_id, lang, CASE WHEN lang IN ('en', 'fr') THEN n_chars END AS n_chars FROM documents")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = docs.filter(~F.col("lang").isin("en", "fr") | F.col("lang").isNull())
    return artifacts.union_all([docs.filter("lang = 'en'").select("doc_id", "lang", "n_chars"), docs.filter("lang = 'fr'").select("n_chars", "doc_id", "lang"), rest.select("lang", "doc_id")])


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS page_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'f/' || doc_id END, ''), CAST(doc_id AS VARCHAR)) AS file_id,
 source AS barcode, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents"""
)
def stage_page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("page_id"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("f/"), "doc_id")).alias("file_id"),
        F.col("source").alias("barcode"), F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("lang"))).otherwise("{broken").alias("extra_json"), F.lit("kept out").alias("other"),
    )
    return artifacts.identities(rows).select("page_id", "file_id", "barcode", F.try_element_at("extra", F.lit("lang")).alias("lang"))


@query(
    """SELECT 's3://archive/images/B' || l_orderkey || '/B' || l_orderkey || '_' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.jp2' AS uri,
 'B' || l_orderkey || '/B' || l_orderkey || '_' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.jp2' AS file_id,
 'https://archive.example/web/B' || l_orderkey || '/B' || l_orderkey || '_' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '_medium.jpg' AS web,
 'item-' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || '/item-' || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.txt' AS ocr_path
FROM lineitem"""
)
def archive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("barcode", F.concat(F.lit("B"), "l_orderkey"))
    uri, file_id = scalars.archive_image(F.col("barcode"), F.col("l_linenumber"))
    rows = rows.select(uri.alias("uri"), file_id.alias("file_id"), scalars.ocr_text_path(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber")).alias("ocr_path"))
    return rows.withColumn("web", scalars.web_image(F.col("uri")))


@query(
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/?#]+)([?#].*)?$', 1), ''), 'row_' || lpad(CAST(page_id AS VARCHAR), 6, '0')) AS name,
 'web/' || coalesce(nullif(regexp_extract(url, '([^/]+)$', 1), ''), name) AS file_id FROM pages"""
)
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    name = scalars.page_id(F.lit(None).cast("string"), F.col("url"), F.col("page_id"))
    return rows.select("page_id", name.alias("name"), scalars.file_id(F.lit("web"), F.col("url"), name).alias("file_id"))


@query(
    """WITH p(gpu, provider, price, priority) AS (VALUES ('L4','ovhcloud',0.8925,0),('L40','ovhcloud',1.78,0),('L40S','ovhcloud',1.78,0),('A100','ovhcloud',2.975,0),('H100','ovhcloud',4.45,0),('RTX5000','ovhcloud',0.85,0),('RTX6000','ovhcloud',1.9,0),
 ('L4','aws',0.9,1),('L40','aws',1.8,1),('A100','aws',3.06,1),('H100','aws',4.88,1),('T4','aws',0.526,1),('V100','aws',3.06,1),('A10G','aws',1.006,1)),
a AS (SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'L4' WHEN 1 THEN 'T4' WHEN 2 THEN 'H100' WHEN 3 THEN 'L40S' ELSE 'B200' END AS gpu_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'K8S' WHEN 2 THEN 'elsewhere' END AS provider FROM supplier)
SELECT s_suppkey, gpu_type, coalesce(provider, (SELECT arg_min(provider, priority) FROM p WHERE gpu = gpu_type), 'unknown') AS price_provider,
  CAST(coalesce(CASE WHEN provider IS NULL THEN (SELECT arg_min(price, priority) FROM p WHERE gpu = gpu_type)
       ELSE (SELECT max(price) FROM p WHERE gpu = gpu_type AND p.provider = CASE lower(a.provider) WHEN 'k8s' THEN 'ovhcloud' ELSE lower(a.provider) END) END, 0.0) AS DOUBLE) AS price
FROM a"""
)
def gpu_pricing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.element_at(F.array(*map(F.lit, ("L4", "T4", "H100", "L40S", "B200"))), (F.col("s_nationkey") % 5 + 1).cast("int")).alias("gpu_type"),
        F.element_at(F.array(F.lit("aws"), F.lit("K8S"), F.lit("elsewhere"), F.lit(None).cast("string")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("provider"),
    )
    return costs.with_price(rows).select("s_suppkey", "gpu_type", "price_provider", "price")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) - 1 AS index FROM orders QUALIFY index >= 100")
def index_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders from the hundredth on by date, each with its place."""
    return sampling.index_window(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderpriority", "o_orderkey"], 100, None).select("o_orderkey", "index")


@query(
    """WITH c AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 > 0 THEN CAST(o_custkey AS VARCHAR) END AS item, CAST(o_orderkey AS VARCHAR) AS page, CASE WHEN o_orderstatus <> 'P' THEN 'bar' || o_custkey END AS barcode,
  o_orderkey % 7 AS k, o_orderkey % 10000 AS s FROM orders)
SELECT page AS page_id, barcode || '/' || barcode || '_' || lpad(CAST(s AS VARCHAR), 4, '0') || '.jp2' AS file_id, barcode, s AS sequence, 's3://archive/images/' || barcode || '/' || barcode || '_' || lpad(CAST(s AS VARCHAR), 4, '0') || '.jp2' AS source_uri
FROM c WHERE item <> '' AND barcode IS NOT NULL AND k NOT IN (1, 2, 3)"""
)
def catalog_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as catalog rows, some without an identifier or with a sequence that is no number."""
    key = F.col("o_orderkey")
    sequence = F.when(key % 7 == 1, F.lit("NULL")).when(key % 7 == 2, F.concat(key.cast("string"), F.lit("a"))).when(key % 7 != 3, F.concat(F.lit(" "), (key % 10000).cast("string"), F.lit(" ")))
    rows = table(spark, sf_dir, "orders").select(
        F.when(key % 11 == 0, F.lit("")).when(key % 13 > 0, F.col("o_custkey").cast("string")).alias("ItemID"), key.cast("string").alias("PageID"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("bar"), "o_custkey")).alias("BarCode"), sequence.alias("SequenceOrder"),
    )
    return catalog.page_rows(rows).select("page_id", "file_id", "barcode", "sequence", "source_uri")


@query(
    """WITH g AS (SELECT 'gpu ' || s_suppkey AS gpu, (16 + 8 * (s_nationkey % 9)) * 1073741824::BIGINT AS total_bytes, (16 + 8 * (s_nationkey % 9)) * 1073741824::BIGINT - CAST(abs(s_acctbal) * 100000 AS BIGINT) AS free_bytes,
  CASE WHEN s_suppkey % 4 = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS budget, CASE WHEN s_suppkey % 3 > 0 THEN 300.0 + 50 * (s_suppkey % 61) END AS bandwidth FROM supplier),
w AS (SELECT *, floor(least(floor(free_bytes * 0.95::DOUBLE), floor(total_bytes * budget))) AS cap FROM g),
p(name, backend, weights, max_model_len, planned) AS (VALUES ('whole', 'litellm', 3400000000, 32768, 1000), ('regions', 'layout_chat', 1800000000, 16384, 400)),
r AS (SELECT gpu, name, backend, bandwidth, weights, max_model_len, planned, weights + greatest(2147483648, weights // 2) AS overhead,
  CAST(cap - sum(weights + greatest(2147483648, weights // 2)) OVER (PARTITION BY gpu) AS BIGINT) AS available, max_model_len * 30000 AS request, sum(max_model_len * 30000) OVER (PARTITION BY gpu) AS all_requests FROM w, p),
c AS (SELECT *, greatest(1, least(floor(floor(CAST(available AS DOUBLE) * request / all_requests) / request),
  CASE WHEN bandwidth IS NOT NULL THEN greatest(1, floor(bandwidth / 15)) WHEN backend = 'layout_chat' THEN 16 ELSE 64 END,
  coalesce(greatest(1, floor(240.0 * bandwidth * 1e9 / (planned * weights))), 1e18))) AS n FROM r WHERE available > 0)
SELECT gpu, name AS profile, CAST(n AS BIGINT) AS concurrent_requests, CAST(n AS BIGINT) * request AS kv_cache_memory_bytes, CAST(overhead AS BIGINT) AS overhead_bytes, CAST(max_model_len AS INTEGER) AS max_model_len FROM c"""
)
def autoscale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two profiles on a fleet in which each supplier stands for a GPU, of a third of which the bandwidth is unknown."""
    profiles = spark.createDataFrame(
        [("whole", "litellm", "1.7B", None, 32768, 20000, None), ("regions", "layout_chat", "0.9B", "bf16", 16384, 4096, 400)],
        "name string, backend string, model_size string, dtype string, max_model_len int, max_tokens int, expected_tokens int",
    )
    key, total = F.col("s_suppkey"), (F.lit(16).cast("bigint") + F.col("s_nationkey") % 9 * 8) * 1073741824
    gpus = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("gpu "), key).alias("gpu"), total.alias("total_bytes"), (total - F.round(F.abs("s_acctbal") * 100000).cast("bigint")).alias("free_bytes"),
        F.when(key % 4 == 0, 0.8).otherwise(0.9).alias("budget"), F.when(key % 3 > 0, (300 + key % 61 * 50).cast("double")).alias("bandwidth"),
    )
    return costs.autoscale(profiles, gpus)
