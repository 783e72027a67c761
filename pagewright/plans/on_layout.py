"""Layout queries: four numbers of an embedding stand for a box, fifty neighbouring ids for a page, the label for the category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry, scalars
from pagewright.operators import documents
from pagewright.plans.named import query, table

#: Random boxes rarely overlap by half; the queries match from here on.
THRESHOLD = 0.05


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, side, at, category, bbox): left and top from -1 to 1, sides up to 1, as doubles."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    box = F.struct(e(1).alias("l"), e(2).alias("t"), (e(1) + F.abs(e(3)) + 0.1).alias("r"), (e(2) + F.abs(e(4)) + 0.1).alias("b"))
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("page"), (F.col("vec_id") % 2).alias("side"), "vec_id", F.concat(F.lit("c"), F.col("label") % 3).alias("category"), box.alias("bbox"))


_BOXES = """
WITH b AS (SELECT vec_id // 50 AS page, vec_id % 2 AS side, vec_id, 'c' || (label % 3) AS category, CAST(embedding[1] AS DOUBLE) AS l, CAST(embedding[2] AS DOUBLE) AS t,
  CAST(embedding[1] AS DOUBLE) + abs(CAST(embedding[3] AS DOUBLE)) + 0.1 AS r, CAST(embedding[2] AS DOUBLE) + abs(CAST(embedding[4] AS DOUBLE)) + 0.1 AS b FROM embeddings),
i AS (SELECT p.page, p.category, p.vec_id AS pv, q.vec_id AS bv, greatest(0.0, least(p.r, q.r) - greatest(p.l, q.l)) * greatest(0.0, least(p.b, q.b) - greatest(p.t, q.t)) AS inter,
  (p.r - p.l) * (p.b - p.t) + (q.r - q.l) * (q.b - q.t) AS areas FROM b p JOIN b q ON p.page = q.page AND p.category = q.category AND p.side = 0 AND q.side = 1),
iou AS (SELECT page, category, pv, bv, CASE WHEN inter > 0 THEN inter / (areas - inter) ELSE 0.0 END AS iou FROM i)
"""


@query(_BOXES + "SELECT page, category, pv, bv, round(iou, 9) AS iou FROM iou")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    side = lambda n, v: boxes.filter(F.col("side") == n).select("page", "category", F.col("vec_id").alias(v), F.col("bbox").alias(f"{v}_box"))
    pairs = side(0, "pv").join(side(1, "bv"), ["page", "category"])
    return pairs.select("page", "category", "pv", "bv", F.round(geometry.iou(F.col("pv_box"), F.col("bv_box")), 9).alias("iou"))


def _sides(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Arrays of both sides' regions, in the order of their ids."""
    regions = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("vec_id", F.struct("category", "bbox").alias("r"))))), lambda x: x["r"])
    ids = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("vec_id"))))
    return _boxes(spark, sf_dir).groupBy(*keys).agg(regions(0).alias("pred"), regions(1).alias("base"), ids(0).alias("pred_ids"), ids(1).alias("base_ids"))


_RECURSIVE = _BOXES.replace("WITH b AS", "WITH RECURSIVE b AS") + (
    f""", sorted AS (SELECT page, category, list({{'iou': iou, 'p': pv, 'q': bv}} ORDER BY iou DESC, pv DESC, bv DESC) FILTER (iou >= {THRESHOLD}) AS pairs FROM iou GROUP BY page, category),
greedy AS (
  SELECT page, category, 1 AS step, pairs[1:1] AS done, pairs FROM sorted WHERE pairs IS NOT NULL
  UNION ALL
  SELECT page, category, step + 1, CASE WHEN len(list_filter(done, lambda y: y.p = pairs[step + 1].p OR y.q = pairs[step + 1].q)) > 0 THEN done ELSE list_append(done, pairs[step + 1]) END, pairs
  FROM greedy WHERE step < len(pairs)),
matched AS (SELECT page, category, unnest(done) AS m FROM greedy WHERE step = len(pairs))
"""
)


@query(_RECURSIVE + "SELECT page, category, m.p AS pv, m.q AS bv, round(m.iou, 9) AS iou FROM matched")
def layout_iou_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir, "page", "category")
    boxes = lambda c: F.transform(c, lambda r: r["bbox"])
    found = sides.select("page", "category", "pred_ids", "base_ids", F.explode(geometry.greedy_matches(boxes("pred"), boxes("base"), THRESHOLD)).alias("m"))
    return found.select("page", "category", F.element_at("pred_ids", F.col("m.p") + 1).alias("pv"), F.element_at("base_ids", F.col("m.q") + 1).alias("bv"), F.round("m.iou", 9).alias("iou"))


@query(
    _RECURSIVE
    + """, n AS (SELECT page, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS nb FROM b GROUP BY page)
SELECT n.page, round(coalesce(avg(m.iou), 0.0), 9) AS iou_mean, CAST(count(m.iou) AS INTEGER) AS matched_regions, CAST(np - count(m.iou) AS INTEGER) AS unmatched_pred, CAST(nb - count(m.iou) AS INTEGER) AS unmatched_base,
  round(max(c0), 9) AS c0_mean FROM n LEFT JOIN matched USING (page) LEFT JOIN (SELECT page, avg(m.iou) AS c0 FROM matched WHERE category = 'c0' GROUP BY page) USING (page) GROUP BY n.page, np, nb"""
)
def layout_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir, "page").withColumn("c", documents.layout_comparison(F.col("pred"), F.col("base"), THRESHOLD)).filter("c is not null")
    return sides.select(
        "page", F.round("c.iou_mean", 9).alias("iou_mean"), "c.matched_regions", "c.unmatched_pred", "c.unmatched_base", F.round(F.try_element_at("c.iou_per_category", F.lit("c0")), 9).alias("c0_mean")
    )


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions: order as page, whole-number boxes that repeat, an order given for some orders only."""
    l, t = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") * 25 % 900).cast("double")
    box = F.struct(l.alias("l"), t.alias("t"), (l + F.col("l_quantity") * 4 - 20).alias("r"), (t + F.col("l_linenumber") * 15).alias("b"))
    order = F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_partkey") % 5).cast("bigint"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(F.col("l_partkey").alias("id"), F.concat(F.lit("x"), "l_returnflag").alias("category"), box.alias("bbox"), F.col("l_discount").alias("score"), order.alias("reading_order"), F.col("l_linenumber").alias("n"), "l_suppkey", "l_quantity").alias("region"))


_PIXELS = """
WITH x AS (SELECT l_orderkey AS page, l_partkey AS id, l_linenumber AS n, l_suppkey, l_quantity, CAST(l_partkey % 400 AS DOUBLE) AS l, CAST(l_suppkey * 25 % 900 AS DOUBLE) AS t, l_partkey % 400 + l_quantity * 4 - 20 AS r,
  l_suppkey * 25 % 900 + l_linenumber * 15 AS b, l_discount AS score, CASE WHEN l_orderkey % 3 > 0 THEN l_partkey % 5 END AS reading_order FROM lineitem)
"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    key = F.struct("region.id", "region.n", "region.l_suppkey", "region.l_quantity", "region")
    return pixels.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["region"]).alias("regions"))


@query(
    _PIXELS
    + """, given AS (SELECT page, bool_and(reading_order IS NOT NULL) AS given FROM x GROUP BY page)
SELECT page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CASE WHEN given THEN reading_order ELSE round_even(t / 50, 0) * 50 END, CASE WHEN given THEN t ELSE l END, CASE WHEN given THEN l ELSE 0 END, id, n, l_suppkey, l_quantity) AS ids
FROM x JOIN given USING (page) GROUP BY page"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir)
    return rows.select("page", F.array_join(F.transform(geometry.in_reading_order(F.col("regions")), lambda r: r["id"].cast("string")), ",").alias("ids"))


@query(_PIXELS + "SELECT page, CAST(count(*) FILTER (r - l > 0 AND b - t > 0 AND (r - l) * (b - t) >= 4096) AS INTEGER) AS large, CAST(count(*) FILTER (score >= 0.05) AS INTEGER) AS certain FROM x GROUP BY page")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir)
    return rows.select("page", F.size(geometry.large_enough(F.col("regions"))).alias("large"), F.size(geometry.certain(F.col("regions"), 0.05)).alias("certain"))


def _limits() -> dict[str, int]:
    return {"factor": 28, "min_pixels": 80_000, "max_pixels": 3_000_000}


_RESIZED = """
WITH p AS (SELECT DISTINCT CAST(l_partkey % 3000 + 1 AS DOUBLE) AS w, CAST(l_suppkey * 37 % 2500 + 1 AS DOUBLE) AS h FROM lineitem),
n AS (SELECT w, h, greatest(28.0, round_even(h / 28, 0) * 28) AS nh, greatest(28.0, round_even(w / 28, 0) * 28) AS nw FROM p),
s AS (SELECT w, h, CAST(CASE WHEN nh * nw > 3000000 THEN floor(h / sqrt(h * w / 3000000) / 28) * 28 WHEN nh * nw < 80000 THEN ceil(h * sqrt(80000.0 / (h * w)) / 28) * 28 ELSE nh END AS BIGINT) AS rh,
  CAST(CASE WHEN nh * nw > 3000000 THEN floor(w / sqrt(h * w / 3000000) / 28) * 28 WHEN nh * nw < 80000 THEN ceil(w * sqrt(80000.0 / (h * w)) / 28) * 28 ELSE nw END AS BIGINT) AS rw FROM n)
"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3000 + 1).cast("double").alias("w"), (F.col("l_suppkey") * 37 % 2500 + 1).cast("double").alias("h")).distinct()


@query(_RESIZED + "SELECT w, h, rw, rh FROM s")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.smart_resize(F.col("h"), F.col("w"), **_limits())
    return _sizes(spark, sf_dir).select("w", "h", size["w"].alias("rw"), size["h"].alias("rh"))


@query(_RESIZED + "SELECT w, h, round(CASE WHEN rw <= 0 OR rh <= 0 OR (abs(w / rw - 1) < 1e-6 AND abs(h / rh - 1) < 1e-6) THEN 10.0 ELSE 10 * (w / rw) END, 6) AS l, round(CASE WHEN rw <= 0 OR rh <= 0 OR (abs(w / rw - 1) < 1e-6 AND abs(h / rh - 1) < 1e-6) THEN 40.0 ELSE 40 * (h / rh) END, 6) AS b FROM s")
def bbox_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("l", 10.0), ("t", 20.0), ("r", 30.0), ("b", 40.0))])
    rows = _sizes(spark, sf_dir).withColumn("box", geometry.rescaled(box, F.col("h"), F.col("w"), **_limits()))
    return rows.select("w", "h", F.round("box.l", 6).alias("l"), F.round("box.b", 6).alias("b"))


@query(_PIXELS + "SELECT page, id, n, l_suppkey, l_quantity, CAST(round_even(l * 1.5, 0) AS BIGINT) AS pl, CAST(round_even(t * 0.5, 0) AS BIGINT) AS pt FROM x")
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled: Column = geometry.to_pixels(F.col("region.bbox"), F.lit(1.5), F.lit(0.5))
    rows = _pixels(spark, sf_dir).withColumn("s", scaled)
    return rows.select("page", "region.id", "region.n", "region.l_suppkey", "region.l_quantity", F.col("s.l").alias("pl"), F.col("s.t").alias("pt"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 'table {w}' WHEN p_size % 4 = 2 THEN 'text 7' ELSE 'other ' || p_size || 'x' || (p_size + 1) END AS prompt FROM part"""
)
def region_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category (one whose mode has no template), else the preferred one, with the size filled in."""
    table_of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    size = F.col("p_size")
    category = F.when(size % 4 == 1, "Table").when(size % 4 == 2, "Text").when(size % 4 == 3, "Gone")
    templates = table_of({"whole": "other {width}x{height}", "tables": "table {w}", "texts": "text 7"})
    mode = scalars.prompt_mode(F.coalesce(category, F.lit("?")), table_of({"Table": "tables", "Text": "texts", "Gone": "missing"}), F.lit("whole"), templates)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.with_size(F.try_element_at(templates, mode), size, size + 1).alias("prompt"))
