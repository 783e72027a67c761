"""Roll-ups of result rows: by model, by page, overall, by any cost key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP_KEYS = ("model", "gpu_type", "provider", "barcode", "output_format")
#: Metrics for which less is better, by a part of their name.
LESS_IS_BETTER = "cer|wer|delta"


def text_or_null(column: str | Column) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def failed(column: str = "error") -> Column:
    """Null and '' are no error."""
    return F.coalesce(F.col(column), F.lit("")) != ""


def mean(value: Column) -> Column:
    """Mean of what is a number: nulls and NaN are passed over; null of nothing."""
    return F.avg(F.when(~F.isnan(value.cast("double")), value))


def median(value: Column) -> Column:
    """Median of what is a number; of an even count the middle of the middle two."""
    return F.median(F.when(~F.isnan(value.cast("double")), value))


def cost_rollup(rows: DataFrame, *keys: str, tokens: bool = True) -> DataFrame:
    """Pages, GPU seconds (nulls as 0) and their mean (nulls passed over), tokens, both kinds of cost, by any of GROUP_KEYS."""
    if unknown := set(keys) - set(GROUP_KEYS):
        raise ValueError(f"can't group by {sorted(unknown)}; choose from {GROUP_KEYS}")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = [F.count("*").alias("pages"), total("elapsed_seconds").alias("gpu_seconds"), F.avg("elapsed_seconds").alias("avg_seconds")]
    out += [total("input_tokens").alias("tokens_in"), total("output_tokens").alias("tokens_out")] if tokens else []
    return rows.groupBy(*keys).agg(*out, total("litellm_cost").alias("token_cost"), total("gpu_time_cost").alias("infra_cost")).orderBy(*keys)


def per_model(rows: DataFrame, metrics: tuple[str, ...] = ("run_seconds_per_page", "prepare_seconds", "text_length", "item_count"), order: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """By model (null and '' are '?'): rows with and without error, tokens of those without, their means. Zero tokens count for the total, not the mean.

    output_format is the first one by ``order``. metrics: a map column ``metrics`` of text values.
    """
    ok = ~failed()
    tokens = F.coalesce("tokens", F.lit(0))
    of = lambda m: F.try_element_at("metrics", F.lit(m)).try_cast("double")
    return (
        rows.groupBy(F.coalesce(text_or_null("model"), F.lit("?")).alias("model"))
        .agg(
            F.min_by("output_format", F.when(F.col("output_format").isNotNull(), F.struct(*order))).alias("output_format"),
            F.count_if(ok).alias("pages_ok"), F.count_if(~ok).alias("pages_errored"),
            F.coalesce(F.sum(F.when(ok, tokens)), F.lit(0)).alias("total_tokens"), F.avg(F.when(ok & (tokens != 0), tokens)).alias("mean_tokens"),
            *[mean(F.when(ok, of(m))).alias(f"mean_{m}") for m in metrics],
        )
        .orderBy("model")
    )


def overall(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for a run. pages: page, disagreement, n_models; only pages of two models or more count for its mean and median."""
    multi = F.when(F.col("n_models") >= 2, F.col("disagreement"))
    run = rows.agg(
        F.countDistinct("file_id").alias("n_pages"), F.countDistinct(text_or_null("model")).alias("n_models"), F.count("*").alias("n_rows"),
        F.countDistinct(F.when(failed(), F.col("file_id"))).alias("n_pages_with_errors"),
    )
    return run.crossJoin(F.broadcast(pages.agg(F.avg(multi).alias("mean_disagreement"), F.median(multi).alias("median_disagreement"))))


def top_disagreement(pages: DataFrame, k: int = 10) -> DataFrame:
    return pages.filter("n_models >= 2").orderBy(F.desc("disagreement"), "page").limit(k)


def run_aggregate(rows: DataFrame, order: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """By model: how long the run took (the largest stamp) and per row, failures, first meaningful hardware and price, the estimated cost, concurrency, cache.

    'unknown' hardware, the provider 'local' and zero values are passed over; of concurrent_requests and region_concurrency the
    first that isn't zero counts. ``order`` says what comes first.
    """
    total = F.max(F.try_element_at("metrics", F.lit("run_seconds_total")).try_cast("double"))
    at = F.struct(*order)
    first = lambda value, ok: F.min_by(value, F.when(ok, at))
    own = lambda c, *but: F.coalesce(F.col(c), F.lit("")).isin("", *but)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    busy = F.coalesce(F.nullif(F.col("concurrent_requests"), F.lit(0)), F.nullif(F.col("region_concurrency"), F.lit(0)))
    out = rows.groupBy("model").agg(
        F.count_if(~failed()).alias("succeeded"), F.count_if(failed()).alias("failed"), total.alias("total"), (total / F.count("*")).alias("avg"),
        first(F.col("gpu_type"), ~own("gpu_type", "unknown")).alias("gpu_type"), first(F.col("provider"), ~own("provider", "local")).alias("provider"),
        first(F.col("cost_per_hour"), number("cost_per_hour")).alias("cost_per_hour"), first(busy, busy.isNotNull()).alias("concurrency"),
        first(F.col("kv_cache_memory_bytes"), number("kv_cache_memory_bytes")).alias("kv_bytes"),
    )
    return out.withColumn("est_cost", F.col("total") / 3600 * F.col("cost_per_hour")).orderBy("model")


def best_agreement(rows: DataFrame, page: str = "file_id", comparisons: str = "comparisons_json") -> DataFrame:
    """(page, key, value): the best value of each numeric summary entry among a page's models; the least one where less is better. Broken JSON and other values are passed over."""
    envelope = F.from_json(comparisons, "map<string, string>")
    entry = rows.select(F.col(page).alias("page"), F.explode(envelope).alias("comparison", "payload"))
    summary = F.from_json(F.get_json_object("payload", "$.summary"), "map<string, string>")
    each = entry.select("page", "comparison", F.explode(summary).alias("name", "raw"))
    each = each.select("page", F.concat_ws("_", "comparison", "name").alias("key"), F.col("raw").try_cast("double").alias("v")).filter("v is not null")
    return each.groupBy("page", "key").agg(F.when(F.col("key").rlike(LESS_IS_BETTER), F.min("v")).otherwise(F.max("v")).alias("value"))


def summary_means(rows: DataFrame, summary: str = "summary") -> DataFrame:
    """(key, mean, n) over the results that have the key. summary: map<string, double>."""
    return rows.select(F.explode(summary).alias("key", "v")).groupBy("key").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def canonical_score(summary: str | Column) -> Column:
    """The mean of a summary's values, 0.0 of none."""
    values = F.map_values(summary)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def page_index(rows: DataFrame) -> DataFrame:
    """A row for each file: its models and failed models in order, most characters, first barcode, sequence and link by model, whether a reference exists."""
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("model")))
    chars = F.coalesce(F.try_element_at("metrics", F.lit("text_length")).try_cast("bigint"), F.lit(0))
    return rows.groupBy("file_id").agg(
        F.min_by("page_id", "model").alias("page_id"), first("barcode", text_or_null("barcode").isNotNull()).alias("barcode"),
        first("sequence", F.col("sequence").isNotNull()).alias("sequence"), first("source_uri", text_or_null("source_uri").isNotNull()).alias("source_uri"),
        F.sort_array(F.collect_list("model")).alias("models"), F.sort_array(F.collect_list(F.when(failed(), F.col("model")))).alias("error_models"),
        F.bool_or(text_or_null("reference_text").isNotNull()).alias("has_reference"), F.max(chars).alias("char_count"),
    )


def page_view(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """page_index with each file's disagreement (0.0 without one), number of compared models and map of best agreements. pages: page, disagreement, n_models."""
    best = best_agreement(rows).groupBy("page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("best"))
    of = lambda other: F.col("file_id") == other["page"]
    out = page_index(rows).join(pages, of(pages), "left").drop("page").join(best, of(best), "left").drop("page")
    return out.withColumn("disagreement", F.coalesce("disagreement", F.lit(0.0)))


def ordered_pages(index: DataFrame, by: str = "disagreement") -> DataFrame:
    """Pages by file, characters, errors or disagreement, the largest first and ties by file; 'parquet': as they came, by a column ``ord`` that says how."""
    keys = {"file_id": [], "chars": [F.desc("char_count")], "errors": [F.desc(F.size("error_models"))], "disagreement": [F.desc("disagreement")], "parquet": ["ord"]}
    return index.orderBy(*keys[by], "file_id")


def page_table(rows: DataFrame) -> DataFrame:
    """Result rows by file and model, the file named in its first row alone."""
    return blank_repeats(rows, "file_id", ("file_id", "model")).orderBy("file_id", "model")


def legend(regions: DataFrame, label: str, ord_: str) -> DataFrame:
    """How often each label occurs, in the order in which labels are first seen."""
    seen = regions.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(ord_).alias("first_seen"))
    return seen.orderBy("first_seen", "label")


#: Columns of result rows that statistics read.
STAT_COLUMNS = ("model", "output_format", "error", "tokens", "metrics")


def stat_columns(rows: DataFrame, names: tuple[str, ...] = STAT_COLUMNS) -> DataFrame:
    """The columns that statistics need, those of them that there are, so that no others are read."""
    return rows.select(*[c for c in names if c in rows.columns])


def find_page(rows: DataFrame, wanted: str) -> DataFrame:
    """The rows of the file that ``wanted`` names, by file_id if any has it, else by page_id, of which the first file counts."""
    hit = rows.withColumn("__by", F.when(F.col("file_id") == wanted, 0).when(F.col("page_id") == wanted, 1)).filter("__by is not null")
    best = hit.select("__by", F.col("file_id").alias("__file")).orderBy("__by", "__file").limit(1)
    return hit.join(F.broadcast(best.select("__file")), F.col("file_id") == F.col("__file")).drop("__by", "__file")


def steps(rows: DataFrame, within: str, order: str) -> DataFrame:
    """Each row's neighbours in order, itself at either end."""
    w = Window.partitionBy(within).orderBy(order)
    return rows.withColumn("previous", F.coalesce(F.lag(order).over(w), F.col(order))).withColumn("next", F.coalesce(F.lead(order).over(w), F.col(order)))


def blank_repeats(rows: DataFrame, column: str = "file_id", order: tuple[str, ...] = ("file_id", "model")) -> DataFrame:
    """The column only where it differs from the row before: the first of its rows in order."""
    w = Window.partitionBy(column).orderBy(*order)
    return rows.withColumn(f"shown_{column}", F.when(F.row_number().over(w) == 1, F.col(column)).otherwise(""))


def shown_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have a value anywhere."""
    found = rows.agg(*[(F.count(c) > 0).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def stage_tally(rows: DataFrame, model: str = "model", status: str = "status") -> DataFrame:
    """Rows by model and outcome, and over all models."""
    return rows.rollup(status, model).agg(F.count("*").alias("n")).filter(F.col(status).isNotNull())


def merged_metrics(parts: DataFrame) -> DataFrame:
    """One row: counters and timers summed, the largest GPU peak, pages an hour (null if nothing ran)."""
    total = parts.agg(F.sum("pages_ok").alias("pages_ok"), F.sum("pages_failed").alias("pages_failed"), F.sum("tokens").alias("tokens"), F.max("gpu_peak_mb").alias("gpu_peak_mb"), F.sum("seconds").alias("seconds"))
    return total.withColumn("pages_per_hour", F.when(F.col("seconds") > 0, F.col("pages_ok") * 3600 / F.col("seconds")))
