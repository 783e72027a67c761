"""Costs of pages and GPUs, and how many requests a GPU can take at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import scalars

# Price of an hour by provider and GPU; providers in the order in which they are tried.
OVHCLOUD = {"L4": 0.8925, "L40": 1.78, "L40S": 1.78, "A100": 2.975, "H100": 4.45, "RTX5000": 0.85, "RTX6000": 1.9}
AWS = {"L4": 0.9, "L40": 1.8, "A100": 3.06, "H100": 4.88, "T4": 0.526, "V100": 3.06, "A10G": 1.006}
PROVIDERS = {"ovhcloud": OVHCLOUD, "aws": AWS, "k8s": OVHCLOUD, "kubernetes": OVHCLOUD}
# What the autoscaler reckons with.
TOKEN_BYTES, FREE_SHARE, DEFAULT_OVERHEAD, LEAST_WORKING = 30_000, 0.95, 8 * 1024**3, 2 * 1024**3
BANDWIDTH_A_REQUEST, TARGET_SECONDS, PLANNED_SHARE = 15, 240.0, 0.05
CEILINGS = {"layout_chat": 16}
DEFAULT_CEILING = 64


def price_table(spark) -> DataFrame:
    """(gpu, provider, price, priority): a fixed table of some dozens of rows."""
    rows = [(gpu, p, price, i) for i, (p, table) in enumerate(PROVIDERS.items()) for gpu, price in table.items()]
    return spark.createDataFrame(rows, "gpu string, provider string, price double, priority int")


def with_price(rows: DataFrame, gpu: str = "gpu_type", provider: str = "provider") -> DataFrame:
    """price_provider and price of each row. A given provider: its table alone, 0.0 if the GPU isn't in it. None given: the first that has it, else ('unknown', 0.0)."""
    table = price_table(rows.sparkSession)
    own = table.select(F.col("gpu").alias("__g"), F.col("provider").alias("__p"), F.col("price").alias("__own"))
    best = table.groupBy("gpu").agg(F.min_by("provider", "priority").alias("__best"), F.min_by("price", "priority").alias("__price"))
    out = rows.join(F.broadcast(own), (F.col(gpu) == F.col("__g")) & (F.lower(F.col(provider)) == F.col("__p")), "left")
    out = out.join(F.broadcast(best.withColumnRenamed("gpu", "__any")), F.col(gpu) == F.col("__any"), "left")
    given = F.col(provider).isNotNull()
    out = out.withColumn("price_provider", F.when(given, F.col(provider)).otherwise(F.coalesce("__best", F.lit("unknown"))))
    out = out.withColumn("price", F.coalesce(F.when(given, F.col("__own")).otherwise(F.col("__price")), F.lit(0.0)))
    return out.drop("__g", "__p", "__own", "__any", "__best", "__price")


def page_costs(requests: DataFrame, *keys: str) -> DataFrame:
    """By page: cost, tokens, number of requests, and the time from the first start to the last end (requests overlap; never below 0). Requests without both times don't count."""
    usable = requests.filter("start_s is not null and end_s is not null")
    return usable.groupBy(*(keys or ("page_id",))).agg(
        F.sum("cost").alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("n_requests"),
        F.greatest(F.lit(0.0), F.max("end_s") - F.min("start_s")).alias("elapsed_seconds"),
    )


def gpu_time_cost(elapsed: Column, cost_per_hour: Column) -> Column:
    """Null without requests or price."""
    return elapsed / 3600 * cost_per_hour


def status(rows: DataFrame) -> DataFrame:
    """Rows done and cost so far."""
    return rows.agg(F.count("*").alias("pages_done"), F.coalesce(F.sum(F.coalesce("litellm_cost", F.lit(0.0)) + F.coalesce("gpu_time_cost", F.lit(0.0))), F.lit(0.0)).alias("cumulative_cost"))


def weight_bytes(size: Column, dtype: Column) -> Column:
    per = scalars.lookup(F.lower(F.coalesce(dtype, F.lit("auto"))), {k: float(v) for k, v in scalars.BYTES_PER_PARAMETER.items()}, 2.0)
    return F.floor(scalars.parameter_count(size) * per)


def autoscale(profiles: DataFrame, gpus: DataFrame) -> DataFrame:
    """For each GPU and the profiles that share it: cache and concurrency of each profile.

    profiles: name, backend, model_size, dtype, max_model_len, max_tokens, expected_tokens. gpus: gpu, total_bytes, free_bytes, budget, bandwidth
    (null if unknown). What weights and working space leave of the cap is shared by context length; the concurrency is what fits, up to the
    ceilings by bandwidth (or backend) and by request time, and 1 at least. GPUs whose cap the weights exceed give no rows.
    """
    rows = gpus.crossJoin(F.broadcast(profiles))
    cap = F.least(F.floor(F.col("free_bytes") * FREE_SHARE), F.floor(F.col("total_bytes") * F.col("budget")))
    weights = weight_bytes(F.col("model_size"), F.col("dtype"))
    overhead = F.coalesce(weights + F.greatest(F.lit(LEAST_WORKING), F.floor(weights / 2)), F.lit(DEFAULT_OVERHEAD))
    w = Window.partitionBy("gpu")
    rows = rows.withColumn("weights", weights).withColumn("overhead_bytes", overhead.cast("bigint"))
    rows = rows.withColumn("available", (cap - F.sum("overhead_bytes").over(w)).cast("bigint")).filter("available > 0")
    request = F.col("max_model_len").cast("bigint") * TOKEN_BYTES
    share = F.floor(F.col("available").cast("double") * request / F.sum(request).over(w))
    planned = F.coalesce(F.col("expected_tokens").cast("bigint"), F.greatest(F.lit(1), F.floor(F.col("max_tokens") * PLANNED_SHARE)))
    by_time = F.greatest(F.lit(1), F.floor(TARGET_SECONDS * F.col("bandwidth") * 1e9 / (planned * F.nullif(F.col("weights"), F.lit(0)))))
    ceiling = F.when(F.col("bandwidth").isNotNull(), F.greatest(F.lit(1), F.floor(F.col("bandwidth") / BANDWIDTH_A_REQUEST))).otherwise(scalars.lookup(F.col("backend"), CEILINGS, DEFAULT_CEILING))
    fits = F.greatest(F.lit(1), F.least(F.floor(share / request), ceiling, by_time)).cast("bigint")
    return rows.select("gpu", F.col("name").alias("profile"), fits.alias("concurrent_requests"), (fits * request).alias("kv_cache_memory_bytes"), "overhead_bytes", "max_model_len")


def match_gpus(probes: DataFrame, specs: DataFrame) -> DataFrame:
    """Each probed GPU with the name and bandwidth of its entry in a catalog, null where none fits.

    probes: gpu, memory_gb, cc_major, cc_minor, clock_mhz, pcie_gen, pcie_width (all but gpu may be null); specs: name, bandwidth, memory_gb,
    cc_major, cc_minor, clock_mhz, bus. An entry of the very name wins. Else entries that hold the name as whole words stand; if
    there are several, those whose bus is slower than the one seen go, and of the rest those that agree in most of memory (10 %), compute
    capability and clock (3 %), of equal ones that of least bandwidth; none if nothing agrees. Names are compared by their words, so no
    pair without a common first word is formed.
    """
    name = F.regexp_replace(F.trim("gpu"), "^(NVIDIA|Tesla) ", "")
    words = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\s+", " "), F.lit(" "))
    own = probes.select(F.col("gpu"), name.alias("wanted"), F.element_at(F.split(name, r"\s+"), 1).alias("word"), *[F.col(c).alias(f"p_{c}") for c in ("memory_gb", "cc_major", "cc_minor", "clock_mhz", "pcie_gen", "pcie_width")])
    known = specs.filter("bandwidth > 0").withColumn("word", F.explode(F.array_distinct(F.split("name", r"\s+"))))
    near = lambda a, b, share: F.when(F.abs(F.col(a) - F.col(b)) / F.col(b) <= share, 1).otherwise(0)
    score = near("memory_gb", "p_memory_gb", 0.10) + near("clock_mhz", "p_clock_mhz", 0.03) + F.when((F.col("cc_major") == F.col("p_cc_major")) & (F.col("cc_minor") == F.col("p_cc_minor")), 1).otherwise(0)
    bus = lambda i: F.regexp_extract("bus", r"(?i)PCIe\s+(\d+)\.\d+\s+x(\d+)", i).try_cast("int")
    slower = F.coalesce(bus(1) < F.col("p_pcie_gen"), F.lit(False)) | F.coalesce(bus(2) < F.col("p_pcie_width"), F.lit(False))
    pairs = own.join(known, "word").filter(F.contains(words("name"), words("wanted")))
    w = Window.partitionBy("gpu")
    pairs = pairs.withColumn("exact", F.col("name") == F.col("wanted")).withColumn("many", F.count("*").over(w) > 1)
    pairs = pairs.filter(F.col("exact") | ~F.col("many") | ~slower).withColumn("many", F.count("*").over(w) > 1).withColumn("score", score)
    pairs = pairs.filter(F.col("exact") | ~F.col("many") | (F.col("score") > 0))
    best = pairs.withColumn("at", F.row_number().over(w.orderBy(F.desc("exact"), F.desc("score"), "bandwidth", "name"))).filter("at = 1")
    return probes.select("gpu").join(best.select("gpu", "name", "bandwidth"), "gpu", "left")
