"""The stages from pages to results, each resumed by what its output already holds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import geometry, scalars
from pagewright.operators import comparison, costs, documents, stats
from pagewright.plans.inference import Limits, answered
from pagewright.sources import artifacts

STAGES = ("sample", "layout", "ocr", "normalize")


@dataclass(frozen=True)
class Config:
    """A job that can be written down and run again."""

    output: str
    models: tuple[str, ...] = ()
    stages: tuple[str, ...] = ("sample", "ocr", "normalize")
    sample: int | None = None
    seed: int = 42
    resume: str = "page_model"
    comparisons: tuple[str, ...] | None = None
    categories: dict = field(default_factory=dict)
    start: int = 0
    end: int | None = None

    def __post_init__(self):
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"no such stage: {sorted(unknown)}")
        if self.end is not None and self.end < self.start:
            raise ValueError("end lies before start")

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def load(cls, text: str, **changes) -> Config:
        held = json.loads(text)
        return replace(cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()}), **changes)


def source_options(pairs: list[str]) -> dict:
    """k=v arguments; values are JSON where they can be, text else."""
    out = {}
    for pair in pairs:
        key, found, value = pair.partition("=")
        if not found or not key:
            raise ValueError(f"{pair!r} isn't key=value")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def sample(pages: DataFrame, done: DataFrame | None = None, n: int | None = None, order: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pages that aren't there yet and have a link to their image."""
    own = pages.orderBy(*order).limit(n) if n is not None else pages
    own = own.filter(F.coalesce(F.col("source_uri"), F.lit("")) != "")
    return own if done is None else artifacts.unseen(own, done, "page")


def layout(pages: DataFrame, regions: DataFrame, detector: str, done: DataFrame | None = None, min_area: float = geometry.MIN_AREA) -> DataFrame:
    """Regions of each page in reading order, small ones left out; pages without any have an empty list. regions: page_id, regions."""
    own = pages if done is None else artifacts.unseen(pages, done, "page")
    held = own.join(regions, "page_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{schemas.REGION}>")))
    held = held.withColumn("regions", geometry.in_reading_order(geometry.large_enough(F.col("regions"), min_area)))
    return held.withColumn("detector", F.lit(detector)).withColumn("regions_json", F.to_json("regions"))


def recognise(pages: DataFrame, models: list[tuple[str, str]], ask: Callable, done: DataFrame | None = None, mode: str = "page_model", limits: Limits | None = None) -> DataFrame:
    """Each page by each model (name, output format), but for what is done; rows with an error count as done."""
    work = _by_model(pages, models)
    work = work if done is None else artifacts.unseen(work, done, mode)
    return answered(work, ask, ("page_id", "source_uri", "model"), limits)


def _by_model(pages: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    return pages.crossJoin(F.broadcast(pages.sparkSession.createDataFrame(models, "model string, output_format string")))


def recognise_regions(pages: DataFrame, model: str, ask: Callable, limits: Limits | None = None) -> DataFrame:
    """Each region by itself, put together by page as in assembled. Pages whose detector failed (detect_error, where there is that column) aren't asked about."""
    own = pages.filter(_detector_error(pages).isNull())
    each = own.select("page_id", F.posexplode("regions").alias("at", "r")).select("page_id", "at", F.col("r.category").alias("category"), F.array("r.bbox.l", "r.bbox.t", "r.bbox.r", "r.bbox.b").alias("bbox"), F.col("r.score").alias("score"))
    said = answered(each.repartition("page_id", "at"), ask, ("page_id", "at", "category"), limits)
    return assembled(pages, said.select("page_id", "at", "raw_payload", "tokens", "error"), model)


def _detector_error(pages: DataFrame) -> Column:
    return F.nullif(F.col("detect_error"), F.lit("")) if "detect_error" in pages.columns else F.lit(None).cast("string")


def assembled(pages: DataFrame, said: DataFrame, model: str) -> DataFrame:
    """A raw row for each page: its blocks as a JSON list in the order of its regions.

    said: page_id, at (place among the page's regions), raw_payload, tokens, error. A slot that nothing was said for and one that failed are blocks
    without text and with an error, and the page is fine; of several answers for a slot one without error counts. A page without regions
    has an empty list. A page whose detector failed has no payload and the detector's error as its own.
    """
    failed = _detector_error(pages)
    slots = pages.filter(failed.isNull()).select("page_id", F.posexplode("regions").alias("at", "r"))
    best = said.groupBy("page_id", "at").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), "raw_payload", "error", "tokens")).alias("s"))
    held = slots.join(best, ["page_id", "at"], "left")
    error = F.when(F.col("s").isNull(), F.lit("no answer came for this region")).otherwise(F.col("s.error"))
    text = F.when(error.isNull(), F.col("s.raw_payload")).otherwise(F.lit(""))
    box = F.array("r.bbox.l", "r.bbox.t", "r.bbox.r", "r.bbox.b")
    block = F.struct("at", F.struct(F.col("r.category").alias("category"), box.alias("bbox"), text.alias("text"), F.col("r.score").alias("score"), error.alias("error")).alias("b"))
    put = held.groupBy("page_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"])).alias("raw_payload"), F.sum("s.tokens").alias("tokens"))
    own = pages.join(put, "page_id", "left")
    own = own.withColumn("raw_payload", F.when(failed.isNotNull(), F.lit("")).otherwise(F.coalesce("raw_payload", F.lit("[]"))))
    return own.withColumn("model", F.lit(model)).withColumn("output_format", F.lit("layout_json")).withColumn("error", F.when(failed.isNotNull(), F.concat(F.lit("layout detector failed: "), failed)))


def with_costs(raw: DataFrame, requests: DataFrame, gpu: str | None = None, provider: str | None = None) -> DataFrame:
    """Cost columns of each page and model from its requests and the price of the GPU; requests of unknown pages don't count."""
    by_page = costs.page_costs(requests, "page_id", "model").select("page_id", "model", F.col("cost").alias("litellm_cost"), F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"), "elapsed_seconds")
    priced = costs.with_price(raw.withColumn("gpu_type", F.lit(gpu)).withColumn("provider", F.lit(provider).cast("string")))
    out = priced.join(by_page, ["page_id", "model"], "left").withColumn("provider", F.col("price_provider")).withColumn("cost_per_hour", F.col("price"))
    return out.drop("price_provider", "price").withColumn("gpu_time_cost", costs.gpu_time_cost(F.col("elapsed_seconds"), F.col("cost_per_hour")))


def normalize(
    raw: DataFrame, references: DataFrame | None = None, done: DataFrame | None = None, comparisons: tuple[str, ...] | None = None, categories: dict | None = None, resized: bool = False,
    extra: dict[str, Callable] | None = None, tally: Tally | None = None,
) -> DataFrame:
    """Results of raw rows without error and with a link: document, texts, statistics, comparisons with the page's reference, flat metrics.

    Payloads that aren't what their format says give no row. references: page_id, reference_text and, for document and layout
    comparisons, reference_document. extra: more comparisons by name, as comparison.compare takes them; one that raises leaves its error in the row.
    tally counts what was skipped as done, failed and written.
    """
    seen, failed = F.lit(False), stats.failed() | (F.coalesce(F.col("source_uri"), F.lit("")) == "")
    if done is not None and tally is not None:
        raw, seen = artifacts.marked(raw, done, "page_model"), F.col(artifacts.SEEN)
    elif done is not None:
        raw = artifacts.unseen(raw, done, "page_model")
    layouts = documents.layout_document(categories, resized)
    fit = ~(seen | failed)
    payload, width, height = F.when(fit, F.col("raw_payload")), F.col("width").cast("double"), F.col("height").cast("double")
    doc = F.when(F.col("output_format") == "layout_json", layouts("page_id", payload, width, height)).otherwise(documents.markdown_document("page_id", payload))
    own = raw.withColumn("document", F.when(fit, doc)) if tally is not None else raw.filter(fit).withColumn("document", doc)
    if tally is not None:
        own = tally.of(own, F.when(seen, "skipped").when(F.col("document").isNull(), "failed").otherwise("written"))
    own = own.filter(F.col("document").isNotNull()).drop(artifacts.SEEN)
    about = documents.statistics(F.col("document"))
    own = own.withColumn("markdown", documents.rendered(F.col("document"))).withColumn("text", documents.plain_text(F.col("document")))
    own = own.withColumn("metrics", F.create_map(F.lit("tokens"), F.col("tokens").cast("string"), F.lit("item_count"), about["item_count"].cast("string"), F.lit("text_length"), about["text_length"].cast("string")))
    names = comparison.chosen(list(comparisons) if comparisons is not None else None, references is not None)
    if references is not None:
        own = own.join(references, "page_id", "left")
        own = comparison.compare(own, names, base_doc="reference_document" if "reference_document" in references.columns else None, extra=extra)
        own = own.withColumn("comparisons_json", F.nullif(F.to_json("comparisons"), F.lit("{}")))
    else:
        own = own.withColumn("comparisons_json", F.lit(None).cast("string")).withColumn("reference_text", F.lit(None).cast("string"))
    own = comparison.flattened(own)
    return own.withColumn("document_json", F.to_json("document")).withColumn("metrics_json", artifacts.encoded(F.map_filter("metrics", lambda k, v: v.isNotNull())))


class Tally:
    """Rows by status, over all and by model, counted by Spark while a stage writes them: no second pass."""

    STATUS = ("written", "skipped", "failed")

    def __init__(self, models: tuple[str, ...] = ()):
        self.models, self._seen = models, Observation()

    def of(self, rows: DataFrame, status: Column) -> DataFrame:
        """rows, counted when they are written; once for each stage."""
        held = [F.count_if(status == x).alias(x) for x in self.STATUS]
        held += [F.count_if((status == x) & F.col("model").eqNullSafe(F.lit(m))).alias(f"{x} {k}") for k, m in enumerate(self.models) for x in self.STATUS]
        return rows.observe(self._seen, *held)

    def counts(self) -> dict:
        """{'written', 'skipped', 'failed', 'by_model': {model: the same three}}; waits for the rows to be written."""
        found = self._seen.get
        return {x: found[x] for x in self.STATUS} | {"by_model": {m: {x: found[f"{x} {k}"] for x in self.STATUS} for k, m in enumerate(self.models)}}


class Made(dict):
    """Rows of each stage's artifact; tallies has what each stage of this run wrote, skipped and failed."""

    def __init__(self):
        super().__init__()
        self.tallies: dict[str, dict] = {}


def run(
    spark: SparkSession, config: Config, pages: DataFrame, ask: Callable, models: list[tuple[str, str]], references: DataFrame | None = None, regions: DataFrame | None = None, detector: str = "precomputed",
    limits: Limits | None = None, extra: dict[str, Callable] | None = None,
) -> Made:
    """The configured stages over a folder; each reads what the one before wrote and adds what is missing. Gives the rows of each stage's artifact, and tallies.

    A stage's tally: rows written without and with an error (the latter as failed, though they are kept), rows passed over as done; pages without a link fail, and
    what can't be normalised.
    """
    out, made, names = config.output, Made(), tuple(m for m, _ in models)
    here = lambda stage: artifacts.read(spark, out, stage)

    def added(rows: DataFrame, stage: str, tally: Tally) -> None:
        artifacts.append(rows, out, stage)
        made.tallies[stage], made[stage] = tally.counts(), here(stage).count()

    def counted(rows: DataFrame, stage: str, mode: str, failed: Column, tally: Tally) -> DataFrame:
        held = artifacts.marked(rows, here(stage), mode)
        return tally.of(held, F.when(F.col(artifacts.SEEN), "skipped").when(failed, "failed").otherwise("written"))

    if "sample" in config.stages:
        own = pages.orderBy("page_id").limit(config.sample) if config.sample is not None else pages
        tally, bare = Tally(), F.coalesce(F.col("source_uri"), F.lit("")) == ""
        added(counted(own, "pages", "page", bare, tally).filter(~F.col(artifacts.SEEN) & ~bare), "pages", tally)
    if "layout" in config.stages:
        tally, none = Tally(), F.lit(False)
        added(layout(counted(here("pages"), "layout", "page", none, tally).filter(~F.col(artifacts.SEEN)), regions, detector), "layout", tally)
    if "ocr" in config.stages:
        ready, tally = here("layout") if artifacts.shards(spark, out, "layout") else here("pages"), Tally(names)
        work = artifacts.marked(_by_model(ready, models), here("raw"), config.resume)
        said = answered(work.filter(~F.col(artifacts.SEEN)), ask, ("page_id", "source_uri", "model"), limits)
        passed = work.filter(F.col(artifacts.SEEN))
        rows = tally.of(said.unionByName(passed, allowMissingColumns=True), F.when(F.col(artifacts.SEEN), "skipped").when(stats.failed(), "failed").otherwise("written"))
        added(rows.filter(~F.col(artifacts.SEEN)), "raw", tally)
    if "normalize" in config.stages:
        tally = Tally(names)
        added(normalize(here("raw"), references, here("train"), config.comparisons, config.categories, extra=extra, tally=tally), "train", tally)
    return made


def prompts(pages: DataFrame, by_category: dict[str, str], preferred: str | None, templates: dict[str, str]) -> DataFrame:
    """(page_id, at, prompt) for each region: the template of its category, with the region's size filled in."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string, string>")
    each = pages.select("page_id", F.posexplode("regions").alias("at", "r"))
    mode = scalars.prompt_mode(F.col("r.category"), table(by_category), F.lit(preferred).cast("string"), table(templates))
    size = [F.floor(F.col(f"r.bbox.{b}") - F.col(f"r.bbox.{a}")) for a, b in (("l", "r"), ("t", "b"))]
    return each.select("page_id", "at", scalars.with_size(F.try_element_at(table(templates), mode), *size).alias("prompt"))
