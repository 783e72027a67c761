"""Text comparison queries: a conversation stands for a page, its turns for the models' readings of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import markup, text
from pagewright.operators import comparison, stats
from pagewright.plans.named import query, table
from pagewright.sources import catalog


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("page"), F.concat(F.lit("m"), "turn").alias("model"), "text")


_TOKENS = """
WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS page, 'm' || turn AS model, text FROM conversations),
k AS (SELECT page, model, regexp_extract_all(text, '\\S+|\\n+') AS tokens FROM r WHERE text <> ''),
c AS (SELECT page, model, token, count(*) AS n FROM (SELECT page, model, unnest(tokens) AS token FROM k) GROUP BY ALL),
s AS (SELECT a.page, a.model AS ma, b.model AS mb, len(a.tokens) + len(b.tokens) AS total FROM k a JOIN k b ON a.page = b.page AND a.model < b.model),
j AS (SELECT a.page, a.model AS ma, b.model AS mb, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.page = b.page AND a.token = b.token AND a.model < b.model GROUP BY ALL),
p AS (SELECT page, avg(1 - CASE WHEN total > 0 THEN 2 * coalesce(common, 0) / total ELSE 1 END) AS mean FROM s LEFT JOIN j USING (page, ma, mb) GROUP BY page),
d AS (SELECT page, coalesce(mean, 0.0) AS disagreement, n_models FROM (SELECT page, count(DISTINCT model) AS n_models FROM r GROUP BY page) LEFT JOIN p USING (page))
"""


@query(_TOKENS + "SELECT page, round(disagreement, 9) AS disagreement, n_models FROM d")
def page_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.disagreement(_readings(spark, sf_dir), "page", "model", "text").withColumn("disagreement", F.round("disagreement", 9))


@query(_TOKENS + "SELECT page, round(disagreement, 9) AS disagreement, n_models FROM d WHERE n_models >= 2 ORDER BY disagreement DESC, page LIMIT 10")
def top_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text.disagreement(_readings(spark, sf_dir), "page", "model", "text").withColumn("disagreement", F.round("disagreement", 9))
    return stats.top_disagreement(pages)


@query(
    _TOKENS
    + """SELECT (SELECT count(DISTINCT page) FROM r) AS n_pages, (SELECT count(DISTINCT model) FROM r) AS n_models, (SELECT count(*) FROM r) AS n_rows, (SELECT count(DISTINCT page) FROM r WHERE model = 'm5') AS n_pages_with_errors,
  round(avg(disagreement), 9) AS mean_disagreement, round(median(disagreement), 9) AS median_disagreement FROM d WHERE n_models >= 2"""
)
def overall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).withColumn("file_id", F.col("page")).withColumn("error", F.when(F.col("model") == "m5", "failed"))
    out = stats.overall(rows, text.disagreement(rows, "page", "model", "text"))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_disagreement", "median_disagreement")})


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\\S+|\\n+')) AS INTEGER) AS n_tokens, md5(array_to_string(regexp_extract_all(text, '\\S+|\\n+'), ' ')) AS joined FROM conversations")
def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.tokens("text")).alias("n_tokens"), F.md5(F.array_join(text.tokens("text"), " ").cast("binary")).alias("joined"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn and the next one: base and pred."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("base"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("base").alias("pred"))
    return a.join(b, ["conv_id", "turn"])


def _edits(cut: str, name: str) -> str:
    """SQL for (conv_id, turn, name): edits over what ``cut`` makes of t, a stripped text, of the next turn against a turn.

    DuckDB measures edits in bytes. What both sides have gets a byte of its own; what one side alone has never matches, so a byte a side does.
    """
    byte = lambda side, other: f"array_to_string(list_transform({side}, lambda w: chr(CASE WHEN list_contains(k, w) THEN CAST(2 + list_position(k, w) AS INTEGER) ELSE {other} END)), '')"
    return f"""SELECT conv_id, turn, CASE WHEN len(b) > 0 AND len(p) > 0 THEN round(levenshtein({byte("b", 1)}, {byte("p", 2)}) / len(b), 9) END AS {name}
FROM (SELECT x.conv_id, x.turn, x.own AS b, y.own AS p, list_intersect(x.own, y.own) AS k
  FROM (SELECT conv_id, turn, {cut} AS own FROM turns) x JOIN (SELECT conv_id, turn, {cut} AS own FROM turns) y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""


_TURNS = "WITH turns AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations) "
_CER = _edits("regexp_extract_all(t, '(?s).')", "cer")
_WER = _edits(r"list_filter(string_split(regexp_replace(t, '\s\s+', ' ', 'g'), ' '), lambda w: w <> '')", "wer")


@query(_TURNS + _CER)
def text_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(text.cer("base", "pred"), 9).alias("cer"))


@query(_TURNS + f"SELECT conv_id, turn, cer, wer FROM ({_CER}) JOIN ({_WER}) USING (conv_id, turn)")
def text_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both error rates of whole turns as they are."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(text.cer("base", "pred"), 9).alias("cer"), F.round(text.wer("base", "pred"), 9).alias("wer"))


@query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", text.similarity("base", "pred").alias("similarity"))


@query()
def text_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("d", text.text_comparison("base", "pred"))
    return rows.select("conv_id", "turn", *[F.col(f"d.{c}") for c in ("similarity", "common", "removed", "added", "lines_unchanged", "lines_removed", "lines_added")])


@query()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line opcodes, and how many lines have a word diff of their own."""
    rows = _pairs(spark, sf_dir).withColumn("d", text.text_comparison("base", "pred"))
    # posexplode puts a filter on its array below, for which every pair would be compared twice
    codes = rows.select("conv_id", "turn", F.size("d.inline_word_opcodes").alias("n_inline"), F.posexplode_outer("d.line_opcodes").alias("at", "o")).filter("at is not null")
    return codes.select("conv_id", "turn", "n_inline", "at", "o.*")


@query()
def text_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison envelope and the flat metrics taken back out of it."""
    rows = comparison.compare(_pairs(spark, sf_dir), ("text",), "pred", "base", base_doc=None)
    return comparison.flattened(rows.select("conv_id", "turn", F.to_json("comparisons").alias("comparisons_json"))).select("conv_id", "turn", "text_similarity", "text_cer", "text_wer")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'open' WHEN p_size % 4 = 1 THEN 'closed' END AS label, CASE WHEN length(p_name) >= 12 THEN substr(p_name, 1, 14) END AS input FROM part"""
)
def classify_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    long = F.concat(F.lit('<think>{"label": "closed"}</think> Sure: {"why": [{"of": {"age": {"said": "}{"}}}, "'), F.repeat("p_name", 2000), F.lit('"], "label": "open"} or {"label": "closed"}'))
    said = F.when(size == 0, long).when(size == 1, '{"label": "closed"}').when(size == 2, '{"label": "maybe"}').otherwise("no idea")
    return table(spark, sf_dir, "part").select("p_partkey", markup.label_of(said, ["open", "closed"]).alias("label"), markup.classifiable(F.col("p_name"), 14, 12).alias("input"))


@query("SELECT p_partkey, p_type AS open, 'b:' || p_brand AS closed, 2 AS n FROM part")
def label_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markup.label_descriptions(F.concat(F.lit(" open : "), "p_type", F.lit(" ;nothing;closed:b:"), "p_brand"))
    return table(spark, sf_dir, "part").withColumn("m", m).select("p_partkey", F.try_element_at("m", F.lit("open")).alias("open"), F.try_element_at("m", F.lit("closed")).alias("closed"), F.size("m").alias("n"))


@query(
    """SELECT p_partkey, 'You are a helpful classification assistant that thinks step by step.' AS system, 'Classify this text into one of these categories:' || chr(10) || chr(10) || 'Categories:' || chr(10) || '- open: free to use' || chr(10) || '- closed'
  || chr(10) || chr(10) || 'Text: ' || p_name || chr(10) || chr(10) || 'Think through your classification step by step, then provide your final answer in this JSON format:' || chr(10) || '{"label": "your_chosen_label"}' AS reasoned,
  'Classify this text as one of: open, closed' || chr(10) || chr(10) || 'Text: ' || p_name || chr(10) || chr(10) || 'Label:' AS short FROM part"""
)
def classifier_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier of part names is asked, with reasoning and without."""
    ask = lambda reasoning: catalog.classifier_messages(F.col("p_name"), ["open", "closed"], {"open": "free to use"}, reasoning)
    rows = table(spark, sf_dir, "part").select("p_partkey", ask(True).alias("a"), ask(False).alias("b"))
    return rows.select("p_partkey", F.col("a")[0]["content"].alias("system"), F.col("a")[1]["content"].alias("reasoned"), F.col("b")[1]["content"].alias("short"))
