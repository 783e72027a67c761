"""Document queries: lines of documents stand for blocks of pages, web pages for markup."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import markup, scalars, text
from pagewright.operators import documents
from pagewright.plans.named import query, shared_folder, spread, table
from pagewright.sources import catalog

_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made markdown: the first line a title, every third one a section, each fifth a table of its first words, an HTML table at the end."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    word = lambda line, i: F.coalesce(F.nullif(F.regexp_replace(F.try_element_at(F.split(line, r"\s+"), F.lit(i)), r"[|#<>]", ""), F.lit("")), F.lit("x"))
    row = lambda line: F.concat(F.lit("| "), word(line, 1), F.lit(" | "), word(line, 2), F.lit(" |\n|---|:--:|\n| "), word(line, 3), F.lit(" | y |"))
    plain = lambda line: F.regexp_replace(line, r"[|#<>]", "")
    made = F.transform("lines", lambda line, i: F.when(i == 0, F.concat(F.lit("# "), plain(line))).when(i % 5 == 4, row(line)).when(i % 3 == 0, F.concat(F.lit("### "), plain(line))).otherwise(F.concat(F.lit("\n"), plain(line), F.lit("\n"))))
    return rows.select("doc_id", F.concat(F.array_join(made, "\n"), F.lit("\n<table><tr><th colspan=2>h</th></tr><tr><td>a<td>b</table>")).alias("markdown"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _markdown(spark, sf_dir).select("doc_id", F.posexplode(markup.markdown_blocks("markdown")).alias("at", "b"))
    return rows.select("doc_id", "at", "b.kind", "b.level", F.length("b.payload").alias("size"))


@query(
    """SELECT p_partkey, r AS "row", c AS col, CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'name' ELSE 'size' END ELSE CASE c WHEN 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END END AS text, r = 0 AS header
FROM part, (VALUES (0), (1)) x(r), (VALUES (0), (1)) y(c)"""
)
def pipe_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("| name | size |\n|:--|---|\n| "), "p_name", F.lit(" | "), "p_size", F.lit(" |\n"))
    cells = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.explode(markup.table_cells(made)["cells"]).alias("c"))
    return cells.select("p_partkey", F.col("c.r0").alias("row"), F.col("c.c0").alias("col"), "c.text", F.col("c.column_header").alias("header"))


@query(
    """SELECT p_partkey, r0, c0, text, header, num_rows, num_cols FROM (
SELECT p_partkey, 0 AS r0, 0 AS c0, p_name AS text, true AS header, 3 AS num_rows, 3 AS num_cols FROM part UNION ALL SELECT p_partkey, 0, 1, 'b c', true, 3, 3 FROM part UNION ALL SELECT p_partkey, 1, 1, p_type, false, 3, 3 FROM part
UNION ALL SELECT p_partkey, 1, 2, '1', false, 3, 3 FROM part UNION ALL SELECT p_partkey, 2, 0, p_brand, false, 3, 3 FROM part)"""
)
def html_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in both directions, a header row, unclosed cells, a colspan that isn't one."""
    made = F.concat(F.lit("<table><thead><tr><td rowspan=2>"), "p_name", F.lit("</td><td colspan='2'>b\n <b>c</b></td></tr></thead><tr><td>"), "p_type", F.lit("</td><td colspan=x>1</td></tr><tr><td>"), "p_brand", F.lit("</table>"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", markup.table_cells(made).alias("t"))
    cells = rows.select("p_partkey", "t.num_rows", "t.num_cols", F.explode("t.cells").alias("c"))
    return cells.select("p_partkey", "c.r0", "c.c0", "c.text", F.col("c.column_header").alias("header"), "num_rows", "num_cols")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list of blocks for each part, with malformed ones in it; for every tenth no list."""
    blocks = F.concat(
        F.lit('[{"category": "Title", "text": " '), "p_name", F.lit(' ", "bbox": [0, 0, 10, '), F.col("p_size").cast("string"), F.lit("]}, 7, "),
        F.lit('{"category": "Section-header", "level": 9, "text": "s", "bbox": [1, 2, 3]}, {"category": "Section-header", "level": 9, "text": "s"}, '),
        F.lit('{"category": "Picture", "bbox": [1, 1, 5, 5]}, {"category": "Table", "text": "| a | b |\\n|---|---|\\n| 1 | 2 |"}, {"category": "Odd", "text": "'), "p_brand", F.lit('"}]'),
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 10 == 9, '{"no": "list"}').otherwise(blocks).alias("payload"))


_BLOCKS = """
WITH i AS (SELECT p_partkey, 0 AS ord, 'title' AS label, p_name AS text, 1 AS level, CAST(p_size AS DOUBLE) AS b FROM part UNION ALL SELECT p_partkey, 1, 'section_header', 's', 6, NULL FROM part UNION ALL SELECT p_partkey, 2, 'picture', '', 0, 5.0 FROM part
UNION ALL SELECT p_partkey, 3, 'table', '', 0, NULL FROM part UNION ALL SELECT p_partkey, 4, 'text', p_brand, 0, NULL FROM part)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    convert = documents.layout_document({"Section-header": "section_header"})
    return _payloads(spark, sf_dir).select("p_partkey", convert(F.col("p_partkey").cast("string"), "payload", F.lit(100.0), F.lit(200.0)).alias("document"))


@query(_BLOCKS + "SELECT p_partkey, ord, label, text, level, b FROM i WHERE p_partkey % 10 <> 9")
def layout_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # explode puts a filter on its array below, for which every document would be made twice
    items = _documents(spark, sf_dir).select("p_partkey", F.explode_outer("document.items").alias("i")).filter("i is not null")
    return items.select("p_partkey", "i.ord", "i.label", "i.text", "i.level", F.col("i.bbox.b").alias("b"))


@query(_BLOCKS + "SELECT p_partkey, CAST(5 AS BIGINT) AS item_count, CAST(length(p_name) + 1 + length(p_brand) AS BIGINT) AS text_length, p_name || chr(10) || chr(10) || 's' || chr(10) || chr(10) || p_brand AS text, 'title,picture' AS boxed, p_name || ',s,[picture],[table],' || p_brand AS shown FROM part WHERE p_partkey % 10 <> 9")
def document_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).filter("document is not null")
    s, join = documents.statistics(F.col("document")), lambda xs, k: F.array_join(F.transform(xs, lambda x: x[k]), ",")
    return rows.select("p_partkey", s["item_count"].alias("item_count"), s["text_length"].alias("text_length"), documents.plain_text(F.col("document")).alias("text"), join(documents.regions(F.col("document")), "category").alias("boxed"), join(documents.sections(F.col("document")), "text").alias("shown"))


@query()
def normalized_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of markdown and rendered again."""
    rows = _markdown(spark, sf_dir).withColumn("document", documents.markdown_document(F.col("doc_id").cast("string"), "markdown"))
    s = documents.statistics(F.col("document"))
    return rows.select("doc_id", s["item_count"].alias("item_count"), s["text_length"].alias("text_length"), F.md5(documents.rendered(F.col("document")).cast("binary")).alias("rendered"))


def _by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred: the lines of a document as items by their length; base: the same without the last three lines."""
    label = lambda line: F.when(F.length(line) % 5 == 0, "section_header").when(F.length(line) % 5 == 1, "title").when(F.length(line) % 5 == 2, "paragraph").otherwise("caption")
    kind = lambda line: F.when(F.length(line) % 7 == 0, "table").when(F.length(line) % 7 == 1, "picture").otherwise("text")
    item = lambda line, i: F.struct(i.alias("ord"), kind(line).alias("kind"), label(line).alias("label"), line.alias("text"))
    lines = F.split("text", "\n")
    doc = lambda xs: F.struct(F.transform(xs, item).alias("items"))
    return table(spark, sf_dir, "documents").select("doc_id", doc(lines).alias("pred"), doc(F.slice(lines, F.lit(1), F.greatest(F.lit(0), F.size(lines) - 3))).alias("base"))


_KINDS = (
    _LINES
    + """, k AS (SELECT doc_id, i, line, CASE WHEN length(line) % 7 = 0 THEN '__tables__' WHEN length(line) % 7 = 1 THEN '__pictures__' WHEN length(line) % 5 = 0 THEN 'section_header' WHEN length(line) % 5 = 1 THEN 'title' WHEN length(line) % 5 = 2 THEN 'paragraph' ELSE 'caption' END AS label,
  i < len(string_split(d.text, chr(10))) - 3 AS base FROM l JOIN documents d USING (doc_id)),
n AS (SELECT doc_id, label, count(*) AS p, count(*) FILTER (base) AS b FROM k GROUP BY ALL)
"""
)


@query(_KINDS + "SELECT doc_id, label, CAST(p AS INTEGER) AS pred, CAST(b AS INTEGER) AS base FROM n")
def document_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both sides by label, 0 where a side has none of it; labels that neither side has are left out."""
    rows = _by_length(spark, sf_dir)
    of = lambda c: rows.select("doc_id", F.explode(documents.item_counts(F.col(c))).alias("label", c)).filter(F.col(c) > 0)
    joined = of("pred").join(of("base"), ["doc_id", "label"], "full_outer")
    return joined.select("doc_id", "label", F.coalesce("pred", F.lit(0)).alias("pred"), F.coalesce("base", F.lit(0)).alias("base"))


@query(
    _KINDS
    + """SELECT doc_id, CAST(coalesce(sum(p - b) FILTER (label IN ('title', 'section_header')), 0) AS BIGINT) AS headings, CAST(coalesce(sum(p - b) FILTER (label = '__tables__'), 0) AS BIGINT) AS tables, CAST(coalesce(sum(p - b) FILTER (label = '__pictures__'), 0) AS BIGINT) AS pictures,
  concat_ws(' ', CASE WHEN coalesce(sum(b) FILTER (label = '__tables__'), 0) = 0 AND sum(p) FILTER (label = '__tables__') >= 3 THEN 'Baseline has no tables; prediction has ' || sum(p) FILTER (label = '__tables__') || '.' END,
   CASE WHEN coalesce(sum(b) FILTER (label = '__pictures__'), 0) = 0 AND sum(p) FILTER (label = '__pictures__') >= 3 THEN 'Baseline has no pictures; prediction has ' || sum(p) FILTER (label = '__pictures__') || '.' END) AS callouts FROM n GROUP BY doc_id"""
)
def document_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_length(spark, sf_dir).select("doc_id", documents.deltas(F.col("pred"), F.col("base")).alias("d"))
    return rows.select("doc_id", F.col("d.heading_count_delta").alias("headings"), F.col("d.table_count_delta").alias("tables"), F.col("d.picture_count_delta").alias("pictures"), F.array_join(documents.missing_callouts(F.col("d")), " ").alias("callouts"))


@query(
    """WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
n AS (SELECT doc_id, ls, list_transform(range(1, len(ls) + 1), lambda i: list_sum(list_transform(ls[1:i], lambda x: length(x)))) AS upto FROM t),
s AS (SELECT doc_id, array_to_string(ls[1:coalesce(list_position(list_transform(upto, lambda u: u >= 80), true), len(ls))], ' · ') AS line FROM n)
SELECT doc_id, CASE WHEN line = '' THEN '(no text items)' WHEN length(line) > 80 THEN substr(line, 1, 79) || '…' ELSE line END AS snippet FROM s"""
)
def doc_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.snippet(F.split("text", "\n"), 80).alias("snippet"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '\"' || c_name END AS c_name, c_mktsegment FROM customer")
def catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as a tab-separated dump with \\N and stray quotes, taken in again. The dump lies where checkpoints do."""
    root = shared_folder(spark)
    target = f"{root}/dump-{os.urandom(6).hex()}"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('"'), "c_name")).alias("c_name"), "c_mktsegment")
    rows.write.csv(f"{target}/text", sep="\t", header=True, nullValue="\\N", quote="", escapeQuotes=False)
    return catalog.ingest(spark, f"{target}/text", f"{target}/parquet")


@query("SELECT doc_id, length(trim(text)) AS size, lang IN ('en', 'de') AS chosen FROM documents")
def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.stripped("text")).cast("bigint").alias("size"), F.col("lang").isin("en", "de").alias("chosen"))
