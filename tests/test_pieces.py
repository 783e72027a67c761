from pyspark.sql import functions as F

from pagewright.functions import markup, pieces, text
from pagewright.operators import comparison, documents
from pagewright.plans import named, on_documents, on_text  # noqa: F401  the latter two register queries


class Held(dict):
    """A result that knows how many of its kind there are."""

    alive = 0

    def __init__(self, **kw):
        super().__init__(kw)
        Held.alive += 1

    def __del__(self):
        Held.alive -= 1


def test_few_results_are_held_at_a_time(spark):
    """A batch of 3000 rows is given on piece by piece, and so are long texts."""
    assert pieces.ROWS < 1000

    def one(i, t):
        held = Held(i=i, n=len(t or ""))
        held["alive"] = Held.alive
        return held

    rows = spark.range(3000).coalesce(1).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))).alias("t"))
    got = rows.select("id", "t", pieces.by_pieces(one, "struct<i: bigint, n: int, alive: int>")("id", "t").alias("r")).collect()
    assert len(got) == 3000 and all(r.r.i == r.id and r.r.n == len(r.t or "") for r in got)
    assert max(r.r.alive for r in got) <= pieces.ROWS + 1

    long = spark.range(40).coalesce(1).select("id", F.repeat(F.lit("x"), pieces.SIZE // 4).alias("t"))
    assert max(r.r.alive for r in long.select(pieces.by_pieces(one, "struct<alive: int>")("id", "t").alias("r")).collect()) <= 5


def test_pieces_of_nothing(spark):
    one = pieces.by_pieces(lambda t: t and {"t": t}, "struct<t: string>")
    assert spark.createDataFrame([], "t string").select(one("t")).collect() == []
    assert [r[0] and r[0].t for r in spark.createDataFrame([("a",), (None,), ("b",)], "t string").coalesce(1).select(one("t")).collect()] == ["a", None, "b"]


def test_comparisons_are_made_by_pieces(spark, monkeypatch):
    """What Spark gives of 600 pairs is what Python gives of each."""
    made = []
    monkeypatch.setattr(text, "by_pieces", lambda *of: made.append(of) or pieces.by_pieces(*of))
    pairs = [(i, *((None, "x") if i % 50 == 0 else (f"a b\nc {i % 7}\nsame", f"a x\nc {i % 3} {i}\nsame"))) for i in range(600)]
    rows = spark.createDataFrame(pairs, "i int, b string, p string").coalesce(1)
    got = {r.i: r.d and r.d.asDict(recursive=True) for r in rows.select("i", text.text_comparison("b", "p").alias("d")).collect()}
    assert made and got == {i: text.compared(b, p) for i, b, p in pairs} and got[1]["inline_word_opcodes"]


def test_counts_of_many_comparisons(spark):
    """Counts read from comparisons of several pieces, evaluated by iterators of Arrow arrays and not by the row."""
    pairs = [(i, f"a b\nc {i % 7}\nsame", f"a x\nc {i % 3} {i}\nsame") for i in range(600)]
    d = text.text_comparison("b", "p")
    rows = spark.createDataFrame(pairs, "i int, b string, p string").coalesce(1).select("i", d["common"].alias("common"), d["lines_added"].alias("lines_added"), d["similarity"].alias("similarity"))
    want = {i: text.compared(b, p) for i, b, p in pairs}
    assert all((r.common, r.lines_added, r.similarity) == tuple(want[r.i][k] for k in ("common", "lines_added", "similarity")) for r in rows.collect())
    assert text.text_comparison.__globals__["by_pieces"] is pieces.by_pieces


def test_envelopes_of_many_comparisons(spark):
    """Flat metrics come back from the envelopes of several pieces; a pair without a side has none."""
    pairs = [(i, None if i % 50 == 0 else f"a b\nc {i % 7}", f"a x\nc {i % 3} {i}") for i in range(600)]
    rows = comparison.compare(spark.createDataFrame(pairs, "i int, b string, p string").coalesce(1), ("text",), "p", "b", base_doc=None)
    got = comparison.flattened(rows.select("i", F.to_json("comparisons").alias("comparisons_json"))).collect()
    want = {i: text.compared(b, p) for i, b, p in pairs}
    assert all(r.text_similarity == (want[r.i] and want[r.i]["similarity"]) and (r.text_wer is None) == (want[r.i] is None) for r in got) and len(got) == 600


MARKDOWN = [(i, None if i % 50 == 0 else f"# T{i}\n\npara {i % 7}\n\n| a | b |\n|---|---|\n| {i} | 2 |\n\n<table><tr><th colspan=2>h</th></tr><tr><td>a<td>{i}</table>" + "\n\nx" * (i % 5)) for i in range(600)]


def markdown(spark):
    return spark.createDataFrame(MARKDOWN, "i int, t string").coalesce(1)


def test_documents_are_made_by_pieces(spark, monkeypatch):
    made = []
    monkeypatch.setattr(documents, "by_pieces", lambda *of: made.append(of) or pieces.by_pieces(*of))
    got = {r.i: r.d.asDict(recursive=True) for r in markdown(spark).select("i", documents.markdown_document(F.col("i").cast("string"), "t").alias("d")).collect()}
    assert made and got == {i: documents.from_markdown(str(i), t) for i, t in MARKDOWN} and got[1]["items"][2]["cells"]


def test_blocks_are_made_by_pieces(spark, monkeypatch):
    made = []
    monkeypatch.setattr(markup, "by_pieces", lambda *of: made.append(of) or pieces.by_pieces(*of))
    got = {r.i: [b.asDict() for b in r.b] for r in markdown(spark).select("i", markup.markdown_blocks("t").alias("b")).collect()}
    assert made and got == {i: markup.blocks(t) for i, t in MARKDOWN}


def test_cells_are_spread_over_the_cores(spark):
    """A file that one task reads is parsed by all of them."""
    of = named.QUERIES["html_table_cells"](spark, "/root/testdata/sf0.001")
    assert of.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    made = of.select("p_partkey").distinct()
    assert made.count() == named.table(spark, "/root/testdata/sf0.001", "part").count()


def evaluations(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_layouts_are_made_once(spark):
    of = named.QUERIES["layout_json_blocks"](spark, "/root/testdata/sf0.001")
    assert evaluations(of) == 1 and of.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_lines_are_compared_once(spark):
    assert evaluations(named.QUERIES["line_diff"](spark, "/root/testdata/sf0.001")) == 1
