import json

from pyspark.sql import functions as F

from pagewright.functions import markup, scalars
from pagewright.operators import documents


def kinds(text):
    return [(b["kind"], b["payload"], b["level"]) for b in markup.blocks(text)]


def test_blocks():
    assert kinds("# T\n#T2\n####### x\n#\n## ") == [("heading", "T", 1), ("heading", "T2", 1), ("heading", "x", 6)]
    assert kinds("one\n  two \n\nthree") == [("paragraph", "one two", 0), ("paragraph", "three", 0)]
    assert kinds("| a | b |\n|---|---|\n| 1 | 2 |\nrest") == [("pipe_table", "| a | b |\n|---|---|\n| 1 | 2 |", 0), ("paragraph", "rest", 0)]
    assert kinds("| a | b |\n| 1 | 2 |") == [("paragraph", "| a | b | | 1 | 2 |", 0)]
    assert kinds("x <TABLE a=1><tr><td>1</table> y <table><td>2</table>") == [("paragraph", "x", 0), ("html_table", "<TABLE a=1><tr><td>1</table>", 0), ("paragraph", "y", 0), ("html_table", "<table><td>2</table>", 0)]
    assert kinds("<table> open") == [("paragraph", "<table> open", 0)] and kinds("") == [] and kinds(None) == []


def cells(t):
    return [(c["text"], c["r0"], c["c0"], c["row_span"], c["col_span"], c["column_header"]) for c in t["cells"]]


def test_pipe_tables():
    t = markup.table("| a | b | c |\n|:--|:--:||\n| 1 |\n| - | x |\n")
    assert (t["num_rows"], t["num_cols"]) == (3, 3) and [c[0] for c in cells(t)] == ["a", "b", "c", "1", "-", "x"] and cells(t)[0][-1] and not cells(t)[3][-1]
    assert not markup.is_delimiter(["-"]) and markup.is_delimiter(["--", ""]) and not markup.is_delimiter(["", ""])
    assert markup.table("")["num_rows"] == 0 and markup.table(None)["cells"] == [] and [c[0] for c in cells(markup.table("<otsl><fcel>a"))] == ["a"]


def test_html_tables():
    t = markup.table("<table><thead><tr><td rowspan=2>a<td colspan='0'>b</thead><tr><th> c\n d </th><td colspan=x>e</table>")
    assert [c[0] for c in cells(t)][-1] == "e"
    u = markup.html_table("<table><thead><tr><td rowspan=2>a</td><td colspan=2>b</td></tr></thead><tr><th> c\n <b>d</b> </th><td>e</td></tr><tr><td>open</table>")
    assert cells(u) == [("a", 0, 0, 2, 1, True), ("b", 0, 1, 1, 2, True), ("c d", 1, 1, 1, 1, True), ("e", 1, 2, 1, 1, False), ("open", 2, 0, 1, 1, False)]
    assert (u["num_rows"], u["num_cols"]) == (3, 3)


def test_sequence_tables():
    t = markup.table("<otsl><ched>A<ched>B<lcel><nl><fcel>1<ecel><FCEL> x  y<nl><ucel><fcel>2<xcel></otsl>")
    assert cells(t) == [("A", 0, 0, 1, 1, True), ("B", 0, 1, 1, 2, True), ("1", 1, 0, 2, 1, False), ("", 1, 1, 1, 1, False), ("x y", 1, 2, 1, 1, False), ("2", 2, 1, 1, 1, False)]
    assert (t["num_rows"], t["num_cols"]) == (3, 3)
    assert [c[0] for c in cells(markup.table("| a <nl> | b |\n|---|---|\n| 1 | 2 |"))] == ["a <nl>", "b", "1", "2"]
    assert [c[0] for c in cells(markup.table("<XCEL><fcel>a"))] == ["a"]


def test_odd_html():
    rows = lambda t: [(c[0], c[1], c[2]) for c in cells(markup.html_table(t))]
    assert rows("<tr><td>lost</tr><tr><td>a</td><td>b</td></tr>") == [("a", 1, 0), ("b", 1, 1)]
    assert rows("<td>no row</td>") == [] and markup.html_table("<tr></tr><tr>")["num_rows"] == 1
    assert rows("<tr><td>&amp;<br>x</td></tr>") == [("&x", 0, 0)]
    wide = markup.html_table("<tr><td rowspan='2' colspan=' 2 '>a</td><td>b</td></tr><tr><td>c</td></tr>")
    assert [(c["c0"], c["c1"]) for c in wide["cells"]] == [(0, 2), (2, 3), (2, 3)]


def test_a_bad_block_costs_itself_alone():
    blocks = '[{"category": "heading", "level": Infinity, "text": "x"}, {"category": "Text", "text": "kept"}, {"category": ["a"], "text": "y"}]'
    assert [i["text"] for i in documents.from_layout("p", blocks)["items"]][:1] == ["kept"]
    assert documents.from_layout("p", "[" * 200_000) is None


def test_layout_json():
    good = {"category": "Text", "text": " t ", "bbox": [0, 1, 2, 3]}
    blocks = [good, 7, {"category": "Title", "text": "x", "bbox": [1, 2, 3]}, {"category": "heading", "level": 9, "text": "h"}, {"category": "heading", "level": "two"}, {"text": None}, {"category": "Weird"}, {"category": "picture", "bbox": [1, 1, 2, 2]}]
    doc = documents.from_layout("p", json.dumps(blocks), width=10, height=20)
    assert [(i["label"], i["text"], i["level"]) for i in doc["items"]] == [("text", "t", 0), ("section_header", "h", 6), ("text", "", 0), ("text", "", 0), ("picture", "", 0)]
    assert doc["items"][0]["bbox"] == {"l": 0, "t": 1, "r": 2, "b": 3}
    assert documents.from_layout("p", "{}") is None and documents.from_layout("p", "nonsense") is None and documents.from_layout("p", None) is None
    assert documents.from_layout("p", json.dumps([{"category": "Kopf", "text": "x"}]), {"Kopf": "page_header"})["items"][0]["label"] == "page_header"


def test_documents_in_columns(spark):
    md = "# T\n\npara | one\n\n## S\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    df = spark.createDataFrame([("p", md, "x"), ("q", None, None)], "id string, a string, b string")
    df = df.select("id", documents.markdown_document("id", "a").alias("d"), documents.markdown_document("id", "b").alias("e"))
    r = df.select("id", documents.item_counts(F.col("d")).alias("n"), documents.statistics(F.col("d")).alias("s"), documents.rendered(F.col("d")).alias("md"), documents.deltas(F.col("d"), F.col("e")).alias("x"), documents.regions(F.col("d")).alias("g"), documents.sections(F.col("d")).alias("v")).collect()
    assert r[0].n == {"title": 1, "paragraph": 1, "section_header": 1, "__tables__": 1, "__pictures__": 0} and tuple(r[0].s) == (4, 12)
    assert r[0].md == "# T\n\npara | one\n\n## S\n\n| a | b |\n|---|---|\n| 1 | 2 |" and markup.blocks(r[0].md) == markup.blocks(md)
    assert r[0].x.heading_count_delta == 2 and r[0].x.table_count_delta == 1 and r[0].g == [] and [x.text for x in r[0].v][-1] == "[table]"
    assert tuple(r[1].s) == (0, 0)


def test_labels_and_sizes(spark):
    df = spark.createDataFrame([('<think>{"label":"a"}</think>{"label":"b"}',), ('{"label":"z"}',), ("none",), ('so {"why": {"x": {"y": 1}}, "label": "a"} {"label":"b"}',)], "x string")
    assert [r[0] for r in df.select(markup.label_of(F.col("x"), ["a", "b"])).collect()] == ["b", None, None, "a"]
    sizes = spark.createDataFrame([("12G",), ("12g",), ("1.5KB",), ("7",), ("x",), ("",)], "x string")
    assert [r[0] for r in sizes.select(scalars.byte_count(F.col("x"))).collect()] == [12 * 1024**3, 12 * 10**9, 1536, 7, None, None]
    assert [r[0] for r in spark.createDataFrame([("3B",), ("1.7",), ("750m",), ("big",)], "x string").select(scalars.parameter_count(F.col("x"))).collect()] == [3 * 10**9, 1_700_000_000, 750_000_000, None]


def test_snippet_and_durations(spark):
    df = spark.createDataFrame([([" a ", "", "b\nc"],), ([],), (["x" * 30, "y"],)], "t array<string>")
    assert [r[0] for r in df.select(scalars.snippet(F.col("t"), 20)).collect()] == ["a · b c", "(no text items)", "x" * 19 + "…"]
    assert [r[0] for r in spark.createDataFrame([(5.24,), (61.0,), (3720.0,), (None,)], "s double").select(scalars.human_duration(F.col("s"))).collect()] == ["5.2s", "1m01s", "1h02m", None]


def test_arguments(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "c": "3"},)], "m map<string, string>")
    inside, rest = scalars.allowed(F.col("m"), ["a", "b"])
    assert tuple(df.select(inside, rest).first()) == ({"a": "1"}, {"c": "3"})


def test_labels_of_long_and_odd_answers(spark):
    """A megabyte of nested objects, braces and quotes within strings, what isn't closed, isn't JSON or names no known label."""
    deep = '{"label": "a", "why": [' + ", ".join('{"k": {"v": {"w": {"x": "}{"}}}}' for _ in range(30_000)) + "]}"
    cases = {
        deep: "a", '{"label": "b", "why": "' + "x" * 1_000_000 + '"} and {"label": "a"}': "b", r'{"why": "\\\"}{", "label": "a"}': "a", '{"label": "a"': None, '{"label": "a", }': None, "{" * 100_000: None,
        '{"label": "c"}': None, '{"label": ["a"]}': None, '{"label": 1}': None, "{}": None, "": None, None: None, 'x</think>{"label": "a"}</think>{"label": "b"}': "a", '{"label": "b"}</think>none': None,
    }
    assert len(deep) > 900_000
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").repartition(2)
    got = {r.i: r.l for r in df.select("i", markup.label_of(F.col("x"), ["a", "b"]).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
