import json

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import comparison, costs, stats
from pagewright.plans import pipeline, publish, registry
from pagewright.sources import artifacts, files
from pagewright.streaming import incremental


def pages(spark, n=6):
    return spark.createDataFrame([(f"p{i}.jpg", f"v/p{i}.jpg", "b1", i, f"s3://x/p{i}.jpg" if i != 4 else "", 100 if i else 0, 200) for i in range(n)], "page_id string, file_id string, barcode string, sequence long, source_uri string, width long, height long")


def ask(row):
    """A stand-in for a model: one page fails, models differ by a word."""
    if row["page_id"].startswith("p3"):
        raise RuntimeError("no answer")
    return f"# Title\n\nbody of {row['page_id']} by {row.get('model') or 'x'}", 7


def test_pipeline_resumes(spark, tmp_path):
    config = pipeline.Config(output=f"file://{tmp_path}/run")
    references = spark.createDataFrame([("p0.jpg", "Title body of p0.jpg by a")], "page_id string, reference_text string")
    models = [("a", "markdown"), ("b", "markdown")]
    first = pipeline.run(spark, config, pages(spark), ask, models, references)
    assert first == {"pages": 5, "raw": 10, "train": 8}  # one page without a link, two failures
    assert pipeline.run(spark, config, pages(spark), ask, models, references) == first
    assert pipeline.run(spark, config, pages(spark, 7), ask, models, references) == {"pages": 6, "raw": 12, "train": 10}
    train = artifacts.read(spark, config.output, "train")
    row = train.filter("page_id = 'p0.jpg' and model = 'a'").first()
    assert row.text == "Title\n\nbody of p0.jpg by a" and row.text_wer == 0 and json.loads(row.metrics_json) == {"tokens": "7", "item_count": "2", "text_length": str(len("Titlebody of p0.jpg by a"))}
    assert train.filter("page_id = 'p1.jpg'").first().text_cer is None and row.width is None
    held = publish.stage(spark, config.output, f"file://{tmp_path}/published", "demo", config=config.dump())
    assert held["overall"]["n_models"] == 2 and held["overall"]["size_category"] == "n<1K" and (tmp_path / "published/README.md").read_text().startswith("---\nsize_categories")
    assert 0 < held["top"][0]["disagreement"] < 1
    with pytest.raises(FileNotFoundError):
        publish.stage(spark, f"file://{tmp_path}/nothing", f"file://{tmp_path}/x", "demo")
    assert pipeline.Config.load(config.dump(), sample=3).sample == 3


def test_costs_of_pages(spark):
    raw = pages(spark, 2).withColumn("model", F.lit("a"))
    requests = spark.createDataFrame([("p0.jpg", "a", 0.5, 10, 20, 100.0, 103.0), ("p0.jpg", "a", 0.25, 1, 2, 101.0, 102.0), ("p0.jpg", "a", 9.0, 9, 9, None, 1.0), ("gone", "a", 1.0, 1, 1, 0.0, 1.0)], schemas.schema("requests"))
    got = {r.page_id: r for r in pipeline.with_costs(raw, requests, "L4").collect()}
    r = got["p0.jpg"]
    assert (r.litellm_cost, r.input_tokens, r.output_tokens, r.elapsed_seconds, r.cost_per_hour, r.provider) == (0.75, 11, 22, 3.0, 0.8925, "ovhcloud")
    assert abs(r.gpu_time_cost - 3 / 3600 * 0.8925) < 1e-12 and got["p1.jpg"].gpu_time_cost is None and got["p1.jpg"].litellm_cost is None
    back = spark.createDataFrame([("p", 1.0, 1, 1, 5.0, 3.0)], "page_id string, cost double, tokens_in long, tokens_out long, start_s double, end_s double")
    assert costs.page_costs(back).first().elapsed_seconds == 0


def test_resume_keys(spark):
    new = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "m"), (None, "m")], "page_id string, model string")
    done = spark.createDataFrame([("a", "m"), (None, "m"), ("b", None)], "page_id string, model string")
    key = lambda r: (r.page_id or "", r.model)
    assert sorted(map(tuple, artifacts.unseen(new, done, "page_model").collect()), key=str) == sorted([("a", "n"), ("b", "m"), (None, "m")], key=str)
    assert [key(r) for r in artifacts.unseen(new, done, "page").collect()] == [("", "m")]
    assert artifacts.unseen(new, done, "off").count() == 4


def test_volumes_and_tolerant_reading(spark, tmp_path):
    out = f"file://{tmp_path}/a"
    artifacts.write_volumes(spark.createDataFrame([("b1", "old", "u1"), ("b1", "new", "u2"), ("b2", "x", None)], "barcode string, title string, source_uri string"), out)
    assert sorted((r.barcode, r.title) for r in artifacts.read(spark, out, "volumes").collect()) == [("b1", "new"), ("b2", "x")]
    artifacts.append(pages(spark), out, "pages")
    (tmp_path / "a/data/pages-00000.parquet").write_bytes(b"not parquet")
    assert artifacts.shards(spark, out, "pages") and artifacts.resolve(spark, f"{out}/data/pages/*.parquet")
    paths = artifacts.resolve(spark, f"{out}/data/pages/*.parquet") + [f"{out}/data/pages-00000.parquet"]
    assert artifacts.read_projected(spark, paths, "page_id", "file_id").count() == 6
    assert artifacts.read_projected(spark, paths, "nothing").count() == 0
    assert artifacts.read(spark, f"file://{tmp_path}/none", "raw").count() == 0


def test_defaults(spark):
    df = spark.createDataFrame([("p", "", "{bad", ""), ("q", "f", '{"a": "1"}', "e"), (None, "f", None, None)], "page_id string, file_id string, metrics_json string, error string")
    assert [(r.file_id, r.metrics, r.error) for r in artifacts.with_defaults(df).collect()] == [("p", {}, None), ("f", {"a": "1"}, "e")]


def test_layout_stage(spark):
    regions = json.dumps([{"id": 1, "category": "text", "bbox": [0, 100, 90, 200]}, {"category": "text", "bbox": [1, 2, 3]}, {"category": "title", "bbox": [0, 0, 90, 90]}, {"nothing": 1}, {"category": "dot", "bbox": [0, 0, 5, 5]}])
    detected = spark.createDataFrame([("p0.jpg", "[]", 1), ("p0.jpg", regions, 2), ("p1.jpg", "broken", 1)], "page_id string, regions_json string, at int")
    found = files.precomputed_regions(pages(spark, 3), detected, ["at"])
    got = {r.page_id: [x.category for x in r.regions] for r in pipeline.layout(pages(spark, 3), found.select("page_id", "regions"), "precomputed").collect()}
    assert got == {"p0.jpg": ["title", "text"], "p1.jpg": [], "p2.jpg": []}
    rows = pipeline.layout(pages(spark, 3), found.select("page_id", "regions"), "precomputed")
    put = {r.page_id: json.loads(r.raw_payload) for r in pipeline.recognise_regions(rows, "m", lambda r: (f"{r['category']}!", 1)).collect()}
    assert [b["text"] for b in put["p0.jpg"]] == ["title!", "text!"] and put["p1.jpg"] == []
    made = pipeline.prompts(rows, {"title": "t"}, None, {"x": "all {width}", "t": "title {height}"}).orderBy("at").collect()
    assert [r.prompt for r in made] == ["title 90", "all 90"]


def test_files(spark, tmp_path):
    for name in ("in/a.JPG", "in/b/c.png", "in/notes.txt", "refs/a.txt", "refs/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = files.image_pages(spark, f"file://{tmp_path}/in")
    assert sorted((r.page_id, r.file_id) for r in got.collect()) == [("a.JPG", "in/a.JPG"), ("c.png", "in/c.png")]
    assert files.image_pages(spark, f"file://{tmp_path}/in", sample=1).count() == 1
    refs = {r.page_id: r.reference_text for r in files.text_references(spark.createDataFrame([("a.JPG",), ("x/c.png",), ("none.png",)], "page_id string"), f"file://{tmp_path}/refs").collect()}
    assert refs == {"a.JPG": "refs/a.txt", "x/c.png": "refs/c.txt", "none.png": None}
    held = files.with_bytes(got, f"file://{tmp_path}/in").filter("page_id = 'a.JPG'").first()
    assert bytes(held.image.bytes) == b"in/a.JPG"
    texts = spark.createDataFrame([("item-000007/item-000007-00000009-0002.txt", "t")], "path string, text string")
    rows = spark.createDataFrame([("9", "7", 2), ("x", "7", 2)], "page_id string, item_id string, sequence int")
    assert {r.page_id: (r.reference_text, r.reference_provenance and r.reference_provenance.method) for r in files.archive_references(rows, texts).collect()} == {"9": ("t", "ocr"), "x": (None, None)}
    named = files.row_pages(spark.createDataFrame([(0, "", "http://h/q/z.jpg?x=1"), (1, "id1", None), (2, None, None)], "i int, id string, url string"), "set", "i", "url").orderBy("page_id").collect()
    assert [(r.page_id, r.file_id) for r in named] == [("id1", "set/id1"), ("row_000002", "set/row_000002"), ("z.jpg", "set/z.jpg?x=1")]


def test_statistics_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [("f1", None, None, 0, {"text_length": "NaN"}), ("f2", "", "", 5, {"text_length": "4"}), ("f3", "m", "boom", 9, {}), ("f4", "m", None, None, {})],
        "file_id string, model string, error string, tokens long, metrics map<string, string>",
    ).withColumn("output_format", F.lit(None).cast("string"))
    got = {r.model: r for r in stats.per_model(rows, ("text_length",)).collect()}
    assert (got["?"].pages_ok, got["?"].total_tokens, got["?"].mean_tokens, got["?"].mean_text_length) == (2, 5, 5.0, 4.0)
    assert (got["m"].pages_ok, got["m"].pages_errored, got["m"].total_tokens, got["m"].mean_tokens) == (1, 1, 0, None)
    assert stats.find_page(rows.withColumn("page_id", F.concat(F.lit("p"), "file_id")), "pf3").first().file_id == "f3"
    assert stats.shown_columns(rows, ["tokens", "output_format"]) == ["tokens"]
    with pytest.raises(ValueError):
        stats.cost_rollup(rows, "page_id")
    parts = spark.createDataFrame([(3, 1, 10, 5.0, 60.0), (1, 0, 5, 9.0, 0.0)], "pages_ok long, pages_failed long, tokens long, gpu_peak_mb double, seconds double")
    assert tuple(stats.merged_metrics(parts).first()) == (4, 1, 15, 9.0, 60.0, 240.0)
    assert stats.merged_metrics(parts.filter("seconds = 0")).first().pages_per_hour is None
    assert [r[0] for r in spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({},)], "m map<string, double>").select(stats.canonical_score("m")).collect()] == [1.5, 0.0]
    index = spark.createDataFrame([("b", 1, ["x"], 0.5), ("a", 9, [], 0.5), ("c", 9, ["x", "y"], 0.1)], "file_id string, char_count long, error_models array<string>, disagreement double")
    assert [[r.file_id for r in stats.ordered_pages(index, by).collect()] for by in ("file_id", "chars", "errors", "disagreement")] == [["a", "b", "c"], ["a", "c", "b"], ["c", "b", "a"], ["a", "b", "c"]]


def test_choices():
    assert comparison.chosen(None, True) == comparison.ALL and comparison.chosen(["none"], True) == () and comparison.chosen(None, False) == () and comparison.chosen(["text"], True) == ("text",)
    with pytest.raises(ValueError):
        comparison.chosen(["nothing"], True)
    assert pipeline.source_options(["a=1", 'b=["x"]', "c=plain"]) == {"a": 1, "b": ["x"], "c": "plain"}
    with pytest.raises(ValueError):
        pipeline.Config(output="x", stages=("nothing",))


def test_registry():
    assert registry.get("normalizers", "markdown").__name__ == "markdown_document" and "precomputed" in registry.names("layout_detectors")
    registry.register("benchmarks", "mine", 1)
    assert registry.get("benchmarks", "mine") == 1
    with pytest.raises(ValueError):
        registry.register("benchmarks", "mine", 2)
    with pytest.raises(ValueError):
        registry.register("normalizers", "markdown", None)
    with pytest.raises(KeyError):
        registry.get("sources", "nothing")
    for group in registry.groups():
        assert all(registry.get(group, n) is not None for n in registry.names(group))


def test_streams(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("p1", "p1", "m", "markdown", "x"), ("p1", "p1", "m", "markdown", "x"), ("p2", "p2", "m", "markdown", "y")], "page_id string, file_id string, model string, output_format string, raw_payload string")
    rows.write.parquet(source)
    stream = incremental.follow(spark, source, rows.schema)
    incremental.stage_by_batch(stream, out, "raw", f"file://{tmp_path}/c1").awaitTermination()
    assert artifacts.read(spark, out, "raw").count() == 2
    rows.limit(1).withColumn("model", F.lit("n")).write.mode("append").parquet(source)
    incremental.stage_by_batch(incremental.follow(spark, source, rows.schema), out, "raw", f"file://{tmp_path}/c1").awaitTermination()
    incremental.stage_by_batch(incremental.follow(spark, source, rows.schema), out, "raw", f"file://{tmp_path}/c2").awaitTermination()  # all over again adds nothing
    assert artifacts.read(spark, out, "raw").count() == 3
    incremental.to_folder(incremental.new_keys(stream), f"{out}/plain", f"file://{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{out}/plain").count() == 3
