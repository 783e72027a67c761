"""The stage data source, footers read in tasks, the ledger of fetched texts, routing of sources, catalog rows, places in an order."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from pagewright.operators import sampling, stats
from pagewright.sources import artifacts, catalog, files, ledger, stage_source

from .test_artifacts import pages


def test_stage_source(spark, tmp_path):
    stage_source.register(spark)
    out = f"file://{tmp_path}/run"
    own = artifacts.conform(pages(spark).repartition(3), "pages")
    own.write.format(stage_source.NAME).option("path", out).option("stage", "pages").option("shard_rows", 2).mode("append").save()
    read = lambda **o: spark.read.format(stage_source.NAME).options(path=out, **o).load()
    key = lambda df: sorted((r.page_id, r.width) for r in df.collect())
    assert read().schema == own.schema and key(read()) == key(own)
    manifests = list((tmp_path / "run/data").glob("_manifest-pages-*.json"))
    held = json.loads(manifests[0].read_text())
    assert held["rows"] == 6 and len(held["shards"]) >= 3 and max(n for _, n in held["shards"]) <= 2
    raw = artifacts.conform(pages(spark, 2).coalesce(1).withColumn("model", F.lit("m")), "raw")
    raw.write.format(stage_source.NAME).option("path", out).option("stage", "raw").mode("append").save()
    assert read().count() == 6 and read(stage="raw").count() == 2  # the earlier stage counts unless one is named
    own.limit(1).write.format(stage_source.NAME).option("path", out).option("stage", "pages").mode("overwrite").save()
    assert read().count() == 1 and read(stage="raw").count() == 2
    one = next((tmp_path / "run/data").glob("raw-*.parquet"))
    assert spark.read.format(stage_source.NAME).option("path", f"file://{one}").load().count() == 2
    old = tmp_path / "old"
    old.mkdir()
    pages(spark, 3).select("page_id").toPandas().to_parquet(old / "layout-00000.parquet")
    assert spark.read.format(stage_source.NAME).option("path", str(old)).load().filter("regions_json is null").count() == 3
    assert spark.read.format(stage_source.NAME).option("path", f"{tmp_path}/nothing").load().count() == 0


def test_aborted_write_leaves_nothing(spark, tmp_path):
    stage_source.register(spark)

    def fails(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("task lost")

    own = artifacts.conform(pages(spark), "pages")
    with pytest.raises(Exception, match="task lost"):
        own.mapInArrow(fails, own.schema).write.format(stage_source.NAME).option("path", f"file://{tmp_path}/run").option("stage", "pages").mode("append").save()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_footers_of_many_shards(spark, tmp_path):
    for k in range(120):
        pages(spark, 1).select("page_id").toPandas().to_parquet(tmp_path / f"pages-{k:05d}.parquet") if k < 1 else (tmp_path / f"pages-{k:05d}.parquet").write_bytes((tmp_path / "pages-00000.parquet").read_bytes())
    (tmp_path / "pages-00007.parquet").write_bytes(b"PAR1 no footer")
    (tmp_path / "pages-00008.parquet").write_bytes((tmp_path / "pages-00000.parquet").read_bytes()[:60])
    pages(spark, 2).select("file_id").toPandas().to_parquet(tmp_path / "pages-00009.parquet")
    paths = artifacts.resolve(spark, f"file://{tmp_path}/pages-*.parquet") + [f"file://{tmp_path}/gone.parquet"]
    got = {r.path.rpartition("/")[2]: r for r in artifacts.footers(spark, paths, "page_id", files_a_task=20).collect()}
    bad = {k: r.reason for k, r in got.items() if r.reason}
    assert len(got) == 121 and set(bad) == {"pages-00007.parquet", "pages-00008.parquet", "pages-00009.parquet", "gone.parquet"}
    assert bad["pages-00009.parquet"] == "lacks page_id" and got["pages-00009.parquet"].rows == 2 and "FileNotFoundError" in bad["gone.parquet"] and bad["pages-00007.parquet"].startswith("Arrow")
    assert artifacts.read_projected(spark, paths, "page_id").count() == 117


def test_ledger(spark, tmp_path):
    """Tags and bytes lie in files that stand for a store; a log has what was read."""
    store, out = tmp_path / "store", f"file://{tmp_path}/ledger"
    store.mkdir()

    def put(name, tag, data):
        (store / f"{name}.tag").write_text(tag)
        (store / name).write_bytes(data)

    def tag_of(url):
        with open(f"{store}/log", "a") as log:
            log.write(f"tag {url}\n")
        if url == "broken":
            raise ConnectionError("refused")
        try:
            return open(f"{store}/{url}.tag").read()
        except FileNotFoundError:
            return None

    def fetch(url):
        with open(f"{store}/log", "a") as log:
            log.write(f"read {url}\n")
        return open(f"{store}/{url}", "rb").read()

    def log():
        lines = (store / "log").read_text().split("\n") if (store / "log").exists() else []
        (store / "log").write_text("")
        return sorted(x for x in lines if x)

    put("a", "1", b"first \xff")
    put("b", "1", b"")
    wanted = spark.createDataFrame([("ka", "a"), ("ka", "a"), ("kb", "b"), ("kc", "c"), ("kd", "broken"), (None, "a"), ("ke", None)], "key string, url string")
    assert ledger.refresh(wanted, out, tag_of, fetch) == {"unchanged": 0, "held": 2, "missing": 1, "failed": 1}
    assert log() == ["read a", "read b", "tag a", "tag b", "tag broken", "tag c"]
    text = lambda: {r.key: r.text for r in ledger.texts(spark, out).collect()}
    assert text() == {"ka": "first �", "kb": ""}
    put("b", "2", b"second")
    put("c", "1", b"there now")
    assert ledger.refresh(wanted, out, tag_of, fetch) == {"unchanged": 1, "held": 1, "missing": 0, "failed": 1}
    assert log() == ["read b", "tag a", "tag b", "tag broken"]  # an unchanged text isn't read, a missing one isn't asked for
    assert text() == {"ka": "first �", "kb": "second"}
    assert ledger.refresh(wanted.filter("key = 'kc'"), out, tag_of, fetch, ask_again=True)["held"] == 1
    (store / "a.tag").unlink()
    put("b", "3", b"third")
    (store / "b").unlink()
    assert ledger.refresh(wanted.filter("key in ('ka', 'kb')"), out, tag_of, fetch)["missing"] == 2 and text() == {"kc": "there now"}
    last = ledger.read(spark, out).filter("key = 'kd'").first()
    assert last.state == "failed" and last.error == "ConnectionError: refused" and last.content is None

    def meddles(url):  # another refresher finishes first
        (tmp_path / "ledger/version=5").mkdir(exist_ok=True)
        return tag_of(url)

    with pytest.raises(Exception, match="(?i)exist"):
        ledger.refresh(wanted.filter("key = 'kc'"), out, meddles, fetch, force=True)
    assert text() == {"kc": "there now"} and threading.active_count() > 0


def test_routing_and_remote_results(spark, tmp_path):
    out = f"{tmp_path}/run"
    artifacts.append(pages(spark), out, "pages")
    assert artifacts.route(spark, out, sample=5, seed=None) == ("pages", {"sample": 5, "path": out})
    assert artifacts.route(spark, f"{tmp_path}") == ("images", {"path": f"{tmp_path}"})
    assert artifacts.route(spark, f"file://{out}")[0] == "images" and artifacts.route(spark, None) == ("images", {"path": None})
    assert artifacts.route(spark, out, "catalog", start=3) == ("catalog", {"start": 3})
    train = pages(spark).select("page_id", F.lit("m").alias("model"), F.lit(2.0).alias("elapsed_seconds"), F.lit(0.5).alias("gpu_time_cost"))
    artifacts.append(train, out, "train", shard_rows=2)
    (row,) = stats.cost_rollup(artifacts.results_at(spark, f"file://{out}/"), "model").collect()
    assert (row.pages, row.gpu_seconds, row.infra_cost, row.token_cost) == (6, 12.0, 3.0, 0)
    with pytest.raises(FileNotFoundError):
        artifacts.results_at(spark, f"{tmp_path}/nothing")


def test_rows_without_image_are_passed_over(spark):
    df = spark.createDataFrame([(0, (b"x", None)), (1, (None, "v/b.png")), (2, (None, None)), (3, None)], "i int, image struct<bytes: binary, path: string>")
    assert sorted(r.page_id for r in files.row_pages(df, "parent", "i").collect()) == sorted(r.page_id for r in files.row_pages(df.filter("i < 2"), "parent", "i").collect())
    bare = spark.createDataFrame([(0, b"x"), (1, None)], "i int, image binary")
    assert files.row_pages(bare, "parent", "i").count() == 1


def test_catalog_rows_and_last_volume(spark):
    rows = [("1", "10", "b", "7", "Text"), ("", "11", "b", "7", None), ("1", None, "b", "7", None), ("1", "12", "", "7", None), ("1", "13", "b", "x", None), ("1", "14", "b", " 12 ", None), ("1", "15", "b", None, None)]
    got = catalog.page_rows(spark.createDataFrame(rows, "ItemID string, PageID string, BarCode string, SequenceOrder string, PageTypeName string"))
    assert sorted((r.page_id, r.sequence, r.source_uri) for r in got.collect()) == [("10", 7, "s3://archive/images/b/b_0007.jp2"), ("14", 12, "s3://archive/images/b/b_0012.jp2")]
    tied = spark.createDataFrame([("b", 1, "old"), ("b", 2, "x"), ("b", 2, "y")], "barcode string, at int, title string")
    assert [r.title for r in catalog.volumes(tied, ("at",)).collect()] == ["y"]


def test_classified_table(spark, tmp_path):
    df = spark.createDataFrame([("Public domain", 3), ("In copyright", 2), ("?", 1), (None, 1)], "rights_json string, n long")
    out = catalog.write_classified(df, f"file://{tmp_path}/rights")
    assert sorted((r.n, r.classification, r.parsing_success) for r in out.collect()) == sorted([(3, "public_domain", True), (2, "in_copyright", True), (1, None, False), (1, None, False)], key=lambda x: (x[0], str(x[1])))
    assert catalog.parsed_share(out).first().parsed == 2
    assert catalog.write_classified(df.limit(1), f"file://{tmp_path}/rights").count() == 1


def test_prompts(spark):
    df = spark.createDataFrame([("some % text",), (None,)], "t string")
    ask = lambda **o: [r.m for r in df.select(catalog.classifier_messages(F.col("t"), ["a", "b"], **o).alias("m")).collect()]
    assert [m.role for m in ask()[0]] == ["system", "user"] and "Categories: a, b\n\nText: some % text\n\nThink" in ask()[0][1].content and ask()[1][1].content is None
    assert "Categories:\n- a\n- b: second\n\nText:" in ask(descriptions={"b": "second"})[0][1].content
    assert ask(reasoning=False, descriptions={"a": "x"})[0][1].content == "Classify this text as one of: a, b\n\nText: some % text\n\nLabel:"


def test_places_in_an_order(spark):
    """Any number of tasks, equal rows, nulls; the same places as one sorted list has."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("k")).repartition(9)
    got = sampling.indexed(df, ["k", "x"]).collect()
    rows = sorted(((r.k or "", r.x) for r in df.collect()))
    assert sorted(r["index"] for r in got) == list(range(1000)) and [(r.k or "", r.x) for r in sorted(got, key=lambda r: r["index"])] == rows
    assert sorted(r["index"] for r in sampling.index_window(df, ["k", "x"], 990, None).collect()) == list(range(990, 1000))
    assert sampling.indexed(df.limit(0), ["x"]).count() == 0
