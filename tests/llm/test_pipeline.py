from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from pagewright.llm.op3_toxicity import toxicity
from pagewright.llm.op9_quality import quality

from .test_exact_and_shards import lowered
from .test_packing import check
from .test_similar import components

SMALL = "/root/testdata/sf0.01"


def by_id(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text or ""))


def stages(spark, docs, sf_dir):
    """(name, rows before, rows or result after) of each stage."""
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        if name != "packing":
            assert after.columns == docs.columns
        yield name, docs, after
        docs = after.checkpoint()


def largest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    return [r for r in rows if r.doc_id is None or r.doc_id == max(i for i in groups[lowered(r.text)] if i is not None)]


def least(rows):
    """What stays where all pairs are compared by the similarity of their five-word shingles."""
    first = dict(components(rows))
    return [r for r in rows if r.doc_id is None or r.doc_id == first[r.doc_id]]


def test_stages(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, docs, after in stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL):
        rows = docs.collect()
        if name == "quality":
            stay = {r.doc_id for r in quality(docs).filter("kept").collect()}
            want = [r for r in rows if r.doc_id in stay]
        elif name == "toxicity":
            stay = {r.doc_id for r in toxicity(docs, labels).filter("predicted = 0").collect()}
            got = {r.doc_id for r in after.collect()}
            assert got == stay
            continue
        elif name == "exact_dedup":
            want = largest(rows)
        elif name == "near_dedup":
            want = least(rows)
        else:
            check(rows, after.collect(), 1024)
            continue
        assert by_id(after.collect()) == by_id(want), name
        assert 0 < len(want) <= len(rows) - (name != "near_dedup")


def test_odd_rows(spark, odd, tmp_path):
    """What each stage makes of nulls, empty and long texts, repeated rows and clashing names; of an empty table nothing."""
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert all(after.count() == 0 for _, _, after in stages(spark, odd.limit(0), str(tmp_path)))
    rows = odd.collect()
    text = lambda r: (r.doc_id, r.text)
    exact, near = ([text(r) for r in stage(spark, odd, str(tmp_path)).collect()] for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup))
    assert sorted(exact, key=str) == sorted(map(text, largest(rows)), key=str)
    assert (None, "null id") in near and (0, None) in near and (1, "") not in near and (2, " ") not in near and near.count((3, "a")) == 3 and (4, "a") not in near
    for stage in (corpus_pipeline.quality, corpus_pipeline.toxicity):
        out = stage(spark, odd, str(tmp_path)).collect()
        assert all(r in rows for r in out) and len(out) <= len(rows)
    packed = corpus_pipeline.packing(spark, odd, str(tmp_path)).collect()
    check(rows, packed, 1024)


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[0] == "doc_id" and got.count() > 0


def test_stages_with_clashing_names(spark, odd):
    """Columns named as those that the stages make on their way go through."""
    names = ["__terms", "terms", "dropped_id", "dropped_h", "__dropped_id", "__dropped_h", "keep_id", "h", "id", "size", "kept", "score", "prefix", "digest", "node", "fingerprint", "group_size", "key", "rep"]
    docs = odd
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, docs, SMALL)
        assert name == "packing" or after.columns == docs.columns
        assert after.count() > 0
