import hashlib
import zlib
from collections import Counter, defaultdict

from pagewright.llm.op7_sharding import kd_shards, op7_sharding
from pagewright.llm.op8_exact_dedup import copies, exact_duplicates, op8_exact_dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(r.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact(spark, odd):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        rows = docs.collect()
        want = brute(rows)
        text = {r.doc_id: r.text for r in rows}
        for bound in (10**6, 0):
            got = exact_duplicates(docs, bound=bound).collect()
            assert len(got) == len(rows)
            for r in got:
                keep, n = want[lowered(text[r.doc_id])]
                assert (r.keep_id, r.group_size) == (keep, n)
                assert r.kept == (r.doc_id is None or r.doc_id == keep)
                assert r.text_sha256 == hashlib.sha256(lowered(text[r.doc_id]).encode()).hexdigest()
            pair = lambda rows: sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows if r.group_size > 1), key=str)
            assert pair(copies(docs, bound=bound).collect()) == pair(got)
    assert exact_duplicates(odd.limit(0)).count() == 0 and copies(odd.limit(0)).count() == 0


def test_exact_plan_is_native(spark):
    plan = op8_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def held(rows, texts, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    assert all(0 <= s < n for s in by)
    return [sum(r.size for r in by[s]) for s in range(n)]


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op7_sharding(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(texts)
    sizes = held(rows, texts, 40)
    assert max(sizes) < 1.05 * sum(sizes) / 40 and min(sizes) > 0.95 * sum(sizes) / 40
    of = defaultdict(set)
    for r in rows:
        of[texts[r.doc_id]].add(r.shard)
    fit = [t for t, n in Counter(texts.values()).items() if n > 1 and n * (len(t.encode()) + 16) <= sum(sizes) / 40]
    assert len(fit) > 100 and all(len(of[t]) == 1 for t in fit)


def test_groups_that_fit_stay_whole(spark):
    """Many texts of a tenth to nearly all of a shard, one of two shards, and light ones between."""
    rows = [(i, f"light {i} " + "x" * (i % 50)) for i in range(6000)]
    for g, share in enumerate([0.3, 0.12, 0.5, 0.9, 0.31, 0.2, 0.45, 0.15, 0.8, 0.33, 2.0]):
        rows += [(10_000 + 1000 * g + i, f"group {g} " + "y" * 60) for i in range(int(share * 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "if(doc_id % 3 = 0, 'a', concat('s', doc_id % 7)) as source")
    texts, count = dict(rows), Counter(t for _, t in rows)
    for n in (8, 11):
        got = kd_shards(docs, shards=n).collect()
        sizes, of = held(got, texts, n), defaultdict(set)
        for r in got:
            of[texts[r.doc_id]].add(r.shard)
        mean = sum(sizes) / n
        assert max(sizes) < 1.06 * mean and min(sizes) > 0.94 * mean
        assert all(len(of[t]) == 1 for t, c in count.items() if c * (len(t.encode()) + 16) <= mean) and any(c > 100 for c in count.values())


def test_shards_hot_text_and_odd_rows(spark, odd):
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text again and again', concat('text ', id)) as text", "'en' as lang", "'a' as source")
    texts = {r.doc_id: r.text for r in hot.collect()}
    sizes = held(kd_shards(hot, shards=7).collect(), texts, 7)
    assert max(sizes) < 1.05 * sum(sizes) / 7
    assert kd_shards(odd, shards=5).count() == odd.count()
    assert kd_shards(odd.drop("lang", "source"), target_bytes=50_000).agg({"shard": "max"}).first()[0] > 0
    assert kd_shards(odd.limit(0), shards=5).count() == 0
    same = spark.range(100).selectExpr("id as doc_id", "'x' as text")
    assert max(held(kd_shards(same, shards=4).collect(), dict.fromkeys(range(100), "x"), 4)) <= 26 * 17
