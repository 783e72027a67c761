import random

import numpy as np

import corpus_pipeline
from pagewright.llm import similar

from .test_simhash import sets


def shingled(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def components(rows):
    """(id, least id of the component) by comparing all pairs."""
    own = [shingled(r.text) for r in rows]
    root = sets(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if similarity(own[i], own[j]) >= 0.8])
    first = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            first[root[k]] = min(first.get(root[k], r.doc_id), r.doc_id)
    return sorted(((r.doc_id, first.get(root[k])) for k, r in enumerate(rows)), key=str)


def test_all_pairs(spark, odd):
    pick = random.Random(8)
    word = lambda: f"w{pick.randrange(5000)}"
    texts = []
    for _ in range(30):
        own = [word() for _ in range(pick.randint(60, 400))]
        for _ in range(pick.randint(1, 12)):
            changed = list(own)
            for _ in range(pick.randint(0, max(1, len(own) // 60))):
                changed[pick.randrange(len(own))] = word()
            texts.append(" ".join(changed))
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for docs in (made, odd):
        got = similar.similar_texts(docs).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == components(docs.collect())
    assert similar.similar_texts(odd.limit(0)).count() == 0


def test_stage_drops_a_copy_with_changed_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id in (875, 582, 944, 709, 1)")
    text = {r.doc_id: shingled(r.text) for r in docs.collect()}
    assert similarity(text[875], text[582]) >= 0.8 and similarity(text[944], text[709]) >= 0.8
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 582, 709]


def test_sets_meet_as_often_as_they_should():
    """Pairs of similarity 0.8 exactly differ in three of 32 bits or fewer in one of the tables, and never in more of all bits than a pair may."""
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        own = np.unique(rng.integers(0, 1 << 63, 270, dtype="u8"))[:260]
        apart = similar.fingerprints(own[:234], similar.WIDE) ^ similar.fingerprints(own[26:], similar.WIDE)  # 208 of 260 in common
        assert np.bitwise_count(apart).sum() <= similar.WIDE_BITS
        met += (np.bitwise_count(apart[: similar._WORDS64].view("u4")) <= similar.MAX_BITS).any()
    assert met >= 390


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with a word or two changed are one component, whose links are not all of its pairs."""
    pick = random.Random(3)
    base = [f"w{pick.randrange(900)}" for _ in range(150)]
    texts = []
    for i in range(1500):
        own = list(base)
        own[pick.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, " ".join(f"v{pick.randrange(10**6)}" for _ in range(80))) for i in range(300)]
    got = {r.doc_id: r for r in similar.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i].component_id for i in range(1500)} == {0} and [i for i in range(1500) if got[i].kept] == [0]
    assert all(got[5000 + i].component_id == 5000 + i and got[5000 + i].kept for i in range(300))
    # a candidate forest in each table and turn, in which a set picks one pair at a time: at most two rows a set
    nodes = spark.createDataFrame([(i, similar.fingerprints(similar.shingles(t)).view("i8").tolist()) for i, t in rows], "node long, keys array<long>")
    pairs = similar._dealt(nodes).mapInArrow(similar._spanning, "a long, b long, bits int")
    assert 1499 <= pairs.count() <= 2 * len(rows) * similar.TABLES * (similar.MAX_BITS + 1)


def test_rows_that_share_an_id_are_judged_apart(spark, tmp_path):
    docs = spark.createDataFrame([(3, "same text here"), (3, "unique text"), (9, "same text here"), (None, "same text here"), (7, "a b c d e f g h i j k"), (7, "A b c d e f g h i j k"), (8, "a b c d e f g h i j k")], "doc_id long, text string")
    kept = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert kept(corpus_pipeline.exact_dedup(spark, docs, "")) == [(3, "unique text"), (8, "a b c d e f g h i j k"), (9, "same text here"), (None, "same text here")]
    near = kept(corpus_pipeline.near_dedup(spark, docs, ""))
    assert len([x for x in near if x[0] in (7, 8)]) == 1 and (3, "unique text") in near and (3, "same text here") in near and (9, "same text here") not in near


def test_candidates_of_near_and_of_nearly_similar_copies_are_tried_once(spark):
    """Copies that differ in so many words that half of them link with none: the number of jobs doesn't follow rounds over all candidates."""
    pick = random.Random(9)
    base, texts = [f"w{pick.randrange(900)}" for _ in range(150)], []
    for i in range(250):
        own = list(base)
        for k in range(pick.randint(0, 9)):
            own[pick.randrange(len(own))] = f"x{i}y{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("near copies", "near copies")
    try:
        got = similar.similar_texts(docs).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near copies"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = components(docs.collect())
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want and 20 < len({c for _, c in want}) < 240
    assert jobs <= 150, jobs


def test_what_is_shuffled_follows_sets_and_not_their_pairs(spark):
    """Each of the groups has far more candidate pairs than texts; their sets go to the groups, not to the pairs, and wide fingerprints to no group that is far from others."""
    pick = random.Random(4)
    texts = []
    for g in range(6):
        base = [f"w{g}x{k}" for k in range(1200)]
        for i in range(60):
            own = list(base)
            own[pick.randrange(len(own))] = f"x{i}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    stages = spark.sparkContext._jsc.sc().statusStore()
    last = max((s.stageId() for s in _stages(spark, stages)), default=-1)
    got = {r.doc_id: r.component_id for r in similar.similar_texts(docs).collect()}
    assert got == {i: i - i % 60 for i in range(360)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = sum(s.shuffleWriteBytes() for s in _stages(spark, stages) if s.stageId() > last)
    once = 360 * 1196 * 8
    assert moved <= 1.4 * once, moved / once


def _stages(spark, store):
    held = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [held.apply(i) for i in range(held.size())]


def test_sets_of_a_large_group_are_dealt_over_tiles(spark, monkeypatch):
    """Tiles of few bytes change no component, and no tile gets all sets of a group."""
    monkeypatch.setattr(similar, "TILE_BYTES", 20_000)
    pick = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(f"x{i}" if k == at else w for k, w in enumerate(base))) for i, at in enumerate(pick.randrange(120) for _ in range(150))]
    got = similar.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    pairs = spark.createDataFrame([(0, i) for i in range(1, 150)] + [(i, 500) for i in range(1, 150)] + [(600, 601)], "a long, b long")
    sizes = spark.createDataFrame([(i, 116) for i in [*range(150), 500]] + [(600, 100), (601, 79)], "node long, size int")
    tiles = similar._tiled(pairs, sizes, 0.8).collect()
    assert sorted((r.a, r.b) for r in tiles) == sorted((r.a, r.b) for r in pairs.collect() if r.a < 600)
    most = max(len({x for r in tiles if r.tile == t for x in (r.a, r.b)}) for t in {r.tile for r in tiles})
    assert most < 100


def test_pairs_of_a_large_group_are_dealt_over_tiles(spark, monkeypatch):
    """A group with many pairs of few bytes is not one task's work."""
    monkeypatch.setattr(similar, "TILE_PAIRS", 100)
    pairs = spark.createDataFrame([(i, j) for j in range(60) for i in range(j)], "a long, b long")
    sizes = spark.createDataFrame([(i, 3) for i in range(60)], "node long, size int")
    tiles = similar._tiled(pairs, sizes, 0.8).groupBy("tile").count().collect()
    assert sum(r["count"] for r in tiles) == 1770 and max(r["count"] for r in tiles) < 500
