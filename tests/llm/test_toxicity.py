import zlib

import numpy as np

from pagewright.llm import op3_toxicity as tox


def load(spark, size):
    return [spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark):
    docs, labels = load(spark, "sf0.1")
    got = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect() if got[r.doc_id].held_out}
    hit = sum(got[i].predicted == t == 1 for i, t in truth.items())
    assert hit >= 0.9 * sum(truth.values())
    assert hit >= 0.9 * sum(got[i].predicted for i in truth)


def test_block_max_is_exact(spark):
    index = tox.fit(*load(spark, "sf0.1"))
    rng = np.random.default_rng(2)
    dense = np.zeros((len(index.vocabulary), len(index.ids)))
    for t, (at, w) in enumerate(index.postings):
        dense[t, at] = w
    for _ in range(200):
        terms = np.unique(rng.integers(0, len(index.vocabulary), rng.integers(1, 12)))
        w = index.vector(terms, rng.integers(1, 5, len(terms)))
        cosine = w @ dense[terms]
        for first in (1, 8):
            found, got = index.nearest(terms, w, 15, first=first)
            assert np.allclose(np.sort(cosine)[::-1][: len(got)], got) and np.allclose(cosine[found], got)
            assert len(got) == min(15, (cosine > 1e-15).sum())


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (4, None), (5, 7), (99, 1)], "doc_id long, toxic int")
    got = tox.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in tox.toxicity(odd, labels.limit(0)).collect())
    assert tox.toxicity(odd.limit(0), labels).count() == 0


def test_a_copy_of_an_example_finds_it(spark):
    """Few labels, and words that one example alone has: every example is indexed with all of its terms."""
    texts = [f"clean{i} quiet{i} talk{i}" for i in range(8)] + [f"vile{i} nasty{i} slur{i}" for i in range(8)]
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5][:16]
    labelled = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([*labelled, *[(1000 + i, t) for i, t in labelled]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in labelled], "doc_id long, toxic int")
    index = tox.fit(docs, labels)
    assert sorted(index.ids.tolist()) == ids
    got = {r.doc_id: r for r in tox.score(docs, index).collect()}
    for i, _ in labelled:
        assert got[1000 + i].evidence[0] == i and abs(got[1000 + i].cosine - 1) < 1e-9


def test_score_against_brute_force(spark):
    """Examples, terms, weights, cosines, votes and calibration worked out anew in plain Python over dictionaries."""
    import math
    from collections import Counter

    docs, labels = load(spark, "sf0.01")
    index = tox.fit(docs, labels)
    got = {r.doc_id: r for r in tox.score(docs, index).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    counts = {i: tox.terms_of(t) for i, t in texts.items()}
    n = [sum(t == y for t in truth.values()) for y in (0, 1)]
    seen = [Counter(x for i, t in truth.items() if t == y for x in counts[i]) for y in (0, 1)]
    factor = {}
    for x in seen[0] | seen[1]:
        a, b = seen[0][x], seen[1][x]
        c, d = n[0] - a, n[1] - b
        chi = sum(n) * (a * d - b * c) ** 2 / (n[0] * n[1] * (a + b) * max(c + d, 0.5))
        factor[x] = 1.0 if chi >= 24 and abs(math.log((b + 0.5) * (c + 0.5) / ((a + 0.5) * (d + 0.5)))) >= math.log(4) else 0.02
    frequency = Counter(x for c in counts.values() for x in c)
    idf = {x: (math.log((1 + len(texts)) / (1 + frequency[x])) + 1) * f for x, f in factor.items()}

    def vector(i):
        w = {x: (1 + math.log(c)) * idf[x] for x, c in counts[i].items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    examples = {i: v for i in truth if (v := vector(i))}
    for i in list(texts)[::9]:
        own = vector(i)
        cosine = sorted(((sum(v * e.get(x, 0.0) for x, v in own.items()), j) for j, e in examples.items()), reverse=True)
        best = [c for c, _ in cosine[:15] if c > 1e-12]
        assert np.allclose([sum(v * examples[j].get(x, 0.0) for x, v in own.items()) for j in got[i].evidence], best, atol=1e-5)
        if not best:
            assert got[i].score == index.empty
            continue
        if len(cosine) > 15 and cosine[14][0] - cosine[15][0] < 1e-5:
            continue  # a tie for the last place
        w = [1 / (1 - min(c, 1) + 0.05) for c, _ in cosine[: len(best)]]
        v = min(max(sum(a * truth[j] for a, (_, j) in zip(w, cosine, strict=False)) / sum(w), 0.005), 0.995)
        assert abs(got[i].score - 1 / (1 + math.exp(-(index.slope * math.log(v / (1 - v)) + index.offset)))) < 1e-3


def test_equal_texts_score_equal_and_blocks_are_skipped(spark):
    docs, labels = load(spark, "sf0.1")
    index = tox.fit(docs, labels)
    scores, by_text, alone = {r.doc_id: r for r in tox.score(docs, index).collect()}, {}, 0
    rows = docs.collect()
    for r in rows:
        by_text.setdefault(r.text, set()).add(scores[r.doc_id].score)
        alone += not scores[r.doc_id].evidence
    assert all(len(x) == 1 for x in by_text.values())
    assert alone < 0.1 * len(rows)  # documents without any neighbour
    index.read = index.there = 0
    read = index.vocabulary.reader()
    for r in rows[:400]:
        index.scored(*read(r.text or ""))
    assert index.read < 0.6 * index.there


def test_sums_made_together_are_exact(spark):
    """Many texts at once score as each alone and by brute force; equal examples tie to the last bit and go by number."""
    index = tox.fit(*load(spark, "sf0.1"))
    dense = np.zeros((len(index.vocabulary), len(index.ids)))
    for t, (at, w) in enumerate(index.postings):
        dense[t, at] = w
    read = index.vocabulary.reader()
    texts = [read(r.text or "") for r in load(spark, "sf0.1")[0].orderBy("doc_id").limit(3 * tox.TOGETHER // 2).collect()] + [read("")]
    together = list(index.scores(texts))
    assert len(together) == len(texts) > tox.TOGETHER and together[-1][0] == index.empty
    for (terms, counts), (score, found, cosine) in zip(texts[:-1], together, strict=False):
        alone = index.scored(terms, counts)
        assert abs(score - alone[0]) < 1e-12 and np.array_equal(found, alone[1]) and np.array_equal(cosine, alone[2])
        best = np.sort(index.vector(terms, counts) @ dense[terms])[::-1][: len(cosine)]
        assert np.allclose(best, cosine) and np.array_equal(np.lexsort((found, -cosine)), np.arange(len(found)))


def test_no_term_is_frequent(spark):
    """More examples than OFTEN, none of which shares a term with another."""
    ids = [i for i in range(1, 300) if zlib.crc32(str(i).encode()) % 5][:40]
    docs = spark.createDataFrame([(i, f"word{i} other{i} third{i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    assert all(list(got[i].evidence) == [i] for i in ids)


def test_dense_prefixes_from_counts():
    words = ("badword badwords badly badness " * 3 + "other thing").split()
    assert sorted(tox.dense_prefixes(words)) == sorted([f"{p}*0" for p in ("badl", "badn", "badne", "badnes")] + [f"{p}*{k}" for p in ("badw", "badwo", "badwor") for k in (0, 1)])
