import random
from collections import defaultdict

import numpy as np
import xxhash

from pagewright.llm.op4_simhash import fingerprint, near_duplicates, op4_simhash, trie_links


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def sets(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute_links(fps, bits=3):
    v = np.array(fps, "u8")
    return [(int(v[i]), int(v[j])) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= bits) + i + 1]


def test_documents_and_odd_rows(spark, odd):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        rows = docs.collect()
        fps = [brute_fp(r.text) for r in rows]
        root = sets(set(fps), brute_links(sorted(set(fps))))
        least = defaultdict(list)
        for r, f in zip(rows, fps, strict=True):
            if r.doc_id is not None:
                least[root[f]].append(r.doc_id)
        want = sorted(((r.doc_id, f"{f:016x}", min(least[root[f]], default=None)) for r, f in zip(rows, fps, strict=True)), key=str)
        for hot in (10**6, 3):
            got = near_duplicates(docs, hot_rows=hot).collect()
            assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert near_duplicates(odd.limit(0)).count() == 0


def test_trie_against_all_pairs(spark):
    pick = random.Random(4)
    fps = set()
    for _ in range(60):  # families: a fingerprint and others a few bits away
        centre = pick.getrandbits(64)
        fps.add(centre)
        for _ in range(pick.randint(0, 40)):
            f = centre
            for _ in range(pick.randint(1, 6)):
                f ^= 1 << pick.randrange(64)
            fps.add(f)
    fps |= {pick.getrandbits(64) for _ in range(2000)} | {pick.getrandbits(12) for _ in range(500)}
    fps = sorted(fps)
    want = sets(fps, brute_links(fps))
    signed = [(int(np.array(f, "u8").view("i8")),) for f in fps]
    table = spark.createDataFrame(signed, "fp long").repartition(5)
    for hot in (10**6, 20):
        links = [(r.a % 2**64, r.b % 2**64) for r in trie_links(table, hot_rows=hot).collect()]
        assert all((a ^ b) for a, b in links)
        assert sets(fps, links) == want


def test_long_text_in_batches():
    text = " ".join(str(i * i % 977) for i in range(70000))
    assert fingerprint(text) == brute_fp(text)


def test_query(spark):
    assert op4_simhash(spark, "/root/testdata/sf0.001").columns == ["doc_id", "fingerprint", "component_id"]
