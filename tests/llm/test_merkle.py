import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.llm.op13_merkle import merkle, op13_merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes, fanout):
    """The root and, for each node, its siblings by level as (left, right)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k - k % fanout
            ways[i].append((level[run:k], level[k + 1 : run + fanout]))
        level, at = [sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)], [k // fanout for k in at]
    return level[0], ways


def plain(rows, forge, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees.append(tree([x[2] for x in groups[s]], fanout))
    root, over = tree([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, ways), above in zip(order, trees, over, strict=True):
        for (_, _, own, r), way in zip(groups[s], ways, strict=True):
            x = leaf(r, lowered(r.text)) if forge(r) else own
            for a, b in way + above:
                x = sha(*a, x, *b)
            out.append((r.doc_id, own, subroot, root, sha(*(h for a, b in way + above for h in a + b)), x, x == root))
    return sorted(out, key=str)


def tampered(r):
    return r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = op13_merkle(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows, tampered)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2), (16, 3)])
def test_many_rounds_and_odd_rows(spark, odd, fanout, levels):
    """Sources of one row, of a whole block and of many; repeated rows, null ids and sources, clashing names."""
    made = spark.range(300).selectExpr("id * 7 % 300 as doc_id", "concat('Text ', id) as text", "'en' as lang", "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source", "id as n_chars", "'x' as hash", "'y' as at")
    copies = spark.range(50).selectExpr("5L as doc_id", "'Same' as text", "'en' as lang", "'hot' as source", "1L as n_chars", "'x' as hash", "'y' as at")
    clash = odd.withColumnRenamed("component_id", "hash").withColumn("at", F.lit("y"))
    docs = made.unionByName(copies).unionByName(clash)
    forge = F.col("doc_id") % 2 == 0
    got = merkle(docs, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), forge, fanout=fanout, levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs.collect(), lambda r: r.doc_id is not None and r.doc_id % 2 == 0, fanout)


def test_empty_and_single(spark, odd):
    assert merkle(odd.limit(0)).count() == 0
    one = odd.filter("doc_id = 4")
    r = one.first()
    assert [tuple(x) for x in merkle(one).collect()] == [(4, *[leaf(r, r.text)] * 3, sha(), leaf(r, r.text), True)]
