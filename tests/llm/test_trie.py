import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pagewright.llm.op12_prefix_trie import digests, op12_prefix_trie, prefix_trie


def by_conversation(rows):
    turns = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            turns[r.conv_id].append(r)
    key = lambda r: (r.turn is not None, r.turn or 0)
    return {c: [(r.role or "", r.text or "") for r in sorted(own, key=key)] for c, own in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in below)
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    got = op12_prefix_trie(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == trie(rebuilt(by_conversation(rows)))


def test_copies_odd_rows_and_turnless(spark, tmp_path):
    """Groups of copies, conversations that begin others, long and turnless ones, nulls in every column, clashing names; the same through the query, whose rebuilding leaves some without turns."""
    rows = []
    for c in range(60):
        for t in range(1 + c % 4):
            rows.append((c, t, ["user", None, "assistant"][t % 3], None if c % 7 == 0 else f"text {t} {c % 3 if t > 1 else ''} é", "x"))
    rows += [(100 + k, t, "user", f"long {t}" if t < 30 else f"long {t} {k // 2}", "x") for k in range(4) for t in range(35)]
    rows += [(200, None, "user", "first", "x"), (200, 3, "user", "third", "x"), (200, 1, None, "", "x"), (201, None, "user", "first", "x"), (None, 0, "user", "nobody's", "x"), (16, 9, "user", "z" * 100_000, "x")]
    rows += [(c, 0, "user", f"only {c}", "x") for c in range(301, 309)]  # most have lent all they have, and nobody lends them any
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    convs = by_conversation(df.collect())
    for chunk in (256, 3):
        assert sorted(map(tuple, prefix_trie(digests(df), chunk=chunk).collect()), key=str) == trie(convs)
    convs |= {500: [], 501: []}
    members = spark.createDataFrame([(c,) for c in convs], "conv long")
    assert sorted(map(tuple, prefix_trie(digests(df), members).collect()), key=str) == trie(convs)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt(by_conversation(df.collect()))
    assert any(not x for x in want.values())
    assert sorted(map(tuple, op12_prefix_trie(spark, str(tmp_path)).collect()), key=str) == trie(want)


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie(digests(df)).collect()), key=str) == trie(by_conversation(df.collect()))
    assert prefix_trie(digests(df.limit(0))).count() == 0
    nobody = df.limit(0).select(F.col("conv_id").alias("conv"))
    only = prefix_trie(digests(df.limit(0)), nobody.union(spark.createDataFrame([(7,)], "conv long"))).collect()
    assert [tuple(r) for r in only] == trie({7: []})
