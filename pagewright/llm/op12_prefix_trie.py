"""The trie of conversations' prefixes by partition refinement, folded back from its leaves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import durable, narrow, sql_crc32, table, written
from pagewright.llm.ranks import ranked

#: Ids that are put together before those of a large group of copies meet in order.
CHUNK_IDS = 256


def digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, bytes) for every turn: key is the SHA-256 of role and text, null counting as empty, bytes the text's length in UTF-8.

    Texts go no further than this. Rows without a conversation aren't part of any.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))


def with_shared_heads(turns: DataFrame, family: Column, length: Column) -> tuple[DataFrame, DataFrame]:
    """turns (conv, turn, key, bytes) rebuilt, and (conv) for every conversation, turnless ones too.

    family: the conversation, from conv, that lends its first ``length`` turns (fewer if it has fewer; none if absent) to conv,
    whose own turns follow from its ``length``-th on. Ties in turn go by key.
    """
    own = ranked(turns, ["conv"], ["turn", "key"])
    sizes = own.filter("at = 0").select("conv", "n")
    info = sizes.select("conv", family.alias("family"), length.cast("long").alias("h"))
    lent = sizes.select(F.col("conv").alias("family"), F.col("n").alias("lent"))
    info = durable(info.join(lent, "family", "left").select("conv", "family", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("t")))
    most = info.agg(F.max("t")).first()[0] or 0
    heads = own.filter(F.col("at") < most).select(F.col("conv").alias("family"), "at", "key", "bytes")
    heads = heads.join(info.select("conv", "family", "t"), "family").filter("at < t").select("conv", F.col("at").alias("turn"), "key", "bytes")
    rest = own.join(narrow(info.select("conv", "h", "t")), "conv").filter("at >= h").select("conv", F.expr("t + at - h").alias("turn"), "key", "bytes")
    return heads.unionByName(rest), info.select("conv")


def _streamed(batches):
    """Sorted (seq, chunk, ids) to (seq, sha): SHA-256 of each sequence's ids joined by commas, in bounded memory however many there are."""
    seq, held = None, None
    for batch in batches:
        out = []
        for s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != seq:
                if held is not None:
                    out.append((seq, held.hexdigest()))
                seq, held = s, hashlib.sha256(ids.encode())
            else:
                held.update(b"," + ids.encode())
        yield _shas(out)
    if held is not None:
        yield _shas([(seq, held.hexdigest())])


def _shas(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["seq", "sha"])


def _ends(owners: DataFrame, chunk: int) -> DataFrame:
    """(seq, sha) from (seq, conv) of sequences that several conversations share."""
    rows = ranked(owners, ["seq"], ["conv"]).withColumn("chunk", F.expr(f"at div {chunk}"))
    parts = rows.groupBy("seq", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition("seq").sortWithinPartitions("seq", "chunk").mapInArrow(_streamed, "seq long, sha string")


def _refined(turns: DataFrame, seqs: DataFrame, root: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """By round the runs that end in it and the chains that hang from them, and where sequences end (conv, depth, seq).

    All sequences begin in one class. Each round looks some turns ahead, twice as many as the one before: as long as all members of a class
    agree its run goes on, at the first turn where they don't it splits. A class is named by its least conversation. What is left of one
    sequence alone retires as a chain, so rounds grow with the number of splits on a path and the logarithm of what is shared.

    Runs and chains: conv, since (depth of the first node), parent and above (conv and since of the run that it hangs from), until,
    n_convs, own (bytes of its turns), upto (bytes down to its last node).
    """
    fields = ["conv", "since", "parent", "above", "n_convs"]
    start = [F.lit(root).cast("long").alias("conv"), F.lit(0).cast("long").alias("since"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("above")]
    whole = seqs.agg(F.sum("copies").alias("n_convs"), F.count("*").alias("seqs"))
    # at: depth down to which the class is known to agree; before: bytes above its first node; upto: bytes down to at
    classes = whole.select(*start, "n_convs", "seqs", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("upto"))
    classes = durable(classes.filter("seqs > 0"))
    active = durable(seqs.select("seq", "copies", "total", "length", F.lit(root).cast("long").alias("conv"), F.lit(0).cast("long").alias("at")))
    rounds, ends, ahead = [], [], 1
    while not (rounds and classes.isEmpty()):
        lo, hi = classes.agg(F.coalesce(F.min("at"), F.lit(0)), F.coalesce(F.max("at"), F.lit(0))).first()
        window = turns.filter((F.col("pos") > lo) & (F.col("pos") <= hi + ahead)).select("seq", "pos", "key", "bytes", F.col("upto").alias("sofar"))
        step = durable(active.join(window, "seq").filter((F.col("pos") > F.col("at")) & (F.col("pos") <= F.col("at") + ahead)))
        agreed = step.groupBy("conv", "pos").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n"), F.min("sofar").alias("sofar"))
        agreed = agreed.join(narrow(classes.select("conv", "seqs")), "conv").withColumn("ok", (F.col("a") == F.col("b")) & (F.col("n") == F.col("seqs")))
        bound = agreed.groupBy("conv").agg(F.min(F.when(~F.col("ok"), F.col("pos"))).alias("split"), F.max("pos").alias("last"))
        reach = agreed.filter("ok").join(narrow(durable(bound)), "conv").filter("split is null or pos < split").groupBy("conv").agg(F.max("sofar").alias("reach"))
        known = durable(classes.join(bound, "conv", "left").join(reach, "conv", "left").withColumn("upto", F.greatest("upto", F.coalesce("reach", "upto"))).drop("reach"))
        # a class without a turn left, or that looked ahead beyond its end, is one sequence
        over = F.col("split").isNotNull() | F.col("last").isNull() | (F.col("last") < F.col("at") + ahead)
        done = known.filter(over)
        until = F.coalesce(F.col("split") - 1, F.col("last"), F.col("at"))
        runs = durable(done.select(*fields, until.alias("until"), (F.col("upto") - F.col("before")).alias("own"), "split", "upto"))

        members = active.drop("at").join(narrow(runs.select("conv", "since", "until", "split", F.col("upto").alias("before"))), "conv")
        turn = step.select("seq", F.col("pos").alias("split"), "key", "bytes", "sofar")
        members = durable(members.join(turn, ["seq", "split"], "left"))
        ends.append(members.filter("key is null").select("conv", F.col("until").alias("depth"), "seq"))
        parts = members.filter("key is not null").groupBy(F.col("conv").alias("parent"), F.col("since").alias("above"), F.col("split").alias("since"), "key")
        least = {c: F.min(c).alias(c) for c in ("before", "total", "length")}
        parts = durable(parts.agg(F.min("seq").alias("conv"), F.sum("copies").alias("n_convs"), F.count("*").alias("seqs"), F.min("sofar").alias("upto"), *least.values()))
        chains = parts.filter("seqs = 1").select(*fields, F.col("length").alias("until"), (F.col("total") - F.col("before")).alias("own"), F.col("total").alias("upto"))
        ends.append(chains.select("conv", F.col("until").alias("depth"), F.col("conv").alias("seq")))
        rounds.append((runs, chains))
        born = parts.filter("seqs > 1").withColumn("at", F.col("since"))
        moved = members.filter("key is not null").select("seq", "copies", "total", "length", F.col("conv").alias("parent"), "key")
        moved = moved.join(narrow(born.select("parent", "key", "conv", "at")), ["parent", "key"]).select("seq", "copies", "total", "length", "conv", "at")
        going = known.filter(~over).withColumn("at", F.col("at") + ahead)
        stay = active.drop("at").join(narrow(going.select("conv", "at")), "conv").select("seq", "copies", "total", "length", "conv", "at")
        state = [*fields, "seqs", "at", "before", "upto"]
        # tables, as what a checkpoint is known to satisfy would grow from round to round, and planning with it
        classes, active = written(going.select(state).unionByName(born.select(state))), written(stay.unionByName(moved))
        ahead *= 2
    return rounds, durable(_union(ends))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _folded(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Runs and chains with what hangs from their last node: n_children, n_leaves, saved. Going back from the last round, each run adds up its subtrees, which ended in later rounds."""
    out, below = [], []
    for runs, chains in reversed(rounds):
        none = {"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")}
        out.append(chains.withColumns(none))
        below.append(_handed_up(out[-1]))
        under = _union(below).groupBy("parent", "above").agg(*(F.sum(c).alias(c) for c in none))
        under = under.withColumnsRenamed({"parent": "conv", "above": "since"})
        out.append(durable(runs.drop("split").join(under, ["conv", "since"], "left").na.fill({"n_children": 0, "n_leaves": 1, "saved": 0})))
        below.append(_handed_up(out[-1]))
    return _union(out)


def _handed_up(runs: DataFrame) -> DataFrame:
    saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("own")
    return runs.filter("parent is not null").select("parent", "above", F.lit(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved"))


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, chunk: int = CHUNK_IDS) -> DataFrame:
    """A row for every distinct sequence of first turns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv, turn, key, bytes), as from digests; a conversation's turns are ordered by turn, null first, ties by key. members: (conv)
    of all conversations, where some have no turns. saved_tokens sums (n_convs - 1) times bytes over the subtree; ends_sha256 is of the
    ids of conversations that end at the node.

    Conversations that are equal throughout become one sequence with a count first, so copies neither meet nor make rounds. Positions come
    from a sort by range, so a conversation of any length is spread out. A turn is known by its SHA-256. Only the hash
    over the ids of one group of copies runs in one task, as SHA-256 must; it streams, and ids come to it in chunks.
    An empty table gives no nodes; repeated rows are turns of their own.
    """
    rows = ranked(turns.select("conv", "turn", "key", "bytes"), ["conv"], ["turn", "key"], F.col("bytes")).withColumn("pos", F.col("at") + 1)
    rows = durable(rows.select("conv", "pos", "key", "bytes", "upto"))
    prints = rows.groupBy("conv").agg(
        F.max("pos").alias("length"), F.bit_xor(F.xxhash64("pos", "key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "key", "pos")).alias("h2"), F.max("upto").alias("total")
    )
    if members is not None:
        prints = members.select("conv").distinct().join(prints, "conv", "left")
    prints = durable(prints.na.fill(0))
    same = ["length", "h1", "h2"]
    seqs = durable(prints.groupBy(*same).agg(F.min("conv").alias("seq"), F.count("*").alias("copies"), F.min("total").alias("total")))
    root = seqs.agg(F.min("seq")).first()[0] or 0
    several = seqs.filter("copies > 1").select(*same, "seq")
    shas = _ends(prints.join(narrow(several), same).select("seq", "conv"), chunk)

    own = rows.withColumnRenamed("conv", "seq").join(narrow(seqs.select("seq")), "seq")
    own = written(own.repartitionByRange("pos", "seq").sortWithinPartitions("pos", "seq"))
    rounds, ends = _refined(own, seqs, root)
    nodes = _along(own, durable(_folded(rounds)))
    alone = F.sha2(F.col("seq").cast("string"), 256)
    ends = ends.join(shas, "seq", "left").select("conv", "depth", F.coalesce("sha", alone).alias("ends"))
    return nodes.join(ends, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def _along(turns: DataFrame, runs: DataFrame) -> DataFrame:
    """The nodes of runs: the turns of the conversation that a run is named by, and the root."""
    last = F.col("pos") == F.col("until")
    shared = F.col("n_convs") - 1
    fields = ["conv", "pos", F.when(F.col("pos") == F.col("since"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves"]
    nodes = turns.withColumnRenamed("seq", "conv").select("conv", "pos", "bytes", F.col("upto").alias("sofar")).join(narrow(runs), "conv").filter("pos between since and until")
    nodes = nodes.select(*fields, (F.col("saved") + shared * (F.col("upto") - F.col("sofar") + F.col("bytes"))).alias("saved_tokens"))
    root = runs.filter("since = 0").withColumn("pos", F.lit(0).cast("long"))
    root = root.select(*fields, (F.col("saved") + shared * F.col("upto")).alias("saved_tokens"))
    return nodes.unionByName(root).withColumnRenamed("pos", "depth")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    length = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie(*with_shared_heads(digests(table(spark, sf_dir, "conversations")), conv - conv % 5, length))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS family, {sql_crc32("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.family WHERE k <= h
  UNION ALL
  SELECT conv_id, 1, k, role, text FROM c JOIN t USING (conv_id) WHERE k > h),
s AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, k) AS turns FROM rebuilt GROUP BY conv_id),
p AS (
  SELECT conv_id, turns, d, turns[1:d] AS pre, d = len(turns) AS ended
  FROM (SELECT conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN s USING (conv_id)), unnest(range(len(turns) + 1)) AS u(d)),
n AS (
  SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(octet_length(encode(pre[d].text)), 0) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ids
  FROM p GROUP BY pre, d),
below AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN below USING (pre, d)),
sums AS (
  SELECT pre[1:e] AS pre, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * bytes)::BIGINT AS saved_tokens
  FROM own, unnest(range(d + 1)) AS u(e) GROUP BY ALL)
SELECT own.conv_id, d AS depth, up.conv_id AS parent_conv_id, own.n AS n_convs, own.n_children, n_leaves, saved_tokens, sha256(own.ids) AS ends_sha256
FROM own JOIN sums USING (pre, d) LEFT JOIN n up ON up.d = own.d - 1 AND up.pre = own.pre[1:own.d - 1]
"""
