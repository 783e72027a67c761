"""A Merkle manifest of a dataset: leaves by row, trees by source, one root, and a proof for every row."""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import durable, narrow, sql_crc32, table
from pagewright.llm.ranks import ranked
from pagewright.llm.unions import runs, whole_groups

FANOUT = 16
#: Levels that one aligned block covers: it holds at most FANOUT ** LEVELS nodes, which one step of a task has in memory.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def depth_of(n: int, fanout: int) -> int:
    """Levels above n nodes until one remains."""
    depth, width = 0, 1
    while width < n:
        depth, width = depth + 1, width * fanout
    return depth


def climbed(nodes: np.ndarray, depth: int, fanout: int) -> list[np.ndarray]:
    """The levels of one aligned block from nodes (S64, contiguous) up: rows of fanout digests are hashed, and the shorter last one."""
    levels = [np.ascontiguousarray(nodes)]
    for _ in range(depth):
        own = levels[-1]
        whole = len(own) // fanout * fanout
        rows = own[:whole].view("u1").reshape(-1, 64 * fanout)
        digests = [_sha(row) for row in rows]
        if whole < len(own):
            digests.append(_sha(own[whole:].tobytes()))
        levels.append(np.array(digests, "S64"))
    return levels


def beside(level: np.ndarray, k: int, fanout: int) -> tuple[bytes, bytes]:
    """The siblings of node k within its run: those to its left and those to its right."""
    start = k - k % fanout
    return level[start:k].tobytes(), level[k + 1 : start + fanout].tobytes()


def _steps(path: str) -> list[tuple[bytes, bytes]]:
    """A path as text, steps ended by ';' with left and right siblings parted by ',', as pairs."""
    return [tuple(x.encode() for x in step.split(",")) for step in path.split(";")[:-1]]


def _roots(fanout: int, levels: int):
    """Sorted (g, block, at, n, hash) to (g, at, n, hash): each block's root as a node of the next round."""
    size = fanout**levels

    def work(batches):
        for g, block, _, n, digest in whole_groups(batches, 2):
            edge = runs(g, block)
            first = edge[:-1]
            tops = [climbed(digest[lo:hi].astype("S64"), min(levels, depth_of(int(n[lo]), fanout)), fanout)[-1][0].decode() for lo, hi in zip(first, edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(block[first]), pa.array(-(-n[first] // size)), pa.array(tops, pa.string())], ["g", "at", "n", "hash"])

    return work


def _down(fanout: int, levels: int, leaves: bool):
    """Sorted (g, block, at, n, hash, path, id as text, forged), each block headed by a row with at -1 that has the path above it and its subroot as hash.

    Gives (g, at, path, hash) for nodes: the path from each of them to the root, and the subroot again. For leaves gives
    (id, leaf, subroot, proof, folded).
    """

    names = ["id", "leaf", "subroot", "proof", "folded"] if leaves else ["g", "at", "path", "hash"]
    kinds = [pa.string()] * 5 if leaves else [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def work(batches):
        for g, block, at, n, digest, path, ids, forged in whole_groups(batches, 2):
            out = []
            edge = runs(g, block)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                own = climbed(digest[lo + 1 : hi].astype("S64"), min(levels, depth_of(int(n[lo + 1]), fanout)), fanout)
                above, ends = [_steps(path[lo])], [path[lo]]
                # for every level from the block's root down to the one above its nodes: steps that lead on from each node
                for level in own[-2:0:-1]:
                    steps = [beside(level, k, fanout) for k in range(len(level))]
                    above = [[step, *above[k // fanout]] for k, step in enumerate(steps)]
                for k in range(hi - lo - 1):
                    onward = above[k // fanout] if len(own) > 1 else above[0]
                    steps = [beside(own[0], k, fanout), *onward] if len(own) > 1 else onward
                    if not leaves:
                        out.append((int(g[lo]), int(at[lo + 1 + k]), "".join(f"{a.decode()},{b.decode()};" for a, b in steps), digest[lo]))
                        continue
                    proof = hashlib.sha256()
                    x = (forged[lo + 1 + k] or digest[lo + 1 + k]).encode()
                    for a, b in steps:
                        proof.update(a)
                        proof.update(b)
                        x = _sha(a + x + b).encode()
                    out.append((ids[lo + 1 + k], digest[lo + 1 + k], digest[lo], proof.hexdigest(), x.decode()))
                if len(out) >= 1024:
                    yield batch(out)
                    out = []
            yield batch(out)

    return work


def _blocks(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    """nodes with their blocks, each block in one task and in order; at may be -1 for the head of the block that it names."""
    rows = nodes.select("g", "block" if "block" in nodes.columns else F.expr(f"at div {size}").alias("block"), "at", "n", "hash", *more)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "at")


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes (g, at, n, hash; durable) and, after each round, the nodes that are left of groups that had more than one: the roots of their blocks."""
    most, size, out = nodes.agg(F.max("n")).first()[0] or 0, fanout**levels, [nodes]
    while most > 1:
        left = _blocks(out[-1].filter("n > 1"), size).mapInArrow(_roots(fanout, levels), "g long, at long, n long, hash string")
        out.append(durable(left))
        most = -(-most // size)
    return out


def _paths(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, block, path, hash) for every block of rounds[0]: the way from its root to the very top. tops: (g, path, hash) for each group's root."""
    size, heads = fanout**levels, None
    for k in range(len(rounds) - 1, -1, -1):
        ended = rounds[k].filter("n = 1").select("g").join(tops, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "hash")
        heads = ended if heads is None else heads.unionByName(ended)
        if k:
            heads = _headed(rounds[k], heads, size).mapInArrow(_down(fanout, levels, False), "g long, at long, path string, hash string")
            heads = durable(heads.withColumnRenamed("at", "block"))
    return heads


def _headed(nodes: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """The blocks of nodes, each after its head."""
    extra = {c: F.lit(None).cast(t) for c, t in (("path", "string"), ("id", "string"), ("forged", "string")) if c not in nodes.columns}
    own = nodes.withColumns(extra).withColumn("block", F.expr(f"at div {size}"))
    lead = heads.select("g", "block", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), "hash", "path", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("forged"))
    return _blocks(own.unionByName(lead), size, "path", "id", "forged")


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def merkle(docs: DataFrame, forged_text: Column | None = None, forge: Column | None = None, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    fields: id, source, then the others that a leaf covers, the text last. A leaf is the SHA-256 of all fields, each '-' if null or else
    its length in UTF-8 bytes, ':' and the value. The leaves of a source in the order of ids (null first; rows of one id by their leaf)
    are hashed in runs of fanout until one node is left, its subroot; subroots by source (null first, then by bytes) likewise give the root. A
    row's proof is all siblings from its leaf up; folding them onto the leaf, or onto the leaf of forged_text where forge holds, gives
    folded_root, and verified says whether that is the root.

    Rows are put in order by range, so a source may be of any size; then aligned blocks of fanout ** levels nodes become one node
    each, round by round, and the paths come down the same way. Repeated rows are leaves of their own. An empty text is '0:', a long one is hashed where it is read and doesn't
    move. An empty table has no rows and no root. Other columns aren't read.
    """
    id_col, source_col, *_, text_col = fields
    forge, forged_text = F.lit(False) if forge is None else forge, F.col(text_col) if forged_text is None else forged_text
    head = [_part(F.col(c)) for c in fields[:-1]]
    leaf = lambda text: F.sha2(F.concat(*head, _part(text)), 256)
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), leaf(F.col(text_col)).alias("hash"), F.when(forge, leaf(forged_text)).alias("forged"))
    rows = ranked(durable(rows), ["source"], ["id", "hash"])  # durable, as a sort by range reads its input twice
    sources = durable(rows.filter("at = 0").select("source"))
    sources = ranked(sources.withColumn("all", F.lit(0)), ["all"], ["source"]).select("source", F.col("at").alias("g"), F.col("n").alias("sources"))
    nodes = _numbered(rows, sources)

    upward = _rounds(nodes.select("g", "at", "n", "hash"), fanout, levels)
    subroots = [x.filter("n = 1").select("g", "hash") for x in upward]
    first = subroots[0]
    for other in subroots[1:]:
        first = first.union(other)
    n = F.lit(sources.agg(F.max("sources")).first()[0]).cast("long")
    tops = durable(first.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), n.alias("n"), "hash"))
    over = _rounds(tops, fanout, levels)
    root = over[-1].first()
    root = F.lit(root.hash if root else None).cast("string")

    heads = _paths(over, over[-1].select("g", F.lit("").alias("path"), "hash"), fanout, levels)
    down = _headed(over[0], heads, fanout**levels).mapInArrow(_down(fanout, levels, False), "g long, at long, path string, hash string")
    ways = durable(down.select(F.col("at").alias("g"), "path").join(tops.select(F.col("at").alias("g"), "hash"), "g"))
    heads = _paths(upward, ways, fanout, levels)
    found = _headed(nodes, heads, fanout**levels).mapInArrow(_down(fanout, levels, True), "id string, leaf string, subroot string, proof string, folded string")
    return found.select(F.col("id").cast("long").alias(id_col), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def _numbered(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (durable) with the number of their source instead of its name."""
    known = narrow(durable(sources.select(F.col("source").alias("__source"), "g")))
    return durable(rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).select("g", "at", "n", "hash", F.col("id").cast("string").alias("id"), "forged"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle(table(spark, sf_dir, "documents"), lowered, F.coalesce(digits % 5 == 0, F.lit(False)))


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_CRC = sql_crc32("doc_id")


def _sql_part(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(_sql_part(c) for c in FIELDS[:-1])
_RUN = f"k // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}"

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_HEAD} || {_sql_part("text")}) AS leaf, sha256({_HEAD} || {_sql_part(f"translate(text, '{_UP}', '{_LOW}')")}) AS forged, {_CRC} % 5 = 0 AS tampered
  FROM documents),
l AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n
  FROM d),
up AS (
  SELECT s, 0 AS lv, k, n, leaf AS h FROM l
  UNION ALL
  SELECT s, lv + 1, {_RUN}, sha256(string_agg(h, '' ORDER BY k)) FROM up WHERE n > 1 GROUP BY s, lv, k // {FANOUT}, n),
tops AS (SELECT s, h, lv FROM up WHERE n = 1),
above AS (
  SELECT 0 AS lv, s AS k, (SELECT count(*) FROM tops) AS n, h FROM tops
  UNION ALL
  SELECT lv + 1, {_RUN}, sha256(string_agg(h, '' ORDER BY k)) FROM above WHERE n > 1 GROUP BY lv, k // {FANOUT}, n),
nodes AS (
  SELECT s, lv, k, h FROM up WHERE n > 1
  UNION ALL
  SELECT -1, lv, k, h FROM above WHERE n > 1),
beside AS (
  SELECT x.s, x.lv, x.k, coalesce(string_agg(y.h, '' ORDER BY y.k) FILTER (y.k < x.k), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.k) FILTER (y.k > x.k), '') AS b
  FROM nodes x JOIN nodes y ON x.s = y.s AND x.lv = y.lv AND x.k // {FANOUT} = y.k // {FANOUT}
  GROUP BY x.s, x.lv, x.k),
folds AS (
  SELECT l.s, l.doc_id, l.leaf, 0 AS lv, l.k, l.s AS tree, tops.lv AS last, '' AS proof, CASE WHEN tampered THEN forged ELSE leaf END AS x
  FROM l JOIN tops USING (s)
  UNION ALL
  SELECT f.s, f.doc_id, f.leaf, CASE WHEN f.lv < f.last THEN f.lv + 1 ELSE 0 END, CASE WHEN f.lv < f.last THEN f.k // {FANOUT} ELSE f.s END,
         CASE WHEN f.lv < f.last THEN f.tree ELSE -1 END, CASE WHEN f.lv < f.last THEN f.last ELSE (SELECT max(lv) FROM above) END,
         f.proof || coalesce(e.a || e.b, ''), CASE WHEN f.lv < f.last THEN sha256(e.a || f.x || e.b) ELSE f.x END
  FROM folds f LEFT JOIN beside e ON e.s = f.tree AND e.lv = f.lv AND e.k = f.k
  WHERE f.lv < f.last OR f.tree >= 0),
root AS (SELECT h FROM above WHERE n = 1)
SELECT f.doc_id, f.leaf, tops.h AS subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = root.h AS verified
FROM folds f JOIN tops USING (s) CROSS JOIN root
WHERE f.tree = -1 AND f.lv = f.last
"""
