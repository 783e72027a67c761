"""Near duplicates by SimHash fingerprints and a binary trie that is joined with itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import durable, table, whole_text
from pagewright.llm.components import connected
from pagewright.llm.unions import pairs_within, runs, united, whole_groups

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints below one trie node of the first level; a node with more is dealt out by its descendants.
HOT_ROWS = 200_000
#: Bits by which a hot node is dealt out.
HOT_BITS = 6
#: Node pairs of at most so many fingerprint pairs are compared outright.
LEAF_PAIRS = 24
#: Node pairs that are handled at a time.
FRONTIER = 1 << 19
#: Hashes whose bits are unfolded at a time.
HASHES = 1 << 15


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    count = np.zeros(64, "i8")
    for start in range(0, len(hashes), HASHES):
        raw = np.array(hashes[start : start + HASHES], "u8").astype(">u8").view("u1").reshape(-1, 8)
        count += np.unpackbits(raw, axis=1).sum(axis=0, dtype="i8")
    return count


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash of a text: a bit is 1 if over half of the shingles' hashes have it. No words: 0."""
    from xxhash import xxh64_intdigest

    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not own:
        return 0
    joined, ends, at = b" ".join(own), [], -1
    for w in own:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)] or [xxh64_intdigest(joined, seed)]
    return int.from_bytes(np.packbits(_ones(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp) for every row, fp the fingerprint's 64 bits as a signed long."""

    def work(batches):
        for batch in batches:
            held = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.view("i8"))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(work, "id long, fp long")


def near_pairs(v: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, stop: int, max_bits: int, label: np.ndarray):
    """Pairs (i, j) of places in v that lie below the given pairs of trie nodes and differ in max_bits or fewer of the first stop bits.

    v is sorted where it matters: a node at a depth is a range of v with equal leading bits. pairs: the ranges a0, a1 and
    b0, b1 of both nodes and the bits in which they differ so far. Pairs are taken depth first in batches; a pair
    goes when its bits exceed the budget, or when both ranges belong to one set by label, which may change between batches.
    """
    stack = [(depth, pairs)]
    while stack:
        depth, (a0, a1, b0, b1, bits) = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, tuple(x[half:] for x in (a0, a1, b0, b1, bits))), (depth, tuple(x[:half] for x in (a0, a1, b0, b1, bits)))]
            continue
        same = a0 == b0
        live = (bits <= max_bits) & (a1 > a0) & (b1 > b0) & ~(same & (a1 - a0 < 2))
        if live.sum() > 4096:
            turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            ia, ib = np.minimum(a0, len(v) - 1), np.minimum(b0, len(v) - 1)
            live &= ~((turns[ia] == turns[a1 - 1]) & (turns[ib] == turns[b1 - 1]) & (label[ia] == label[ib]))
        a0, a1, b0, b1, bits, same = (x[live] for x in (a0, a1, b0, b1, bits, same))
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth >= stop)
        if small.any():
            k, x, y = pairs_within((a1 - a0)[small], (b1 - b0)[small])
            i, j = a0[small][k] + x, b0[small][k] + y
            near = (np.bitwise_count(v[i] ^ v[j]) <= max_bits) & (i != j)
            yield i[near], j[near]
        a0, a1, b0, b1, bits, same = (x[~small] for x in (a0, a1, b0, b1, bits, same))
        if not len(a0):
            continue
        zeros = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        cross = ~same
        stack.append((depth + 1, (
            np.concatenate([a0, am, a0, am[cross]]), np.concatenate([am, a1, am, a1[cross]]),
            np.concatenate([b0, bm, bm, b0[cross]]), np.concatenate([bm, b1, b1, bm[cross]]),
            np.concatenate([bits, bits, bits + 1, bits[cross] + 1]),
        )))


def _traverse(v: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, max_bits: int, label: np.ndarray) -> np.ndarray:
    """label with all fingerprints united that lie below the given pairs of trie nodes and differ in max_bits or fewer."""
    for i, j in near_pairs(v, pairs, depth, 64, max_bits, label):
        label[:] = united(label, i, j)
    return label


def _joined(top: int, width: int, hot_bits: int, max_bits: int):
    """Sorted rows (turn, node, cell, fingerprint turned) to links (a, b) that span the sets below each node."""

    def back(v: np.ndarray, turn: np.ndarray) -> np.ndarray:
        s = (turn * width).astype("u8")
        return np.where(s > 0, (v >> s) | (v << ((np.uint64(64) - s) % np.uint64(64))), v).view("i8")

    def work(batches):
        for turn, node, cell, signed in whole_groups(batches, 3):
            v = signed.view("u8")
            edge = runs(turn, node, cell)
            a0, a1, of = edge[:-1], edge[1:], cell[edge[:-1]]
            label = np.arange(len(v))
            plain = of < 0
            zero = np.zeros(plain.sum(), "i8")
            label = _traverse(v, (a0[plain], a1[plain], a0[plain], a1[plain], zero), top, max_bits, label)
            if not plain.all():
                a0, a1, of = a0[~plain], a1[~plain], of[~plain]
                low, high = of >> hot_bits, of & ((1 << hot_bits) - 1)
                sub = (v >> np.uint64(64 - top - hot_bits)) & np.uint64((1 << hot_bits) - 1)
                mid = np.array([s + np.searchsorted(sub[s:e], x, side="right") for s, e, x in zip(a0, a1, low, strict=True)], "i8")
                own = low == high
                label = _traverse(v, (a0, mid, np.where(own, a0, mid), a1, np.bitwise_count(low ^ high).astype("i8")), top + hot_bits, max_bits, label)
            moved = np.flatnonzero(label != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(back(v[moved], turn[moved])), pa.array(back(v[label[moved]], turn[moved]))], ["a", "b"])

    return work


def trie_links(distinct: DataFrame, fp_col: str = "fp", max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fingerprints that differ in max_bits or fewer.

    A trie over 64 bits is cut into max_bits + 1 stretches. Two fingerprints within the budget agree on one stretch at
    least, so for each stretch the fingerprints are turned to begin with it and dealt out by it: a task gets whole
    subtrees and traverses their node pairs together. A subtree with over hot_rows fingerprints is dealt out once
    more, by pairs of its descendants within the budget, so no task gets more than a part of it. The table of such
    subtrees has at most (max_bits + 1) * 2 ** stretch rows, whatever the input.
    """
    width = 64 // (max_bits + 1)
    fp = F.col(fp_col)
    turned = lambda s: fp if s == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))
    rows = distinct.select(F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), turned(t * width).alias("v")) for t in range(max_bits + 1)])).alias("x"))
    rows = rows.select("x.turn", F.shiftrightunsigned("x.v", 64 - width).alias("node"), "x.v")
    hot = rows.groupBy("turn", "node").count().filter(F.col("count") > hot_rows).select("turn", "node", F.lit(True).alias("hot")).collect()
    cell = F.lit(-1)
    if hot:
        side = 1 << HOT_BITS
        known = distinct.sparkSession.createDataFrame(hot, "turn int, node long, hot boolean")
        rows = rows.join(F.broadcast(known), ["turn", "node"], "left")
        sub = F.shiftrightunsigned("v", 64 - width - HOT_BITS).bitwiseAND(side - 1).cast("int")
        near = F.filter(F.sequence(F.lit(0), F.lit(side - 1)), lambda t: F.bit_count(t.bitwiseXOR(sub)) <= max_bits)
        cells = F.transform(near, lambda t: F.least(t, sub) * side + F.greatest(t, sub))
        rows = rows.withColumn("cell", F.explode(F.when(F.col("hot"), cells).otherwise(F.array(cell))))
    else:
        rows = rows.withColumn("cell", cell)
    rows = rows.select("turn", "node", F.col("cell").cast("int").alias("cell"), "v")
    dealt = rows.repartition("turn", "node", "cell").sortWithinPartitions("turn", "node", "cell", "v")
    return dealt.mapInArrow(_joined(width, width, HOT_BITS, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs, repeated rows included.

    Equal fingerprints are one class from the start, so copies cost one entry however many they are; links join
    classes. component_id is the least id that links reach. Null counts as empty; texts without words have the
    fingerprint 0 and are linked like any other; a text of fewer words than a shingle is one shingle. A null id stays
    and is passed over in component_id, which is null only if no row of the component has an id. Other columns aren't
    read. Texts are read whole; memory follows the longest text and a batch of fingerprints. Ties, fingerprints that are equal or equally far apart, are all
    linked, so no order decides. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected(trie_links(classes.select("fp"), "fp", max_bits, hot_rows), "a", "b")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = durable(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
