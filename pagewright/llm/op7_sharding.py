"""Shards of near-equal bytes by a k-d tree over document metadata."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import durable, narrow, table, whole_text

SHARDS = 40
#: Bytes that every row counts on top of its text.
ROW_BYTES = 16
#: A cut may miss its median by this share of a shard; where it would miss by more, equal texts that it falls among are set aside.
TOLERANCE = 0.02
#: Groups that a cut sets aside at most before it misses by what the next one weighs.
SET_ASIDE = 12
#: Rows that get their slots in one task, on average.
SLOT_ROWS = 50_000
#: A key is the coordinate, then bits of the text's hash, then bits of the id's hash.
COORDINATE_BITS, TEXT_BITS, ID_BITS = 20, 27, 15
#: Bits of the key that are settled in each pass over the rows.
PASSES = (13, 13, 13, 8, 15)


@dataclass
class _Node:
    """Part of the tree: shards first to first + n - 1. A cut node holds the keys up to ``cut`` on the left; texts in ``before`` and ``behind`` (by their part of the key) go left and right wherever they are."""

    first: int
    n: int
    dim: int | None = None
    cut: int | None = None
    before: tuple[int, ...] = ()
    behind: tuple[int, ...] = ()
    left: _Node | None = None
    right: _Node | None = None

    def place(self) -> Column:
        """The first shard of the leaf that a row falls into, as an expression."""
        if self.left is None:
            return F.lit(self.first)
        key = F.col(f"k{self.dim}")
        left, text = key <= self.cut, F.shiftright(key, ID_BITS)
        if self.behind:
            left &= ~text.isin(*self.behind)
        if self.before:
            left |= text.isin(*self.before)
        return F.when(left, self.left.place()).otherwise(self.right.place())

    def leaves(self) -> list[_Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def split(self, dim: int, cut: int, before: list[int], behind: list[int]) -> None:
        half = self.n // 2
        self.dim, self.cut, self.before, self.behind = dim, cut, tuple(before), tuple(behind)
        self.left, self.right = _Node(self.first, half), _Node(self.first + half, self.n - half)


def _pick(values: dict[int, int | float], default: int = -1) -> Column:
    """The value for the row's node."""
    out = F.lit(default).cast("long")
    for node, value in values.items():
        out = F.when(F.col("node") == node, F.lit(value)).otherwise(out)
    return out


def _points(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(id, size, crc, k0..): a key for each dimension; the first is the size, the others are columns that docs has. Equal texts share their coordinates."""
    text, wide = whole_text(text_col), (1 << COORDINATE_BITS) - 1
    own = [d for d in dims if d in docs.columns]
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"),
        *[F.shiftright(F.crc32(F.coalesce(F.col(d).cast("string"), F.lit("")).cast("binary")), 32 - COORDINATE_BITS).alias(f"x{i}") for i, d in enumerate(own, 1)],
    )
    if own:
        rows = durable(rows)
        shared = rows.groupBy("h").agg(*[F.min(f"x{i}").alias(f"x{i}") for i in range(1, len(own) + 1)])
        rows = rows.drop(*[f"x{i}" for i in range(1, len(own) + 1)]).join(shared, "h")
    x0 = F.least(F.floor(F.log2(F.col("size").cast("double")) * F.lit(wide / 48)), F.lit(wide)).cast("long")
    low = F.shiftleft(F.col("h").bitwiseAND((1 << TEXT_BITS) - 1), ID_BITS).bitwiseOR(F.xxhash64("id").bitwiseAND((1 << ID_BITS) - 1))
    key = lambda x: F.shiftleft(x.cast("long"), TEXT_BITS + ID_BITS).bitwiseOR(low)
    return durable(rows.select("id", "size", "crc", key(x0).alias("k0"), *[key(F.col(f"x{i}")).alias(f"k{i}") for i in range(1, len(own) + 1)])), 1 + len(own)


def _crossing(placed: DataFrame, targets: dict[int, float]) -> dict[int, tuple[int, int, int, int]]:
    """For each node the first bin where the running bytes reach the target: (bin, bytes before it, bytes with it, its rows). placed: node, bin, size."""
    by_bin = placed.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    run = by_bin.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    target = F.lit(0.0)
    for node, value in targets.items():
        target = F.when(F.col("node") == node, F.lit(float(value))).otherwise(target)
    hit = run.filter((F.col("upto") >= target) & (F.col("upto") - F.col("w") < target))
    return {r.node: (r.bin, r.upto - r.w, r.upto, r.n) for r in hit.select("node", "bin", "w", "upto", "n").collect()}


def _level(points: DataFrame, root: _Node, open_: list[_Node], n_dims: int, shard: float) -> None:
    """Cut every open node along its widest dimension at its weighted median.

    Where the median falls into the rows of one text that weigh more than the slack but fit into a shard, the text is set aside
    to the right, or to the left if the right is full of such, and the median of the rest is looked for again. A text that occurs once just goes to
    the nearer side.
    """
    slack = TOLERANCE * shard
    at = points.withColumn("node", root.place())
    spans = [F.max(f"k{d}").alias(f"hi{d}") for d in range(n_dims)] + [F.min(f"k{d}").alias(f"lo{d}") for d in range(n_dims)]
    stats = {r.node: r for r in at.groupBy("node").agg(F.sum("size").alias("w"), *spans).collect()}
    dim = {x.first: max(range(n_dims), key=lambda d: (stats[x.first][f"hi{d}"] - stats[x.first][f"lo{d}"]) if x.first in stats else 0) for x in open_}
    want = {x.first: stats[x.first].w * (x.n // 2) / x.n for x in open_ if x.first in stats}
    key = F.lit(0).cast("long")
    for node, d in dim.items():
        key = F.when(F.col("node") == node, F.col(f"k{d}")).otherwise(key)
    at = at.withColumn("key", key)
    cut, before_, behind = {}, {n: [] for n in want}, {n: [] for n in want}
    room = {x.first: stats[x.first].w - want[x.first] for x in open_ if x.first in want}  # for what is set aside to the right
    waiting, tries = set(want), 0
    while waiting:
        again, tries = set(), tries + 1
        rest = at
        for n in waiting:
            if aside := before_[n] + behind[n]:
                rest = rest.filter((F.col("node") != n) | ~F.shiftright("key", ID_BITS).isin(*aside))
        prefix, below, shift = {n: 0 for n in waiting}, dict.fromkeys(waiting, 0), sum(PASSES)
        for bits in PASSES:
            if not prefix:
                break
            inside = rest.filter(F.col("node").isin(list(prefix))).filter(F.shiftright("key", shift) == _pick(prefix))
            shift -= bits
            found = _crossing(inside.select("node", F.shiftright("key", shift).alias("bin"), "size"), {n: want[n] - below[n] for n in prefix})
            for n, (bin_, before, upto, n_rows) in found.items():
                prefix[n], start = bin_, below[n]
                below[n] = start + before
                if shift > ID_BITS:
                    continue
                over, under = start + upto - want[n], want[n] - below[n]
                if shift == 0:  # the last rows of a text that no shard can hold
                    cut[n] = bin_ if over <= under else bin_ - 1
                elif min(over, under) <= slack or upto - before <= shard and (n_rows == 1 or tries > SET_ASIDE):
                    cut[n] = ((bin_ + (over <= under)) << shift) - 1
                elif upto - before <= shard:
                    again.add(n)
                    if upto - before <= room[n]:
                        behind[n].append(bin_)
                        room[n] -= upto - before
                    else:
                        before_[n].append(bin_)
                        want[n] -= upto - before
            prefix = {n: p for n, p in prefix.items() if n not in cut and n not in again and n in found}
        waiting = again
    for x in open_:
        x.split(dim[x.first], cut.get(x.first, -1), before_.get(x.first, []), behind.get(x.first, []))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs: shards of near-equal bytes.

    A k-d tree is cut level by level. The dimensions are the size and the columns ``dims`` that docs has (as fixed
    hash coordinates); a node is cut along the one its rows spread widest in, at the weighted median, or at the share that
    fits if its number of leaves is odd, until ``shards`` leaves are left, or as many as make ``target_bytes`` each.
    Medians come from histograms that are refined in five passes; the driver sees one row a node. Equal texts have
    equal coordinates and stay together if together they fit into a shard; a text that fills more, a third of the table say, is shared out by id
    where a cut would else miss by over TOLERANCE of a shard. Slots count from 0 in each shard without a gap, in no particular order of
    texts. Null texts count as empty, null metadata as '', a null id is hashed as null; repeated rows each get a slot.
    Rows that tie on a key, rows of one text and id, stay together. Of a long text only size and hashes are kept; other columns than id, text and dims
    aren't read. An empty table gives an empty result. grown_shard is null under this law.
    """
    points, n_dims = _points(docs, id_col, text_col, dims)
    rows, total = points.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = shards or max(1, math.ceil(total / (target_bytes or total or 1)))
    root = _Node(0, n)
    while open_ := [x for x in root.leaves() if x.n > 1]:
        _level(points, root, open_, n_dims, total / n)
    parts = max(1, math.ceil(rows / (n * SLOT_ROWS)))
    placed = points.select("id", "size", "crc", root.place().alias("shard")).withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(parts)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = durable(placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("start")))
    order = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size"))
    return placed.withColumn("at", order).join(narrow(starts), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
