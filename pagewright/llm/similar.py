"""Near copies by exact similarity of word shingles; candidates come from tries of SimHash fingerprints that are joined with themselves."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.bpe import released, slices
from pagewright.llm.common import durable, narrow, whole_text
from pagewright.llm.components import connected
from pagewright.llm.op4_simhash import near_pairs
from pagewright.llm.unions import pairs_within, runs, united, whole_groups

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Tables of fingerprints, two to a 64-bit number; bits of one, and of those in which two may differ. Two sets of similarity 0.8 differ in
#: arccos(0.889) / pi = 0.151 of all bits, so they meet in one of 16 tables with probability 0.993.
TABLES, BITS, MAX_BITS = 16, 32, 3
#: Bits that a pair may differ in on 64 bits of other tables, and on a wide fingerprint of so many 64-bit numbers that begins with those of
#: all tables: 0.151 of them and about four standard deviations.
CHECK_BITS, WIDE, WIDE_BITS = 21, 24, 285
#: Bits, of 96, in which candidates differ at most that are tried first: 2.4 of 32 and 0.151 of 64, and one standard deviation. All others are tried later.
TRIED_BITS = 15
#: Pairs that are worked out together, about, and bytes of their sets.
TILE_PAIRS, TILE_BYTES = 1 << 12, 8_000_000
#: Leading bits of a turned fingerprint by which it is dealt.
TOP = BITS // (MAX_BITS + 1)
#: Shingles whose bits are unfolded at a time; at most 255, so that a byte can count them. Pairs that are compared at a time.
HASHES, PAIRS = 255, 1 << 17

_WORDS64 = TABLES * BITS // 64
_DRAW = np.random.default_rng(SEED).integers(0, 1 << 63, (2, WIDE), dtype="u8") * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words, or of none, is one shingle."""
    from xxhash import xxh64_intdigest

    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    joined, ends, at = b" ".join(own), [], -1
    for w in own:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)] or [xxh64_intdigest(joined, seed)]
    return np.unique(np.array(hashes, "u8"))


def identity(own: np.ndarray) -> int:
    """A number that stands for a set of shingles."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED)


def fingerprints(own: np.ndarray, numbers: int = _WORDS64) -> np.ndarray:
    """The SimHash fingerprints of a set of shingles under so many hash functions of 64 bits: a bit is 1 if over half of the hashes have it."""
    count = np.zeros(numbers * 64, "i8")
    for start in range(0, len(own), HASHES):
        mixed = (own[start : start + HASHES, None] ^ _DRAW[0, :numbers]) * _DRAW[1, :numbers]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _DRAW[1, :numbers]
        mixed ^= mixed >> np.uint64(29)
        count += np.unpackbits(mixed.view("u1"), axis=1, bitorder="little").sum(axis=0, dtype="u1")
    return np.packbits(count * 2 > len(own), bitorder="little").view("u8")


def _prints(batches):
    for batch in (some for batch in batches for some in slices(batch, 2)):
        of, size, keys = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text)
            of.append(identity(own))
            size.append(len(own))
            keys.append(fingerprints(own))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype="i4") * _WORDS64), pa.array(np.concatenate([*keys, np.zeros(0, "u8")]).view("i8")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(of, "u8").view("i8")), pa.array(size, pa.int32()), listed], ["id", "h", "node", "size", "keys"])


def _sets(batches):
    """(h, text) to (node, shingles, wide); a text that occurs again in the task is passed over."""
    seen: set[int] = set()
    for batch in (some for batch in batches for some in slices(batch, 1)):
        held = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if h not in seen:
                seen.add(h)
                held.append(shingles(text))
        columns = [pa.array(np.array([identity(x) for x in held], "u8").view("i8")), *(pa.array([x.tobytes() for x in some], pa.binary()) for some in (held, [fingerprints(x, WIDE) for x in held]))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "wide"])


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    """(more, node) for both ends of each pair."""
    return pairs.select(*more, F.col("a").alias("node")).union(pairs.select(*more, F.col("b").alias("node")))


def _tiled(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """Durable (tile, a, b) of the pairs whose sets are near enough in size; a < b; sizes: node, size, to be broadcast if it is marked so.

    A pair goes by the least node beside one of its ends, so that the pairs of a group share a tile and each set goes there once. The pairs of a hub with over
    TILE_PAIRS of them or TILE_BYTES of sets are dealt over a square of tiles by the hashes of both ends, which bounds a tile; a set goes to two sides of the square, or to as many tiles as it has pairs.
    Such hubs are a row for so many pairs or bytes at most, few enough to broadcast.
    """
    hubs = narrow(durable(_ends(pairs, "a").groupBy("node").agg(F.min("a").alias("hub")).join(sizes, "node")))
    x, y = (hubs.select(F.col("node").alias(n), F.col("hub").alias(f"hub_{n}"), F.col("size").alias(f"size_{n}")) for n in "ab")
    fit = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    near = durable(pairs.join(x, "a").join(y, "b").filter(fit).select(F.least("hub_a", "hub_b").alias("hub"), "a", "b", "size_a", "size_b"))
    sets = near.select("hub", "a", F.col("size_a").alias("size")).union(near.select("hub", "b", "size_b")).distinct()
    held = sets.select("hub", "size", F.lit(0).alias("pairs")).union(near.select("hub", F.lit(0), F.lit(1)))
    large = held.groupBy("hub").agg(F.ceil(F.greatest(F.sum("size") * 8 / TILE_BYTES, F.sqrt(F.sum("pairs") / TILE_PAIRS))).alias("side")).filter("side > 1")
    side = F.coalesce("side", F.lit(1))
    tile = F.xxhash64("hub", *(F.pmod(F.xxhash64(n), side) for n in "ab"))
    return durable(near.join(F.broadcast(large), "hub", "left").select(tile.alias("tile"), "a", "b"))


def _similar(similarity: float):
    """Sorted rows (tile, a, b, shingles), first the sets of a tile (b null) and then its pairs, to links that connect as much as all similar pairs of the tile."""

    def work(batches):
        now, held, least = None, {}, {}

        def root(x: int) -> int:
            while (up := least.get(x, x)) != x:
                least[x] = x = least.get(up, up)
            return x

        for batch in (some for batch in batches for some in slices(batch, 3)):
            links = []
            for tile, a, b, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    now, held, least = tile, {}, {}
                if b is None:
                    held[a] = np.frombuffer(own, "u8")
                    continue
                i, j = sorted((root(a), root(b)))
                if i != j:
                    both = len(np.intersect1d(held[a], held[b], assume_unique=True))
                    if both >= (len(held[a]) + len(held[b]) - both) * similarity - 1e-9:
                        links.append((a, b))
                        least[j] = i
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        released()

    return work


def _dealt(nodes: DataFrame, *more: str, other: tuple[str, ...] = ("x.other",)) -> DataFrame:
    """(part, v, other, node, more) for each table and turn of a node's fingerprints, dealt and sorted by part and v; other: 64 bits of other tables, if they are asked for.

    Two fingerprints within the budget agree on one of MAX_BITS + 1 stretches at least, so each is turned to begin with each
    stretch and dealt out by it: a task gets whole subtrees.
    """
    rows = []
    for t in range(TABLES):
        low = F.shiftrightunsigned(F.col("keys")[t // 2], 32 * (t % 2)).bitwiseAND((1 << BITS) - 1)
        others = F.col("keys")[(t // 2 + 1) % _WORDS64]
        for turn in range(MAX_BITS + 1):
            v = F.shiftleft(low, turn * TOP).bitwiseOR(F.shiftrightunsigned(low, BITS - turn * TOP)).bitwiseAND((1 << BITS) - 1) if turn else low
            rows.append(F.struct(F.lit((t * (MAX_BITS + 1) + turn) << TOP).alias("base"), v.alias("v"), others.alias("other")))
    out = nodes.select("node", *more, F.explode(F.array(*rows)).alias("x"))
    out = out.select((F.col("x.base") + F.shiftright("x.v", BITS - TOP)).cast("int").alias("part"), "x.v", *other, "node", *more)
    return _by_part(out)


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "v", "node")


def _edges(a: np.ndarray, b: np.ndarray, bits: np.ndarray | None = None) -> pa.RecordBatch:
    ends = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
    return pa.RecordBatch.from_arrays(ends, ["a", "b"]) if bits is None else pa.RecordBatch.from_arrays([*ends, pa.array(bits.astype("i4"))], ["a", "b", "bits"])


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Of the pairs some that unite as much as all of them, which label then shows: each set picks the first pair that leads out of it, again and again."""
    picked = []
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        chosen = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
        picked.append((i[chosen], j[chosen]))
        label[:] = united(label, i[chosen], j[chosen])
    return picked


def _spanning(batches):
    """Sorted rows (part, v, other, node) to candidate pairs, and the bits they differ in, that connect all nodes which a part's candidate pairs connect.

    Pairs that differ in few bits come first.

    Equal fingerprints are a run and stand together behind its first node, batch by batch, so a hot part is as large as its distinct fingerprints.
    """
    stars: list[pa.RecordBatch] = []

    def thinned(part, v, other, node):
        edge = runs(part, v)
        if len(edge) <= len(part):
            of = np.repeat(edge[:-1], np.diff(edge))
            bits = np.bitwise_count(other[of] ^ other)
            later = np.flatnonzero((of != np.arange(len(of))) & (bits <= CHECK_BITS))
            stars.append(_edges(node[of[later]], node[later], bits[later]))
            part, v, other, node = (x[edge[:-1]] for x in (part, v, other, node))
        return part, v, other, node

    first = (pa.RecordBatch.from_arrays([pa.array(x) for x in thinned(*[c.to_numpy() for c in batch.columns])], batch.schema.names) for batch in batches if batch.num_rows)
    for group in whole_groups(first, 1):
        part, v, other, node = thinned(*group)
        yield from stars
        stars.clear()
        top = v.astype("u8") << np.uint64(64 - BITS)
        bound = runs(part)
        label = np.arange(len(top))
        pairs = (bound[:-1], bound[1:], bound[:-1], bound[1:], np.zeros(len(bound) - 1, "i8"))
        for i, j in near_pairs(top, pairs, TOP, BITS, MAX_BITS, label):
            bits = np.bitwise_count(other[i] ^ other[j])
            alike = np.flatnonzero(bits <= CHECK_BITS)
            bits += np.bitwise_count(top[i] ^ top[j])
            alike = alike[np.argsort(bits[alike], kind="stable")]
            for a, b in _forest(label, i[alike], j[alike]):
                yield _edges(node[a], node[b], np.bitwise_count(other[a] ^ other[b]) + np.bitwise_count(top[a] ^ top[b]))
    released()


def _first_part(apart: np.ndarray) -> np.ndarray:
    """The table and turn, as one number, in which pairs meet first; apart: the bits by table in which each pair differs."""
    table = (np.bitwise_count(apart) <= MAX_BITS).argmax(axis=1)
    own = apart[np.arange(len(apart)), table]
    leading = own[:, None] >> (BITS - TOP - TOP * np.arange(MAX_BITS + 1, dtype="u4")) & np.uint32((1 << TOP) - 1)
    return table * (MAX_BITS + 1) + (leading == 0).argmax(axis=1)


def _near_runs(part: np.ndarray, v: np.ndarray, root: np.ndarray):
    """Runs of equal fingerprints (where they start, and how long they are), and the batches of pairs (i, j) of runs near each other that hold different roots; i = j where one does itself."""
    edge = runs(part, v)
    first = edge[:-1]
    pure = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
    _, label = np.unique(root[first], return_inverse=True)
    label = np.where(pure, label, len(label) + np.arange(len(first)))
    top = v[first].astype("u8") << np.uint64(64 - BITS)
    bound = runs(part[first])
    pairs = (bound[:-1], bound[1:], bound[:-1], bound[1:], np.zeros(len(bound) - 1, "i8"))
    mixed = np.flatnonzero(~pure)
    found = chain([(mixed, mixed)], near_pairs(top, pairs, TOP, BITS, MAX_BITS, label))
    return first, np.diff(edge), ((i[apart], j[apart]) for i, j, apart in ((i, j, (label[i] != label[j]) | (i == j)) for i, j in found))


def _beside_others(batches):
    """Those of sorted rows (part, v, node, root) that have a row of another root near them in their part: all that _across can pair."""
    for part, v, node, root in whole_groups(batches, 1):
        first, size, found = _near_runs(part, v, root)
        beside = np.zeros(len(first), bool)
        for i, j in found:
            beside[i] = beside[j] = True
        stay = np.repeat(beside, size)
        yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (part, v, node, root)], ["part", "v", "node", "root"])
    released()


def _across(batches):
    """Sorted rows (part, v, node, root, wide) to all candidate pairs of different roots, each where it is met first."""
    for part, v, node, root, wide in whole_groups(batches, 1):
        first, size, found = _near_runs(part, v, root)
        bits = np.frombuffer(b"".join(wide), "u8").reshape(-1, WIDE)
        for i, j in found:
            step = np.cumsum(size[i] * size[j]) // PAIRS
            for s in np.unique(step):
                k, x, y = pairs_within(size[i][step == s], size[j][step == s])
                a, b = first[i][step == s][k] + x, first[j][step == s][k] + y
                fit = (root[a] != root[b]) & ((i != j)[step == s][k] | (x < y))
                a, b = a[fit], b[fit]
                apart = bits[a] ^ bits[b]
                fit = np.bitwise_count(apart).sum(axis=1) <= WIDE_BITS
                fit &= _first_part(apart[:, :_WORDS64].copy().view("<u4")) == part[a] >> TOP
                yield _edges(node[a[fit]], node[b[fit]])
    released()


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, h, component_id, kept) for every row of docs, repeated rows included; h: xxhash64 of the text.

    Links are the pairs of texts whose fingerprints differ in at most three of 32 bits in one of 16 tables (and in no more of
    the other bits than similar sets do) and whose sets of five-word shingles have a Jaccard similarity of
    ``similarity`` or more, worked out exactly. Equal sets are one node from the start. The tries are traversed twice:
    at first for a forest of candidates, the nearest of which already connect large groups of copies;
    then for all candidates between groups that are still apart, sifted by wide fingerprints. So a large group of copies costs a few rows a
    copy; texts that are just short of similar cost a row a pair. Pairs that share nodes are worked out together, so that
    a set is sent to its group and not to each of its pairs, and wide fingerprints only where groups come near each other.

    Null counts as empty, and texts without words are alike. component_id is the least id that links reach; a null id
    comes after all others, and component_id is null only if no row of the component has an id. kept: rows without an id, and of the
    others in a component those of the least (id, h); so rows of one id with unrelated texts are judged apart, and rows that
    repeat both stay or go together.
    Of candidates that tie in nearness the one of the least hash is tried first, which changes no result. An empty table gives an empty result; columns but id and text aren't read. Texts are read whole, and memory follows the longest.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(whole_text(text_col)).alias("h"), whole_text(text_col).alias("text"))
    prints = durable(texts.mapInArrow(_prints, "id long, h long, node long, size int, keys array<long>"))
    nodes = durable(prints.groupBy("node").agg(_least().alias("first"), F.min("h").alias("h"), F.first("size").alias("size"), F.first("keys").alias("keys")))

    candidates = _dealt(nodes.select("node", "keys")).mapInArrow(_spanning, "a long, b long, bits int")
    candidates = durable(candidates.groupBy("a", "b").agg(F.min("bits").alias("bits")))
    met = durable(candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "size", "keys", "h"))
    asked = durable(met.select("h").distinct())
    sets = durable(texts.join(narrow(asked), "h", "left_semi").select("h", "text").mapInArrow(_sets, "node long, shingles binary, wide binary"))
    sizes = narrow(met.select("node", "size"))

    def verified(pairs: DataFrame) -> DataFrame:
        tiles = _tiled(pairs, sizes, similarity)
        wanted = durable(_ends(tiles, "tile").distinct())
        held = sets.join(narrow(wanted), "node").select("tile", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
        rows = held.union(tiles.select("tile", "a", "b", F.lit(None).cast("binary")))
        return durable(rows.repartition("tile").sortWithinPartitions("tile", "b").mapInArrow(_similar(similarity), "a long, b long"))

    links = verified(candidates.filter(F.col("bits") <= TRIED_BITS).select("a", "b"))
    roots = durable(connected(links, "a", "b"))
    own = met.join(roots, "node", "left").select("node", "keys", F.coalesce("root", "node").alias("root"))
    beside = _dealt(own, "root", other=()).mapInArrow(_beside_others, "part int, v long, node long, root long")
    wide = sets.select("node", "wide").dropDuplicates(["node"])
    later = _by_part(beside.join(wide, "node").select("part", "v", "node", "root", "wide"))
    later = verified(durable(later.mapInArrow(_across, "a long, b long")))
    roots = durable(connected(roots.union(later), "node", "root"))
    rooted = durable(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of = durable(rooted.join(least, "root").select("node", "least"))
    rows = prints.drop("size", "keys").join(narrow(of), "node")
    kept = F.col("id").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h")))
    return rows.select(F.col("id").alias(id_col), "h", F.col("least.id").alias("component_id"), kept.alias("kept"))


def _least() -> Column:
    """The least (id, h), null ids last."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
