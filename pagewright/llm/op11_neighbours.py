"""Approximate nearest neighbours: NN-descent builds a neighbour graph by Spark joins, greedy search walks it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import durable, narrow, table
from pagewright.llm.ranks import ranked
from pagewright.llm.unions import runs

#: Neighbours that are returned, and that the graph keeps of each vector; reverse ones that join in at a node.
NEAREST, KEPT, BACK = 20, 64, 48
#: Orders of the first lists, pivots of each, pivots that make a sort key, vectors compared with one another along an order.
TABLES, PIVOTS, KEY_LENGTH, ALONG = 8, 64, 6, 512
#: Rounds of joins at most; they end before where less than this share of the lists changed. Nodes of one block.
ROUNDS, SETTLED, BLOCK_NODES = 4, 0.02, 4096
#: Best nodes that a query expands in a step, steps, and found ones that are ranked in double precision.
BEAM, STEPS, RANKED = 24, 2, 40
SEED = 11

#: Ids of one part, whose lists are merged together.
PART_IDS = 512

_LISTS = "id long, block long, near array<long>, sims array<float>, fresh array<boolean>"
_HELD = "home long, part long, ids array<long>, vecs array<float>, bounds array<float>"
_PARTED = "part long, ids array<long>, block long, counts array<int>, near array<long>, sims array<float>, fresh array<boolean>"


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(ids, blocks, counts, near, sims, fresh) -> pa.RecordBatch:
    ends = pa.array(np.append(0, np.cumsum(counts)).astype("i4"))
    columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (near, sims, fresh)]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blocks), *columns], ["id", "block", "near", "sims", "fresh"])


def _best(of, near, sims, fresh, k: int):
    """The k nearest of each run of ``of``, sorted, one row a neighbour, ties to the smaller id; an entry that isn't fresh stands for a fresh one of the same neighbour."""
    order = np.lexsort((fresh, near, of))
    of, near, sims, fresh = of[order], near[order], sims[order], fresh[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (near[1:] != near[:-1])
    of, near, sims, fresh = of[first], near[first], sims[first], fresh[first]
    order = np.lexsort((near, -sims, of))
    of, near, sims, fresh = of[order], near[order], sims[order], fresh[order]
    kept = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[kept], near[kept], sims[kept], fresh[kept]


def _chain(sims: np.ndarray) -> list[int]:
    """All of some items, each followed by the most similar one that is left, so that neighbours in number are alike."""
    out, left = [0], np.ones(len(sims), bool)
    left[0] = False
    while left.any():
        out.append(int(np.where(left, sims[out[-1]], -np.inf).argmax()))
        left[out[-1]] = False
    return out


def _keys(pivots: np.ndarray, length: int):
    """(id, vec) to (t, key, id, vec): for each order of vectors the numbers of the pivots nearest in angle, nearest first."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _rows_of(batch.column(1), pivots.shape[2])
            for t, own in enumerate(pivots):
                sims = m @ own.T
                top = np.argpartition(-sims, length - 1, axis=1)[:, :length] if length < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(m), 1))
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1).astype("u1")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, "i4")), pa.array([x.tobytes() for x in top], pa.binary()), batch.column(0), batch.column(1)], ["t", "key", "id", "vec"])

    return work


def _along(dim: int, k: int, width: int):
    """Sorted (t, key, id, vec) to lists: every vector's nearest among the ``width`` that stand together in the order of t."""

    def lists(ids, m):
        sims = m @ m.T
        np.fill_diagonal(sims, -np.inf)
        n = min(k, len(ids) - 1)
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n] if 0 < n < len(ids) - 1 else np.argsort(-sims, axis=1)[:, :n]
        return _lists(ids, np.full(len(ids), -1, "i8"), np.full(len(ids), n), ids[top].reshape(-1), np.take_along_axis(sims, top, 1).reshape(-1).astype("f4"), np.ones(n * len(ids), bool))

    def work(batches):
        held = 0, np.zeros(0, "i8"), np.zeros((0, dim), "f4")
        for batch in batches:
            t, ids, m = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _rows_of(batch.column(3), dim)
            for own in np.unique(t):
                if own != held[0] and len(held[1]):
                    yield lists(*held[1:])
                    held = own, held[1][:0], held[2][:0]
                at = t == own
                held = (own, np.concatenate([held[1], ids[at]]), np.concatenate([held[2], m[at]]))
                while len(held[1]) >= 2 * width:  # what is left over at the end of a task is never alone
                    yield lists(held[1][:width], held[2][:width])
                    held = own, held[1][width:], held[2][width:]
        for lo in range(0, len(held[1]), max(1, -(-len(held[1]) // max(1, len(held[1]) // width)))):
            size = -(-len(held[1]) // max(1, len(held[1]) // width))
            yield lists(held[1][lo : lo + size], held[2][lo : lo + size])

    return work


def _merged(k: int, most: int = 4_000_000):
    """Sorted rows of lists by part of the ids (part, ids, block, counts, near, sims, fresh) to one list an id: the k nearest of all of its lists. Rows of a part stream and are thinned out on the way, so there may be any number."""

    def work(batches):
        part, lists, known, size = None, [], [], 0
        for batch in batches:
            parts = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[: len(parts)]), len(parts))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if part is not None and parts[lo] != part:
                    yield out(known, lists)
                    lists, known, size = [], [], 0
                part = parts[lo]
                _, ids, block, counts, near, sims, fresh = batch.slice(lo, hi - lo).columns
                own = ids.flatten().to_numpy()
                known.append((own, np.repeat(block.to_numpy(), pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))))
                flat = near.flatten().to_numpy(), sims.flatten().to_numpy(), fresh.flatten().to_numpy(zero_copy_only=False)
                lists.append((np.repeat(own, counts.flatten().to_numpy()), *flat))
                size += len(flat[0])
                if size > most:
                    lists = [_best(*(np.concatenate(x) for x in zip(*lists, strict=True)), k)]
                    size = len(lists[0][0])
        if part is not None:
            yield out(known, lists)

    def out(known, lists):
        ids, blocks = (np.concatenate(x) for x in zip(*known, strict=True))
        best = _best(*(np.concatenate(x) for x in zip(*lists, strict=True)), k)
        order = np.argsort(ids, kind="stable")
        ids, blocks = ids[order], blocks[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        own = ids[first]
        counts = np.searchsorted(best[0], own, "right") - np.searchsorted(best[0], own)
        return _lists(own, np.maximum.reduceat(blocks, first), counts, *best[1:])

    return work


def _part(parts: int) -> Column:
    """The part of the ids that an id belongs to: lists of a part come to one task."""
    return F.pmod(F.xxhash64("id"), F.lit(parts))


def _as_lists(rows: DataFrame, k: int) -> DataFrame:
    """One list an id from rows of lists by part, durable."""
    rows = rows.select("part", "ids", "block", "counts", "near", "sims", "fresh")
    return durable(rows.repartition("part").sortWithinPartitions("part").mapInArrow(_merged(k), _LISTS))


def _by_part(lists: DataFrame, parts: int) -> DataFrame:
    return lists.select(_part(parts).alias("part"), F.array("id").alias("ids"), "block", F.array(F.size("near")).alias("counts"), "near", "sims", "fresh")


def _padded(lists: pa.ChunkedArray, known: np.ndarray) -> np.ndarray:
    """Lists of ids as rows of positions in known (sorted); len(known) where there is none."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.full((len(counts), max(1, counts.max(initial=0))), len(known))
    out[np.arange(out.shape[1]) < counts[:, None]] = np.searchsorted(known, lists.flatten().to_numpy())
    return out


def _sorted(ids: np.ndarray, m: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids, their vectors and a zero one at the end, their bounds and an infinite one at the end, and the order that sorts them."""
    order = np.argsort(ids)
    return ids[order], np.vstack([m[order], np.zeros((1, m.shape[1]), "f4")]), np.append(bound[order], np.float32(np.inf)), order


def _vectors(held: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What _sorted gives, of all rows of vectors that a block holds."""
    ids, vecs, bounds = (held.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "vecs", "bounds"))
    return _sorted(ids, vecs.reshape(-1, dim), bounds)


def _packed(dim: int):
    """Cogrouped parts of the ids, what blocks name of one and its vectors, to one row a block with all that it names of the part."""

    def work(named: pa.Table, own: pa.Table) -> pa.Table:
        ids, m, bound, _ = _sorted(own.column("id").to_numpy(), _rows_of(own.column("vec").combine_chunks(), dim), own.column("bound").to_numpy())
        home, wanted = named.column("home").to_numpy(), named.column("id").to_numpy()
        order = np.lexsort((wanted, home))
        order = order[np.isin(wanted[order], ids)]
        home, wanted = home[order], wanted[order]
        at, edge = np.searchsorted(ids, wanted), runs(home).astype("i4")
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for ends, x in ((edge, wanted), (edge * dim, m[at].reshape(-1)), (edge, bound[at]))]
        part = np.repeat(named.column("part").to_numpy()[:1], len(edge) - 1)
        return pa.Table.from_arrays([pa.array(home[edge[:-1]]), pa.array(part), *lists], ["home", "part", "ids", "vecs", "bounds"])

    return work


def _joined(dim: int, k: int, step: int = 32, most: int = 2_000_000):
    """Cogrouped blocks to rows of lists, one a part of the ids: at each centre every fresh neighbour meets every other, and what brings either nearer than its farthest so far is kept."""

    def work(centres: pa.Table, held: pa.Table) -> pa.Table:
        ids, m, bound, order = _vectors(held, dim)
        per = pa.compute.list_value_length(held.column("ids").combine_chunks()).to_numpy(zero_copy_only=False)
        part_of, none = np.repeat(held.column("part").to_numpy(), per)[order], len(ids)
        new, every = _padded(centres.column("new"), ids), _padded(centres.column("every"), ids)
        found, size = [], 0

        def compact(found):
            of, near, sims = (np.concatenate(x) for x in zip(*found, strict=True))
            return list(_best(of, near, sims, np.ones(len(of), bool), k)[:3])

        for lo in range(0, len(new), step):
            a, b = new[lo : lo + step], every[lo : lo + step]
            sims = m[a] @ m[b].transpose(0, 2, 1)
            c, i, j = np.nonzero(sims > np.minimum(bound[a][:, :, None], bound[b][:, None, :]))
            s, x, y = sims[c, i, j], a[c, i], b[c, j]
            ok = (x != y) & (x != none) & (y != none)
            s, x, y = s[ok], x[ok], y[ok]
            for p, q in ((x, y), (y, x)):
                better = s > bound[p]
                found.append((p[better], q[better], s[better]))
                size += int(better.sum())
            if size > most:
                found = [tuple(compact(found))]
                size = len(found[0][0])
        of, near, sims = compact(found) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, "f4"))
        by = np.argsort(part_of[of], kind="stable")
        of, near, sims = of[by], near[by], sims[by]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])  # of the lists
        own, counts = of[starts], np.diff(np.append(starts, len(of)))
        rows = np.flatnonzero(np.append(True, part_of[own][1:] != part_of[own][:-1])[: len(own)])  # of the parts
        per, ends = np.append(rows, len(own)).astype("i4"), np.append(starts[rows], len(of)).astype("i4")
        lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in ((per, ids[own]), (per, counts.astype("i4")), (ends, ids[near]), (ends, sims), (ends, np.ones(len(of), bool)))]
        columns = [pa.array(part_of[own][rows]), lists[0], pa.array(np.full(len(rows), -1, "i8")), *lists[1:]]
        return pa.Table.from_arrays(columns, ["part", "ids", "block", "counts", "near", "sims", "fresh"])

    return work


def _needed(centres: DataFrame, lists: list[str], vectors: DataFrame, dim: int, parts: int) -> DataFrame:
    """(home, part, ids, vecs, bounds): all of vectors (id, vec, bound) that the centres of a block name, one row a part of the ids. A vector comes once to a block, not once to a centre."""
    named = centres.select(F.col("block").alias("home"), F.explode(F.concat(*lists)).alias("id")).distinct()
    named, own = (rows.withColumn("part", _part(parts)) for rows in (named, vectors.select("id", "vec", "bound")))
    return named.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(_packed(dim), _HELD)


def _in_blocks(graph: DataFrame, order: DataFrame, block_nodes: int, some: int = 32) -> DataFrame:
    """graph, durable, with blocks of so many nodes that are near one another, so that few vectors serve a block: nodes are sorted by the median of their neighbours' places in the first order."""
    places = ranked(order, ["t"], ["key"]).select("id", "at")
    near = graph.select("id", F.explode_outer(F.slice("near", 1, some)).alias("other"))
    middle = near.join(places.withColumnRenamed("id", "other"), "other", "left").groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("at"))
    middle = middle.select(F.lit(0).alias("t"), "id", F.try_element_at("at", F.greatest(F.size("at") / 2, F.lit(1)).cast("int")).alias("middle"))
    blocks = ranked(middle, ["t"], ["middle", "id"]).select("id", F.expr(f"at div {block_nodes}").alias("block"))
    return durable(graph.drop("block").join(blocks, "id").select("id", "block", "near", "sims", "fresh"))


def neighbour_graph(vectors: DataFrame, dim: int, k: int = KEPT, back: int = BACK, rounds: int = ROUNDS, settled: float = SETTLED, tables: int = TABLES, along: int = ALONG, block_nodes: int = BLOCK_NODES, seed: int = SEED) -> DataFrame:
    """(id, block, near, sims, fresh), durable: the k nearest found of each of vectors (id long, vec array<float> of dim), nearest first.

    First lists: vectors are sorted by range by the pivots nearest to them, in several orders, and compared with those that stand next to them. Then
    in each round the neighbours of a node, its own and up to ``back`` that count it as theirs, meet at the node: pairs of which
    one is new since the last round are compared. Nodes come in blocks of bounded size, to which vectors are joined.
    """
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(tables * PIVOTS).select("vec").collect()
    pivots = np.array([r.vec for r in sample], "f4").reshape(-1, dim)
    norms = np.sqrt((pivots.astype("f8") ** 2).sum(axis=1, keepdims=True))
    pivots = (pivots / np.where(norms > 0, norms, 1)).astype("f4")
    each = max(1, min(PIVOTS, len(pivots)))
    pivots = pivots[np.arange(tables * each) % max(1, len(pivots))].reshape(tables, each, dim)
    pivots = np.stack([own[_chain(own @ own.T)] for own in pivots])
    keyed = vectors.select("id", "vec").mapInArrow(_keys(pivots, min(KEY_LENGTH, each)), "t int, key binary, id long, vec array<float>")
    order = ["t", "key", F.xxhash64("id"), "id"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    n = vectors.count()
    parts = max(1, -(-n // PART_IDS))
    graph = _as_lists(_by_part(ordered.mapInArrow(_along(dim, k, along), _LISTS), parts), k)
    graph = _in_blocks(graph, keyed.filter("t = 0").select("t", "key", "id"), block_nodes)
    for _ in range(rounds):
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed <= settled * n * k:
            break
        edges = graph.select("id", F.explode(F.arrays_zip("near", "fresh")).alias("e")).select(F.col("e.near").alias("node"), "id", F.col("e.fresh").alias("fresh"))
        first = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("id", "node"), "id")
        reverse = edges.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= back).groupBy(F.col("node").alias("id"))
        reverse = reverse.agg(F.collect_list("id").alias("back"), F.collect_list(F.when(F.col("fresh"), F.col("id"))).alias("fresh_back"))
        none = F.array().cast("array<long>")
        fresh_near = F.transform(F.filter(F.arrays_zip("near", "fresh"), lambda x: x["fresh"]), lambda x: x["near"])
        centres = graph.join(reverse, "id", "left").select(
            "block", F.array_union(fresh_near, F.coalesce("fresh_back", none)).alias("new"), F.array_union("near", F.coalesce("back", none)).alias("every")
        )
        centres = durable(centres.filter(F.size("new") > 0))
        bounds = vectors.join(graph.select("id", F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(float("-inf"))).cast("float").alias("bound")), "id")
        met = centres.groupBy("block").cogroup(_needed(centres, ["every"], bounds, dim, parts).groupBy("home")).applyInArrow(_joined(dim, k), _PARTED)
        settled_lists = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
        graph = _as_lists(_by_part(settled_lists, parts).unionByName(met), k)
    return graph


def _seen(dim: int, most: int):
    """Cogrouped blocks of (id, vec, near, sims, new) to (id, block, near, sims, fresh): what a query had found, and the new ones with their nearness, the ``most`` nearest."""

    def work(queries: pa.Table, held: pa.Table) -> pa.Table:
        queries = queries.combine_chunks()
        ids, m, _, _ = _vectors(held, dim)
        own = queries.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        new = queries.column("new").combine_chunks()
        counts = pa.compute.list_value_length(new).to_numpy(zero_copy_only=False)
        of, node = np.repeat(np.arange(len(counts)), counts), np.searchsorted(ids, new.flatten().to_numpy())
        sims = np.concatenate([m[node[lo : lo + 65536]] [:, None, :] @ own[of[lo : lo + 65536]][:, :, None] for lo in range(0, len(of), 65536)] or [np.zeros((0, 1, 1), "f4")])[:, 0, 0]
        near = queries.column("near").combine_chunks()
        before = pa.compute.list_value_length(near).to_numpy(zero_copy_only=False)
        old = np.repeat(np.arange(len(before)), before)
        fresh = ~queries.column("done").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)
        best = _best(
            np.concatenate([old, of]), np.concatenate([near.flatten().to_numpy(), ids[node]]), np.concatenate([queries.column("sims").combine_chunks().flatten().to_numpy(), sims]),
            np.concatenate([fresh, np.ones(len(of), bool)]), most,
        )
        counts = np.bincount(best[0], minlength=len(counts))
        return pa.Table.from_batches([_lists(queries.column("id").to_numpy(), queries.column("block").to_numpy(), counts, *best[1:])])

    return work


def greedy_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int, beam: int = BEAM, steps: int = STEPS, most: int = KEPT) -> DataFrame:
    """(id, near, sims): the ``most`` nearest nodes that each of queries (id, block, vec, near, sims) finds from the nodes it starts with.

    In every step a query expands those of its ``beam`` nearest that it hasn't yet: the nodes next to them are joined from the graph, their
    vectors come once to each block of queries. fresh marks nodes that aren't expanded.
    """
    found = queries.withColumn("fresh", F.transform("near", lambda _: F.lit(True)))
    unit = vectors.withColumn("bound", F.lit(0.0).cast("float"))
    parts = max(1, -(-vectors.count() // PART_IDS))
    for _ in range(steps):
        ahead = F.transform(F.filter(F.slice(F.arrays_zip("near", "fresh"), 1, beam), lambda x: x["fresh"]), lambda x: x["near"])
        wave = found.select(F.col("id").alias("query"), F.explode(ahead).alias("id"))
        beyond = wave.join(graph.select("id", F.col("near").alias("next")), "id").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
        done = F.transform(F.arrays_zip("near", "fresh"), lambda x, i: ~x["fresh"] | (i < beam))
        rows = found.withColumn("done", done).join(beyond.withColumnRenamed("query", "id"), "id", "left")
        rows = rows.withColumn("new", F.array_except(F.coalesce("next", F.array().cast("array<long>")), F.concat("near", F.array("id")))).drop("next", "fresh")
        rows = durable(rows)
        held = _needed(rows, ["new"], unit, dim, parts)
        after = rows.groupBy("block").cogroup(held.groupBy("home")).applyInArrow(_seen(dim, most), _LISTS)
        found = durable(after.join(queries.select("id", "vec"), "id"))
    return found.select("id", "near", "sims")


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", **graph_options) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of embeddings where is_query (of id) holds the k nearest other rows found, by inner product in double precision, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components and rows without an id take no part; vectors of unequal
    dimension aren't compared. Equal vectors are one node of the graph, so any number of copies costs one; all of their ids count, the least k + 1
    of them can be among the nearest. Repeated rows count once; of several vectors of one id the nearest counts. Fewer rows than k are all returned.
    An empty table gives no rows; other columns aren't read.
    """
    vec = F.col("vec")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("second"), "vec")})
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("vec").alias("vec"), F.max("asks").alias("asks"))
    classes = durable(classes.withColumn("dim", F.size("vec")))
    of = durable(rows.select("h1", "h2", "id", "asks").join(narrow(classes.select("h1", "h2", "node")), ["h1", "h2"]).select("node", "id", "asks").distinct())
    few = of.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1).select("node", "id")
    out = None
    for (dim,) in sorted(classes.select("dim").distinct().collect()):
        found = _found(classes.filter(F.col("dim") == dim), dim, k, **graph_options)
        out = found if out is None else out.union(found)
    if out is None:
        out = classes.select(F.col("node").alias("query"), "node", F.lit(0.0).alias("score"))
    ids = out.join(few, "node").select("query", "id", "score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ids = ids.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    asked = of.filter("asks").select(F.col("node").alias("query"), F.col("id").alias("query_id"))
    pairs = asked.join(ids, "query").filter("query_id <> id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _found(classes: DataFrame, dim: int, k: int, **graph_options) -> DataFrame:
    """(query, node, score) for the nodes that ask, with themselves among what they find."""
    most = classes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0]
    vectors = durable(classes.select(F.col("node").alias("id"), F.transform("vec", lambda x: (x / F.lit(most)).cast("float")).alias("vec"), "asks"))
    graph = neighbour_graph(vectors.drop("asks"), dim, **graph_options)
    starts = graph.join(vectors.filter("asks"), "id").select("id", "block", "vec", "near", "sims")
    found = greedy_search(graph, vectors.drop("asks"), starts, dim)
    near = found.select(F.col("id").alias("query"), F.explode(F.concat(F.slice("near", 1, max(RANKED, 2 * k)), F.array("id"))).alias("node"))
    exact = classes.select("node", "vec")
    scored = near.join(exact, "node").join(exact.select(F.col("node").alias("query"), F.col("vec").alias("own")), "query")
    dot = F.aggregate(F.zip_with("own", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return scored.select("query", "node", dot.alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


#: Every pair, summed up in the order of components; the same where few enough vectors are compared outright, as on the driver's tables.
ORACLE = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), lambda s, x: s + x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= {NEAREST}
"""
