"""Near duplicates among embeddings by E8 lattice hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import durable, narrow, table
from pagewright.llm.components import connected
from pagewright.llm.unions import runs, united, whole_groups

COSINE = 0.93
#: Lattice tables, neighbouring cells probed in each, lattice units per unit of distance on the sphere, seed of the projections.
TABLES, PROBES, SCALE, SEED = 6, 4, 1.6, 8
#: Rows of one cell that are compared in one block; a cell with more is dealt out by pairs of blocks.
BLOCK_ROWS = 2048
#: Rows of whole cells that are multiplied at a time.
TILE = 512


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    rest = x[odd] - near[odd]
    worst = np.abs(rest).argmax(axis=1)
    step = np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    near[odd, worst] += step
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: the better of D8 and D8 shifted by a half in each coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    first = [tuple(s if k == i else t if k == j else 0 for k in range(8)) for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    second = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array(first + second)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each table a random map to 8 dimensions that keeps distances on average, and a random shift."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((tables, dim, 8)) / np.sqrt(8), rng.uniform(0, 2, (tables, 8))


def _mixed(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit number for each lattice point (rows of eight doubled integers)."""
    h = salt.astype("u8")
    for k in range(8):
        h = (h ^ (np.rint(points[:, k] * 2).astype("i8").view("u8"))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view("i8")


def cells(unit: np.ndarray, salt: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """rows x tables x (1 + probes) cell numbers: the cell of each vector, and the neighbouring cells nearest to it."""
    maps, shifts = _projections(unit.shape[1], tables, seed)
    out = np.empty((len(unit), tables, 1 + probes), "i8")
    for t in range(tables):
        x = unit @ maps[t] * scale + shifts[t]
        home = nearest_e8(x)
        toward = (x - home) @ roots().T
        best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
        own = salt + np.uint64(t * 0x51ED270B)
        out[:, t, 0] = _mixed(home, own)
        for p in range(probes):
            out[:, t, 1 + p] = _mixed(home + roots()[best[:, p]], own)
    return out


def _by_dimension(batch, tables: int, probes: int, scale: float, seed: int):
    """(rows, vectors as given, cells) for the vectors of each dimension in a batch of rep, weight, salt, vec."""
    salts = batch.column(2).to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
    flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        m = flat[starts[at][:, None] + np.arange(dim)]
        yield at, m, cells(m / np.sqrt((m * m).sum(axis=1, keepdims=True)), salts[at].view("u8"), tables, probes, scale, seed)


def _spread(*lattice):
    """A narrow row (cell, rep, t, probe) for each vector, table and cell."""

    def work(batches):
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, found in _by_dimension(batch, *lattice):
                n, tables, width = found.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.reshape(-1)),
                        pa.array(np.repeat(reps[at], tables * width)),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype="i4"), width), n)),
                        pa.array(np.tile(np.arange(width) > 0, n * tables)),
                    ],
                    ["cell", "rep", "t", "probe"],
                )

    return work


def _carried(*lattice):
    """(rep, weight, vec, all): what a vector brings to where it meets others. Components that single precision holds exactly go as such."""

    def work(batches):
        for batch in batches:
            for at, m, found in _by_dimension(batch, *lattice):
                short = m.astype("f4")
                exact = (short == m).all(axis=1)
                vec = [b"4" + short[k].tobytes() if exact[k] else b"8" + m[k].tobytes() for k in range(len(at))]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(vec, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["rep", "weight", "vec", "all"])

    return work


def _vector(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"f{held[:1].decode()}", offset=1).astype("f8")


def _verify(cosine: float, tables: int, probes: int):
    """Rows sorted by cell to (rep, n, root): other vectors linked here for the first time, and the least one of the linked set in this cell."""
    width = 1 + probes

    def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of rows (n x width cells of one table) meet in the table."""
        return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)

    def work(batches):
        for cell, part, rep, weight, t, probe, block, vec, every in whole_groups(batches, 2):
            edge = runs(cell, part)
            count, root = np.zeros(len(rep), "i8"), np.arange(len(rep))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi - lo < 2 or probe[lo:hi].all():
                    continue
                m = np.stack([_vector(x) for x in vec[lo:hi]])
                known = np.stack([np.frombuffer(x, "i8") for x in every[lo:hi]]).reshape(hi - lo, tables, width)
                norm, own, table_no = np.sqrt((m * m).sum(axis=1)), ~probe[lo:hi], t[lo]
                homes = np.flatnonzero(own)
                split = block[lo:hi]
                for start in range(0, hi - lo, TILE):
                    rows = np.arange(start, min(start + TILE, hi - lo))
                    near = (m[rows] @ m[homes].T) / (norm[rows][:, None] * norm[homes]) >= cosine
                    a, b = np.nonzero(near)
                    a, b = rows[a], homes[b]
                    ok = (~own[a] | (rep[lo + a] < rep[lo + b])) & (rep[lo + a] != rep[lo + b])
                    if part[lo] >= 0:  # a hot cell: this part is there for two of its blocks, or for one with itself
                        ok &= _own_blocks(part[lo], split[a], split[b])
                    a, b = a[ok], b[ok]
                    both = ~own[a] & (known[b, table_no, 1:] == known[a, table_no, :1]).any(axis=1)
                    fresh = ~(both & (rep[lo + b] < rep[lo + a]))
                    for before in range(table_no):
                        fresh &= ~met(known[a, before], known[b, before])
                    a, b = lo + a[fresh], lo + b[fresh]
                    np.add.at(count, a, weight[b])
                    np.add.at(count, b, weight[a])
                    root = united(root, a, b)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(count[at]), pa.array(rep[root[at]])], ["rep", "n", "root"])

    return work


def _own_blocks(part: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.minimum(a, b) == part >> 32) & (np.maximum(a, b) == part & 0xFFFFFFFF)


def lattice_links(vectors: DataFrame, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, cosine: float = COSINE, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """(rep, n, root) from (rep long, weight long, salt long, vec array<double>): rows to be summed by rep, and links to be followed.

    Vectors meet in a cell if it is the home of both, or the home of one and among the cells that the other probes;
    only vectors of equal salt and dimension do. Narrow rows find the cells where anything can meet at all; only
    there the vectors follow. A pair counts in the first table where it meets. A cell with over block_rows rows is dealt out by pairs
    of blocks, so what a task holds is bounded.
    """
    lattice = (tables, probes, scale, seed)
    given = vectors.select("rep", "weight", "salt", "vec")
    spread = given.mapInArrow(_spread(*lattice), "cell long, rep long, t int, probe boolean")
    shared = durable(spread.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("homes")).filter("n > 1 and homes > 0").select("cell", "n"))
    rows = spread.join(narrow(shared), "cell")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.shiftleft(F.least(x, F.col("block")).cast("long"), 32) + F.greatest(x, F.col("block")))
    rows = rows.withColumn("part", F.explode(F.when(F.col("n") > block_rows, pairs).otherwise(F.array(F.lit(-1).cast("long")))))
    rows = rows.join(given.mapInArrow(_carried(*lattice), "rep long, weight long, vec binary, all binary"), "rep")
    rows = rows.select("cell", "part", "rep", "weight", "t", "probe", "block", "vec", "all")
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_verify(cosine, tables, probes), "rep long, n long, root long")


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **lattice) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings.

    Two vectors are linked if their labels are equal and not null, their dimensions are equal, and their cosine in
    double precision is COSINE or more. Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without id or label, link with nothing: 0 links, a component of their own. Equal vectors of one label are one
    class with a weight and are linked to one another; copies of one id count once. Every link reported is exact;
    those between vectors that share no cell are missed, which the tests hold below a tenth of the links at any cosine above the bound.
    component_id is the least id that links reach, and of vectors that tie none is preferred but by it. Other columns aren't read. An empty table gives an
    empty result; repeated rows get a row each. The length of a vector doesn't matter: very long or short ones are scaled first.
    """
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    # the direction counts alone; very long and very short vectors are made about 1 long, so that no square of a component overflows or vanishes
    most = F.array_max(F.transform(vec, lambda x: F.abs(x)))
    scaled = F.when((most > 0) & (most < float("inf")) & ((most > 1e100) | (most < 1e-100)), F.transform(vec, lambda x: x / most)).otherwise(vec)
    rows = rows.withColumn("usable", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))).withColumn("vec", scaled)
    key = [F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit("second"), "vec", "label").alias("h2")]
    good = rows.filter("usable").select("id", "label", "vec", *key)
    alike = good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"), F.first("vec").alias("vec"), F.first(F.xxhash64("label")).alias("salt"))
    classes = durable(alike)
    found = durable(lattice_links(classes, **lattice))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected(found, "rep", "root")
    of = classes.select("h1", "h2", "rep", "weight").join(n, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    own = rows.select("id", F.when(F.col("usable"), key[0]).alias("h1"), F.when(F.col("usable"), key[1]).alias("h2"))
    component = F.coalesce("component_id", "id")
    return own.join(of, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs and what they reach; the same where the tables miss no link, as on the driver's tables.
ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}),
r AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN c ON id = vec_id LEFT JOIN n ON a = vec_id
"""
