import numpy as np

from pagewright.llm.op2_lattice import COSINE, nearest_e8, near_vectors, op2_lattice, roots

from .test_simhash import sets


def brute(rows):
    """Exact links of usable rows by id."""
    out = {r.vec_id: set() for r in rows}
    by = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is None or r.label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        by.setdefault((r.label, len(v)), []).append((r.vec_id, v))
    for own in by.values():
        ids, m = np.array([i for i, _ in own]), np.array([v for _, v in own], "f8")
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= COSINE), strict=True):
            if ids[a] != ids[b]:
                out[ids[a]].add(int(ids[b]))
    return out


def check(rows, got, least=0.9):
    want = brute(rows)
    n = sum(map(len, want.values()))
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= len(want[r.vec_id]) for r in got if r.vec_id is not None)
    assert found >= least * n
    if found == n:
        root = sets(list(want), [(a, b) for a, near in want.items() for b in near])
        assert all(r.component_id == root[r.vec_id] and r.kept == (r.vec_id == root[r.vec_id]) for r in got if r.vec_id is not None)
    return found, n


def test_lattice_points():
    m = roots()
    assert len(m) == 240 and np.allclose((m * m).sum(axis=1), 2)
    x = np.random.default_rng(1).normal(size=(2000, 8)) * 3
    near = nearest_e8(x)
    doubled = np.rint(near * 2).astype(int)
    assert np.allclose(near * 2, doubled) and ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all() and (doubled.sum(axis=1) % 4 == 0).all()
    best = ((x - near) ** 2).sum(axis=1)
    assert (best[:, None] <= ((x[:, None] - near[:, None] - m) ** 2).sum(axis=2) + 1e-9).all()


def families(spark, cosine, n=120, size=6, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for k in range(n):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            d = rng.normal(size=dim)
            d -= d @ c * c
            d /= np.linalg.norm(d)
            rows.append((i, (rng.uniform(0.5, 3) * (cosine * c + np.sqrt(1 - cosine**2) * d)).tolist(), k % 3))
            i += 1
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_recall_near_the_bound(spark):
    for own in (0.967, 0.975, 0.99):  # pairs of a family have about its square as cosine
        docs = families(spark, own)
        found, n = check(docs.collect(), near_vectors(docs).collect())
        assert n > 100


def test_hot_cells_and_documents(spark):
    docs = families(spark, 0.995, n=4, size=90)
    check(docs.collect(), near_vectors(docs, block_rows=16).collect(), 0.98)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    check(table.collect(), op2_lattice(spark, "/root/testdata/sf0.1").collect(), 0.98)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, "c"), (1, [2.0, 0.0], 1, "c"), (2, [1.0, 0.0], 1, "c"), (2, [1.0, 0.0], 1, "c"), (3, [1.0, 0.0], 2, "c"), (4, [1.0, 0.0], None, "c"), (5, None, 1, "c"), (6, [0.0, 0.0], 1, "c"),
            (7, [1.0, None], 1, "c"), (8, [nan, 1.0], 1, "c"), (9, [inf, 1.0], 1, "c"), (10, [], 1, "c"), (None, [1.0, 0.0], 1, "c"), (11, [1.0, 0.0, 0.0], 1, "c"), (12, [-1.0, 0.0], 1, "c"), (13, [1.0, 0.1], 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    linked = {0: 3, 1: 3, 2: 3, 13: 3}
    want = [(r[0], linked.get(r[0], 0), 0 if r[0] in linked else r[0], r[0] is None or r[0] not in linked or r[0] == 0) for r in rows]
    assert got == sorted(want, key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_very_long_and_very_short_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [2e200, 1e199]), (2, [1e-200, 0.0]), (3, [2e-200, 1e-201]), (4, [1.0, 0.0]), (5, [0.0, 1e300]), (6, [1e308, 1e308]), (7, [5e-324, 5e-324])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {k: (4, 0, k == 0) for k in range(5)} | {5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False)}
