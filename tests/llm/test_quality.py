import numpy as np

from pagewright.llm import op9_quality as q


def test_accuracy(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    bad = [i for i, t in truth.items() if t == 0]
    good = [i for i, t in truth.items() if t == 1]
    assert sum(not got[i].kept for i in bad) >= 0.95 * len(bad)
    assert sum(not got[i].kept for i in good) <= 0.005 * len(good)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(9)
    n, m = 200_000, q.N_LABELLERS
    good = rng.random(n) < 0.8
    finds = rng.uniform(0.2, 0.9, m)
    fires = rng.random((n, m)) < np.where(good[:, None], 0.01, finds)
    silent = rng.random((n, m)) < 0.1
    votes = np.where(silent, q.ABSTAIN, np.where(fires, q.BAD, q.GOOD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.votes[:, q.BAD, q.BAD] - finds).max() < 0.03


def test_odd_rows(spark, odd):
    got = q.quality(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.kept for r in got if r.doc_id in (0, 1, 2))
    assert q.quality(odd.limit(0)).count() == 0
    assert q.measures("")[0] == [0, None] + [None] * 8


def test_against_plain_python(spark):
    """Votes, label model, sample, features, regression and scores of all documents worked out anew, document by document."""
    import math
    from collections import Counter

    import xxhash

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows).repartition(3)).collect()}
    text = {r.doc_id: r.text or "" for r in rows}
    votes = {i: tuple(q.votes_on(q.measures(t)[0])) for i, t in text.items()}

    def probability(prior, accuses, said):
        """Of good: accuses[k] = (how often labeller k accuses a bad one, and a good one)."""
        like = [math.log(1 - prior), math.log(prior)]
        for (bad, good), v in zip(accuses, said, strict=True):
            if v != q.ABSTAIN:
                like = [x + math.log(p if v == q.BAD else 1 - p) for x, p in zip(like, (bad, good), strict=True)]
        return 1 / (1 + math.exp(like[0] - like[1]))

    prior, accuses, tally = q.PRIOR, [(q.ACCUSES_BAD, q.ACCUSES_GOOD)] * q.N_LABELLERS, Counter(votes.values())
    for _ in range(q.ROUNDS):
        good = {said: probability(prior, accuses, said) for said in tally}
        mass = sum(n * good[said] for said, n in tally.items())
        new = []
        for k in range(q.N_LABELLERS):
            rate = []
            for weight, hope in ((lambda said: 1 - good[said], q.ACCUSES_BAD), (lambda said: good[said], q.ACCUSES_GOOD)):
                yes = sum(n * weight(said) for said, n in tally.items() if said[k] == q.BAD) + q.SMOOTH * hope
                no = sum(n * weight(said) for said, n in tally.items() if said[k] == q.GOOD) + q.SMOOTH * (1 - hope)
                rate.append(yes / (yes + no))
            new.append((min(max(rate[0], q.LEAST_BAD), 0.99), min(max(rate[1], 1e-4), q.MOST_GOOD)))
        prior, accuses = (mass + q.SMOOTH * q.PRIOR) / (len(votes) + q.SMOOTH), new
    weak = {i: probability(prior, accuses, said) for i, said in votes.items()}
    assert all(abs(weak[i] - got[i].weak_label) < 1e-6 for i in text)

    hash_of = lambda i: (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) + 2**63) % 2**64 - 2**63
    sides = [sorted((i for i in text if (weak[i] >= 0.5) == side), key=lambda i: (hash_of(i), i)) for side in (False, True)]
    sample = [(i, len(side) / min(len(side), q.TEACHERS)) for side in sides for i in side[: q.TEACHERS]]

    def features(t):
        values, words = q.measures(t)
        raw = t.encode()
        count = Counter(int(q._buckets(np.frombuffer(raw[k : k + 3], "u1"))[0]) for k in range(len(raw) - 2)) if len(raw) < 4000 else None
        x = q.hashed(t, values, words).astype("f8")
        if count is not None:
            total = max(1, sum(count.values()))
            assert all(abs(x[b] - n / total) < 1e-6 for b, n in count.items())
        return x

    xs = {i: features(t) for i, t in text.items()}
    x, soft = np.array([xs[i] for i, _ in sample]), np.array([weak[i] for i, _ in sample])
    weight = np.array([w for _, w in sample])
    weight /= weight.sum()
    mean = weight @ x[:, :-2]
    scale = np.sqrt(weight @ (x[:, :-2] - mean) ** 2) + np.array([1e-4] * q.FEATURES + [1e-2] * q.N_LABELLERS)

    def standard(x):
        trust = np.concatenate([np.full(q.FEATURES, x[-2] / math.sqrt(q.FEATURES)), np.full(q.N_LABELLERS, x[-1])])
        return (x[:-2] - mean) / scale * trust

    z = np.array([standard(row) for row in x])
    w, b, pace_w, pace_b = np.zeros(z.shape[1]), math.log(prior / (1 - prior)), 0.0, 0.0
    for _ in range(q.STEPS):
        off = weight * (1 / (1 + np.exp(-(z @ w + b))) - soft)
        pace_w = 0.9 * pace_w - q.RATE * (z.T @ off + q.SHRINK * w)
        pace_b = 0.9 * pace_b - q.RATE * off.sum()
        w, b = w + pace_w, b + pace_b
    for i in text:
        p = 1 / (1 + math.exp(-max(-30, min(30, standard(xs[i]) @ w + b))))
        assert abs(p - got[i].score) < 2e-3 and (got[i].kept == (got[i].score >= 0.5)), i
