from collections import Counter

import numpy as np

from pagewright.llm import op1_lm_score as lm


def brute(network, tokens):
    """Sum of log probabilities, token by token from a full table of all tokens' probabilities."""
    total, line = 0.0, [lm.EDGE] * lm.WINDOW + tokens + [lm.EDGE] * lm.WINDOW
    for i, t in enumerate(tokens):
        context = line[i : i + lm.WINDOW] + line[i + lm.WINDOW + 1 : i + 2 * lm.WINDOW + 1]
        h = np.tanh(sum(network.near[k][c].astype("f8") for k, c in enumerate(context)) + network.shift)
        g = np.exp(h @ network.group + network.group_bias)
        m = np.exp(np.einsum("w,gwm->gm", h, network.member) + network.member_bias)
        p = (g / g.sum())[:, None] * m / m.sum(axis=1, keepdims=True)
        assert abs(p.sum() - 1) < 1e-6
        total += np.log(p.reshape(-1)[t])
    return total


def test_gradients():
    rng = np.random.default_rng(3)
    net = lm.Network(*[(p + rng.normal(size=p.shape) * 0.3).astype("f8") for p in lm.Network.fresh().parts()])
    context, target = lm.windows([rng.integers(0, lm.TOKENS, 9).tolist(), rng.integers(0, lm.TOKENS, 4).tolist()])
    loss = lambda: -net.log_probability(context, target).mean()
    for part, g in zip(net.parts(), net.gradients(context, target), strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:5]:
            flat, e = part.reshape(-1), 1e-5
            was = flat[at]
            flat[at] = was + e
            up = loss()
            flat[at] = was - e
            down = loss()
            flat[at] = was
            assert abs((up - down) / (2 * e) - g.ravel()[at]) < 1e-5


def test_scores(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, odd):
        texts = df.selectExpr("doc_id as id", "coalesce(text, '') as text")
        common = lm.common_words(texts)
        want = Counter(w for r in texts.collect() for w in r.text.lower().split())
        assert common == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))][: lm.TOKENS - lm.BUCKETS]
        network = lm.train(texts, common)
        token = lm.numbering(common)
        text = {r.id: r.text for r in texts.collect()}
        got = lm.score(df, network, common).collect()
        assert len(got) == df.count()
        for r in [r for r in got if r.doc_id not in (None, 3)][:40]:
            own = [token[w] for w in text[r.doc_id].lower().split()]
            assert r.n_tokens == len(own)
            if len(own) < 3000:
                assert abs(r.log_likelihood - brute(network, own)) < 1e-3 * max(1, len(own))
            assert (r.mean_log_probability is None) == (not own)
    assert lm.pseudo_likelihood(odd.limit(0)).count() == 0


def test_context_helps(spark):
    """Over all documents the network beats the frequencies of the very same tokens, and shuffled words score worse."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.selectExpr("doc_id as id", "text")
    common = lm.common_words(texts)
    network = lm.train(texts, common)
    token = lm.numbering(common)
    held = [[token[w] for w in r.text.lower().split()] for r in texts.collect()]
    counts = np.bincount(np.concatenate(held), minlength=lm.TOKENS)
    unigram = float((counts[counts > 0] * np.log(counts[counts > 0] / counts.sum())).sum() / counts.sum())
    context, target = lm.windows(held)
    assert network.log_probability(context, target).mean() > unigram + 0.1
    mixed = np.random.default_rng(1).permutation(np.concatenate(held)).tolist()
    assert network.log_probability(*lm.windows([mixed])).mean() < unigram


def test_words_share_their_bucket(spark):
    """Every token has a probability of its own: the bucket's times the word's share of it, and the shares with the unseen one add up to 1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = docs.selectExpr("doc_id as id", "text")
    seen = Counter(w for r in texts.collect() for w in r.text.lower().split())
    common, first = lm.common_words(texts), lm.TOKENS - lm.BUCKETS
    token, network = lm.numbering(common), lm.train(texts, common)
    total = Counter()
    for w, n in seen.items():
        total[token[w]] += n
    assert sum(token[w] >= first for w in seen) > 1000
    some = spark.createDataFrame([(-1, "unseenword qqqq the unseenword"), (-2, None), (None, "zzzzunseen")], "doc_id long, text string").union(docs.select("doc_id", "text").limit(30))
    counts = lm.word_counts(texts)
    plain = {r.doc_id: r for r in lm.score(some, network, common).collect()}
    whole = {r.doc_id: r for r in lm.score(some, network, common, counts=counts).collect()}
    for r in some.collect():
        inside = sum(np.log((seen[w] or 1) / (total[token[w]] + 1)) for w in (r.text or "").lower().split() if token[w] >= first)
        assert abs(whole[r.doc_id].log_likelihood - plain[r.doc_id].log_likelihood - inside) < 1e-6 * max(1, abs(inside))
    trained = {r.doc_id: r.log_likelihood for r in lm.pseudo_likelihood(docs).collect()}
    assert all(abs(trained[i] - whole[i].log_likelihood) < 1e-2 * abs(trained[i]) for i in whole if i is not None and i >= 0)


def test_scores_dont_follow_the_layout(spark, monkeypatch):
    """The same documents in one partition and in eight get the same scores; several groups are trained."""
    monkeypatch.setattr(lm, "GROUP_POSITIONS", 60_000)
    monkeypatch.setattr(lm, "HEAD", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, eight = ({r.doc_id: r.log_likelihood for r in lm.pseudo_likelihood(docs.repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == eight.keys() and all(abs(one[i] - eight[i]) <= 1e-6 * max(1, abs(one[i])) for i in one)


def test_head_and_tail_agree(spark):
    """A word's share is the same whether its count was sent along or joined in."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = docs.selectExpr("doc_id as id", "text")
    counts = lm.word_counts(texts)
    common = lm.commonest(counts)
    network = lm.Network.fresh()
    all_, none = ({r.id: r.log_likelihood for r in lm.scored(lm.tokenised(texts, common, counts, head), network, common, counts).collect()} for head in (10**6, 0))
    assert all(abs(all_[i] - none[i]) < 1e-6 * max(1, abs(all_[i])) for i in all_)
