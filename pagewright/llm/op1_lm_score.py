"""Masked pseudo-likelihood of documents under a small network that sees a window on both sides of a token."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.bpe import Remembered, slices
from pagewright.llm.common import durable, table, whole_text

#: Outputs are GROUPS groups of MEMBERS tokens each; BUCKETS of the tokens stand for words by hash, the others for the commonest words.
GROUPS, MEMBERS, BUCKETS = 32, 32, 128
TOKENS = GROUPS * MEMBERS
#: Nothing there: before the start and behind the end of a document.
EDGE = TOKENS
#: Tokens seen on either side, width of the hidden layer.
WINDOW, WIDTH = 2, 16
#: Positions in a training step and in a scoring step; step size of both trainings, seed.
STEP, BATCH, RATE, SEED = 1 << 13, 1 << 14, 0.1, 1
#: Documents of the first, small training, how many words one of them may have, and how often it goes through them.
WARM_DOCUMENTS, WARM_WORDS, WARM_ROUNDS = 400, 20_000, 3
#: Positions that one network is trained on, on average, before networks are averaged.
GROUP_POSITIONS = 4_000_000
#: Words, the commonest ones, whose counts go to every task; the counts of others are joined in by word.
HEAD = 100_000
#: Pieces in which networks are summed up.
CHUNKS = 128


@dataclass
class Network:
    """tanh of one vector per place in the window, then a group, then a member of the group: two small softmaxes in place of a large one."""

    near: np.ndarray
    shift: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype("f4")
        zero = lambda *shape: np.zeros(shape, "f4")
        return cls(draw(2 * WINDOW, TOKENS + 1, WIDTH), zero(WIDTH), draw(WIDTH, GROUPS), zero(GROUPS), draw(GROUPS, WIDTH, MEMBERS), zero(GROUPS, MEMBERS))

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.shift, self.group, self.group_bias, self.member, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in cls.fresh().parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype("f4"))
            at += p.size
        return cls(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """A column for each position; context: 2 * WINDOW rows of tokens."""
        h = self.near[0][context[0]]
        for k in range(1, 2 * WINDOW):
            h += self.near[k][context[k]]
        h += self.shift
        return np.ascontiguousarray(np.tanh(h, out=h).T)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target between its neighbours."""
        order, slices = _by_group(target // MEMBERS)
        target = target[order]
        h, group, member = self.hidden(context[:, order]), target // MEMBERS, target % MEMBERS
        own = _log_softmax_at(self.group.T @ h + self.group_bias[:, None], group)
        for g, at in slices:
            own[at] += _log_softmax_at(self.member[g].T @ h[:, at] + self.member_bias[g][:, None], member[at])
        out = np.empty_like(own)
        out[order] = own
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log probability, for parts()."""
        n = np.float32(len(target))
        order, slices = _by_group(target // MEMBERS)
        context, target = context[:, order], target[order]
        h, group, member = self.hidden(context), target // MEMBERS, target % MEMBERS
        off = _softmax_less_one(self.group.T @ h + self.group_bias[:, None], group) / n
        d_member, d_member_bias = np.zeros_like(self.member), np.zeros_like(self.member_bias)
        back = self.group @ off
        for g, at in slices:
            own = h[:, at]
            below = _softmax_less_one(self.member[g].T @ own + self.member_bias[g][:, None], member[at]) / n
            d_member[g], d_member_bias[g] = own @ below.T, below.sum(axis=1)
            back[:, at] += self.member[g] @ below
        back *= 1 - h * h
        d_near = np.stack([np.stack([np.bincount(c, x, TOKENS + 1) for x in back], axis=1) for c in context]).astype("f4")
        return [d_near, back.sum(axis=1), h @ off.T, off.sum(axis=1), d_member, d_member_bias]


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order in which positions of one group stand together, and where each group that occurs stands in it."""
    order = np.argsort(group.astype("u1"), kind="stable")
    edges = np.searchsorted(group[order], np.arange(GROUPS + 1))
    return order, [(g, slice(edges[g], edges[g + 1])) for g in range(GROUPS) if edges[g] < edges[g + 1]]


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns of scores to the log probability of one row in each."""
    x -= x.max(axis=0)
    own = x[at, np.arange(len(at))]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def _softmax_less_one(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    x[at, np.arange(len(at))] -= 1
    return x


class Trainer:
    """Steps of a size that shrinks with the squared gradients so far."""

    def __init__(self, network: Network, rate: float = RATE, seen: float = 1e-6):
        self.network, self.rate = network, rate
        self.squares = [np.full_like(p, seen) for p in network.parts()]

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        for p, square, g in zip(self.network.parts(), self.squares, self.network.gradients(context, target), strict=True):
            square += g * g
            p -= self.rate * g / np.sqrt(square)


def windows(documents: list) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (2 * WINDOW rows) and targets of every token of every document."""
    edge = np.full(WINDOW, EDGE, "i4")
    line = np.concatenate([x for d in documents for x in (edge, np.asarray(d, "i4"))] + [edge])
    at = np.flatnonzero(line != EDGE)
    return np.stack([line[at + k] for k in range(-WINDOW, WINDOW + 1) if k]), line[at]


def numbering(common: list[str]) -> Remembered:
    """word -> token: its place among the common words, else a bucket by hash."""
    held = {w: i for i, w in enumerate(common)}
    return Remembered(lambda w: held[w] if w in held else bucket_of(w))


def bucket_of(word: str) -> int:
    return TOKENS - BUCKETS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) for every word of all texts; counted by task first, then over all."""

    def work(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
            if len(held) > 400_000:
                yield counted(held)
                held = Counter()
        yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(texts: DataFrame, n: int = TOKENS - BUCKETS) -> list[str]:
    """The n commonest words of all texts, equal counts by word."""
    return commonest(word_counts(texts), n)


def commonest(counts: DataFrame, n: int = TOKENS - BUCKETS) -> list[str]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(n).select("word").collect()]


def bucket_totals(counts: DataFrame, common: list[str]) -> np.ndarray:
    """How often the words of each bucket occur, common words left out."""
    known = counts.sparkSession.createDataFrame([(w,) for w in common], "word string")
    bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int").alias("bucket")
    rows = counts.join(F.broadcast(known), "word", "left_anti").groupBy(bucket).agg(F.sum("n").alias("total")).collect()
    out = np.zeros(BUCKETS)
    out[[r.bucket for r in rows]] = [r.total for r in rows]
    return out


def within_buckets(words: DataFrame, counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """(row, inside) for rows (row, word, times) of words that aren't common: the sum of times * log(share of the word in its bucket).

    A bucket's N counted words leave one part in N + 1 to unseen ones: a word counted n times has n / (N + 1), an unseen one 1 / (N + 1).
    """
    of = words.sparkSession.createDataFrame([(k, float(np.log(t + 1))) for k, t in enumerate(totals)], "bucket long, whole double")
    bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("bucket")
    each = words.join(counts, "word", "left").select("row", "times", "n", bucket).join(F.broadcast(of), "bucket")
    return each.groupBy("row").agg(F.sum(F.col("times") * (F.log(F.coalesce("n", F.lit(1))) - F.col("whole"))).alias("inside"))


def _packed(tokens: np.ndarray) -> bytes:
    return zstandard.compress(tokens.astype("<u2").view("u1").reshape(-1, 2).T.tobytes(), 1)


def _unpacked(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), "u1").reshape(2, -1).T).view("<u2").ravel()


def tokenised(texts: DataFrame, common: list[str], counts: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """Durable (row, id, h, n, tokens, inside, words, times) for every row of texts (id, text): a text is taken to pieces once.

    row numbers the rows, h is a hash of the text, n its number of words. With counts, inside sums up the log share in their bucket of
    the words among the ``head`` commonest, and words and times are those beyond them; without, there is nothing of that.
    """
    first, share = {w: i for i, w in enumerate(common)}, np.zeros(len(common))
    if counts is not None:
        rows = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in common], "word string")), "word", "left_anti")
        rows = rows.orderBy(F.desc("n"), "word").limit(head).toArrow()
        more, totals = rows["word"].to_pylist(), bucket_totals(counts, common)
        first |= {w: len(common) + i for i, w in enumerate(more)}
        own = np.array([bucket_of(w) for w in more], "i8")
        share = np.concatenate([share, np.log(rows["n"].to_numpy()) - np.log(totals[own - TOKENS + BUCKETS] + 1)])
        token = np.concatenate([np.arange(len(common)), own])
    else:
        token = np.arange(len(common))
    sent = texts.sparkSession.sparkContext.broadcast((first, token.astype("i4"), share))
    with_tail = counts is not None

    def work(batches):
        first, token, share = sent.value
        get, bucket = first.get, Remembered(bucket_of).__getitem__
        row = TaskContext.get().partitionId() << 40
        for batch in (some for batch in batches for some in slices(batch, 2)):
            sizes, held, inside, tails = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                at = np.fromiter(map(get, words, repeat(-1)), "i8", len(words))
                seen = at >= 0
                own = np.empty(len(at), "i4")
                own[seen] = token[at[seen]]
                tail = [words[i] for i in np.flatnonzero(~seen)]
                own[~seen] = list(map(bucket, tail))
                sizes.append(len(words))
                held.append(_packed(own))
                inside.append(float(share[at[seen]].sum()))
                tails.append(Counter(tail) if with_tail else {})
            ends = pa.array(np.cumsum([0, *map(len, tails)]), pa.int32())
            words = pa.ListArray.from_arrays(ends, pa.array([w for x in tails for w in x], pa.string()))
            times = pa.ListArray.from_arrays(ends, pa.array([n for x in tails for n in x.values()], pa.int32()))
            number = pa.array(np.arange(row, row + len(sizes)))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([number, batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()), pa.array(inside, pa.float64()), words, times], names)

    names = ["row", "id", "h", "n", "tokens", "inside", "words", "times"]
    kind = "row long, id long, h long, n long, tokens binary, inside double, words array<string>, times array<int>"
    return durable(texts.select(F.col("id").cast("long"), F.xxhash64(whole_text("text")).alias("h"), whole_text("text").alias("text")).mapInArrow(work, kind))


def train(texts: DataFrame, common: list[str]) -> Network:
    """A network trained on every token of all texts (id, text), see trained."""
    return trained(tokenised(texts, common))


def trained(rows: DataFrame) -> Network:
    """A network trained on every token of all tokenised rows, the same however the rows are dealt out.

    It begins with a small training on WARM_DOCUMENTS documents, those of the least hash with up to WARM_WORDS words. From there the documents of each
    group train a network of their own, and those are averaged by their tokens. Groups are made by a hash of id and text, as many as
    the number of tokens asks for, and a group's documents come in order of id and text. Networks are summed up in pieces, so
    no task or driver holds more than a few at a time.
    """
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key = F.xxhash64("id", "h")
    first = rows.filter((F.col("n") > 0) & (F.col("n") <= WARM_WORDS)).orderBy(key, "id", "h").limit(WARM_DOCUMENTS).select("tokens").collect()
    warm = Trainer(Network.fresh())
    context, target = windows([_unpacked(r.tokens) for r in first])
    for _ in range(WARM_ROUNDS):
        for start in range(0, len(target), STEP):
            warm.step(context[:, start : start + STEP], target[start : start + STEP])
    sent = rows.sparkSession.sparkContext.broadcast((warm.network.flat(), np.concatenate([s.ravel() for s in warm.squares])))

    def local(batches):
        group, own, n, held, waiting = None, None, 0, [], 0

        def steps():
            context, target = windows(held)
            for start in range(0, len(target), STEP):
                own.step(context[:, start : start + STEP], target[start : start + STEP])

        def network():
            pieces = np.array_split((own.network.flat().astype("f8") * n), CHUNKS)
            return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([group] * CHUNKS, pa.int64()), pa.array([n] * CHUNKS, pa.int64()), pa.array([p.astype("f4").tobytes() for p in pieces], pa.binary())], ["chunk", "group", "n", "sum"])

        for batch in batches:
            for g, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g != group:
                    if group is not None:
                        steps()
                        yield network()
                    group, n, held, waiting = g, 0, [], 0
                    flat, squares = sent.value
                    own = Trainer(Network.from_flat(flat))
                    own.squares = Network.from_flat(squares).parts()
                held.append(_unpacked(packed))
                n += len(held[-1])
                waiting += len(held[-1])
                if waiting >= 8 * STEP:
                    steps()
                    held, waiting = [], 0
        if group is not None:
            steps()
            yield network()

    def summed(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for chunk, _, n, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = held.setdefault(chunk, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(x, "f4").astype("f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], ["chunk", "n", "sum"])

    dealt = rows.filter("n > 0").select(F.pmod(key, F.lit(max(1, -(-total // GROUP_POSITIONS)))).alias("group"), "tokens", "id", "h")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "id", "h").select("group", "tokens")
    parts = dealt.mapInArrow(local, "chunk int, group long, n long, sum binary").repartition("chunk").sortWithinPartitions("chunk", "group")
    found = parts.mapInArrow(summed, "chunk int, n long, sum binary").collect()
    if not found:
        return warm.network
    return Network.from_flat(np.concatenate([np.frombuffer(r["sum"], "f8") / r.n for r in sorted(found, key=lambda r: r.chunk)]))


def score(docs: DataFrame, network: Network, common: list[str], id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_probability) for every row of docs.

    With counts (word, n) a word in a bucket has its share of the bucket; without, it has the whole bucket's probability.
    """
    return scored(tokenised(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), common, counts), network, common, counts).withColumnRenamed("id", id_col)


def scored(rows: DataFrame, network: Network, common: list[str], counts: DataFrame | None = None) -> DataFrame:
    """As score, with the column id, from tokenised rows."""
    sent = rows.sparkSession.sparkContext.broadcast(network)

    def work(batches):
        network = sent.value
        for batch in batches:
            sums = batch.column(4).to_numpy(zero_copy_only=False).copy()
            held, of, n = [], [], 0

            def flush():
                if held:
                    context, target = windows(held)
                    each = np.concatenate([network.log_probability(context[:, s : s + BATCH], target[s : s + BATCH]) for s in range(0, len(target), BATCH)])
                    sums[of] += np.add.reduceat(each.astype("f8"), np.cumsum([0, *[len(x) for x in held[:-1]]]))

            for k, packed in enumerate(batch.column(3).to_pylist()):
                own = _unpacked(packed)
                if len(own):
                    held.append(own)
                    of.append(k)
                    n += len(own)
                if n >= BATCH:
                    flush()
                    held, of, n = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["row", "id", "n_tokens", "log_likelihood"])

    found = rows.select("row", "id", "n", "tokens", "inside").mapInArrow(work, "row long, id long, n_tokens long, log_likelihood double")
    if counts is not None:
        each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        found = found.join(within_buckets(each, counts, bucket_totals(counts, common)), "row", "left")
        found = found.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("inside", F.lit(0.0)))
    return found.select("id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the words of docs, train on docs, score every row of docs.

    The score is the sum over a document's words of the log probability of each one given the two words on either side;
    a word that isn't among the commonest is seen by the network as its hash bucket, and has the bucket's probability times its
    share of the bucket's words in all of docs. Words are lower-cased, blank-separated.
    Null counts as empty: 0 tokens, likelihood 0, no mean. A null id stays, and its text is trained on all the same.
    Repeated rows count as often as they occur; ties among the commonest words go by word. An empty table gives an empty result. Other
    columns aren't read. Texts of any length are taken to pieces whole, one at a time; a document's tokens are in memory at once.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    counts = durable(word_counts(texts))
    common = commonest(counts)
    rows = tokenised(texts, common, counts)
    return scored(rows, trained(rows), common, counts).withColumnRenamed("id", id_col)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
