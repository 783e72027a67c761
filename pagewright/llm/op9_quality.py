"""Quality by weak labels: expectation-maximisation over heuristic labellers, and a hashed linear scorer taught by its posteriors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.bpe import slices
from pagewright.llm.common import durable, table, whole_text

BAD, GOOD, ABSTAIN = 0, 1, 2
#: Rounds of expectation and maximisation; pseudo-counts; share of good documents to begin with.
ROUNDS, SMOOTH, PRIOR = 60, 2.0, 0.85
#: What a labeller is like to begin with: how often it accuses a bad and a good document when it votes.
ACCUSES_BAD, ACCUSES_GOOD = 0.3, 0.01
#: What holds for every labeller throughout: each finds some bad documents, and none accuses many good ones.
LEAST_BAD, MOST_GOOD = 0.1, 0.02
#: Hash buckets of the scorer, documents of each side that teach it at most, its rounds, step and shrinkage.
FEATURES, TEACHERS, STEPS, RATE, SHRINK = 4096, 1500, 300, 0.3, 1e-3
#: Trigrams and words at which a text's features count by half.
FEW_BYTES, FEW_WORDS = 100, 10
#: A document stays if its probability of being good is at least this.
KEEP = 0.5
#: Bytes that are looked at together.
CHUNK = 1 << 20

# What kind of character each byte is.
_KIND = np.zeros(256, "u1")
_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _ODD, _WIDE = range(1, 8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 10, 11, 12, 13, 32]] = _LOWER, _UPPER, _DIGIT, _SPACE
_KIND[[ord(c) for c in ".,;:'\"()?-"]] = _MARK
_KIND[[ord(c) for c in "$%&#*@^~|<>{}[]=+_\\/!`"]] = _ODD
_KIND[128:] = _WIDE


#: What is measured of a text, and from which value up to which a labeller says good and from which on bad.
MEASURES = (
    ("odd characters a visible byte", 0.012, 0.05),
    ("capitals a letter", 0.15, 0.45),
    ("lines said before", 0.05, 0.3),
    ("share of the commonest word", 0.12, 0.5),
    ("words like the one before", 0.03, 0.2),
    ("longest run of a word, up to 5", 1, 4),
    ("pairs of words said before", 0.15, 0.92),
    ("words a sentence", 45, 80),
    ("letters a word", 7.5, 11),
    ("words with odd endings", 0.04, 0.25),
)


def measures(text: str) -> tuple[list[float | None], int]:
    """The MEASURES of a text, None where it is too short to tell, and its number of words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    kinds = np.zeros(8, "i8")
    for start in range(0, len(raw), CHUNK):
        kinds += np.bincount(_KIND[raw[start : start + CHUNK]], minlength=8)
    seen = max(1, len(raw) - int(kinds[_SPACE]))
    letters = int(kinds[_LOWER] + kinds[_UPPER])
    words = text.split()
    n = len(words)
    held: list[float | None] = [kinds[_ODD] / seen, kinds[_UPPER] / letters if letters >= 20 else None]
    if n < 5:
        return held + [None] * 8, n
    lines = [x for x in text.split("\n") if x.strip()]
    most = Counter(words).most_common(1)[0][1]
    same = bytes(map(str.__eq__, words, words[1:]))
    longest = next((k for k in (5, 4, 3) if b"\1" * (k - 1) in same), 1)
    ends = text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + text.endswith((".", "!", "?"))
    odd = sum(text.count(x) for x in ("$ ", "% ", "& ", "# ", "* ", "| ", "! "))
    return held + [
        1 - len(set(lines)) / len(lines) if len(lines) >= 3 else None,
        most / n if n >= 20 else None,
        sum(same) / n,
        longest,
        1 - len(set(zip(words, words[1:], strict=False))) / (n - 1),
        n / (ends or 0.5) if n >= 30 else None,
        abs(letters + int(kinds[_WIDE]) / 2) / n,
        odd / n,
    ], n


def votes_on(values: list[float | None]) -> list[int]:
    """What each labeller says: good up to one bound, bad from the other on, nothing in between or where nothing was measured."""
    return [ABSTAIN if v is None else GOOD if v <= good else BAD if v >= bad else ABSTAIN for v, (_, good, bad) in zip(values, MEASURES, strict=True)]


N_LABELLERS = len(MEASURES)


@dataclass
class LabelModel:
    """The share of good documents and each labeller's votes given the truth: votes[labeller, truth, vote]."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes; abstaining says nothing."""
        said = patterns != ABSTAIN
        log = np.log(self.votes[np.arange(patterns.shape[1]), :, patterns]) * said[:, :, None]
        both = log.sum(axis=1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(both[:, BAD] - both[:, GOOD], -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Accuracies of overlapping labellers from how often each pattern of votes occurs, without any truth.

    Each labeller looks for one defect, so its silence says little and its accusation much: the accuracies begin so and
    stay within LEAST_BAD and MOST_GOOD. Without that, labellers of one defect that agree would make up a class of
    their own and leave other defects with the good. A labeller that never votes does no harm.
    """
    m = patterns.shape[1] if len(patterns) else N_LABELLERS
    hope = np.array([[ACCUSES_BAD, 1 - ACCUSES_BAD], [ACCUSES_GOOD, 1 - ACCUSES_GOOD]])
    model = LabelModel(PRIOR, np.dstack([np.tile(hope, (m, 1, 1)), np.ones((m, 2, 1))]))
    for _ in range(rounds if len(patterns) else 0):
        good = model.posterior(patterns)
        side = np.stack([1 - good, good], axis=1) * counts[:, None]
        votes = np.ones((m, 2, 3))
        for k in range(m):
            for v in (BAD, GOOD):
                votes[k, :, v] = side[patterns[:, k] == v].sum(axis=0) + SMOOTH * hope[:, v]
        accuses = votes[:, :, BAD] / votes[:, :, :2].sum(axis=2)
        accuses = np.stack([np.clip(accuses[:, BAD], LEAST_BAD, 0.99), np.clip(accuses[:, GOOD], 1e-4, MOST_GOOD)], axis=1)
        votes[:, :, :2] = np.stack([accuses, 1 - accuses], axis=2)
        prior = (side[:, GOOD].sum() + SMOOTH * PRIOR) / (side.sum() + SMOOTH)
        done = abs(prior - model.prior) < 1e-9 and np.abs(votes - model.votes).max() < 1e-9
        model = LabelModel(float(prior), votes)
        if done:
            break
    return model


def _buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of each three neighbouring bytes."""
    x = raw.astype("u4")
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)


def hashed(text: str, values: list[float | None], words: int) -> np.ndarray:
    """Shares of a text's byte trigrams by bucket, then how far each measure lies between its bounds, then how much there is to go by (0 to 1) for both kinds."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    held = np.zeros(FEATURES, "i8")
    for start in range(0, len(raw) - 2, CHUNK):
        held += np.bincount(_buckets(raw[start : start + CHUNK + 2]), minlength=FEATURES)
    total = int(held.sum())
    between = [0.0 if v is None else min(1.5, max(-0.5, (v - good) / (bad - good))) for v, (_, good, bad) in zip(values, MEASURES, strict=True)]
    return np.concatenate([held / max(1, total), between, [total / (total + FEW_BYTES), words / (words + FEW_WORDS)]]).astype("f4")


@dataclass
class Scorer:
    """The label model, and weights for the standardised features; with little to go by the features count less."""

    label_model: LabelModel
    bias: float = 0.0
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = x[..., :-2] - self.mean
        z /= self.scale
        z[..., :FEATURES] *= x[..., -2:-1] / np.sqrt(FEATURES)
        z[..., FEATURES:] *= x[..., -1:]
        return z

    def probability(self, x: np.ndarray) -> float:
        at = self.bias if self.weights is None else self.standard(x) @ self.weights + self.bias
        return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))

    def train(self, x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression on soft labels by gradient steps with momentum over the whole sample. x, the largest thing that the driver holds, is overwritten, some rows at a time."""
        weight = (weight / weight.sum()).astype("f4")
        some = [slice(k, k + 256) for k in range(0, len(x), 256)]
        self.mean = (weight @ x)[:-2]
        spread = np.sqrt(sum(weight[c] @ (x[c, :-2] - self.mean) ** 2 for c in some))
        self.scale = (spread + np.where(np.arange(x.shape[1] - 2) < FEATURES, 1e-4, 1e-2)).astype("f4")
        for c in some:
            x[c, :-2] = self.standard(x[c])
        x[:, -2:] = 0
        w, b = np.zeros(x.shape[1], "f4"), self.bias
        pace_w, pace_b = np.zeros_like(w), 0.0
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            off = (weight * (p - good)).astype("f4")
            pace_w = 0.9 * pace_w - RATE * (x.T @ off + SHRINK * w)
            pace_b = 0.9 * pace_b - RATE * float(off.sum())
            w, b = w + pace_w, b + pace_b
        self.weights, self.bias = w[:-2], float(b)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", teachers: int = TEACHERS) -> Scorer:
    """The label model over all of docs, and the scorer on a bounded sample: of documents that the model holds for good and for bad
    at most ``teachers`` each, those of the least hash of their id, weighted to stand for all of their side."""

    def work(batches):
        for batch in (some for batch in batches for some in slices(batch, 1)):
            votes = [sum(v * 3**k for k, v in enumerate(votes_on(measures(x)[0]))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.int32())], ["id", "pattern"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    voted = durable(texts.mapInArrow(work, "id long, pattern int"))
    seen = sorted((r.pattern, r["count"]) for r in voted.groupBy("pattern").count().collect())  # 3 ** labellers rows at most
    codes, counts = (np.array(x, "i8") for x in zip(*seen, strict=True)) if seen else (np.zeros(0, "i8"), np.zeros(0, "i8"))
    patterns = codes[:, None] // 3 ** np.arange(N_LABELLERS) % 3
    model = expectation_maximisation(patterns, counts)
    good = model.posterior(patterns) if len(codes) else np.zeros(0)
    of = dict(zip(codes.tolist(), good.tolist(), strict=True))
    scorer = Scorer(model, bias=float(np.log(model.prior / (1 - model.prior))))
    sides = {side: [c for c, g in of.items() if (g >= 0.5) == side] for side in (True, False)}
    total = {side: sum(n for c, n in seen if c in set(own)) for side, own in sides.items()}
    picked = [voted.filter(F.col("id").isNotNull() & F.col("pattern").isin(own)).orderBy(F.xxhash64("id"), "id").limit(teachers) for own in sides.values() if own]
    if len(picked) < 2:
        return scorer

    def features(batches):
        for batch in (some for batch in batches for some in slices(batch, 1)):
            held = [zstandard.compress(hashed(x, *measures(x)).tobytes(), 3) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, pa.binary())], ["id", "pattern", "x"])

    sample = texts.join(F.broadcast(picked[0].union(picked[1]).dropDuplicates(["id"])), "id").select("id", "text", "pattern")
    found = sample.mapInArrow(features, "id long, pattern int, x binary").groupBy("id").agg(F.min("pattern").alias("pattern"), F.min("x").alias("x"))
    rows = sorted(found.collect(), key=lambda r: r.id)  # a row an id, however often it occurs
    if rows:
        x, soft = np.empty((len(rows), FEATURES + N_LABELLERS + 2), "f4"), np.array([of[r.pattern] for r in rows])
        for k, r in enumerate(rows):
            x[k] = np.frombuffer(zstandard.decompress(r.x), "f4")
        del rows
        n = {side: max(1, int(((soft >= 0.5) == side).sum())) for side in sides}
        scorer.train(x, soft, np.array([total[g >= 0.5] / n[g >= 0.5] for g in soft]))
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, weak_label, score, kept) for every row: the label model's and the scorer's probability of good."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batches):
        held = sent.value
        known: dict[tuple, float] = {}
        for batch in (some for batch in batches for some in slices(batch, 1)):
            weak, scores = [], []
            for text in batch.column(1).to_pylist():
                values, words = measures(text)
                votes = tuple(votes_on(values))
                if votes not in known:
                    known[votes] = float(held.label_model.posterior(np.array([votes]))[0])
                weak.append(known[votes])
                scores.append(held.probability(hashed(text, values, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], ["id", "weak_label", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(work, "id long, weak_label double, score double")
    return rows.select(F.col("id").alias(id_col), "weak_label", "score", (F.col("score") >= keep).alias("kept"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """fit on docs, then score all of docs.

    No truth is used. Each document gets the votes of ten heuristics, patterns of votes are counted over the whole
    table, and expectation-maximisation finds the labellers' accuracies from them. Null counts as empty. Empty and very short texts
    get few votes or none and score near the prior, so they stay unless most of the table is bad. Repeated rows get a row
    each, and equal texts (ties) the same score; a null id stays, but doesn't teach. If all patterns fall on one side, every score
    is the prior. An empty table gives an empty result. Columns but id and text aren't read, whatever their names. Texts of any length are
    measured whole, one at a time; their words are in memory at once.
    """
    return score(docs, fit(docs, id_col, text_col), id_col, text_col, keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def good_rows(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs, all columns as they are, that the scorer gives at least ``keep``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def work(batches):
        for batch in (some for batch in batches for some in slices(batch, at)):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([sent.value.probability(hashed(x, *measures(x))) >= keep for x in texts], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
