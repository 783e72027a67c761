"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pagewright.llm.bpe import released, slices
from pagewright.llm.common import durable, free_name, table, whole_text
from pagewright.llm.unions import runs

#: Labelled rows of each class that are indexed at most; chi-square and odds ratio from which a term tells the classes apart, weight of one that doesn't.
EXAMPLES, CHI_SQUARE, ODDS, PLAIN = 3000, 24.0, 4.0, 0.02
#: Examples in a block, blocks looked at first, neighbours that vote, clusters by which examples are ordered, and rounds of clustering.
BLOCK, FIRST_BLOCKS, NEIGHBOURS, CLUSTERS, ROUNDS = 32, 8, 15, 64, 4
#: A term that one example in so many has keeps its postings as a row of all blocks.
OFTEN = 16
#: A prefix of a text's longer words is a term where it is dense: so often at least, and so often a word at least; denser, it is another term as well.
PREFIXES = (4, 5, 6)
LEVELS = ((3, 1 / 200), (4, 1 / 80))
#: Texts whose frequent terms are summed up in one product of matrices.
TOGETHER = 64
#: Added to a distance before it is inverted.
SOFT = 0.05
#: Share by which sums in single precision of some hundred terms may be off at most.
ROUGH = 5e-5
#: The column of packed terms.
TERMS = "__terms"

_WORDS = re.compile(r"\w+").findall


def dense_prefixes(words: list[str], held: Counter | None = None) -> list[str]:
    """The terms of a text's dense prefixes, with the level that each one reaches; held: how often each of the words occurs, where that is known."""
    held = Counter(words) if held is None else held
    least, rate = LEVELS[0]
    bound, n = max(least, rate * len(words)), PREFIXES[0]
    hot = {p for p, count in _prefixes(held.items(), n).items() if count >= bound}
    if not hot:
        return []
    some = [(w, count) for w, count in held.items() if w[:n] in hot]
    out = []
    for n in PREFIXES:
        for p, count in _prefixes(some, n).items():
            out += [f"{p}*{k}" for k, (least, rate) in enumerate(LEVELS) if count >= least and count >= rate * len(words)]
    return out


def _prefixes(held: Iterable[tuple[str, int]], n: int) -> dict[str, int]:
    """How often each prefix of n characters occurs in longer words."""
    out: dict[str, int] = {}
    for w, count in held:
        if len(w) > n:
            p = w[:n]
            out[p] = out.get(p, 0) + count
    return out


def terms_of(text: str) -> Counter:
    """How often each term occurs: lower-cased words, and dense prefixes once each."""
    words = _WORDS(text.lower())
    held = Counter(words)
    held.update(dense_prefixes(words, held))
    return held


class Vocabulary:
    """Numbers terms."""

    def __init__(self, terms: list[str]):
        self.terms = terms

    def __len__(self) -> int:
        return len(self.terms)

    def reader(self):
        """text -> the numbers of its terms, ascending, and how often each occurs."""
        number = dict(zip(self.terms, range(len(self.terms)), strict=True)).get

        def read(text: str) -> tuple[np.ndarray, np.ndarray]:
            held = terms_of(text)
            found = np.fromiter(map(number, held, repeat(-1)), "i8", len(held))
            counts = np.fromiter(held.values(), "i4", len(held))
            order = np.argsort(found)
            order = order[np.searchsorted(found[order], 0) :]
            return found[order], counts[order]

        return read


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[k] .. start[k] + size[k] - 1, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Index:
    """Examples with unit vectors, in blocks. A term has an entry for each block that it occurs in: the block, its largest weight there, and its postings, example numbers and weights. A frequent term has a row instead: weights of all examples, the largest in each block."""

    vocabulary: Vocabulary | None
    idf: np.ndarray
    #: By example.
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    #: What a text without any term scores; slope and offset of the calibration.
    empty: float
    slope: float = 1.0
    offset: float = 0.0
    #: Where each term's entries start, and the end; block, largest weight and start of the postings of each entry, and the end.
    start: np.ndarray | None = None
    block: np.ndarray | None = None
    most: np.ndarray | None = None
    begin: np.ndarray | None = None
    at: np.ndarray | None = None
    of: np.ndarray | None = None
    #: Row of a frequent term, -1 for others; largest weights by row and block, weights by row, block and place in the block.
    row: np.ndarray | None = None
    peak: np.ndarray | None = None
    often: np.ndarray | None = None
    #: often in single precision, by row, made where it is used.
    rough: np.ndarray | None = None
    #: Blocks whose postings were read so far, and blocks that there were.
    read: int = 0
    there: int = 0

    @property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Examples and weights of each term."""
        out = []
        for row, a, b in zip(self.row.tolist(), self.start[:-1].tolist(), self.start[1:].tolist(), strict=True):
            flat = self.often[row].reshape(-1) if row >= 0 else None
            here = slice(self.begin[a], self.begin[b])
            out.append((self.at[here], self.of[here]) if flat is None else (np.flatnonzero(flat), flat[flat > 0]))
        return out

    def arrange(self, terms: np.ndarray, example: np.ndarray, weights: np.ndarray) -> None:
        """Entries, postings and rows from the vectors of all examples: a term, an example and a weight each."""
        n, blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        much = np.flatnonzero(np.bincount(terms, minlength=len(self.vocabulary)) * OFTEN >= max(n, OFTEN))
        self.row = np.full(len(self.vocabulary), -1, "i4")
        self.row[much] = np.arange(len(much))
        self.often = np.zeros((len(much), blocks, BLOCK))
        dense = self.row[terms] >= 0
        self.often[self.row[terms[dense]], example[dense] // BLOCK, example[dense] % BLOCK] = weights[dense]
        self.peak = self.often.max(axis=2).astype("f4")
        terms, example, weights = terms[~dense], example[~dense], weights[~dense]
        order = np.lexsort((example, terms))
        terms, example = terms[order], example[order]
        self.at, self.of = example.astype("i4"), weights[order]
        block = example // BLOCK
        self.begin = runs(terms, block) if len(terms) else np.zeros(1, "i8")
        first = self.begin[:-1]
        self.block = block[first].astype("i4")
        self.most = (np.maximum.reduceat(self.of, first) if len(first) else np.zeros(0)).astype("f4")
        self.start = np.searchsorted(terms[first], np.arange(len(self.vocabulary) + 1))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms of each query, terms and weights, add to its cosine with each example, in single precision: by query, block and place in the block."""
        if self.rough is None:
            self.rough = self.often.astype("f4")
        heavy = np.zeros((len(queries), len(self.rough)), "f4")
        for own, (terms, w) in zip(heavy, queries, strict=True):
            row = self.row[terms]
            own[row[row >= 0]] = w[row >= 0]
        return (heavy @ self.rough.reshape(len(self.rough), self.rough.shape[1] * BLOCK)).reshape(len(queries), *self.rough.shape[1:])

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, without: int | None = None, first: int = FIRST_BLOCKS, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest positive cosine (equal ones by number) and the cosines; ``without``: the number of one to leave out; ``dense``: the query's sums where they are known.

        The largest sum of frequent terms in a block and the largest weights there of the query's other terms bound its cosines. Postings are read of the best-bounded blocks first,
        then of those whose bound reaches the k-th best cosine so far; the others are never touched. Frequent terms are summed up in single precision,
        and what comes within ROUGH of the k-th best is worked out again in double precision, so the result is exact.
        """
        blocks = self.often.shape[1]
        dense = self.sums([(terms, w)])[0] if dense is None else dense
        row = self.row[terms]
        heavy = w[row >= 0]
        row, terms, w = row[row >= 0], terms[row < 0], w[row < 0]
        size = self.start[terms + 1] - self.start[terms]
        entry, own = _ranges(self.start[terms], size), np.repeat(w, size)
        block = self.block[entry]
        bound = np.bincount(block, self.most[entry] * own, minlength=blocks) + dense.max(axis=1)
        score, light, best = np.zeros((blocks, BLOCK)), np.zeros((blocks, BLOCK)), 1e-12
        flat = score.reshape(-1)
        first = min(first, blocks)
        front = np.zeros(blocks, bool)
        front[np.argpartition(-bound, first - 1)[:first] if first else []] = True
        for some in (front, None):
            if some is None:
                some = ~front & (bound >= best * (1 - ROUGH))
            some &= bound > 0
            if not some.any():
                continue
            here = np.flatnonzero(some)
            self.read += len(here)
            kept = some[block]
            chosen = entry[kept]
            begin = self.begin[chosen]
            many = self.begin[chosen + 1] - begin
            places = _ranges(begin, many)
            light += np.bincount(self.at[places], self.of[places] * np.repeat(own[kept], many), minlength=len(flat)).reshape(-1, BLOCK)
            score[here] = dense[here] + light[here]
            if without is not None:
                flat[without] = 0
            top = score[here].reshape(-1)
            if len(top) > k:
                best = max(best, np.partition(top, len(top) - k)[len(top) - k])
        self.there += blocks
        found = np.flatnonzero(flat >= best * (1 - ROUGH))  # places beyond the last example hold 0
        each = heavy[:, None] * self.often.reshape(len(self.often), blocks * BLOCK)[row[:, None], found]
        cosine = np.cumsum(np.vstack([light.reshape(-1)[found], each]), axis=0)[-1]  # one after another, so that equal examples tie to the last bit
        order = np.lexsort((found, -cosine))[:k]
        return found[order], cosine[order]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Votes weighted by inverse distance and by how many rows an example stands for: 0 to 1."""
        if not len(found):
            return self.empty
        w = self.weight[found] / (1 - np.minimum(cosine, 1) + SOFT)
        return float((w * self.toxic[found]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 0.005), 0.995)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.offset))))

    def scored(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, np.ndarray, np.ndarray]:
        """The score of a text with these terms, the numbers of its nearest examples and their cosines."""
        return next(self.scores([(terms, counts)], k))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """scored of each of many texts, terms and counts: the sums of TOGETHER of them are made in one product."""
        for lo in range(0, len(texts), TOGETHER):
            queries = [(terms, self.vector(terms, counts)) for terms, counts in texts[lo : lo + TOGETHER]]
            for (terms, w), dense in zip(queries, self.sums(queries), strict=True):
                found, cosine = self.nearest(terms, w, k, dense=dense) if len(terms) else (np.zeros(0, int), np.zeros(0))
                yield self.calibrated(self.vote(found, cosine)) if len(found) else self.empty, found, cosine


def _clustered(terms: np.ndarray, size: np.ndarray, weights: np.ndarray, n_terms: int) -> np.ndarray:
    """A cluster for each example, by spherical k-means from evenly spaced examples: neighbours in a block are alike, so bounds are tight."""
    n, start = len(size), np.cumsum(size) - size
    centre = np.zeros((n_terms, min(CLUSTERS, n)), "f4")
    of = np.full(n, -1)
    of[np.linspace(0, n - 1, centre.shape[1]).astype(int)] = np.arange(centre.shape[1])
    for _ in range(ROUNDS):
        centre[:] = 0
        for i in np.flatnonzero(of >= 0):
            here = slice(start[i], start[i] + size[i])
            centre[terms[here], of[i]] += weights[here]
        centre /= np.sqrt((centre * centre).sum(axis=0)) + 1e-12
        of = np.array([(weights[a : a + m] @ centre[terms[a : a + m]]).argmax() for a, m in zip(start, size, strict=True)])
    return of


def _platt(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from vote to label by Newton steps, drawn towards (1, 0)."""
    v = np.clip(votes, 0.005, 0.995)
    x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], axis=1)
    theta, pull, w = np.array([1.0, 0.0]), np.diag([5.0, 5.0]), weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - toxic)) + pull @ (theta - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + pull, grad)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.1), float(theta[1])


def held_out(id_col: str | Column) -> Column:
    """Whether a document is kept from learning; a null id counts as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, each: int) -> tuple[DataFrame, dict[int, int]]:
    """Durable (id, toxic, text) of at most ``each`` documents of each class, those of the least hash of their id; and how many labelled ids each class has. Of several texts of an id the least counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(~held_out("id"))
    known = durable(known.groupBy("id").agg(F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(each) for t in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return durable(texts.join(F.broadcast(picked[0].union(picked[1])), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))), sizes


def _terms(examples: DataFrame, least: float, odds: float) -> tuple[list[str], np.ndarray]:
    """All terms of the examples, and the factor of each: 1 where chi-square over documents and an odds ratio either way tell the classes apart, else PLAIN."""

    def work(batches):
        for batch in batches:
            held: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in terms_of(text):
                    held.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array([x[k] for x in held.values()], pa.int64()) for k in (0, 1)]], ["term", "clean", "toxic"])

    n = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
    if not n0 or not n1:
        return [], np.zeros(0)
    seen = examples.select("toxic", "text").mapInArrow(work, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b, c, d = F.col("a"), F.col("b"), F.lit(n0) - F.col("a"), F.lit(n1) - F.col("b")
    chi = (n0 + n1) * F.pow(a * d - b * c, 2) / (n0 * n1 * (a + b) * F.greatest(c + d, F.lit(0.5)))
    ratio = F.abs(F.log((b + 0.5) * (c + 0.5) / ((a + 0.5) * (d + 0.5))))
    rows = seen.select("term", ((chi >= least) & (ratio >= float(np.log(odds)))).alias("tells")).orderBy("term").toArrow()
    return rows["term"].to_pylist(), np.where(rows["tells"].to_numpy(), 1.0, PLAIN)


def _packed(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending term numbers as differences, then counts, their bytes in four planes, compressed."""
    both = np.concatenate([np.diff(terms, prepend=0), counts]).astype("<i4")
    return zstandard.compress(both.view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), "u1").reshape(4, -1).T).view("<i4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half], dtype="i8"), both[half:]


def numbered(docs: DataFrame, vocabulary: Vocabulary, text_col: str, keep_text: bool) -> DataFrame:
    """docs, durable, with the terms of each text and their counts in a column more, the last; so that a text is read once for frequencies and scores."""
    sent, at = docs.sparkSession.sparkContext.broadcast(vocabulary), docs.columns.index(text_col)
    fields, name = [f for f in docs.schema.fields if keep_text or f.name != text_col], free_name(docs, TERMS)

    def work(batches):
        read = sent.value.reader()
        for batch in (some for batch in batches for some in slices(batch, at)):
            held = pa.array([_packed(*read(x or "")) for x in batch.column(at).to_pylist()], pa.binary())
            kept = [batch.column(i) for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*kept, held], [*[f.name for f in fields], name])

    out = durable(docs.mapInArrow(work, StructType([*fields, StructField(name, BinaryType())])))
    sent.destroy()
    return out


def _document_frequency(known: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each of so many terms occurs, and how many documents there are."""

    def work(batches):
        held, n = np.zeros(size + 1, "i8"), 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                n += 1
                held[_unpacked(packed)[0]] += 1
        held[-1] = n
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(held[at])], ["term", "n"])

    rows = known.select(known.columns[-1]).mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = EXAMPLES) -> Index:
    """The index alone, see fitted."""
    return fitted(docs, labels, id_col, text_col, label_col, each)[0]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = EXAMPLES, keep_text: bool = False) -> tuple[Index, DataFrame]:
    """The index of the labelled examples that aren't held out, and docs with their terms in its vocabulary.

    Every term of every example is indexed; ``each`` examples a class bound the index that goes to the executors. Document
    frequencies are taken over all of docs. Votes for the calibration are cast without the example itself.
    """
    examples, sizes = _examples(docs, labels, id_col, text_col, label_col, each)
    words, factor = _terms(examples, CHI_SQUARE, ODDS)
    vocabulary = Vocabulary(words)
    known = numbered(docs, vocabulary, text_col, keep_text)
    df, n = _document_frequency(known, len(vocabulary))
    idf = (np.log((1 + n) / (1 + df)) + 1) * factor
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        read = sent.value.reader()
        for batch in batches:
            terms, counts = zip(*[read(x) for x in batch.column(2).to_pylist()], strict=True) if batch.num_rows else ((), ())
            ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, "i4"), *x]).astype("i4"))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "toxic", "terms", "counts"])

    rows = examples.mapInArrow(work, "id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("id").combine_chunks()
    sent.destroy()
    ids, toxic = rows["id"].to_numpy(), rows["toxic"].to_numpy().astype("f8")
    size = pa.compute.list_value_length(rows["terms"]).to_numpy()
    terms, counts = (pa.compute.list_flatten(rows[x]).to_numpy() for x in ("terms", "counts"))
    stands = np.array([sizes.get(t, 0) / max(1, int((toxic == t).sum())) for t in (0, 1)])
    without = [float(((toxic == t) & (size == 0)).sum() * stands[t]) for t in (0, 1)]
    empty = without[1] / sum(without) if sum(without) else sizes.get(1, 0) / max(1, sum(sizes.values()))
    ids, toxic, size = ids[size > 0], toxic[size > 0], size[size > 0]
    index = Index(vocabulary, idf, ids, toxic, stands[toxic.astype(int)], empty)
    example = np.repeat(np.arange(len(ids)), size)
    weights = (1 + np.log(counts)) * idf[terms]
    weights /= np.sqrt(np.bincount(example, weights * weights, minlength=len(ids)))[example]
    if len(ids):
        start = np.cumsum(size) - size
        heaviest = np.array([terms[a + weights[a : a + m].argmax()] for a, m in zip(start, size, strict=True)])
        order = np.lexsort((ids, heaviest, _clustered(terms, size, weights, len(vocabulary))))
        place = np.argsort(order)
        index.ids, index.toxic, index.weight, example = ids[order], toxic[order], index.weight[order], place[example]
    index.arrange(terms, example, weights)
    if len(ids):
        votes = np.zeros(len(ids))
        for lo in range(0, len(ids), TOGETHER):
            own = [(terms[a : a + m], weights[a : a + m]) for a, m in zip(start[lo : lo + TOGETHER], size[lo : lo + TOGETHER], strict=True)]
            for i, query, dense in zip(place[lo : lo + TOGETHER], own, index.sums(own), strict=True):
                votes[i] = index.vote(*index.nearest(*query, NEIGHBOURS, i, dense=dense))
        index.slope, index.offset = _platt(votes, index.toxic, index.weight)
    return index, known


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """(id, held_out, score, predicted, evidence, cosine) for every row of docs; evidence: ids of the nearest examples, nearest first. Equal texts score equal: the id is not looked at, so an example is its own nearest."""
    return _scored(numbered(docs.select(id_col, text_col), index.vocabulary, text_col, False), index, id_col, k)


def _scored(docs: DataFrame, index: Index, id_col: str, k: int = NEIGHBOURS) -> DataFrame:
    """As score, for docs whose last column has their terms."""
    sent = docs.sparkSession.sparkContext.broadcast(replace(index, vocabulary=None))  # terms are numbers by now

    def work(batches):
        index = sent.value
        for batch in batches:
            scores, found, cosines = zip(*index.scores([_unpacked(x) for x in batch.column(1).to_pylist()], k), strict=True) if batch.num_rows else ((), (), ())
            evidence = pa.array([index.ids[x].tolist() for x in found], pa.list_(pa.int64()))
            nearest = pa.array([float(x[0]) if len(x) else 0.0 for x in cosines], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), evidence, nearest], ["id", "score", "evidence", "cosine"])
        released()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), docs.columns[-1]).mapInArrow(work, "id long, score double, evidence array<long>, cosine double")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosine")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fit on docs and labels, then score all of docs.

    Terms are words, and word prefixes that are dense in a text; a text's weights are (1 + log count) * idf, less for
    terms that don't tell the classes apart. Its nearest examples vote, weighted by
    inverse distance and class size, and a logistic curve fitted on the examples' own leave-one-out votes makes a probability of
    the vote. A text that shares no term with any example (an empty or null one too) scores the share of toxic rows among examples
    without terms. Rows of labels with a null, or with a label other than 0 and 1, teach nothing; of several labels of an id the
    largest counts, of several texts the least. With no labels of one of the classes every score is the share of the other. Repeated rows
    get a row each, equal texts (ties) the same score; an empty table gives an empty result, and other columns aren't read.
    Texts of any length are read whole, a text at a time.
    """
    index, known = fitted(docs.select(id_col, text_col), labels, id_col, text_col)
    return _scored(known, index, id_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.5, k: int = NEIGHBOURS) -> DataFrame:
    """The rows of docs, all columns as they are, that score below ``most`` by examples among docs."""
    index, known = fitted(docs, labels, id_col, text_col, keep_text=True)
    sent = docs.sparkSession.sparkContext.broadcast(replace(index, vocabulary=None))  # terms are numbers by now

    def work(batches):
        for batch in batches:
            texts = [_unpacked(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            stay = pa.array([score < most for score, _, _ in sent.value.scores(texts, k)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(stay) for c in batch.columns[:-1]], batch.schema.names[:-1])
        released()

    return known.mapInArrow(work, docs.schema)
