"""Byte-level BPE over a global table of distinct words: each distinct pre-token is encoded once, wherever it occurs."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe
from pagewright.llm.common import table, whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A block of texts shares one table of words; it ends at so many distinct words or bytes of text.
BLOCK_WORDS, BLOCK_BYTES = 400_000, 48 << 20
#: Texts of one block travel together up to about so many positions.
ROW_POSITIONS = 400_000
#: Words are dealt to the encoders by hash in so many buckets; a row holds the words of one block and bucket.
BUCKETS = 512

#: key: where a row is dealt to, the block's number or, below zero, the bucket of words.
_PACKED = "key long, block long, ids array<long>, a binary, b binary, c binary"
_ARROW = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _pack(numbers) -> bytes:
    """32-bit numbers, their bytes in four planes, compressed."""
    return zstandard.compress(np.asarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Block:
    """Numbers the distinct pre-tokens of a run of texts in order of first sight; the positions of a text become those numbers."""

    def __init__(self, number: int, pattern: str):
        self.number, self.bytes, self.positions = number, 0, 0
        self.at: dict[str, int] = {}
        self.match = bpe.words_in(pattern, lambda w: self.at.setdefault(w, len(self.at)), "i4")
        self.ids, self.sizes, self.places = [], [], []

    def add(self, doc_ids: list, texts: pa.Array) -> None:
        places, ends = self.match(texts)
        self.ids += doc_ids
        self.places.append(places)
        self.sizes.append(np.diff(ends))
        self.positions += len(places)
        self.bytes += texts.nbytes

    def texts(self) -> tuple:
        row = (self.number, self.number, self.ids, _pack(np.concatenate(self.places)), _pack(np.concatenate(self.sizes)), None)
        self.ids, self.sizes, self.places, self.positions = [], [], [], 0
        return row

    def words(self, buckets: int):
        """A row for each bucket: the numbers, joined bytes and lengths of its words."""
        held = [[] for _ in range(buckets)]
        for word, i in self.at.items():
            raw = word.encode()
            held[int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little") % buckets].append((raw, i))
        for bucket, own in enumerate(held):
            if own:
                own.sort()
                yield (-1 - bucket, self.number, None, _pack([i for _, i in own]), zstandard.compress(b"".join(w for w, _ in own), 3), _pack([len(w) for w, _ in own]))


def _explode(pattern: str, buckets: int):
    def work(batches):
        number = TaskContext.get().partitionId() << 24
        block = _Block(number, pattern)
        for batch in batches:
            for some in bpe.slices(batch, 1):
                block.add(some.column(0).to_pylist(), some.column(1))
                full = len(block.at) >= BLOCK_WORDS or block.bytes >= BLOCK_BYTES
                if full or block.positions >= ROW_POSITIONS:
                    yield _rows([block.texts()])
                if full:
                    yield _rows(list(block.words(buckets)))
                    block = _Block(number := number + 1, pattern)
        if block.ids:
            yield _rows([block.texts()])
        if block.at:
            yield _rows(list(block.words(buckets)))

    return work


def _encode(path: str):
    """Words become ids, dealt back to their block; the rows of a bucket come together, and each of its distinct words is encoded once."""

    def work(batches):
        ranks = bpe.read_ranks(path)
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for key, block, _, at, joined, sizes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key >= 0:
                    continue
                if key != bucket:
                    bucket, known = key, {}
                joined, ids, counts, start = zstandard.decompress(joined), [], [], 0
                for n in _unpack(sizes).tolist():
                    word = joined[start : start + n]
                    start += n
                    if (own := known.get(word)) is None:
                        own = known[word] = bpe.encode_word(word, ranks)
                    ids += own
                    counts.append(len(own))
                yield _rows([(block, block, None, at, _pack(ids), _pack(counts))])

    return work


def _reassemble(finish, schema: str):
    """Positions become ids by the block's table of words; finish gets document ids, offsets and ids of several texts."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # a bucket of words, encoded by now
            return finish([], np.zeros(1, "i8"), np.zeros(0, "i4")).slice(0, 0)
        at, ids, counts = ([_unpack(x) for x in words.column(c).to_pylist()] for c in "abc")
        at, ids, counts = (np.concatenate(x) if x else np.zeros(0, "u4") for x in (at, ids, counts))
        counts = counts.astype("i8")
        starts, sizes = np.zeros(len(at), "i8"), np.zeros(len(at), "i8")
        starts[at], sizes[at] = np.cumsum(counts) - counts, counts
        ids, out = ids.astype("i4"), []
        for doc_ids, places, of in zip(texts.column("ids").to_pylist(), texts.column("a").to_pylist(), texts.column("b").to_pylist(), strict=True):
            places, of = _unpack(places), _unpack(of).astype("i8")
            each = sizes[places]
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(of)])]
            out.append(finish(doc_ids, ends, bpe.gather(ids, starts[places], each)))
        return pa.concat_tables(out).select(names)

    return work


def _run(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, buckets: int, finish, schema: str) -> DataFrame:
    """Two exchanges: words go to their bucket and texts to their block in the first, ids follow to the block in the second. Texts wait where the first one put them."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    dealt = texts.mapInArrow(_explode(pattern, buckets), _PACKED).repartition("key")
    encoded = dealt.sortWithinPartitions("key").mapInArrow(_encode(vocabulary), _PACKED).repartition("key")
    return dealt.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(_reassemble(finish, schema), schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, buckets: int = BUCKETS) -> DataFrame:
    """(id, ids array<int>) for every row of docs, repeated rows included.

    Pre-tokens are exploded with their positions and summed up by block before the shuffle: a block numbers its
    distinct words, and a text is kept as those numbers. All blocks' words meet by hash, so every distinct word is
    encoded once; the ids go back to the blocks, where texts are put together again by position. A word that makes up
    a third of all positions is one entry a block. Null counts as empty and gives no ids; a null document id stays null;
    other columns aren't read. An empty table gives an empty result. Of adjacent pairs of equal rank (ties) the leftmost is merged first. A text of any length is
    matched whole, and makes up a block of its own if it is long. Special strings are ordinary text. A block's numbers follow the order of its rows, so docs has to
    give its rows in the same order when a lost task reads them again, as files and checkpoints do.
    """

    def finish(doc_ids, ends, ids):
        return pa.table({"id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))})

    return _run(docs, id_col, text_col, vocabulary, pattern, buckets, finish, "id long, ids array<int>").withColumnRenamed("id", id_col)


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    ranks = bpe.read_ranks(path)
    held = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        held[i] = word
    return held


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, bytes binary): each id of a row joined with the token-byte table, in order. Null and empty ids give no bytes; an id that the table lacks is an error."""

    def work(batches):
        held = token_bytes(vocabulary)
        for batch in batches:
            out = [b"".join([held[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(work, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, buckets: int = BUCKETS) -> DataFrame:
    """As encode and decode, but hands out digests of ids and decoded bytes instead of either."""
    tables: list = []

    def finish(doc_ids, ends, ids):
        if not tables:
            tables.append(token_bytes(vocabulary))
            tables.append([str(i) for i in range(len(tables[0]))])
        held, written = tables
        rows, ends = [], ends.tolist()
        for start, stop in zip(ends, ends[1:], strict=False):
            own = ids[start:stop].tolist()
            rows.append((stop - start, hashlib.sha256(",".join([written[i] for i in own]).encode()).hexdigest(), hashlib.sha256(b"".join([held[i] for i in own])).hexdigest()))
        counts, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return _run(docs, id_col, text_col, vocabulary, pattern, buckets, finish, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
