"""Sequences of neighbouring documents along a Hilbert curve."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm import bpe
from pagewright.llm.common import durable, narrow, table, whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LENGTH, END_ID = 1024, 0
#: Documents are hashed vectors of so many token buckets, projected to DIMS dimensions of BITS bits each.
BUCKETS, DIMS, BITS, SEED = 1 << 13, 3, 10, 6
#: Bytes of text that are encoded at a time: what that takes of memory comes on top of what earlier stages left in an executor.
SLICE_BYTES = 2 << 20
#: What the mean projected token differs by from text to text: puts coordinates across the whole range.
SPREAD = 0.15


@lru_cache(maxsize=2)
def _projection(seed: int = SEED) -> np.ndarray:
    """The projection of each 16-bit id's bucket."""
    of_bucket = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype("f4")
    return of_bucket[(np.arange(1 << 16, dtype="u8") * 0x9E3779B1 >> 7) % BUCKETS]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position along the Hilbert curve of each row of unsigned coordinates below 2 ** bits.

    The coordinates become the transposed index in place: from the highest bit down each one exchanges or inverts
    the lower bits of the first, then the result is Gray-decoded and interleaved.
    """
    x = points.astype("i8").T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            swap = (x[0] ^ x[i]) & low
            on = (x[i] & bit) > 0
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= np.where(on, 0, swap)
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], "i8")
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], "i8")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def coordinates(ids: list[np.ndarray]) -> np.ndarray:
    """Coordinates below 2 ** BITS of each document: the mean projection of its tokens' buckets, spread over the range; no tokens: the middle."""
    of = _projection()
    mean = np.array([of[x].mean(axis=0) if len(x) else np.zeros(DIMS) for x in ids]).reshape(-1, DIMS)
    return np.minimum((0.5 + np.arctan(mean / SPREAD) / np.pi) * (1 << BITS), (1 << BITS) - 1).astype("i8")


def _packed(ids: np.ndarray) -> bytes:
    return zstandard.compress(ids.view("u1").reshape(-1, 2).T.tobytes(), 1)


def _unpacked(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), "u1").reshape(2, -1).T).view("<u2").ravel()


def _tokenise(vocabulary: str, end_id: int):
    def work(batches):
        encode = bpe.encoder(vocabulary, public_tokenizers.PATTERN)
        bpe.released()  # what the vocabulary's file took
        row = TaskContext.get().partitionId() << 40
        for batch in (some for batch in batches for some in bpe.slices(batch, 1, SLICE_BYTES)):
            n = batch.num_rows
            flat, ends = encode(batch.column(1))
            ids = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            keys = hilbert_key(coordinates(ids))
            held = [_packed(np.append(x, np.uint16(end_id))) for x in ids]
            sizes = np.array([len(x) + 1 for x in ids], "i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + n)), pa.array(keys), pa.array(sizes), pa.array(held, pa.binary())], ["id", "row", "key", "n", "ids"])
            row += n

    return work


def _cut(length: int):
    """Documents with their place along the curve to pieces that end where sequences do."""

    def work(batches):
        for batch in batches:
            out = []
            for doc_id, held, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = _unpacked(held).astype("<u4")
                n, start = len(raw), 0
                while start < n:
                    stop = min(n, start + length - (at + start) % length)
                    out.append((doc_id, start, stop - start, zlib.crc32(raw[start:stop].tobytes()), n, (at + start) // length, (at + start) % length))
                    start = stop
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each document.

    Texts are encoded once. The mean projection of a document's hashed tokens gives a point, its place on the Hilbert
    curve the order; documents of one place go by an arbitrary row number, so any number of copies is spread
    over range partitions. Small rows (place, tokens) are range-sorted and summed up to each document's place in the
    stream of all ids; documents follow one another without padding and are cut where a sequence is full, so only the
    last sequence is short. Null counts as empty and packs as the end id alone; a null id stays null; repeated rows are
    packed each. Documents that tie on the curve follow one another in no particular order. A text of any length is encoded whole by one task and
    cut into as many pieces as it fills sequences. Other columns aren't read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    held = durable(texts.mapInArrow(_tokenise(vocabulary, end_id), "id long, row long, key long, n long, ids binary"))
    small = held.select("row", "key", "n").repartitionByRange("key", "row").withColumn("part", F.spark_partition_id())
    small = durable(small)
    run = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = durable(small.groupBy("part").agg(F.sum("n").alias("sum")).select("part", F.coalesce(before, F.lit(0)).alias("base")))
    placed = durable(small.withColumn("run", run).join(F.broadcast(parts), "part").select("row", (F.col("run") + F.col("base")).alias("at")))
    pieces = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return held.select("id", "ids", "row").join(narrow(placed), "row").select("id", "ids", "at").mapInArrow(_cut(length), pieces).withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
