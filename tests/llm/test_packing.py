import zlib
from collections import defaultdict
from itertools import product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import pagewright.llm.op6_packing as packing
from pagewright.llm.op6_packing import VOCABULARY, hilbert_key, op6_packing, pack


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(product(range(1 << bits), repeat=dims)))
        keys = hilbert_key(points, bits)
        assert sorted(keys) == list(range(len(points)))
        along = points[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def check(rows, got, length):
    encode = Tokenizer.from_file(VOCABULARY).encode
    ids = [(r.doc_id, np.array([*encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")) for r in rows]
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    total = sum(len(x) for _, x in ids)
    assert sorted(at) == list(range(-(-total // length)))
    for s, own in at.items():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) == min(length, total - s * length)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, x in ids:
        own = sorted(pieces[doc_id], key=lambda r: (r.start, r.sequence_id))
        assert all(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(x) for r in own)
        assert sum(r.length for r in own) == len(x) * sum(d == doc_id for d, _ in ids)


def test_packing(spark, odd):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(rows, op6_packing(spark, "/root/testdata/sf0.001").collect(), 1024)
    odd = odd.filter("doc_id <> 3 or doc_id is null").distinct()
    check(odd.collect(), pack(odd, length=64).collect(), 64)
    assert pack(odd.limit(0)).count() == 0


def test_copies_lie_together(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 4 = 0, 'one text that is there many times over', concat('number ', id, ' and ', id * 7919)) as text")
    got = pack(docs, length=4096).filter("doc_id % 4 = 0").orderBy("sequence_id", "offset").collect()
    places = [r.sequence_id * 4096 + r.offset for r in got]
    assert places[-1] - places[0] < 1.05 * sum(r.length for r in got)


def test_batch_encoder():
    import random

    import public_tokenizers as P
    import pyarrow as pa

    from pagewright.llm.bpe import encoder as encoder_of

    from .conftest import ODD

    pick = random.Random(11)
    texts = [t or "" for t in ODD] + ["".join(pick.choice(["a", "bc", " ", " ", "\n", "\t", "é", " ", "　", "\x1c", "\x85", ".", "'s", "<|endoftext|>", "12", "​"]) for _ in range(pick.randint(0, 14))) for _ in range(20000)]
    encode = Tokenizer.from_file(VOCABULARY)
    want = [x.ids for x in encode.encode_batch(texts, add_special_tokens=False)]
    encoder = encoder_of(VOCABULARY, P.PATTERN)
    for size in (1, 7, len(texts)):
        some = texts[: 40 * size]
        got = []
        for k in range(0, len(some), size):
            ids, ends = encoder(pa.array(some[k : k + size], pa.string()))
            got += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == want[: len(some)]


def test_few_bytes_are_encoded_at_a_time(monkeypatch):
    """A batch of 12 MB goes through in pieces of 2 MB, a longer text by itself, and every document comes out once."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    text = "some words that repeat " * 2000
    texts = [text] * 200 + [text * 60] + [""] * 5 + [text] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    out = list(packing._tokenise(packing.VOCABULARY, 0)([batch]))
    sizes = [sum(len(texts[i]) for i in x.column("id").to_pylist()) for x in out]
    assert max(s for s, x in zip(sizes, out, strict=True) if x.num_rows > 1) <= 2 << 20 and len(text) * 60 > 2 << 20
    assert [i for x in out for i in x.column("id").to_pylist()] == list(range(len(texts)))
    assert [r for x in out for r in x.column("row").to_pylist()] == [(3 << 40) + i for i in range(len(texts))]
