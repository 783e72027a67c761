import public_tokenizers as P
import random

import pyarrow as pa

from tokenizers import Tokenizer

from pagewright.llm import bpe
from pagewright.llm.op5_token_counts import VOCABULARY, count_tokens

from .conftest import ODD


def library(texts):
    return [len(x.ids) for x in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_counts_odd_texts(spark, odd):
    got = count_tokens(odd).collect()
    assert len(got) == odd.count()
    want = dict(enumerate(library([t or "" for t in ODD])))
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            assert r.n_tokens == want[r.doc_id], r
            assert r.n_bytes == len((ODD[r.doc_id] or "").encode())
            assert r.over_limit == (r.n_tokens > 512)
    assert count_tokens(odd.limit(0)).count() == 0


def test_counts_random_texts():
    pick = random.Random(5)
    texts = ["".join(pick.choice("ab cd\n\t é.'s  <|endoftext|>0") for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    counts, ends = bpe.counter(VOCABULARY, P.PATTERN)(pa.array(texts, pa.string()))
    assert [int(counts[a:b].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)] == library(texts)


def test_counts_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    rows = docs.collect()
    assert got == dict(zip([r.doc_id for r in rows], library([r.text or "" for r in rows]), strict=True))


def tiktoken_ids(texts):
    import tiktoken

    from pagewright.llm.op10_bpe_codec import VOCABULARY

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    return [enc.encode_ordinary(t) for t in texts]


def test_white_space():
    """Every character that Python or the pattern's engine takes for white space, beside blanks and letters, in batches of several texts."""
    import pyarrow.compute as pc
    import regex

    from pagewright.llm.op6_packing import VOCABULARY as PACKED
    from pagewright.llm.op10_bpe_codec import VOCABULARY as CODEC

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    white = [c for c in chars if c.isspace() or regex.match(r"\s", c)]
    assert "\x0b" in white and all(pc.match_substring_regex(pa.array(white), f"^{bpe._WHITE}$").to_pylist())
    pick = random.Random(11)
    texts = [f(w) for w in white for f in ("a {}".format, "{}-".format, "b {0}c {0}d".format, " {0} {0}".format, "a{0} b".format, "x {0}{0} y".format)]
    texts += ["".join(pick.choice([" ", "a", "b.", pick.choice(white)]) for _ in range(pick.randint(1, 30))) for _ in range(3000)]
    find = regex.compile(P.PATTERN).findall
    library_ids = [x.ids for x in Tokenizer.from_file(PACKED).encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        batch = pa.array(some, pa.string())
        cut = lambda found: [found[0][a:b].tolist() for a, b in zip(found[1][:-1], found[1][1:], strict=True)]
        seen: dict[str, int] = {}
        words = cut(bpe.words_in(P.PATTERN, lambda w: seen.setdefault(w, len(seen)), "i4")(batch))  # noqa: B023
        names = list(seen)
        assert [[names[i] for i in x] for x in words] == [find(t) for t in some]
        assert cut(bpe.encoder(PACKED, P.PATTERN)(batch)) == library_ids[at : at + 97]
        assert [sum(x) for x in cut(bpe.counter(VOCABULARY, P.PATTERN)(batch))] == [len(x) for x in library_ids[at : at + 97]]
    ranks = bpe.read_ranks(CODEC)
    assert [[i for w in find(t) for i in bpe.encode_word(w.encode(), ranks)] for t in texts] == tiktoken_ids(texts)


def test_vertical_tabs(spark):
    from pagewright.llm.op6_packing import pack
    from pagewright.llm.op10_bpe_codec import round_trip_digests

    texts = ["a \x0b", "\x0b-", "b \x0bc \x0bd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.n_tokens for r in count_tokens(docs).orderBy("doc_id").collect()] == library(texts)
    assert [r.n_tokens for r in round_trip_digests(docs).orderBy("doc_id").collect()] == list(map(len, tiktoken_ids(texts)))
    assert pack(docs).count() == 3


def test_encode_words():
    from pagewright.llm.op10_bpe_codec import VOCABULARY

    ranks, pick = bpe.read_ranks(VOCABULARY), random.Random(7)
    words = ["".join(pick.choice("aeé日nstThion😀") for _ in range(pick.randint(1, 80))) for _ in range(2000)]
    assert [bpe.encode_word(w.encode(), ranks) for w in words] == tiktoken_ids(words)


def test_codec(spark, odd):
    import hashlib

    from pagewright.llm import op10_bpe_codec as codec

    texts = [t or "" for t in ODD]
    want = dict(enumerate(tiktoken_ids(texts)))
    encoded = codec.encode(odd, buckets=7)
    rows = encoded.collect()
    assert len(rows) == odd.count()
    assert all(r.ids == want[r.doc_id] for r in rows if r.doc_id not in (None, 3))
    assert all(bytes(r.bytes) == texts[r.doc_id].encode() for r in codec.decode(encoded).collect() if r.doc_id is not None)
    for r in codec.round_trip_digests(odd).collect():
        if r.doc_id not in (None, 3):
            assert r.n_tokens == len(want[r.doc_id])
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert codec.encode(odd.limit(0)).count() == 0


def test_codec_documents(spark):
    import hashlib

    from pagewright.llm.op10_bpe_codec import op10_bpe_codec

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op10_bpe_codec(spark, "/root/testdata/sf0.001").collect()}
    for r, ids in zip(rows, tiktoken_ids([r.text or "" for r in rows]), strict=True):
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
