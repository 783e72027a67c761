"""Byte-pair merging in plain Python: vocabularies, pieces of text, merge loops."""

from __future__ import annotations

import base64
import ctypes
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

#: A key of this length or more is worked out anew each time rather than remembered.
LONG = 96


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes to rank, from a file of base64 text and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def read_merges(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[int], tuple[str, ...]]:
    """From a tokenizer's JSON: pair of symbols to (rank, merged symbol), the symbol of each byte, and the special strings."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocab, of = held["model"]["vocab"], byte_symbols()
    first = [0] * 256
    for char, byte in of.items():
        first[byte] = vocab[char]
    merges = {}
    for rank, pair in enumerate(held["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return merges, first, tuple(x["content"] for x in held.get("added_tokens", []))


def merged_count(word: bytes, merges: dict, first: list[int]) -> int:
    """Symbols that are left of word: a heap holds the adjacent pairs, a linked list what is next to what.

    The pair of the lowest rank goes first, the leftmost among equals; an entry whose symbols have changed since is
    passed over. No identifiers are put together: the result is the initial symbols less the merges made.
    """
    n = left = len(word)
    if n < 2:
        return n
    sym = [first[b] for b in word]
    if n == 2:
        return 1 if (sym[0], sym[1]) in merges else 2
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = merges.get
    heap = [(hit[0], i, sym[i], sym[i + 1], hit[1]) for i in range(n - 1) if (hit := get((sym[i], sym[i + 1])))]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, a, b, new = pop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = new, -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if hit := get((new, sym[k])):
                push(heap, (hit[0], i, new, sym[k], hit[1]))
        h = before[i]
        if h >= 0 and (hit := get((sym[h], new))):
            push(heap, (hit[0], h, sym[h], new, hit[1]))
    return left


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair whose joined bytes have the lowest rank merges first, the leftmost among equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    if n < 24:
        parts = [word[i : i + 1] for i in range(n)]
        get = ranks.get
        found = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(n - 1)]
        while found and (low := min(found)) < 1 << 30:
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(found):
                found[i] = get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]
    return _encode_long(word, ranks)


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, start = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, get = [True] * n, ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            start[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := start[i]) >= 0 and (r := get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Remembered(dict):
    """work(key) for each key, kept for short keys in two generations of ``most`` entries at the most.

    A full generation becomes the old one; what is asked for again moves on, so frequent keys stay and memory is bounded.
    """

    def __init__(self, work, most: int = 250_000):
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) < LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def json_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes to id and special string to id, from a tokenizer's JSON whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocab, of = held["model"]["vocab"], byte_symbols()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in held["model"]["merges"]]
    if merged != sorted(merged) or merged and merged[0] < 256:
        raise ValueError(f"{path}: ids don't follow the order of merges")
    return {bytes(of[c] for c in word): i for word, i in vocab.items()}, {x["content"]: x["id"] for x in held.get("added_tokens", [])}


#: White space (more of it than any pattern takes for such: the vertical tab, which this matcher leaves out of \s, too); around a blank or before one at the end; at either end, or nothing at all.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_INNER_BLANK_RE2, _WHITE_ENDS_RE2 = rf"{_WHITE} ({_WHITE}|\z)", rf"^{_WHITE}|{_WHITE}\z|^\z"


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


#: Bytes of text that are matched at a time; what that takes of memory is some twenty times as much.
SLICE_BYTES = 6 << 20


@lru_cache(maxsize=1)
def _trim():
    """What gives freed memory of the C library back to the system; nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def released() -> None:
    """Give back what a worker has freed: it stays for later stages, whose memory would come on top."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES):
    """The batch in runs of rows with up to so many bytes of text, a single longer text by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    released()


class Batches:
    """What ``match`` finds in each text of a batch: values, one for each token or pre-token.

    match(text) gives values and the lengths of what they stand for, in the units of ``measure``; it mustn't find anything that reaches
    over a blank with text on both sides. A batch is cut at its blanks, its distinct parts are put in a row and matched in one go, and
    the lengths tell where each part's values end. Texts that can't be cut so, or hold a special string (one value each), are
    matched by themselves, and so are parts with white space at an end.
    """

    def __init__(self, match, measure, dtype: str, special: dict[str, int] | None = None):
        self.match, self.measure, self.dtype, self.special = match, measure, dtype, special or {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def plain(self, text: str) -> np.ndarray:
        return self.match(text)[0]

    def whole(self, text: str) -> np.ndarray:
        if self.split is None or not self.split.search(text):
            return self.plain(text)
        return np.concatenate([np.array([self.special[x]], self.dtype) if x in self.special else self.plain(x) for x in self.split.split(text)])

    def parts(self, distinct: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Values of each part with a blank in front, one after another in pieces; where each part's start, and how many it has."""
        edged = pc.match_substring_regex(distinct, _WHITE_ENDS_RE2)
        joined = distinct.filter(pc.invert(edged))
        row = pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined)
        values, lengths = self.match(" " + pc.binary_join(row, " ")[0].as_py()) if len(joined) else (np.zeros(0, self.dtype), np.zeros(0, "i8"))
        at, stops = np.cumsum(lengths), np.cumsum(self.measure(joined).to_numpy(zero_copy_only=False).astype("i8") + 1)
        last = np.searchsorted(at, stops)
        if len(stops) and not np.array_equal(at[last], stops):
            raise ValueError("a token crosses a blank; the pattern doesn't begin pre-tokens there")
        others = [self.plain(" " + x) for x in distinct.filter(edged).to_pylist()]
        alone = edged.to_numpy(zero_copy_only=False)
        sizes, starts = np.zeros(len(distinct), "i8"), np.zeros(len(distinct), "i8")
        sizes[~alone], sizes[alone] = np.diff(last + 1, prepend=0), [len(x) for x in others]
        starts[~alone] = np.cumsum(sizes[~alone]) - sizes[~alone]
        starts[alone] = len(values) + np.cumsum(sizes[alone]) - sizes[alone]
        return [values, *others], np.stack([starts, sizes])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All values, and where each text's begin (one more: the end)."""
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, "i8")
        apart = pc.match_substring_regex(texts, _INNER_BLANK_RE2)
        for x in self.special:
            apart = pc.or_(apart, pc.match_substring(texts, x))
        cut = pc.split_pattern(pc.if_else(apart, pa.scalar("", texts.type), texts), " ")
        offsets = cut.offsets.to_numpy().astype("i8")
        offsets -= offsets[0]
        coded = cut.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype("i8")
        held, (starts, sizes) = self.parts(coded.dictionary)
        alone, firsts = apart.to_numpy(zero_copy_only=False), coded.dictionary.take(pa.array(at[offsets[:-1]])).to_pylist()
        begins = [self.whole(texts[i].as_py()) if alone[i] else self.plain(firsts[i]) for i in range(n)]
        at[offsets[:-1]] = len(sizes) + np.arange(n)
        own = np.array([len(x) for x in begins], "i8")
        starts = np.concatenate([starts, sum(map(len, held)) + np.cumsum(own) - own])
        sizes = np.concatenate([sizes, own])
        each = sizes[at]
        values = gather(np.concatenate([*held, *begins]), starts[at], each)
        return values, np.concatenate([[0], np.cumsum(each)])[offsets]


def words_in(pattern: str, value, dtype: str, special: dict[str, int] | None = None) -> Batches:
    """value(word) of each pre-token."""
    find = regex.compile(pattern).findall

    def match(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = find(text)
        return np.fromiter(map(value, words), dtype, len(words)), np.fromiter(map(len, words), "i8", len(words))

    return Batches(match, pc.utf8_length, dtype, special)


def counter(path: str, pattern: str) -> Batches:
    """The number of tokens of each pre-token, special strings counting one."""
    merges, first, special = read_merges(path)
    word = Remembered(lambda w: merged_count(w.encode(), merges, first))
    return words_in(pattern, word.__getitem__, "i8", dict.fromkeys(special, 1))


def encoder(path: str, pattern: str) -> Batches:
    """The ids of each text as 16-bit numbers, special strings being one id each."""
    ranks, special = json_ranks(path)
    if max([*ranks.values(), *special.values()]) >= 1 << 16:
        raise ValueError(f"{path}: ids over 16 bits")
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    size = np.zeros(1 << 16, "i8")
    for word, i in ranks.items():
        size[i] = len(word)

    def match(text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encode(text), "<u2")
        return ids, size[ids]

    return Batches(match, pc.binary_length, "<u2", special)
