"""Byte-pair tables of a tokenizers .json file, and exact cached encoding of texts with it."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .common import Known, hashed_words, utf8

SPACE = np.isin(np.arange(256), [10, 32])


def load(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read on the driver and sent to the executors, which need not have it. A vocabulary file has a few MB at
    any corpus size; over 64 MB is refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError(f"{path}: not a vocabulary file of bounded size")
    return spark.sparkContext.broadcast(text)


@lru_cache(maxsize=2)
def tokenizer(text: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


class PairTable:
    """Rank and product of each mergeable pair of symbol ids, for whole arrays of pairs: one slot a pair in a table of hashes, and a
    short sorted list of the pairs whose slot is taken."""

    SLOTS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        key = left.astype(np.int64) << 32 | right
        slot = self.slot(key)
        _, first = np.unique(slot, return_index=True)
        self.key = np.full(1 << self.SLOTS, -1, np.int64)
        self.value = np.full(1 << self.SLOTS, -1, np.int32)
        self.key[slot[first]], self.value[slot[first]] = key[first], first
        rest = np.setdiff1d(np.arange(len(key)), first)
        rest = rest[np.argsort(key[rest])]
        self.more, self.more_at = np.append(key[rest], np.int64(1) << 62), np.append(rest, -1)
        self.crowded = np.zeros(1 << self.SLOTS, bool)
        self.crowded[slot[rest]] = True
        self.rank, self.made = np.append(rank, FAR).astype(np.int32), np.append(made, -1).astype(np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x2545F4914F6CDD1D)).view(np.uint64) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair; the last number stands for no pair."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slot = self.slot(key)
        out = np.where(self.key[slot] == key, self.value[slot], len(self.rank) - 1)
        odd = np.flatnonzero(self.crowded[slot] & (out == len(self.rank) - 1))
        if len(odd):
            at = np.searchsorted(self.more, key[odd])
            out[odd] = np.where(self.more[at] == key[odd], self.more_at[at], len(self.rank) - 1)
        return out


def unicode_of_byte() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the
    others, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


FAR = np.int32((1 << 31) - 1)


def merge_all(table: PairTable, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of many words (one row each, -1 beyond its length) after all merges, lowest rank first and leftmost among
    equals; all words take their next merge together, and words without one leave. Returns the ids in one array and each word's
    number of them."""
    n, width = symbols.shape
    out_len, parts = np.zeros(n, np.int64), []
    row, s, k = np.arange(n), symbols, length.astype(np.int64)
    number = np.full((n, max(width - 1, 1)), len(table.rank) - 1)
    if width > 1:
        inside = np.arange(1, width) < k[:, None]
        number[inside] = table.find(s[:, :-1][inside], s[:, 1:][inside])
    while len(row):
        rank = table.rank[number]
        at = rank.argmin(1)
        here = np.arange(len(row))
        done = rank[here, at] == FAR
        if done.any():
            out_len[row[done]] = k[done]
            parts.append((row[done], s[done], k[done]))
            go = ~done
            row, s, k, number, at = row[go], s[go], k[go], number[go], at[go]
            if not len(row):
                break
            most = int(k.max())
            s, number, here = s[:, :most], number[:, : max(most - 1, 1)], np.arange(len(row))
        made = table.made[number[here, at]]
        cols = np.arange(s.shape[1])
        s = np.take_along_axis(s, np.minimum(cols + (cols > at[:, None]), s.shape[1] - 1), 1)
        s[here, at] = made
        k = k - 1
        pc = cols[: number.shape[1]]
        number = np.take_along_axis(number, np.minimum(pc + (pc > at[:, None]), number.shape[1] - 1), 1)
        number[here, np.minimum(k - 1, number.shape[1] - 1)] = len(table.rank) - 1  # the last pair is gone
        for side in (-1, 0):
            ok = (at + side >= 0) & (at + side + 1 < k)
            r, c = here[ok], at[ok] + side
            number[r, c] = table.find(s[r, c], s[r, c + 1])
    ends = np.cumsum(out_len)
    flat = np.zeros(int(ends[-1]) if n else 0, np.uint32)
    for r, t, m in parts:
        inside = np.arange(t.shape[1]) < m[:, None]
        flat[np.repeat(ends[r] - m, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)] = t[inside]
    return flat, out_len


#: A word of more symbols is merged by itself, with a heap.
LONG = 256


def merge_long(symbols: list, join) -> list:
    """The symbols of one word after all merges, lowest rank first and leftmost among equals, in n log n time. join(a, b): (rank, product) of two
    neighbours, or None. The heap holds (rank, begin) as one number; one whose neighbours have changed since is passed over."""
    s, n = symbols[:], len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, made = [-1] * n, [None] * n
    heap = []

    def look(i: int) -> None:
        got = join(s[i], s[after[i]])
        if got is None:
            rank[i] = -1
        else:
            rank[i], made[i] = got
            heapq.heappush(heap, rank[i] << 32 | i)

    for i in range(n - 1):
        look(i)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        if rank[i] != top >> 32:
            continue
        s[i], j = made[i], after[i]
        s[j], rank[i], rank[j] = None, -1, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            look(i)
        if before[i] >= 0:
            look(before[i])
    return [x for x in s if x is not None]


class Merger:
    """Merges of a byte-level vocabulary for many pre-tokens at once; pre-tokens of similar length advance together, and those of over LONG
    bytes are merged one by one."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.byte = unicode_of_byte()
        self.value = {c: b for b, c in self.byte.items()}
        self.table = PairTable(*(np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)), strict=True)))
        self.one = np.array([vocab[self.byte[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[self.byte[b] + self.suffix] for b in range(256)], np.int64)
        self.pair: dict[tuple, tuple] = {}
        self.rules = pairs

    def long(self, word: np.ndarray) -> list[int]:
        """The ids of one long pre-token."""
        if not self.pair:
            v = self.vocab
            self.pair = {(v[a], v[b]): (k, v[a + b]) for k, (a, b) in enumerate(self.rules)}
        s = self.one[word].tolist()
        s[-1] = int(self.last[word[-1]])
        return merge_long(s, lambda a, b: self.pair.get((a, b)))

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of each pre-token's."""
        n = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        body = np.frombuffer(b"".join(pretokens), np.uint8)
        start = np.cumsum(n) - n
        count, got = np.zeros(len(n), np.int64), []
        low = 0
        for j in np.flatnonzero(n > LONG).tolist():
            ids = np.array(self.long(body[start[j] : start[j] + n[j]]), np.uint32)
            count[j] = len(ids)
            got.append((np.array([j]), ids, count[j : j + 1]))
        for high in (2, 4, 6, 8, 10, 12, 15, 19, 24, 32, 64, LONG):
            k = np.flatnonzero((n > low) & (n <= high))
            low = high
            step = max(1, 200_000 // int(min(high, n.max(initial=1))))
            for a in range(0, len(k), step):
                j = k[a : a + step]
                width = int(n[j].max())
                inside = np.arange(width) < n[j][:, None]
                s = np.full((len(j), width), -1, np.int64)
                s[inside] = self.one[body[np.repeat(start[j], n[j]) + np.arange(int(n[j].sum())) - np.repeat(np.cumsum(n[j]) - n[j], n[j])]]
                s[np.arange(len(j)), n[j] - 1] = self.last[body[start[j] + n[j] - 1]]
                flat, m = merge_all(self.table, s, n[j])
                count[j] = m
                got.append((j, flat, m))
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint32)
        for j, flat, m in got:
            out[np.repeat(ends[j] - m, m) + np.arange(len(flat)) - np.repeat(np.cumsum(m) - m, m)] = flat
        return out, count


class ChunkEncoder:
    """Ids of texts by a tokenizer which drops white space, so that each space-separated chunk stands alone (NFC, lower case, then
    the split of `WORDS`, then merges with an end-of-word suffix). Chunks are encoded once and kept; what is kept is
    forgotten beyond `most` chunks, which bounds the memory and changes no result. Chunks with special strings or with characters
    beyond Latin are left to the library."""

    #: The split of that vocabulary, and the space between chunks (fixed value).
    WORDS = r" |'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, text: str, most: int = 700_000):
        import regex

        self.t, self.merger, self.most = tokenizer(text), Merger(text), most
        self.split = regex.compile(self.WORDS).findall
        self.plain = regex.compile(r"[ -~\u00a1-\u00ac\u00ae-\u024f]*").fullmatch
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def keep(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        k, n = self.known.n, len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n] = self.used + np.cumsum(length) - length
        self.length[k : k + n] = length
        self.used += len(ids)
        self.known.add(keys, np.arange(k, k + n))

    def add(self, keys: np.ndarray, chunks: list[str]) -> None:
        text = " ".join(chunks)
        if not self.plain(text) or any(s in text for s in self.special):
            own = np.array([bool(self.plain(c)) and not any(s in c for s in self.special) for c in chunks])
            got = [e.ids for e in self.t.encode_batch([c for c, o in zip(chunks, own, strict=True) if not o], add_special_tokens=False)]
            self.keep(keys[~own], np.array([i for e in got for i in e], np.uint32), np.array([len(e) for e in got], np.int64))
            keys, text = keys[own], " ".join(c for c, o in zip(chunks, own, strict=True) if o)
        if not len(keys):
            return
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        words = [w.encode() for w in self.split(text)]
        ids, count = self.merger.merge([w for w in words if w != b" "])
        chunk = np.cumsum(np.fromiter((w == b" " for w in words), bool, len(words)))
        chunk = chunk[np.fromiter((w != b" " for w in words), bool, len(words))]
        self.keep(keys, ids, np.bincount(chunk, count, len(keys)).astype(np.int64))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in one array, and the offsets of the texts in it; null counts as empty."""
        if self.known.n > self.most:
            self.clear()
        body, off = utf8(column)
        start, end, key, row = hashed_words(body, off, SPACE)
        k = self.known.find(key)
        if (k < 0).any():
            odd = np.flatnonzero(k < 0)
            new, first = np.unique(key[odd], return_index=True)
            raw = body.tobytes()
            self.add(new, [raw[a:b].decode() for a, b in zip(start[odd[first]].tolist(), end[odd[first]].tolist(), strict=True)])
            k[odd] = self.known.find(key[odd])
        length = self.length[k].astype(np.int64)
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[k] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(off)))]
