"""SentencePiece encoding and decoding in batches of equally long words."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import LONG, merge_long
from .common import BASE, BASE_INVERSE, Known, hashed_words, mix, powers, utf8

UNIGRAM, BPE = 1, 2  # model types, and below piece types, of the published file format
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
MARK = "▁"


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int
    byte_fallback: bool
    prefix: bool

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        pieces, scores, types, kind, fallback, prefix = [], [], [], UNIGRAM, False, True
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                types.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(fields(value))
                kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(fields(value))
                prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models with the identity normaliser, which keep extra spaces and escape them, are supported")
        if USER in types or kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        return cls(pieces, np.array(scores, np.float32), np.array(types), kind, fallback, prefix)


class Coder:
    """Encodes words, which the caller gives with the mark for spaces, many at a time."""

    def __init__(self, data: bytes):
        v = self.v = Vocabulary.parse(data)
        if not v.byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        own = np.flatnonzero(v.types == NORMAL)
        self.longest = max(len(v.pieces[k]) for k in own)
        self.power, self.inverse = powers(BASE, 4096), powers(BASE_INVERSE, 4096)
        keys = np.concatenate([self.hash_words([v.pieces[k] for k in own if len(v.pieces[k]) == n])[:, -1] for n in range(1, self.longest + 1) if any(len(v.pieces[k]) == n for k in own)])
        ids = np.concatenate([[k for k in own if len(v.pieces[k]) == n] for n in range(1, self.longest + 1)]).astype(np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.score = np.append(v.scores[self.ids], np.float32(-np.inf))
        self.bytes = np.zeros(256, np.int64)
        for k in np.flatnonzero(v.types == BYTE):
            self.bytes[int(v.pieces[k][3:5], 16)] = k
        # for long words: each piece's place in the order of scores, equal scores having equal places
        place = np.unique(-v.scores[own], return_inverse=True)[1]
        self.place = {v.pieces[k]: r for k, r in zip(own.tolist(), place.tolist(), strict=True)}
        self.unknown = np.float32(v.scores[own].min() - 10)
        #: a space after another character begins a word, if no piece runs over that place; a character in no longer piece stands alone
        self.words_are_apart = not any(MARK in p.lstrip(MARK) for p in (v.pieces[k] for k in own))
        self.alone = {c for c in map(chr, range(256)) if not any(c in p and len(p) > 1 for p in (v.pieces[k] for k in own))}

    def hash_words(self, words: list[str]) -> np.ndarray:
        """Key of every prefix of equally long words, one row a word; the key of a piece is that of its last prefix."""
        run = self.prefixes(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1))
        return self.key(run, np.zeros(1, np.int64), np.arange(1, run.shape[1]))

    def prefixes(self, chars: np.ndarray) -> np.ndarray:
        n, width = chars.shape
        run = np.zeros((n, width + 1), np.uint64)
        code = mix((chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        np.cumsum(code * self.power[:width], axis=1, out=run[:, 1:])
        return run

    def key(self, run: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        a, z = (run[row, start], run[row, stop]) if row is not None else (run[:, start], run[:, stop])
        return mix((z - a) * self.inverse[start] + (stop - start).astype(np.uint64))

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Places of the keys among the sorted piece keys; the last place is that of no piece."""
        at = np.searchsorted(self.keys, key)
        at = np.minimum(at, len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def viterbi(self, run: np.ndarray) -> np.ndarray:
        """True where a piece begins (and at the end), by the largest sum of scores; of equal sums, the earlier begin wins. All words advance one
        character at a time; a single character that is no piece has the unknown score."""
        n, width = run.shape[0], run.shape[1] - 1
        best = np.full((n, width + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int64)
        for stop in range(1, width + 1):
            low = max(0, stop - self.longest)
            start = np.arange(low, stop)
            s = self.score[self.probe(self.key(run, start, np.full(len(start), stop)))]
            s[:, -1] = np.where(np.isinf(s[:, -1]), self.unknown, s[:, -1])
            total = best[:, low:stop] + s
            pick = total.argmax(1)
            best[:, stop] = total[np.arange(n), pick]
            back[:, stop] = pick + low
        cut = np.zeros((n, width + 1), bool)
        at, rows = np.full(n, width), np.arange(n)
        while len(rows):
            cut[rows, at] = True
            at = back[rows, at]
            rows_on = at > 0
            cut[rows[~rows_on], 0] = True
            rows, at = rows[rows_on], at[rows_on]
        return cut

    def merges(self, run: np.ndarray) -> np.ndarray:
        """The same by merges: each word joins the neighbours whose join is the piece with the largest score, leftmost of equals, until no
        join is a piece. All words take their next merge together."""
        n, width = run.shape[0], run.shape[1] - 1
        cut = np.ones((n, width + 1), bool)
        if width < 2:
            return cut
        row = np.arange(n)
        edge = np.tile(np.arange(width + 1), (n, 1))  # begins of the pieces, then the end
        count = np.full(n, width)
        r, c = np.indices((n, width - 1)).reshape(2, -1)
        score = self.score[self.probe(self.key(run, c, c + 2, r))].reshape(n, width - 1)
        while len(row):
            at = score.argmax(1)
            here = np.arange(len(row))
            go = score[here, at] > -np.inf
            if not go.all():
                row, edge, count, score, at = row[go], edge[go], count[go], score[go], at[go]
                if not len(row):
                    break
                here = np.arange(len(row))
            cut[row, edge[here, at + 1]] = False
            cols = np.arange(edge.shape[1])
            edge = np.take_along_axis(edge, np.minimum(cols + (cols > at[:, None]), edge.shape[1] - 1), 1)
            cols = np.arange(score.shape[1])
            score = np.take_along_axis(score, np.minimum(cols + (cols > at[:, None]), score.shape[1] - 1), 1)
            count = count - 1
            score[here, np.minimum(count - 1, score.shape[1] - 1)] = -np.inf
            for side in (-1, 0):
                ok = (at + side >= 0) & (at + side + 1 < count)
                r, c = here[ok], at[ok] + side
                score[r, c] = self.score[self.probe(self.key(run, edge[r, c], edge[r, c + 2], row[r]))]
        return cut

    def merged(self, word: str) -> np.ndarray:
        """As merges(), for one long word."""

        def join(a: str, b: str):
            r = self.place.get(a + b)
            return None if r is None else (r, a + b)

        cut = np.zeros((1, len(word) + 1), bool)
        cut[0, np.cumsum([0, *map(len, merge_long(list(word), join))])] = True
        return cut

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each word's number of them."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [np.zeros(0, np.int64)] * len(words)
        order = np.argsort(n, kind="stable")
        for length in np.unique(n):
            if not length:
                continue
            mine = order[np.searchsorted(n[order], length) : np.searchsorted(n[order], length, "right")]
            if length >= len(self.power):
                self.power, self.inverse = powers(BASE, int(length) + 1), powers(BASE_INVERSE, int(length) + 1)
            for a in range(0, len(mine), max(1, 400_000 // int(length))):
                part = mine[a : a + max(1, 400_000 // int(length))]
                chars = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le"), np.uint32).reshape(len(part), -1)
                run = self.prefixes(chars)
                if self.v.kind == UNIGRAM:
                    cut = self.viterbi(run)
                else:
                    cut = self.merges(run) if length <= LONG else np.concatenate([self.merged(words[k]) for k in part])
                r, c = np.nonzero(cut[:, :-1])
                _, e = np.nonzero(cut[:, 1:])
                at = self.probe(self.key(run, c, e + 1, r))
                ids = np.append(self.ids, -1)[at]
                odd = np.flatnonzero(ids < 0)
                ends = np.searchsorted(r, np.arange(len(part) + 1))
                if not len(odd):
                    for k, (x, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        out[part[k]] = ids[x:z]
                    continue
                bad = np.unique(r[odd])
                for k, (x, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    out[part[k]] = ids[x:z]
                for k in bad.tolist():
                    got: list[int] = []
                    for i, s, t in zip(ids[ends[k] : ends[k + 1]], c[ends[k] : ends[k + 1]], e[ends[k] : ends[k + 1]], strict=True):
                        got += [int(i)] if i >= 0 else self.bytes[list(words[part[k]][s : t + 1].encode())].tolist()
                    out[part[k]] = np.array(got, np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int64)).astype(np.uint32), np.fromiter(map(len, out), np.int64, len(out))


class Encoder:
    """Ids of texts. Words, parted where no piece can run over, are encoded once and kept, and forgotten beyond `most` words."""

    def __init__(self, data: bytes, most: int = 700_000):
        self.c, self.most = Coder(data), most
        self.byte_piece = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t not in (NORMAL, UNKNOWN) else (" ⁇ " if t == UNKNOWN else p.replace(MARK, " ")).encode() for p, t in zip(self.c.v.pieces, self.c.v.types.tolist(), strict=True)]
        self.is_byte = self.c.v.types == BYTE
        self.clear()

    def clear(self) -> None:
        self.known, self.flat, self.used = Known(), np.zeros(1 << 20, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def keep(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        k, n = self.known.n, len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.length[k : k + n] = self.used + np.cumsum(length) - length, length
        self.used += len(ids)
        self.known.add(keys, np.arange(k, k + n))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in one array, and the offsets of the texts in it; null counts as empty. Each run of spaces goes
        with the word after it; the first word of a text has one more in front."""
        if self.known.n > self.most:
            self.clear()
        body, off = utf8(column)
        space = body == 32
        alone = np.zeros(256, bool)
        if "\n" in self.c.alone:
            alone[10] = True
        solo = alone[body]
        n = len(body)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begin = edge[:n].copy()
        if n and self.c.words_are_apart:
            mark, after = space.copy(), np.append(False, space[:-1])  # a mark begins here; one has just ended
            if n > 2:
                own = np.flatnonzero((body[:-2] == 0xE2) & (body[1:-1] == 0x96) & (body[2:] == 0x81))  # the mark itself, in a text
                mark[own] = True
                after[own[own + 3 < n] + 3] = True
            begin |= mark & ~after
            begin[1:] |= solo[:-1]
            begin |= solo
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], n)
        row = np.searchsorted(off, start, "right") - 1
        leads = edge[start]
        key = self.word_keys(body, start, stop) * np.uint64(2) + leads.astype(np.uint64)
        key = mix(key)
        k = self.known.find(key)
        odd = np.flatnonzero(k < 0)
        if len(odd):
            new, first = np.unique(key[odd], return_index=True)
            at = odd[first]
            raw = body.tobytes()
            pre = MARK if self.c.v.prefix else ""
            words = [(pre if lead else "") + raw[a:b].decode().replace(" ", MARK) for a, b, lead in zip(start[at].tolist(), stop[at].tolist(), leads[at].tolist(), strict=True)]
            self.keep(new, *self.c.encode_words(words))
            k[odd] = self.known.find(key[odd])
        length = self.length[k].astype(np.int64)
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[k] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(off)))]

    @staticmethod
    def word_keys(body: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each start to its stop; the stretches follow each other."""
        never = np.zeros(256, bool)
        if not len(start):
            return np.zeros(0, np.uint64)
        return hashed_words(body, np.append(start, stop[-1]), never)[2]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces for marks, without the one that encoding put in front; runs of byte pieces are read as UTF-8, what is not
        valid there as replacement characters."""
        raw = b"".join([self.byte_piece[i] for i in ids.tolist()])
        if self.c.v.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, ids_crc32, ids, round_trip) for each row, as the sentencepiece library encodes without begin and end.

    A null text counts as empty and has no ids; a null id stays null; repeated rows are each encoded; other columns play no part. One pass,
    without a shuffle; a worker holds a few hundred texts' ids and a bounded table of words. The model file is read on the driver and sent to the
    tasks; it has the vocabulary's size."""
    with open(model_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{model_path}: not a model file of bounded size")
    Vocabulary.parse(data)
    sent = df.sparkSession.sparkContext.broadcast(data)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 400):
                texts = b.column(1).slice(at, 400)
                ids, off = enc.encode(texts)
                _, size = utf8(texts)
                parts = [ids[a:z] for a, z in zip(off[:-1], off[1:], strict=True)]
                same = [enc.decode(p) == (t or "") for p, t in zip(parts, texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 400), pa.array(np.diff(size)), pa.array(np.diff(off)), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(same, pa.bool_())], [id_col, "n_bytes", "n_tokens", "ids_crc32", "ids", "round_trip"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, ids_crc32 long, ids array<int>, round_trip boolean")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else enc.decode(np.array(i, np.int64)) for i in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
