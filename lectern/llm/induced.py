"""Suffix order and common prefixes of one shard, by induced sorting with queues that spill to disk.

Level 0 follows SA-IS (Nong, Zhang and Chan, 2009) in the external form of eSAIS (Bingmann, Fischer and Osipov, 2013): suffixes are not
looked up in a sorted array but travel as tuples (position, common prefix with the tuple before) through a priority queue whose
priority is the first character and, within it, the order of arrival. Whole runs of tuples with one first character are taken and
induced at once with array operations. The common prefix of two tuples that follow each other in a queue is one more than the smallest
common prefix among the tuples that were taken between those that induced them.

Level 1, the string of names of the LMS substrings, has as many characters as names; it is ordered by doubling, to the depth that
counts."""

from __future__ import annotations

import tempfile

import numpy as np

from .common import BASE, BASE_INVERSE, mix, powers


class Queue:
    """A priority queue of tuples (position, common prefix): taken by first character, and in order of arrival within it. Beyond `most`
    tuples in memory, those of the fullest characters go to a file of their own until they are taken."""

    def __init__(self, characters: int, most: int):
        self.parts: list[list] = [[] for _ in range(characters)]
        self.held, self.most, self.size = 0, most, np.zeros(characters, np.int64)
        self.file = None

    def put(self, c: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.parts[c].append((position, prefix))
        self.held += len(position)
        self.size[c] += len(position)
        while self.held > self.most:
            self.spill(int(self.size.argmax()))

    def spill(self, c: int) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="lectern-queue-")
        position, prefix = self.joined(c, keep_order=True)
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(position, np.int32).tobytes() + np.ascontiguousarray(prefix, np.uint8).tobytes())
        self.parts[c] = [*(p for p in self.parts[c] if isinstance(p[0], int)), (at, len(position))]
        self.held -= int(self.size[c])
        self.size[c] = 0

    def joined(self, c: int, keep_order: bool = False) -> tuple[np.ndarray, np.ndarray]:
        parts = [p for p in self.parts[c] if not (keep_order and isinstance(p[0], int))]
        got = []
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(b), np.uint8)
            got.append((a, b))
        if len(got) == 1:
            return got[0]
        return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (np.zeros(0, np.int32), np.zeros(0, np.uint8))

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        out = self.joined(c)
        self.held -= int(self.size[c])
        self.size[c], self.parts[c] = 0, []
        return out

    def close(self) -> None:
        if self.file:
            self.file.close()


def range_minima(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of x[low] ... x[high] for each pair, low <= high."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), x.dtype)
    table, k = x, 0
    top = int(level.max(initial=-1))
    while k <= top:
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :]) if len(table) > 1 << k else table
        k += 1
    return out


class Shard:
    """text: bytes of strings that are each followed by a separator. Characters: 0 at the end, 1 for a separator, 2 + byte."""

    def __init__(self, strings: list[bytes], depth: int = 100, most: int = 1 << 18):
        self.depth, self.most = depth, most
        joined = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
        t = joined.astype(np.int16) + 2
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.stop = np.cumsum(length + 1) - 1  # where the separators are
        self.start = self.stop - length
        t[self.stop] = 1
        t[-1] = 0
        self.t, self.n = t, len(t)
        self.characters = 258
        self.word = None
        differs = np.flatnonzero(t[:-1] != t[1:])
        up = t[differs] < t[differs + 1]
        run = np.diff(np.concatenate([[-1], differs]))
        small = np.repeat(up, run)
        self.small = np.append(small, True)  # S-type
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def words(self) -> np.ndarray:
        """Each position's next eight characters as a number whose lowest byte comes first; only their equality counts."""
        if self.word is None:
            b = np.concatenate([(self.t & 255).astype(np.uint8), np.zeros(self.depth + 16, np.uint8)])
            self.word = np.lib.stride_tricks.as_strided(b, (len(b) - 8, 8), (1, 1))
            self.word = np.ascontiguousarray(self.word).view(np.uint64).ravel()
        return self.word

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The lengths of the common prefixes of suffixes p and q, `depth` at most (2 and 258 share a code only past a separator's end)."""
        w, out = self.words(), np.full(len(p), self.depth, np.int64)
        left = np.arange(len(p))
        for k in range(0, self.depth, 8):
            x = w[np.minimum(p[left] + k, len(w) - 1)] ^ w[np.minimum(q[left] + k, len(w) - 1)]
            odd = np.flatnonzero(x)
            if len(odd):
                d = x[odd]
                low = (d & (~d + np.uint64(1))).astype(np.float64)
                out[left[odd]] = np.minimum(out[left[odd]], k + (np.frexp(low)[1] - 1) // 8)
                left = left[x == 0]
            if not len(left):
                break
        return out.astype(np.uint8)

    def induce(self, first: list, small: bool, prefixes: bool) -> list:
        """One pass. first[c]: tuples of character c that are given, in scan order, to be taken after those of the queue; small: whether
        S-type suffixes are induced, from the largest character down, or L-type ones upwards. Returns the induced tuples by character, in scan
        order."""
        t, kind, cap = self.t, self.small, self.depth
        queue, out = Queue(self.characters, self.most), [None] * self.characters
        for c in range(self.characters - 1, -1, -1) if small else range(self.characters):
            carry = np.zeros(self.characters, np.int64)  # smallest common prefix since the last tuple for each character
            got, last = [], -1
            given = False
            while True:
                position, prefix = queue.take(c)
                if len(position):
                    got.append((position, prefix))
                else:
                    if given or first[c] is None or not len(first[c][0]):
                        break
                    position, prefix = first[c]
                    given = True
                    if prefixes:
                        prefix = prefix.copy()
                        prefix[0] = self.common(np.array([last]), position[:1].astype(np.int64))[0] if last >= 0 else 0
                if prefixes and last < 0:
                    prefix = prefix.copy()
                    prefix[0] = 0
                    if not given:
                        got[-1] = (position, prefix)
                last = int(position[-1])
                before = position - 1
                mine = np.flatnonzero((position > 0) & (kind[before] == small))
                before = before[mine]
                if not len(mine):
                    if prefixes:
                        carry = np.minimum(carry, int(prefix.min()))
                    continue
                d = t[before].view(np.uint16)
                order = np.argsort(d, kind="stable")
                j, before, d = mine[order], before[order].astype(np.int32), d[order]
                cut = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
                heads = d[cut].tolist()
                if prefixes:
                    whole = int(prefix.min())
                    value = np.empty(len(j), np.uint8)
                    if len(j):
                        low = np.empty(len(j), np.int64)
                        low[1:] = j[:-1] + 1
                        low[cut] = 0
                        value = np.minimum(range_minima(prefix, low, j).astype(np.int64), cap)
                        value[cut] = np.minimum(value[cut], carry[heads])
                        value = np.minimum(value + 1, cap).astype(np.uint8)
                    carry = np.minimum(carry, whole)
                    if len(j):
                        ends = np.append(cut[1:], len(d)) - 1
                        tail = np.full(len(ends), cap, np.int64)
                        has = j[ends] + 1 < len(prefix)
                        if has.any():
                            tail[has] = range_minima(prefix, j[ends][has] + 1, np.full(int(has.sum()), len(prefix) - 1))
                        carry[heads] = tail
                else:
                    value = np.zeros(len(j), np.uint8)
                for a, b, h in zip(cut.tolist(), [*cut[1:].tolist(), len(d)], heads, strict=True):
                    queue.put(h, before[a:b], value[a:b])
            out[c] = (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else None
        queue.close()
        return out

    def by_character(self, position: np.ndarray, prefix: np.ndarray) -> list:
        c = self.t[position]
        cut = np.searchsorted(c, np.arange(self.characters + 1))
        return [(position[a:b].astype(np.int32), prefix[a:b]) if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]

    @staticmethod
    def reversed_(tuples: tuple | None) -> tuple | None:
        if tuples is None:
            return None
        position, prefix = tuples
        return position[::-1], np.append(np.zeros(1, np.uint8), prefix[:0:-1])

    def sorted_lms(self) -> np.ndarray:
        """The LMS suffixes in order, to the depth that counts."""
        lms, t = self.lms, self.t
        seeds = lms[np.argsort(t[lms].view(np.uint16), kind="stable")]
        large = self.induce(self.by_character(seeds, np.zeros(len(seeds), np.uint8)), False, False)
        small = self.induce([self.reversed_(x) for x in large], True, False)
        order = np.concatenate([x[0][::-1] for x in small if x is not None] or [np.zeros(0, np.int32)]).astype(np.int64)
        order = order[(order > 0) & ~self.small[np.maximum(order - 1, 0)]]
        order = np.append(self.n - 1, order)  # the end is the smallest
        number = np.empty(self.n, np.int32)
        number[lms] = np.arange(len(lms))
        following = np.append(lms[1:], self.n - 1)
        length = (following - lms + 1)[number[order]]
        run = np.append(np.zeros(1, np.uint64), np.cumsum(mix(np.arange(1, self.characters + 1, dtype=np.uint64))[t] * powers(BASE, self.n), dtype=np.uint64))
        inverse = powers(BASE_INVERSE, self.n)
        h = (run[order + length] - run[order]) * inverse[order]
        name = np.cumsum(np.append(False, (h[1:] != h[:-1]) | (length[1:] != length[:-1])))
        rank = np.empty(len(lms), np.int64)
        rank[number[order]] = name
        step = 1
        while name[-1] + 1 < len(lms) and step < self.depth // 2 + 1:  # an LMS substring advances two characters at least
            bits = int(len(lms)).bit_length()
            if bits <= 21:  # both ranks and the place fit into one number, whose sort is several times as fast
                key = rank << 2 * bits
                key[:-step] |= rank[step:] + 1 << bits
                key |= np.arange(len(lms))
                key.sort()
                by, k = key & (1 << bits) - 1, key >> bits
            else:
                key = rank << 32
                key[:-step] |= rank[step:] + 1
                by = np.argsort(key)
                k = key[by]
            name = np.cumsum(np.append(False, k[1:] != k[:-1]))
            rank[by] = name
            step *= 2
        return lms[np.argsort(rank, kind="stable")]

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes but the end in order, and each one's common prefix with the one before, `depth` at most."""
        order = self.sorted_lms()
        prefix = np.append(np.zeros(1, np.uint8), self.common(order[:-1], order[1:]))
        large = self.induce(self.by_character(order, prefix), False, True)
        small = self.induce([self.reversed_(x) for x in large], True, True)
        position, common = [], []
        for c in range(self.characters):
            s = self.reversed_(small[c])
            if large[c] is not None:
                p, k = large[c]
                position.append(p)
                common.append(np.append(np.zeros(1, np.uint8), k[1:]))
            if s is not None:
                p, k = s
                k = k.copy()
                k[0] = self.common(position[-1][-1:].astype(np.int64), p[:1].astype(np.int64))[0] if large[c] is not None else 0
                position.append(p)
                common.append(k)
        return np.concatenate(position), np.concatenate(common)
