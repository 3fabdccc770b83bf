"""Hierarchical multi-length packing."""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Tables

SCHEMA = "`{}` {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, ordinal long"


@lru_cache(maxsize=1)
def encoder(text: str) -> bpe.ChunkEncoder:
    return bpe.ChunkEncoder(text)


class Packer:
    """Packs the documents of one task. Windows have the sizes of `tiers` (powers of two, largest first).

    Routing: a document fills windows of the largest tier with its leading parts; its rest goes to the smallest tier that holds it.
    Packing: as soon as a tier holds `pool` windows' worth of tokens, its pieces are placed largest first, each into the fullest open
    window that takes it whole. Gaps are filled from the shorter tiers' waiting pieces, whole ones while they fit, the
    last one cut at the gap's end. A window leaves only when it is full, so it needs no padding; what is left
    at the task's end is cut into windows that are powers of two. Windows of one size are counted (`ordinal`), for the step groups."""

    def __init__(self, tiers: tuple[int, ...], pool: int, task: int):
        self.tiers, self.pool = tiers, pool
        self.wait: dict[int, deque] = {t: deque() for t in tiers}
        self.held = dict.fromkeys(tiers, 0)
        self.next, self.filled = task << 40, {}
        self.rows: list[tuple] = []

    def route(self, piece: tuple) -> None:
        """piece: (document's key, start, ids, document's tokens)"""
        n = len(piece[2])
        if n:
            tier = next(t for t in reversed(self.tiers) if n <= t)
            self.wait[tier].append(piece)
            self.held[tier] += n

    def add(self, key, ids: np.ndarray) -> None:
        n, top = len(ids), self.tiers[0]
        whole = n - n % top
        for s in range(0, whole, top):
            self.emit([(key, s, ids[s : s + top], n)], top)
        self.route((key, whole, ids[whole:], n))
        for t in self.tiers:
            if self.held[t] >= self.pool * t:
                self.pack(t)

    def emit(self, pieces: list[tuple], window: int) -> None:
        ordinal = self.filled.get(window, 0)
        self.filled[window] = ordinal + 1
        offset = 0
        for key, start, ids, n in pieces:
            self.rows.append((key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), n, self.next, offset, window, ordinal))
            offset += len(ids)
        self.next += 1

    def take(self, tier: int) -> tuple:
        piece = self.wait[tier].popleft()
        self.held[tier] -= len(piece[2])
        return piece

    def pack(self, tier: int) -> None:
        """Places the tier's waiting pieces; windows that no filler closes wait, cut free again, for the next call."""
        pieces = sorted((self.take(tier) for _ in range(len(self.wait[tier]))), key=lambda p: -len(p[2]))
        room: list[list[int]] = [[] for _ in range(tier + 1)]  # the open windows by free tokens
        free = np.zeros(tier + 1, bool)
        open_: list[list[tuple]] = []
        for p in pieces:
            n = len(p[2])
            k = n + int(np.argmax(free[n:])) if free[n:].any() else -1
            if k < 0:
                open_.append([p])
                w, left = len(open_) - 1, tier - n
            else:
                w, left = room[k].pop(), k - n
                free[k] = bool(room[k])
                open_[w].append(p)
            if left:
                room[left].append(w)
                free[left] = True
        gaps = dict((w, k) for k in range(tier + 1) for w in room[k])
        shorter = [t for t in self.tiers if t < tier]
        for w, window in enumerate(open_):
            gap = gaps.get(w, 0)
            for t in shorter:
                while gap and self.wait[t]:
                    key, start, ids, n = self.take(t)
                    window.append((key, start, ids[:gap], n))
                    self.route((key, start + gap, ids[gap:], n))
                    gap -= min(gap, len(ids))
            if gap and w + 1 < len(open_):  # no filler is left: the rest of the windows fills this one
                while gap and w + 1 < len(open_):
                    key, start, ids, n = open_[-1].pop()
                    gaps[len(open_) - 1] = gaps.get(len(open_) - 1, 0) + len(ids)
                    window.append((key, start, ids[:gap], n))
                    rest = ids[gap:]
                    if len(rest):
                        open_[-1].append((key, start + gap, rest, n))
                        gaps[len(open_) - 1] -= len(rest)
                    gap -= min(gap, len(ids))
                    if not open_[-1]:
                        open_.pop()
            if gap:
                for p in window:
                    self.route(p)
            else:
                self.emit(window, tier)

    def finish(self) -> None:
        for t in self.tiers:
            if self.held[t] >= t:
                self.pack(t)
        rest = [self.take(t) for t in self.tiers for _ in range(len(self.wait[t]))]
        left = sum(len(p[2]) for p in rest)
        queue = deque(rest)
        while left:
            window = min(self.tiers[0], 1 << (left.bit_length() - 1))
            gap, pieces = window, []
            while gap:
                key, start, ids, n = queue.popleft()
                pieces.append((key, start, ids[:gap], n))
                if len(ids) > gap:
                    queue.appendleft((key, start + gap, ids[gap:], n))
                gap -= min(gap, len(ids))
            self.emit(pieces, window)
            left -= window


def pack(df: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = (2048, 1024, 512, 256), end_id: int = 1, pool: int = 64, step_tokens: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group).

    Each document is its text's ids (null text: none) and end_id; each id is in exactly one piece. Sequences are full windows, a power of
    two long, so none needs padding. Repeated rows are documents of their own, a null id stays null, other columns play no part;
    an empty table gives no rows. Each task packs what it reads: no shuffle, memory for `pool` windows a tier, and
    sequence ids that start with the task's number; of a table, whose splits are fixed, a retried task gives the same rows. (Of a
    frame that is shuffled, write a table first, as the pipeline does.)

    Step groups are balanced over all tasks: windows of one size are numbered through, task after task (by what the tasks before have,
    one row a task and size), and each `step_tokens` tokens of them are a group, so that all groups of a size but its last have equal
    tokens. A group's number has the window's size in its upper bits."""
    if list(tiers) != sorted(tiers, reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers: powers of two, largest first")
    tables = Tables(df.sparkSession, "packing")
    vocab = bpe.load(df.sparkSession, tokenizer_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        packer = Packer(tiers, pool, TaskContext.get().partitionId())
        enc = encoder(vocab.value)

        def out(id_type):
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 9
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "ordinal"])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            keys = b.column(0).to_pylist()
            for at in range(0, len(keys), 500):
                ids, off = enc.encode(b.column(1).slice(at, 500))
                for k, key in enumerate(keys[at : at + 500]):
                    packer.add(key, np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)))
            yield out(id_type)
        if id_type is not None:
            packer.finish()
            yield out(id_type)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
    packed = tables.put("packed", df.select(id_col, text_col).mapInArrow(run, SCHEMA.format(id_col, kind)))
    packed = packed.withColumn("_task", F.shiftright("sequence_id", 40))
    earlier = Window.partitionBy("window").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    windows = packed.where("offset = 0").groupBy("window", "_task").agg(F.count("*").alias("_n"))
    first = windows.select("window", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    a_group = F.greatest(F.lit(1), F.expr(f"{int(step_tokens)} div window"))
    group = F.shiftleft("window", 40) + F.floor((F.col("_first") + F.col("ordinal")) / a_group).cast("long")
    return packed.join(F.broadcast(first), ["window", "_task"]).select(*names, group.alias("step_group"))
