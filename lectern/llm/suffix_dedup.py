"""Suffix-array dedup of repeated byte strings, with external induced sorting of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, BYTE_CODE, Tables, fresh, mix, powers, utf8
from .induced import Shard

LENGTH = 100
GRAM = 24  # bytes of an anchor
SLICE = 32  # texts at a time, so that their arrays stay in a core's cache
SHARD_BYTES = 3 << 19  # a shard's sort takes about 65 times as much
HOT = 20_000  # of pieces around one anchor that tasks send; with more, its windows are dealt by their own hashes
COPIES = 20  # so many pieces count as one that is sent, if they are copies within what tasks have read
FLUSH_BYTES = 8 << 20  # of distinct pieces that a task holds before it sends them
FLUSH_WINDOWS = 1 << 20  # of hot anchors, likewise
WINDOWS = 100_000  # of hot anchors that one group is meant to have
M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(body: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes at each position: hashes of 1, 2, 4 ... bytes are combined."""
    out, at = None, 0
    h, width = BYTE_CODE[body], 1
    while True:
        if gram & width:
            if out is None:
                out, at = h, width
            else:
                m = len(h) - at
                out = mix(out[:m] + h[at : at + m] * M) if m > 0 else out[:0]
                at += width
        width *= 2
        if width > gram:
            return out
        half = width // 2
        h = mix(h[:-half] * M + h[half:]) if len(h) > half else h[:0]


def pieces(body: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, key, anchor, first, last, whole) of the pieces of the texts. The anchor of a window of `length` bytes is the leftmost of its grams with
    the smallest hash, so equal windows have equal anchors at equal offsets. A piece is a run of windows, from `first` to
    `last`, with the same anchor; key is the hash of the anchor's bytes, whole the sum of the hashes of all the piece's grams. Positions are within the
    text."""
    n = len(body) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, empty, empty
    h = gram_hashes(body, gram)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    anchor = (v[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(np.diff(off) - length + 1, 0)) - np.maximum(np.diff(off) - length + 1, 0), np.maximum(np.diff(off) - length + 1, 0)) + off[row]
    anchor = anchor[start]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(row) else empty
    last = np.append(new[1:], len(row)) - 1
    base = off[row[new]]
    run = np.append(np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64))
    whole = (run[start[last] + length - gram + 1] - run[start[new]]).view(np.int64)
    return row[new], h[anchor[new]].view(np.int64), anchor[new] - base, start[new] - base, start[last] - base, whole


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Evenly, though keys are the smallest hashes of their windows."""
    return ((mix(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def repeated_anchors(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(d, h, anchor) of the pieces whose anchor's bytes anchor another piece, too, and for each hot anchor a row of its key, about how many
    pieces of it will be sent, and -1. An anchor is hot by its distinct pieces: copies within what a task holds are sent once. A task sends each
    key once, with the first piece that has it, how many have, and how many of these differ; the other pieces with that key are known at once."""
    schema = "bucket long, key binary, d binary, h binary, anchor binary, many binary, distinct binary"
    names = ["bucket", "key", "d", "h", "anchor", "many", "distinct"]

    def send(batches):
        for batch in batches:
            parts = [[], [], [], [], []]
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, SLICE):
                body, off = utf8(batch.column(2).slice(at, SLICE))
                row, key, anchor, _, _, whole = pieces(body, off, length)
                for part, x in zip(parts, (key, whole, d[at + row], h[at + row], anchor.astype(np.int32)), strict=True):
                    part.append(x)
            key, whole, d, h, an = map(np.concatenate, parts)
            order = np.argsort(key, kind="stable")
            key, whole, d, h, an = key[order], whole[order], d[order], h[order], an[order]
            first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            rest = np.flatnonzero(~first)
            for a in range(0, len(rest), 50_000):
                k = rest[a : a + 50_000]
                none = pa.array([b""], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([-1 - (a // 50_000 + int(key[k[0]]) & 0xFFFF)]), none, *(pa.array([x[k].tobytes()], pa.binary()) for x in (d, h, an)), none, none], names)
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(key))).astype(np.int32)
            among = np.flatnonzero(np.repeat(many > 1, many))  # pieces that share their key
            owner, whole = np.repeat(np.arange(len(begin)), many)[among], whole[among]
            order = np.lexsort((whole, owner))
            same = (owner[order[1:]] == owner[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
            distinct = (many - np.bincount(owner[order[1:][same]], minlength=len(begin))).astype(np.int32)
            key, d, h, an = key[begin], d[begin], h[begin], an[begin]
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array([x[order[cut[k] : cut[k + 1]]].tobytes() for k in full], pa.binary()) for x in (key, d, h, an, many, distinct))], names)

    def receive(bucket: tuple, t: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
        key, d, h, an, many, distinct = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in zip(names[1:], kinds, strict=True))
        if bucket[0].as_py() >= 0 and len(key):
            order = np.argsort(key, kind="stable")
            key, d, h, an, many, distinct = key[order], d[order], h[order], an[order], many[order], distinct[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            total = np.add.reduceat(many.astype(np.int64), begin)
            sends = np.maximum(np.add.reduceat(distinct.astype(np.int64), begin), total // COPIES)
            keep, hot = np.repeat(total > 1, size), (total > 1) & (sends > HOT)
            d, h, an = np.append(d[keep], key[begin][hot]), np.append(h[keep], sends[hot]), np.append(an[keep], np.full(int(hot.sum()), -1, np.int32))
        return pa.table({"d": d, "h": h, "anchor": an})

    return texts.mapInArrow(send, schema).groupBy("bucket").applyInArrow(receive, "d long, h long, anchor int")


def known_pieces(row: np.ndarray, anchor: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of the pieces have their anchor in their row's sorted list."""
    many = np.diff(lists.offsets.to_numpy())
    known = lists.flatten().to_numpy().astype(np.int64) + (np.repeat(np.arange(len(many)), many) << 32)
    if not len(known):
        return np.zeros(0, np.int64)
    code = (row << 32) + anchor
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code)


def window_hashes(body: np.ndarray, low: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes of each window of the pieces that begin at `low` and have so many windows, and its offset there."""
    within = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = many + length - 1
    part, offset = body[np.repeat(low, size) + within(size)], within(many)
    place = np.repeat(np.cumsum(size) - size, many) + offset
    forth, back, out = powers(BASE, len(part)), powers(BASE_INVERSE, len(part) + 1)[place], []
    for code in (BYTE_CODE, mix(BYTE_CODE + M)):
        run = np.append(np.zeros(1, np.uint64), np.cumsum(code[part] * forth, dtype=np.uint64))
        out.append(mix((run[place + length] - run[place]) * back).view(np.int64))
    return *out, offset


def spans(start: np.ndarray, stop: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of several owners, with those that touch or overlap made one."""
    if not len(start):
        return start, stop, owner
    order = np.lexsort((start, owner))
    start, stop, owner = start[order], stop[order], owner[order]
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + owner.astype(np.int64) * far)
    new = np.append(True, start[1:] + owner[1:].astype(np.int64) * far > reach[:-1])
    begin = np.flatnonzero(new)
    return start[begin], np.append(reach[begin[1:] - 1], reach[-1]) - owner[begin].astype(np.int64) * far, owner[begin]


def later_copies(strings: list[bytes], key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows of `length` bytes that also start earlier, strings being at `start` of the documents whose order
    is `key`. The suffix array of all strings gives the intervals of suffixes with that much in common."""
    shard = Shard(strings, length)
    position, common = shard.suffixes()
    begin = np.flatnonzero(common < length)
    size = np.diff(np.append(begin, len(position)))
    tied = np.repeat(size > 1, size)
    position = position[tied].astype(np.int64)
    size = size[size > 1]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string = np.searchsorted(shard.start, position, "right") - 1
    offset = position - shard.start[string]
    fits = position + length <= shard.stop[string]  # within its string
    where = key[string] << 32 | (start[string] + offset)
    group = np.repeat(np.arange(len(size)), size)
    string, offset, where, group = string[fits], offset[fits], where[fits], group[fits]
    low = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(low, group, where)
    later = where > low[group]
    return string[later], offset[later]


def removed_spans(documents: DataFrame, tables: Tables, length: int) -> DataFrame:
    """(d, h, spans): of each document (id d, text hash h) the intervals of bytes that are covered by a string of `length` bytes which
    also starts earlier. documents: (d, h, text), each once, no nulls.

    Windows meet where their anchors do: the pieces of text around anchors that occur more than once are sent to the shard of the
    anchor's hash, byte by byte only once from each task; further copies in a task are later copies at once, so that a hot passage
    costs a shard one piece a task. A shard sorts the suffixes of its distinct pieces.

    Windows of hot anchors, whose pieces would all be of one shard, are compared by two 64-bit hashes of their bytes, in the same pass over the texts: a task
    sends each such window once, to the place of its own hash, so that neither an anchor nor a passage that very many texts have gathers in a
    task. The driver holds the keys of hot anchors, of which there is at most one for each HOT pieces that are sent."""
    spark = documents.sparkSession
    volume = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, volume // 50_000_000)
    anchors = tables.put("anchors", repeated_anchors(documents, length, buckets))
    found = anchors.count()
    shards = max(4 * parts, found * 150 // SHARD_BYTES)
    hot = anchors.where("anchor < 0").select("d", "h").collect()
    hots = np.array([r.d for r in hot], np.int64)
    places = max(4 * parts, sum(r.h for r in hot) * (length - GRAM + 1) // WINDOWS)
    listed = anchors.where("anchor >= 0").groupBy("d", "h").agg(F.sort_array(F.collect_list("anchor")).alias("anchors")).hint("merge")
    names = ["bucket", "d", "h", "start", "stop", "size", "body"]
    schema = "bucket long, d binary, h binary, start binary, stop binary, size binary, body binary"

    def cut(batches):
        for batch in batches:
            ids, hashes, listed_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            seen: dict[bytes, int] = {}
            gone, kept, held = [], [], 0  # (row, start, stop) of later copies; (shard, row, start, size) of the first ones
            windows, many = [], 0  # (hash, hash, row, start) of those with a hot anchor
            for at in range(0, batch.num_rows, SLICE):
                body, off = utf8(batch.column(2).slice(at, SLICE))
                row, key, anchor, first, last, _ = pieces(body, off, length)
                here = known_pieces(row, anchor, listed_.slice(at, SLICE))
                is_hot = np.isin(key[here], hots)
                there, here = here[is_hot], here[~is_hot]
                if len(there):
                    n = last[there] - first[there] + 1
                    *codes, offset = window_hashes(body, off[row[there]] + first[there], n, length)
                    windows.append((*codes, np.repeat(row[there] + at, n), np.repeat(first[there], n) + offset))
                    many += len(offset)
                raw = body.tobytes()
                lo, hi = off[row[here]] + first[here], off[row[here]] + last[here] + length
                shard = bucket_of(key[here], shards)
                r = row[here] + at
                for s1, r1, a1, a, z in zip(shard.tolist(), r.tolist(), first[here].tolist(), lo.tolist(), hi.tolist(), strict=True):
                    piece = raw[a:z]
                    other = seen.setdefault(piece, len(kept))
                    if other == len(kept):
                        kept.append((s1, r1, a1, z - a))
                        held += z - a
                    else:  # the earlier one, by id, hash and start, stays
                        s, r0, a0, n = kept[other]
                        if (ids[r1], hashes[r1], a1) < (ids[r0], hashes[r0], a0):
                            kept[other] = (s, r1, a1, n)
                            r1, a1 = r0, a0
                        gone.append((r1, a1, a1 + n))
                if held > FLUSH_BYTES or many > FLUSH_WINDOWS:
                    yield from sent(ids, hashes, seen, kept, gone, windows)
                    seen, kept, gone, held, windows, many = {}, [], [], 0, [], 0
            yield from sent(ids, hashes, seen, kept, gone, windows)

    def sent(ids, hashes, seen, kept, gone, windows):
        g = np.array(gone, np.int64).reshape(-1, 3)
        if windows:
            a, b, row, start = map(np.concatenate, zip(*windows, strict=True))
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((hashes, ids))] = np.arange(len(ids))
            order = np.lexsort((rank[row] << 32 | start, b, a))
            a, b, row, start = a[order], b[order], row[order], start[order]
            first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            g = np.concatenate([g, np.stack([row, start, start + length], 1)[~first]])
            place = shards + bucket_of(a[first], places)
            order = np.argsort(place, kind="stable")
            a, b, row, start, place = a[first][order], b[first][order], row[first][order], start[first][order], place[order]
            edge = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)).tolist()
            for x in range(0, len(edge) - 1, 64):
                part = [slice(*e) for e in zip(edge[x : x + 64], edge[x + 1 : x + 65])]
                columns = (ids[row], hashes[row], start, a, b)
                yield pa.RecordBatch.from_arrays([pa.array([int(place[k.start]) for k in part]), *(pa.array([c[k].tobytes() for k in part], pa.binary()) for c in columns), pa.array([b""] * len(part), pa.binary())], names)
        if len(g):
            start, stop, row = spans(g[:, 1], g[:, 2], g[:, 0])
            for a in range(0, len(row), 20_000):
                k = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(hashes[row[a]] & 0xFFFF)]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[row[k]], hashes[row[k]], start[k], stop[k])), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names)
        if kept:
            k = np.array(kept, np.int64)
            body_of = list(seen)
            order = np.argsort(k[:, 0], kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(k[order, 0]) != 0))
            groups = np.split(order, edge[1:])
            for a in range(0, len(groups), 64):
                part = groups[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([int(k[g[0], 0]) for g in part]), *(pa.array([x.tobytes() for x in col], pa.binary()) for col in ([ids[k[g, 1]] for g in part], [hashes[k[g, 1]] for g in part], [k[g, 2] for g in part], [k[g, 2] + k[g, 3] for g in part], [k[g, 3] for g in part])), pa.array([b"".join([body_of[i] for i in g]) for g in part], pa.binary())], names)

    def sort(bucket: tuple, t: pa.Table) -> pa.Table:
        d, h, start, stop, size = (np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in names[1:6])
        if bucket[0].as_py() >= shards:  # windows by their hashes
            order = np.lexsort((start, h, d, size, stop))
            a, b = stop[order], size[order]
            later = order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
            d, h, start, stop = d[later], h[later], start[later], start[later] + length
        elif bucket[0].as_py() >= 0:
            body = b"".join(t["body"].to_pylist())
            ends = np.cumsum(size)
            order = np.lexsort((start, h, d))
            seen: dict[bytes, int] = {}
            again = []
            for k in order.tolist():
                piece = body[ends[k] - size[k] : ends[k]]
                if seen.setdefault(piece, k) != k:
                    again.append(k)
            rank = np.zeros(len(d), np.int64)
            rank[order] = np.cumsum(np.append(False, (np.diff(d[order]) != 0) | (np.diff(h[order]) != 0)))
            own = np.fromiter(seen.values(), np.int64, len(seen))
            string, offset = later_copies(list(seen), rank[own], start[own], length)
            k = own[string]
            a, z, o = spans(np.concatenate([start[k] + offset, start[again]]), np.concatenate([start[k] + offset + length, stop[again]]), np.concatenate([rank[k], rank[again]]).astype(np.int64))
            one = np.zeros(len(d), np.int64)
            one[rank] = np.arange(len(d))
            d, h, start, stop = d[one[o]], h[one[o]], a, z
        return pa.table({"d": d, "h": h, "start": start, "stop": stop})

    got = documents.join(listed, ["d", "h"]).select("d", "h", "text", "anchors").mapInArrow(cut, schema).groupBy("bucket").applyInArrow(sort, "d long, h long, start long, stop long")
    order = Window.partitionBy("d", "h").orderBy("start")  # intervals that touch are one before they are an array: single windows may be many
    new = (F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    runs = got.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("d", "h", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return tables.put("spans", runs.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")))


def with_spans(documents: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The documents with a column of spans, and its name, which none of theirs has."""
    tables = Tables(documents.sparkSession, "suffixes")
    source = documents.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where(F.col("d").isNotNull() & (F.octet_length("text") >= length))
    if source.groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        source = source.dropDuplicates(["d", "h"])
    names = fresh(documents.columns, "_d", "_h", "_spans")
    found = removed_spans(source, tables, length).select("d", "h", "spans").toDF(*names).hint("merge")
    tables.drop("anchors")
    joined = documents.join(found, (documents[id_col].cast("long") == found[names[0]]) & (F.xxhash64(documents[text_col]) == found[names[1]]), "left")
    return joined.drop(*names[:2]), names[2]


def cut_out(text: bytes, found: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes outside the spans, the number of those within, and the number of maximal spans."""
    if not found:
        return text, 0, 0
    s = np.array([(x["start"], x["stop"]) for x in found], np.int64)
    start, stop, _ = spans(s[:, 0], s[:, 1], np.zeros(len(s), np.int64))
    edges = [0, *np.column_stack([start, stop]).ravel().tolist(), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), int((stop - start).sum()), len(start)


def suffix_digest(documents: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row: each byte covered by a string of `length` bytes that also starts
    earlier (in a smaller id, or earlier in the same document) is removed; strings are judged on the input. Ids are integers.

    A null text counts as empty; a null id has nothing removed; rows with one id and the same text are one document, returned each
    time, and with different texts are ordered by the texts' hashes; other columns play no part."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(len(t), *cut_out(t, s)) for t, s in ((t or b"", s) for t, s in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    got, found = with_spans(documents.select(id_col, text_col), length, id_col, text_col)
    return got.select(id_col, text_col, found).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_bytes(documents: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those bytes, all other columns and rows as they are. Where a cut splits a character, the rest of that
    character goes too. A text without repeats stays as it is; a text that is all repeats becomes empty."""

    @F.pandas_udf("string")
    def cut(texts, found):
        import pandas as pd

        return pd.Series([t if s is None or t is None else cut_out(t.encode(), list(s))[0].decode("utf-8", "ignore") for t, s in zip(texts, found, strict=True)])

    got, found = with_spans(documents, length, id_col, text_col)
    return got.select(*[F.when(F.col(found).isNull(), F.col(c)).otherwise(cut(c, found)).alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns])
