"""Shared pieces: tables in the shared folder, Arrow helpers, hashing of words, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only where it is unset and all runs on one machine (tests) is one made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders of all tables made in this process.
FOLDERS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators have made in this process, also those that their lazy results still read: for callers who have
    written what they want to keep."""
    while FOLDERS:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(FOLDERS.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one operator run, written once and read again, so that a lost executor costs no
    recomputation. drop() removes the tables that the result no longer needs, clear() all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths, self.made, self.base = spark, {}, 0, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        FOLDERS.append(self.base)

    def put(self, key: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{key}-{self.made}"
        self.made += 1
        self.paths[key] = [*self.paths.get(key, []), path]
        schema = df.schema
        old = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # the shuffle files of a finished step are of no more use: its table is what is read
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, old)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *keys: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for key in keys:
            for path in self.paths.pop(key, []):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be none of the columns (upper and lower case count as one)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64 (fixed constants of that published generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so that it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: So many edges one task joins in memory (about 100 MB).
EDGES_A_TASK = 1_000_000


def joined(batches):
    """Edges (a, b) to edges (node, smallest node that these edges reach), for one task's edges."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = up = root[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["a", "b"])


def connected_components(tables: Tables, edges: DataFrame, name: str) -> DataFrame:
    """(node, component), component being the smallest node reachable. edges: (a, b), no nulls. Tasks of at most EDGES_A_TASK edges each
    first replace their edges by those of a forest; if there is more than one such task, large-star and small-star steps
    follow in turn (Kiveris et al., 2014): each replaces a node's edges by edges to its smallest neighbour, so no step
    emits pairs within a group, and the number of rounds grows with the logarithm of the graph's size. Between rounds the edges are a
    table in the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u0"), (F.least("u", "m") if large else F.col("m")).alias("m"))
        linked = both.join(least, both["u"] == least["u0"]).select("u", "v", "m")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u0").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    kind = edges.schema["a"].dataType.simpleString()
    edges = tables.put(f"{name}-edges", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    parts = -(-edges.count() // EDGES_A_TASK) or 1
    edges = tables.put(f"{name}-edges", edges.repartition(parts).mapInArrow(joined, f"a {kind}, b {kind}"))
    seen = None
    while parts > 1:
        after = tables.put(f"{name}-edges", star(star(edges, True), False))
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


_POWERS = powers(BASE, 1 << 16)
_INVERSE = powers(BASE_INVERSE, 1 << 16)


def hashed_words(body: np.ndarray, off: np.ndarray, space: np.ndarray, code: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, 64-bit hash and row of each word of the rows that `off` delimits in `body`. space: for each byte value whether it
    parts words; code: what each byte value counts as. The hash is a polynomial modulo 2**64 over the codes, from a running sum,
    then mixed with the length; the work is a few passes over the bytes and none over single words."""
    n = len(body)
    gap = space[body]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    inside = ~gap
    first = inside.copy()
    if n:
        first[1:] &= gap[:-1] | cut[1:n]
    last = inside.copy()
    if n:
        last[:-1] &= gap[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = np.empty(len(start), np.uint64)
    done, at, block = 0, 0, 1 << 15
    while done < len(start):
        low = int(start[done])
        stop = int(np.searchsorted(end, low + block, "right"))
        if stop == done:  # one word longer than a block
            low, total = int(start[done]), np.uint64(0)
            for a in range(low, int(end[done]), 1 << 15):
                part = body[a : min(a + (1 << 15), int(end[done]))]
                total = mix(np.array([total]))[0] + (code[part] * _POWERS[: len(part)]).sum(dtype=np.uint64)
            h[done] = total
            done += 1
            continue
        high = int(end[stop - 1])
        run = np.zeros(high - low + 1, np.uint64)
        np.cumsum(code[body[low:high]] * _POWERS[: high - low], out=run[1:])
        s, e = start[done:stop] - low, end[done:stop] - low
        h[done:stop] = (run[e] - run[s]) * _INVERSE[s]
        done = stop
    row = np.searchsorted(off, start, "right") - 1
    return start, end, mix(h + (end - start).astype(np.uint64)), row


class Known:
    """Values of 64-bit keys in a table that grows: open addressing over arrays, for whole arrays of keys at a time."""

    def __init__(self, bits: int = 18):
        self.bits, self.n = bits, 0
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those not there."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.value[slot]
        odd = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & mask
            out[odd] = self.value[slot[odd]]
            odd = odd[(self.key[slot[odd]] != keys[odd]) & (out[odd] >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct and not there yet"""
        while (self.n + len(keys)) * 2 > 1 << self.bits:
            old = self.value >= 0
            k, v = self.key[old], self.value[old]
            self.__init__(self.bits + 1)
            self.add(k, v)
        self.n += len(keys)
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.value[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[slot[won]], self.value[slot[won]] = keys[won], values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & mask
