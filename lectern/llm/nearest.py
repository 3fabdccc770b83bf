"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, mix
from .vectors import classes, matrix, valid

#: Vectors, and queries, that are compared at a time, and vectors of one table in a part of it.
BLOCK, ASKED, PART = 2048, 512, 16_384
#: So many queries the parameters are fitted on, and probes are at most.
SAMPLE, MOST_PROBES = 48, 4096
#: At most so many projections of a probe are moved.
MOVED = 4


class Hashes:
    """`tables` tables of `projections` hashes floor((a . x + b) / width), a standard normal (2-stable), b uniform."""

    def __init__(self, dims: int, width: float, tables: int, projections: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dims, projections)) / width
        self.b = rng.uniform(0, 1, (tables, projections))
        self.steps = np.array([s for s in self.moves(projections) if np.count_nonzero(s) <= MOVED])

    @staticmethod
    def moves(projections: int):
        for k in range(min(MOVED, projections) + 1):
            for where in itertools.combinations(range(projections), k):
                for way in itertools.product((-1, 1), repeat=k):
                    step = np.zeros(projections, np.int64)
                    step[list(where)] = way
                    yield step

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        h = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            h = mix(h + cells[..., k].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        return h.view(np.int64)

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.key(np.floor(x @ self.a[t] + self.b[t]))

    def probes(self, x: np.ndarray, t: int, n: int) -> np.ndarray:
        """For each query the `n` buckets in which a near vector is likeliest, likeliest first: own cells moved by -1, 0 or 1 in each
        projection, in MOVED of them at most, by the sum of the squared distances to the walls that are passed."""
        y = x @ self.a[t] + self.b[t]
        low = y - np.floor(y)
        passed = (low * low) @ (self.steps < 0).T + ((1 - low) ** 2) @ (self.steps > 0).T
        best = np.argsort(passed, 1, kind="stable")[:, :n]
        return self.key(np.floor(y)[:, None] + self.steps[best])


def fitted(asked: np.ndarray, near: list[np.ndarray], n: int, tables: int, recall: float) -> tuple[Hashes, int]:
    """The hashes for n vectors, and the number of probes with which they find `recall` of the true nearest vectors `near` of the queries `asked`. A cell is
    about twice as wide as those are far; the number of projections grows with log n."""
    far = [np.sqrt(((v - q) ** 2).sum(1)) for q, v in zip(asked, near, strict=True)]
    far = np.concatenate(far) if far else np.zeros(0)
    width = 2.2 * float(np.median(far[far > 0])) if (far > 0).any() else 1.0
    hashes = Hashes(asked.shape[1], width, tables, max(4, min(10, round(math.log2(max(n, 2)) * 0.6) - 1)))
    first = []  # with how many probes each true neighbour is found
    for q, v in zip(asked, near, strict=True):
        best = np.full(len(v), 1 << 30)
        for t in range(tables):
            keys = hashes.probes(q[None], t, MOST_PROBES)[0]
            hit = hashes.buckets(v, t)[:, None] == keys
            best = np.minimum(best, np.where(hit.any(1), hit.argmax(1) + 1, 1 << 30))
        first.append(best)
    first = np.sort(np.concatenate(first)) if first else np.ones(1, np.int64)
    return hashes, int(min(first[math.ceil(recall * len(first)) - 1], MOST_PROBES))


def runs(*keys: np.ndarray, most: int) -> np.ndarray:
    """Where runs of equal keys begin, or runs of `most` rows end, and the end."""
    n = len(keys[0])
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    begin = np.flatnonzero(new)
    at = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return np.append(np.flatnonzero(new | (at % most == 0)), n)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, from differences, of rows that belong to each other."""
    out = np.empty(len(q))
    for k in range(0, len(q), 4096):
        d = q[k : k + 4096] - x[k : k + 4096]
        out[k : k + 4096] = np.sqrt(np.einsum("xd,xd->x", d, d))
    return out


def nearest_of(q: np.ndarray, x: np.ndarray, k: int, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance): of each q the k nearest x, and those as near as the k-th, of the pairs that `may` be. Squares by a matrix product leave out
    what is farther for certain; the others' distances are exact."""
    with np.errstate(over="ignore"):
        qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None]
    if not np.isfinite(4 * (qq.max(initial=0) + xx.max(initial=0))):  # too large to square
        r, c = np.nonzero(np.ones((len(q), len(x)), bool) if may is None else may)
        return r, c, distances(q[r], x[c])
    d = qq + xx - 2 * (q @ x.T)
    if may is not None:
        d = np.where(may, d, np.inf)
    error = 1e-12 * q.shape[1] * (qq + xx)
    edge = np.partition(d + error, k - 1, axis=1)[:, k - 1 : k] if x.shape[0] > k else np.inf
    r, c = np.nonzero((d - error <= edge) & np.isfinite(d))
    return r, c, distances(q[r], x[c])


def smallest(q: np.ndarray, x: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Rows that are each query's `most` nearest different vectors."""
    order = np.lexsort((x, d, q))
    q1, x1 = q[order], x[order]
    if not len(q1):
        return order
    order = order[np.append(True, (q1[1:] != q1[:-1]) | (x1[1:] != x1[:-1]))]
    q1 = q[order]
    begin = np.flatnonzero(np.append(True, q1[1:] != q1[:-1]))
    place = np.arange(len(q1)) - np.repeat(begin, np.diff(np.append(begin, len(q1))))
    return order[place < most]


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, tables: int = 6, recall: float = 0.94, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance, ties to the smaller id. queries: rows of df.

    Equal vectors are indexed once, with their k + 1 smallest ids. Every class is in one bucket of each of `tables` tables; a query
    visits buckets of each in the order of estimated success. Cell width and number of projections follow from the number of vectors and from how far
    the nearest are; the number of probes is the least with which `recall` of the true nearest of SAMPLE queries (the bounded sample, compared with
    all rows in one pass) are found. A table is dealt by bucket into parts of about PART vectors, in rows of at most BLOCK; a query goes once, with all its
    probes there, to each part that it visits. So a large bucket is spread over tasks, and no bucket is capped. Distances are exact and only
    a query's nearest leave a task. A query that found fewer than there are is compared with all vectors.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null ids. Repeated rows
    count once; of rows with one id and different vectors each may be found, and the own id never is. Ids are integers."""
    spark = df.sparkSession
    store = Tables(spark, "nearest")
    members, reps = classes(valid(df, id_col, vec_col))
    members = store.put("members", members)
    reps = store.put("reps", members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    asked = store.put("asked", members.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").select("id", "v"))
    element = reps.schema["v"].dataType.simpleString()
    kind = np.float64 if "double" in element else np.float32
    some = asked.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(SAMPLE).select("v").toArrow().column(0)
    sample = matrix(pa.concat_arrays(some.chunks) if some.num_chunks else pa.array([], pa.list_(pa.float64()))).astype(np.float64)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = sample.shape[1], reps.count()

    def sampled(batches):
        for b in batches:
            v = matrix(b.column(1))
            for a in range(0, len(v), BLOCK):
                r, c, d = nearest_of(sample, v[a : a + BLOCK].astype(np.float64), k + 1)
                c = c + a
                keep = smallest(r, c, d, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(r[keep].astype(np.int64)), b.column(0).take(pa.array(c[keep])), pa.array(d[keep]), b.column(1).take(pa.array(c[keep]))], ["q", "rep", "d", "v"])

    true = reps.select("rep", "v").mapInArrow(sampled, f"q long, rep long, d double, v {element}")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "rep"))).where(f"r <= {k + 1} and d > 0").select("q", "v").toArrow()
    of, near = true["q"].to_numpy(), matrix(pa.concat_arrays(true["v"].chunks) if true["v"].num_chunks else pa.array([], true["v"].type)).astype(np.float64)
    hashes, probes = fitted(sample, [near[of == j] if len(near) else np.zeros((0, dims)) for j in range(len(sample))], total, tables, recall)
    parts = np.int64(max(1, -(-total // PART)))

    def part_of(bucket: np.ndarray) -> np.ndarray:
        return ((bucket.view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)

    def index(batches):
        for b in batches:
            v = matrix(b.column(1)).astype(np.float64)
            for t in range(tables):
                bucket = hashes.buckets(v, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(part_of(bucket)), pa.array(bucket), *b.columns], ["t", "part", "bucket", "id", "v"])

    def probe(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                few = b.slice(a, 64)
                v = matrix(few.column(1)).astype(np.float64)
                for t in range(tables):
                    keys = hashes.probes(v, t, probes)
                    row = np.repeat(np.arange(len(v)), keys.shape[1])
                    keys = keys.ravel()
                    part = part_of(keys)
                    order = np.lexsort((keys, part, row))
                    cut = runs(row[order], part[order], most=1 << 40)
                    at = order[cut[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(part[at]), pa.array([keys[order[x:z]].tobytes() for x, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), few.column(0).take(pa.array(row[at])), few.column(1).take(pa.array(row[at]))], ["t", "part", "keys", "id", "v"])

    def data_blocks(batches):
        for b in batches:
            if b.num_rows:
                t, part, bucket, ids = (b.column(j).to_numpy() for j in range(4))
                v = matrix(b.column(4))
                cut = runs(t, part, most=BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(t[cut[:-1]]), pa.array(part[cut[:-1]]), *(pa.array([x[p:z].tobytes() for p, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (bucket, ids, v))], ["t", "part", "bucket", "xi", "x"])

    def ask_blocks(batches):
        for b in batches:
            if b.num_rows:
                t, part, ids = (b.column(j).to_numpy() for j in (0, 1, 3))
                keys = b.column(2).to_pylist()
                v = matrix(b.column(4))
                cut = runs(t, part, most=ASKED)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t[cut[:-1]]), pa.array(part[cut[:-1]]), pa.array([b"".join(keys[p:z]) for p, z in spans], pa.binary()), pa.array([np.array([len(x) // 8 for x in keys[p:z]], np.int64).tobytes() for p, z in spans], pa.binary()), *(pa.array([x[p:z].tobytes() for p, z in spans], pa.binary()) for x in (ids, v))], ["qt", "qp", "keys", "many", "qi", "qv"])

    def compare(batches):
        """Blocks of queries against blocks of vectors; without keys and buckets, all pairs."""
        for b in batches:
            qs, xs, ds = [], [], []
            for a in range(b.num_rows):
                keys, many, qi, q, bucket, xi, x = (b.column(c)[a].as_py() for c in range(7))
                qi, xi = np.frombuffer(qi, np.int64), np.frombuffer(xi, np.int64)
                q, x = np.frombuffer(q, kind).reshape(len(qi), dims).astype(np.float64), np.frombuffer(x, kind).reshape(len(xi), dims).astype(np.float64)
                may = None
                if keys is not None:  # the buckets of a block are in order, so a probe is a range of it
                    keys, many, bucket = (np.frombuffer(y, np.int64) for y in (keys, many, bucket))
                    low, high = np.searchsorted(bucket, keys, "left"), np.searchsorted(bucket, keys, "right")
                    row = np.repeat(np.arange(len(qi)), many)
                    edge = np.zeros((len(qi), len(xi) + 1), np.int32)
                    np.add.at(edge, (row, low), 1)
                    np.add.at(edge, (row, high), -1)
                    may = np.cumsum(edge, 1)[:, :-1] > 0
                    mine = np.flatnonzero(may.any(1))
                    if not len(mine):
                        continue
                    qi, q, may = qi[mine], q[mine], may[mine]
                r, c, d = nearest_of(q, x, k + 1, may)
                qs.append(qi[r])
                xs.append(xi[c])
                ds.append(d)
            if qs:
                q, x, d = np.concatenate(qs), np.concatenate(xs), np.concatenate(ds)
                keep = smallest(q, x, d, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(x[keep]), pa.array(d[keep])], ["q", "rep", "d"])

    def sorted_blocks(rows: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
        few = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(few, *by).sortWithinPartitions(*by).mapInArrow(fn, schema)

    shape, take = "q long, rep long, d double", ["keys", "many", "qi", "qv", "bucket", "xi", "x"]
    entries = reps.select(F.col("rep").alias("id"), "v").mapInArrow(index, f"t int, part int, bucket long, id long, v {element}")
    data = store.put("data", sorted_blocks(entries, ["t", "part", "bucket", "id"], data_blocks, "t int, part int, bucket binary, xi binary, x binary"))
    visits = asked.mapInArrow(probe, f"t int, part int, keys binary, id long, v {element}")
    ask = store.put("ask", sorted_blocks(visits, ["t", "part", "id"], ask_blocks, "qt int, qp int, keys binary, many binary, qi binary, qv binary"))
    found = ask.join(data, (ask["qt"] == data["t"]) & (ask["qp"] == data["part"])).select(*take).mapInArrow(compare, shape)
    order = Window.partitionBy("q").orderBy("d", "rep")
    found = store.put("found", found.distinct().withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}").drop("r"))
    fewer = asked.join(found.groupBy(F.col("q").alias("id")).agg(F.count("*").alias("m")), "id", "left").where(F.coalesce("m", F.lit(0)) < min(k + 1, total)).select("id", "v")
    fewer = store.put("fewer", fewer)
    if fewer.limit(1).count():  # whole comparison, by blocks of both sides that meet on a number
        slots = int(parts)
        slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")
        none = F.lit(None).cast("binary")
        zero = [F.lit(0).alias("t"), F.lit(0).alias("part")]
        those = sorted_blocks(fewer.select(*zero, F.lit(b"").alias("keys"), "id", "v"), ["id"], ask_blocks, "qt int, qp int, keys binary, many binary, qi binary, qv binary").select("qi", "qv", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        all_ = sorted_blocks(reps.select(F.col("rep").alias("id"), "v").select(F.lit(0).alias("t"), slot.alias("part"), F.lit(0).cast("long").alias("bucket"), "id", "v"), ["part", "id"], data_blocks, "t int, part int, bucket binary, xi binary, x binary")
        whole = those.join(all_, those["slot"] == all_["part"]).select(none.alias("keys"), none.alias("many"), "qi", "qv", "bucket", "xi", "x").mapInArrow(compare, shape)
        found = found.unionByName(whole).distinct()
    first = Window.partitionBy("h1", "h2").orderBy("id")
    named = members.select("h1", "h2", "id").withColumn("r", F.row_number().over(first)).where(f"r <= {k + 1}").drop("r")
    named = named.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id")
    rank = Window.partitionBy("q").orderBy("d", "id")
    out = found.join(named, "rep").where("id <> q").groupBy("q", "id").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(rank)).where(f"rank <= {k}")
    out = store.put("out", out.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score")))
    store.drop("members", "reps", "asked", "data", "ask", "found", "fewer")
    return out
