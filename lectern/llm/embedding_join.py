"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, connected_components
from .vectors import classes, matrix, valid

#: Vectors in a leaf and, at most, in a group; principal directions of boxes, and of the order; rows that the directions are fitted on.
LEAF, GROUP, DIMS, ORDER, SAMPLE = 256, 65_536, 16, 8, 20_000


def group_size(n: int) -> int:
    """Vectors in a group, of n in all: it grows with the root of n, so that both the groups that a vector may be sent to and what a task holds grow
    slower than n, up to GROUP, which bounds the task."""
    return min(max(8 * LEAF, int(64 * math.sqrt(n)) // LEAF * LEAF), max(GROUP // LEAF, 1) * LEAF)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(reps: DataFrame, dims: int) -> np.ndarray:
    """The leading principal directions, from the SAMPLE rows with the smallest hashes. Any orthonormal directions give right
    results; these make intervals compact."""
    got = reps.select("v", F.xxhash64("h1", F.lit(9)).alias("o")).orderBy("o").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    u = unit(matrix(got.chunk(0) if isinstance(got, pa.ChunkedArray) else got))
    _, vectors = np.linalg.eigh(np.cov(u.T) if len(u) > 1 else np.eye(u.shape[1]))
    return np.ascontiguousarray(np.atleast_2d(vectors)[:, ::-1][:, :dims])


class Joiner:
    """Joins intervals of the sequence within one task, and keeps each vector's number of links and a forest of the links."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, weight: np.ndarray, basis: np.ndarray, cosine: float):
        self.ids, self.weight, self.cosine, self.far = ids, weight.astype(np.float64), cosine, 2 - 2 * cosine + 1e-9
        self.u = unit(v)
        self.f = self.u.astype(np.float32)
        self.x = self.u @ basis
        self.links = np.zeros(len(ids))
        self.root = np.arange(len(ids))

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return int(k)

    def apart(self, a: tuple, b: tuple) -> bool:
        x, y = self.x[slice(*a)], self.x[slice(*b)]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        return float(gap @ gap) > self.far

    def join(self, a: tuple, b: tuple) -> None:
        """a and b: the same interval, or disjoint ones"""
        n, m = a[1] - a[0], b[1] - b[0]
        if not n or not m or (a != b and self.apart(a, b)):
            return
        if n <= LEAF and m <= LEAF:
            self.leaf(a, b)
        elif a == b:
            half = (a[0], a[0] + n // 2), (a[0] + n // 2, a[1])
            self.join(half[0], half[0])
            self.join(half[1], half[1])
            self.join(*half)
        elif n >= m:
            self.join((a[0], a[0] + n // 2), b)
            self.join((a[0] + n // 2, a[1]), b)
        else:
            self.join(a, (b[0], b[0] + m // 2))
            self.join(a, (b[0] + m // 2, b[1]))

    def leaf(self, a: tuple, b: tuple) -> None:
        s = self.f[slice(*a)] @ self.f[slice(*b)].T
        hit = s >= self.cosine - 1e-5
        if a == b:
            hit = np.triu(hit, 1)
        if not hit.any():
            return
        i, j = np.nonzero(hit)
        exact = np.einsum("ij,ij->i", self.u[a[0] + i], self.u[b[0] + j]) >= self.cosine
        i, j = i[exact] + a[0], j[exact] + b[0]
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        # the smallest root that each vector reaches in this leaf, then one union a vector
        k = np.unique(np.concatenate([i, j]))
        own = np.array([self.find(x) for x in k])
        low = own.copy()
        pi, pj = np.searchsorted(k, i), np.searchsorted(k, j)
        while True:
            new = low.copy()
            np.minimum.at(new, pi, low[pj])
            np.minimum.at(new, pj, new[pi])
            if (new == low).all():
                break
            low = new
        for r, t in zip(own.tolist(), low.tolist(), strict=True):
            r, t = self.find(r), self.find(t)
            if r != t:
                self.root[max(r, t)] = min(r, t)

    def result(self) -> pa.Table:
        k = np.flatnonzero(self.links)
        e = np.flatnonzero(self.root != np.arange(len(self.root)))
        return pa.table({"kind": np.concatenate([np.zeros(len(k), np.int64), np.ones(len(e), np.int64)]), "a": np.concatenate([self.ids[k], self.ids[e]]), "b": np.concatenate([self.links[k].astype(np.int64), self.ids[self.root[e]]])})


def near_vectors(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row. Ids are integers. Vectors with a cosine of `cosine` at least are linked; the join is exact.

    Equal vectors are one vector with a weight. Unit vectors are sorted in epsilon grid order: by the cells, as wide as the
    largest distance of a link, of their coordinates on ORDER leading principal directions, and cut into leaves of LEAF and groups of group_size(n) in
    sequence, each with its box on DIMS directions. Pairs of groups meet by an equi-join on cells of the first direction and are kept if their boxes may hold a
    link; to a kept pair go those leaves of either group whose box may hold a link with the other's box, and no others. A task
    joins the intervals of a pair recursively, leaving out those whose boxes are too far apart. It returns, for each vector, the weight of
    its links, and a forest of the links, so nothing grows with the pairs.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing, and are their own
    component; a null id has no links and no component, and is kept. A repeated row (id and vector) counts once and is returned each time; rows
    with one id and different vectors are one node."""
    tables = Tables(df.sparkSession, "vectors")
    members, reps = classes(valid(df, id_col, vec_col))
    reps = tables.put("reps", reps)
    n = reps.count()
    out = F.col(id_col)
    if not n:
        return df.select(id_col, F.lit(0).cast("long").alias("n_links"), out.alias("component_id"), F.lit(True).alias("kept"))
    basis = principal(reps, DIMS)
    width, far = math.sqrt(2 - 2 * cosine), 2 - 2 * cosine + 1e-9
    dims, size = basis.shape[1], group_size(n)
    cells = [f"c{k}" for k in range(min(ORDER, dims))]
    element = reps.schema["v"].dataType.simpleString()

    def place(batches):
        for b in batches:
            c = np.floor(unit(matrix(b.column(2))) @ basis[:, : len(cells)] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c[:, k]) for k in range(len(cells)))], ["rep", "n", "v", *cells])

    placed = reps.select("rep", "n", "v").mapInArrow(place, f"rep long, n long, v {element}, " + ", ".join(f"{c} int" for c in cells))
    ordered = placed.repartitionByRange(-(-n // size), *cells, "rep").sortWithinPartitions(*cells, "rep")
    ordered = tables.put("ordered", ordered.withColumn("m", F.monotonically_increasing_id()).select("rep", "n", "v", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at")))
    # places in the whole sequence, from the numbers of rows in the partitions before, which are one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))

    def leaf(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        v = matrix(t["v"].combine_chunks())
        x = unit(v) @ basis
        return pa.table({"leaf": [key[0].as_py()], "ids": [t["rep"].to_numpy().tobytes()], "w": [t["n"].to_numpy().tobytes()], "v": [np.ascontiguousarray(v, np.float64 if v.dtype == np.float64 else np.float32).tobytes()], "lo": [x.min(0).tolist()], "hi": [x.max(0).tolist()]})

    numbered = ordered.join(F.broadcast(starts), "part").select("rep", "n", "v", (F.col("at") + F.col("first")).alias("at")).withColumn("leaf", F.expr(f"at div {LEAF}"))
    leaves = tables.put("leaves", numbered.groupBy("leaf").applyInArrow(leaf, "leaf long, ids binary, w binary, v binary, lo array<double>, hi array<double>"))
    boxes = leaves.select("leaf", F.expr(f"leaf div {size // LEAF}").alias("grp"), "lo", "hi")
    lows, highs = (F.array(*[f(F.col(c)[k]) for k in range(dims)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi")))
    groups = tables.put("groups", boxes.groupBy("grp").agg(lows, highs))

    def cell(c: str, more: int = 0):
        return (F.floor(F.element_at(c, 1) / F.lit(width)) + more).cast("long")

    def near(a: str, b: str):
        """Whether two boxes, columns <a>lo, <a>hi and <b>lo, <b>hi, may hold a link."""
        sides = F.zip_with(F.arrays_zip(F.col(f"{a}lo").alias("lo"), F.col(f"{a}hi").alias("hi")), F.arrays_zip(F.col(f"{b}lo").alias("lo"), F.col(f"{b}hi").alias("hi")), lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)))
        return F.aggregate(sides, F.lit(0.0), lambda s, d: s + d * d) <= far

    one = groups.select(F.col("grp").alias("g"), F.col("lo").alias("glo"), F.col("hi").alias("ghi"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("c"))
    two = groups.select(F.col("grp").alias("h"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"), F.explode(F.sequence(cell("lo", -1), cell("hi", 1))).alias("c"))
    tiles = one.join(two, "c").where("g <= h").where(near("g", "h")).select("g", "h", "glo", "ghi", "hlo", "hhi").dropDuplicates(["g", "h"])
    # of each side the leaves that are near the other's box
    sides = tiles.select("g", "h", F.col("g").alias("grp"), F.col("hlo").alias("olo"), F.col("hhi").alias("ohi")).unionByName(tiles.where("g < h").select("g", "h", F.col("h").alias("grp"), F.col("glo").alias("olo"), F.col("ghi").alias("ohi")))
    need = sides.join(boxes.select("grp", "leaf", F.col("lo").alias("blo"), F.col("hi").alias("bhi")), "grp").where((F.col("g") == F.col("h")) | near("b", "o")).select("g", "h", "grp", "leaf")
    kind = np.float64 if "double" in element else np.float32

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("leaf")
        ids, w = (np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in ("ids", "w"))
        v = np.frombuffer(b"".join(t["v"].to_pylist()), kind).reshape(len(ids), -1)
        j = Joiner(ids, v, w, basis, cosine)
        if key[0].as_py() == key[1].as_py():
            j.join((0, len(ids)), (0, len(ids)))
        else:
            cut = sum(len(x) // 8 for x, g in zip(t["ids"].to_pylist(), t["grp"].to_pylist(), strict=True) if g == key[0].as_py())
            j.join((0, cut), (cut, len(ids)))
        return j.result()

    sent = need.join(leaves.select("leaf", "ids", "w", "v"), "leaf")
    found = tables.put("found", sent.groupBy("g", "h").applyInArrow(tile, "kind long, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comps = connected_components(tables, found.where("kind = 1").select("a", "b"), "vectors").withColumnRenamed("node", "rep")
    named = tables.put("named", reps.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(comps, "rep", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_component")))
    rows = df.select(id_col, F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(7), vec_col).alias("h2"))
    component = F.when(out.isNull(), F.lit(None)).otherwise(F.coalesce("_component", out))
    got = rows.join(named, ["h1", "h2"], "left").select(id_col, F.when(out.isNull(), F.lit(0)).otherwise(F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"))
    tables.drop("reps", "ordered", "leaves", "groups", "found", "vectors-edges")
    return got.withColumn("kept", F.coalesce(out == F.col("component_id"), F.lit(True)))
