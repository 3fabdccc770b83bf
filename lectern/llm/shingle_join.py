"""N-gram Jaccard join by token-combination prefixes, and its groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODE, Tables, connected_components, hashed_words, joined, mix, utf8

SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
CODE = BYTE_CODE.copy()
CODE[65:91] = BYTE_CODE[97:123]  # A-Z count as a-z
WORD = np.uint64(0x9E3779B97F4A7C15)
SLICE, PACK = 2048, 64

#: A token that this many sets have, or more, is of the frequent class.
FREQUENT = 12
#: Combinations with at most this many sets give all their pairs at once.
SMALL = 8
#: Groups of at most SOLVED sets are compared within one task; larger ones by blocks of about BLOCK sets; either with about TOKENS tokens at most.
SOLVED, BLOCK, TOKENS = 2048, 1024, 4_000_000
#: A hot key's rows are dealt to so many tasks.
SALTS = 16
#: Tokens that a worker holds at a time.
HELD = 250_000


def sets(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle sets (58-bit hashes) of a column's texts in one array, and their offsets."""
    out, sizes = [], []
    for at in range(0, len(column), SLICE):
        body, off = utf8(column.slice(at, SLICE))
        _, _, h, row = hashed_words(body, off, SPACE, CODE)
        rows = len(off) - 1
        m = max(len(h) - words + 1, 0)
        g = h[:m].copy()
        for k in range(1, words):
            g = mix(g + h[k : k + m] * WORD)
        ok = row[:m] == row[words - 1 :] if m else np.zeros(0, bool)
        g, doc = g[ok], row[:m][ok]
        many = np.bincount(row, minlength=rows)
        short = np.flatnonzero((many > 0) & (many < words))
        if len(short):  # too few words: the whole sequence is one shingle
            first = np.searchsorted(row, short)
            s = many[short].astype(np.uint64) * WORD
            for k in range(words - 1):
                has = many[short] > k
                s[has] = mix(s[has] + h[first[has] + k])
            g, doc = np.concatenate([g, s]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            g, doc = g[order], doc[order]
        size = np.zeros(rows, np.int64)
        bound = np.searchsorted(doc, np.arange(0, rows + PACK, PACK))
        for k, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
            key = (doc[a:b] - k * PACK).astype(np.uint64) << np.uint64(58) | g[a:b] >> np.uint64(6)
            key.sort()
            if len(key):
                key = key[np.append(True, key[1:] != key[:-1])]
            mine = np.bincount((key >> np.uint64(58)).astype(np.int64), minlength=PACK)
            size[k * PACK : (k + 1) * PACK] = mine[: rows - k * PACK]
            out.append(key & np.uint64((1 << 58) - 1))
        sizes.append(size)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)


def slices(batches):
    """The batches in parts of SLICE rows, which bounds what a worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return run[off[1:]] - run[off[:-1]]


def prints(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    return sums(mix(flat), off).view(np.int64), sums(mix(flat ^ WORD), off).view(np.int64)


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """What a set of n shares at least with any set that is similar enough: union >= n, so overlap >= num / den of n."""
    return -(-n * num // den)


def extension(n: np.ndarray) -> np.ndarray:
    """By how many tokens a set's prefix is extended."""
    return np.maximum(16, n // 16)


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Similar sets are of the same or of neighbouring classes: within a class sizes differ by a factor of den / num."""
    return np.floor(np.log(n) / np.log(den / num) + 1e-9).astype(np.int64)


def parts_of(k: np.ndarray, num: int, den: int) -> np.ndarray:
    """Into how many parts the frequent tokens of the sets that meet in class k are split. Two similar sets, both of classes k - 1 or k and so
    of n tokens at least, share more than min(extension, least overlap - 1) tokens of their extended prefixes. If all of these
    are frequent, one of that many parts holds two of them."""
    n = np.maximum(np.ceil((den / num) ** (k - 1.0) - 1e-6), 1).astype(np.int64)
    return np.maximum(np.minimum(extension(n), least_overlap(n, num, den) - 1), 1)


def combinations(node: np.ndarray, n: np.ndarray, token: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of two-token combinations, with their nodes and sizes, from rows of frequent prefix tokens sorted by (node, token)."""
    keys, nodes, sizes = [], [], []
    base = size_class(n, num, den)
    for step in (0, 1):
        k = base + step
        parts = parts_of(k, num, den)
        part = (mix(token.view(np.uint64)) >> np.uint64(16)).astype(np.int64) % parts
        _, start, many = np.unique(node, return_index=True, return_counts=True)
        enough = np.repeat(many, many) > parts
        order = np.lexsort((token, part, node))
        o = order[enough[order]]
        a_node, a_part, a_token = node[o], part[o], token[o].view(np.uint64)
        tag = mix((k[o] << 40 | a_part).view(np.uint64))
        gap = 1
        while gap < len(o):  # pairs of rows `gap` apart in one (node, part)
            same = np.flatnonzero((a_node[gap:] == a_node[:-gap]) & (a_part[gap:] == a_part[:-gap]))
            if not len(same):
                break
            keys.append(mix(mix(a_token[same] + tag[same]) + a_token[same + gap] * WORD).view(np.int64))
            nodes.append(a_node[same])
            sizes.append(n[o][same])
            gap += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)) if keys else (empty, empty, empty)


def fingerprints(documents: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(d, n, a, b): size and fingerprints of each row's set."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            flat, off = sets(batch.column(1), words)
            a, b = prints(flat, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(a), pa.array(b)], ["d", "n", "a", "b"])

    return documents.select(id_col, text_col).mapInArrow(run, f"d {kind}, n long, a long, b long")


def postings(documents: DataFrame, words: int, num: int, den: int, buckets: int, text_col: str) -> DataFrame:
    """(node, n, token, frequent): the tokens of the extended prefixes that more than one set has.

    The order of tokens is that of their hashes, so that a prefix is known without counting. A task sends the tokens of many sets to a
    bucket as one row; a bucket counts its tokens. A token which a task itself finds in FREQUENT sets or more is frequent for sure: its
    rows go straight on, and only its count goes to the bucket, so that no bucket gets all rows of a hot token."""

    def send(batches):
        for batch in slices(batches):
            flat, off = sets(batch.column(0), words)
            n = np.diff(off)
            a, _ = prints(flat, off)
            _, first = np.unique(a, return_index=True)
            mine = np.zeros(len(n), bool)
            mine[first] = True  # of equal sets in a batch, one
            mine &= n > 0
            length = np.where(mine, np.minimum(n, n - least_overlap(n, num, den) + 1 + extension(n)), 0)
            at = np.repeat(off[:-1], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            token, node, size = flat[at], np.repeat(a, length), np.repeat(n, length).astype(np.int32)
            order = np.argsort(token, kind="stable")
            token, node, size = token[order], node[order], size[order]
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            count = np.diff(np.append(begin, len(token)))
            hot = np.repeat(count >= FREQUENT, count)
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(int(hot.sum()), dtype=np.int64) % (8 * buckets) - 8 * buckets), pa.array([token[k : k + 1].tobytes() for k in np.flatnonzero(hot)], pa.binary()), pa.array([node[k : k + 1].tobytes() for k in np.flatnonzero(hot)], pa.binary()), pa.array([size[k : k + 1].tobytes() for k in np.flatnonzero(hot)], pa.binary())], ["bucket", "token", "node", "n"])
                only = begin[count >= FREQUENT]
                keep = ~hot
                keep[only] = True
                size = size.copy()
                node = node.copy()
                size[only] = -np.minimum(count[count >= FREQUENT], 1 << 30)  # a count, not a set
                token, node, size = token[keep], node[keep], size[keep]
            bucket = (token >> np.uint64(26)).astype(np.int64) * buckets >> 32  # tokens are sorted, so buckets are ranges
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()) for x in (token, node, size))], ["bucket", "token", "node", "n"])

    def receive(key: tuple, t: pa.Table) -> pa.Table:
        token, node, size = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("token", np.uint64), ("node", np.int64), ("n", np.int32)))
        if key[0].as_py() < 0:
            frequent = np.ones(len(token), bool)
        else:
            order = np.lexsort((node, token))
            token, node, size = token[order], node[order], size[order]
            new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]) | (size[1:] < 0) | (size[:-1] < 0))
            token, node, size = token[new], node[new], size[new]
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            df = np.add.reduceat(np.where(size < 0, -size.astype(np.int64), 1), begin)
            many = np.diff(np.append(begin, len(token)))
            df = np.repeat(df, many)
            keep = (df > 1) & (size > 0)
            token, node, size, frequent = token[keep], node[keep], size[keep], df[keep] >= FREQUENT
        return pa.table({"node": node, "n": size.astype(np.int64), "token": token.view(np.int64), "frequent": frequent})

    return documents.select(text_col).mapInArrow(send, "bucket long, token binary, node binary, n binary").groupBy("bucket").applyInArrow(receive, "node long, n long, token long, frequent boolean")


def set_table(documents: DataFrame, tables: Tables, classes: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the sets of the nodes (a column a), made anew from one text each."""

    def make(batches):
        for batch in slices(batches):
            flat, off = sets(batch.column(0), words)
            a, _ = prints(flat, off)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([flat[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["node", "s"])

    wanted = classes.join(nodes, "a", "left_semi").select(F.col("first").alias("_first")).distinct().hint("merge")
    texts = documents.join(wanted, documents[id_col] == wanted["_first"], "left_semi").select(text_col)
    return tables.put("sets", texts.mapInArrow(make, "node long, s binary"))


def verified(tables: Tables, made: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets are similar enough, each counted exactly."""

    def count(batches):
        for batch in batches:
            ok = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                k = np.searchsorted(y, x)
                both = int((y[np.minimum(k, len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.hint("merge").join(made.toDF("u", "s"), "u").join(made.toDF("v", "t").hint("merge"), "v").select("u", "v", "s", "t")
    return tables.put("found", both.mapInArrow(count, "u long, v long"))


def couples(keyed: DataFrame, key: str, most: int) -> DataFrame:
    """(u, un, v, vn): all pairs of the nodes of each key that are of different components c; a key has `most` nodes at most."""
    few = keyed.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("node", "n", "c"))).alias("s"))
    pair = F.flatten(
        F.transform("s", lambda u, i: F.transform(F.filter(F.slice("s", i + 2, most), lambda v: v["c"] != u["c"]), lambda v: F.struct(u["node"].alias("u"), u["n"].alias("un"), v["node"].alias("v"), v["n"].alias("vn"))))
    )
    return few.select(F.explode(pair).alias("p")).select("p.*")


def solved(tables: Tables, made: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links among the nodes of each group, a forest of them from each task; members: (g, node, n, c), c being the component that other links have
    joined a node to.

    A group is one block, or, if it is large, blocks by hashes: those of a component that has BLOCK nodes of the group or more are blocks of their own. Each
    pair of blocks is one task, which counts what sets share, by stretches of tokens, with matrix products; two blocks of one
    component are left out, as all links between them are known. So a set goes to a task once for each block of its group, no
    task holds more than two blocks, and no pair leaves a task but those of the forest."""
    per = members.groupBy("g", "c").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    pool = F.when(F.col("m") >= BLOCK, F.col("c").cast("string")).otherwise("rest")
    whole = Window.partitionBy("g")
    per = per.withColumn("small", (F.sum("m").over(whole) <= SOLVED) & (F.sum("tokens").over(whole) <= TOKENS))
    per = tables.put("pools", per.select("g", "c", "m", "tokens", F.when(F.col("small"), F.lit("all")).otherwise(pool).alias("pool")))
    parts = F.when(F.col("pool") == "all", F.lit(1)).otherwise(F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("tokens") / TOKENS))).cast("int")
    pools = per.groupBy("g", "pool").agg(parts.alias("parts"))
    blocks = pools.select("g", "pool", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("g", "pool", F.concat_ws("|", "pool", "k").alias("block"))
    other = blocks.toDF("g", "pool2", "y")
    tiles = blocks.withColumnRenamed("block", "x").join(other, "g").where((F.col("x") <= F.col("y")) & ((F.col("pool") != F.col("pool2")) | F.col("pool").isin("rest", "all")))
    need = tiles.select("g", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    placed = members.join(per.select("g", "c", "pool"), ["g", "c"]).join(pools, ["g", "pool"])
    placed = placed.select("g", "node", F.concat_ws("|", "pool", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        node, first = t["node"].to_numpy(), np.array([b == key[1].as_py() for b in t["block"].to_pylist()])
        one = key[1].as_py() == key[2].as_py()
        sets_ = [np.frombuffer(x, np.uint64) for x in t["s"].to_pylist()]
        n = np.array([len(x) for x in sets_], np.int64)
        token, row = np.concatenate(sets_), np.repeat(np.arange(len(n)), n)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        column = np.cumsum(np.append(False, token[1:] != token[:-1]))
        keep = np.bincount(column)[column] > 1
        row, column = row[keep], column[keep]
        column = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else column
        left, right = np.flatnonzero(first), np.flatnonzero(first if one else ~first)
        both = np.zeros((len(left), len(right)), np.float64)
        for a in range(0, int(column.max(initial=-1)) + 1, 4096):  # stretches of tokens
            x, z = np.searchsorted(column, [a, a + 4096])
            held = np.zeros((len(n), 4096), np.float32)
            held[row[x:z], column[x:z] - a] = 1
            both += held[left] @ held[right].T
        hit = (den + num) * both >= num * (n[left][:, None] + n[right][None])
        u, v = np.nonzero(np.triu(hit, 1) if one else hit)
        edges = pa.RecordBatch.from_arrays([pa.array(node[left[u]]), pa.array(node[right[v]])], ["a", "b"])
        return pa.concat_tables([pa.table({"u": e.column(1), "v": e.column(0)}) for e in joined([edges])])

    sent = placed.join(made, "node").join(need, ["g", "block"])
    return sent.select("g", "x", "y", "block", "node", "s").groupBy("g", "x", "y").applyInArrow(solve, "u long, v long")


def counted_keys(tables: Tables, keys: DataFrame) -> DataFrame:
    """The keys that more than one node has, with `many`, their number of nodes, and `head`, the node of which others have most."""
    stats = keys.groupBy("key").agg(F.count("*").alias("many"), F.max(F.struct("q", "node", "n")).alias("head")).where("many > 1")
    return tables.put("keyed", keys.join(stats, "key"))


def heavy_keys(made: DataFrame, heavy: DataFrame, tables: Tables, num: int, den: int, parts: int) -> DataFrame:
    """(key, node, n, q) of the sets with many frequent tokens, for each other: their tokens are counted among them and put in order, rarest
    first; of the extended prefixes, a token that few of them have is a key of its own, frequent ones give the keys of two-token
    combinations. q is how much of the set others of them have, in thousandths."""

    def spread(batches):
        for batch in batches:
            s = batch.column(1)
            size = np.array([len(x) // 8 for x in s.to_pylist()], np.int64)
            node = batch.column(0).to_numpy()
            token = np.frombuffer(b"".join(s.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, size)), pa.array(np.repeat(size, size)), pa.array(token)], ["node", "n", "token"])

    def prefix(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:  # all nodes but the last are complete
                t = pa.Table.from_batches(held)
                cut = int(np.searchsorted(t["node"].to_numpy(), t["node"][-1].as_py()))
                if cut:
                    yield from some(t.slice(0, cut))
                rest = t.slice(cut)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from some(pa.Table.from_batches(held))

    def some(t):
        node, n, token, df = (t[c].to_numpy() for c in ("node", "n", "token", "df"))
        order = np.lexsort((token, df, node))
        node, n, token, df = node[order], n[order], token[order], df[order]
        begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        many = np.diff(np.append(begin, len(node)))
        place = np.arange(len(node)) - np.repeat(begin, many) + n - np.repeat(many, many)  # tokens that no other of these sets has come first
        known = node[begin]  # sorted
        common = many * 1000 // n[begin]  # how much of a set others have, too
        keep = place < n - least_overlap(n, num, den) + 1 + extension(n)
        node, n, token, df = node[keep], n[keep], token[keep], df[keep]
        rare = df < FREQUENT
        names = ["key", "node", "n", "q"]
        yield pa.RecordBatch.from_arrays([pa.array(token[rare]), pa.array(node[rare]), pa.array(n[rare]), pa.array(common[np.searchsorted(known, node[rare])])], names)
        node, n, token = node[~rare], n[~rare], token[~rare]
        order = np.lexsort((token, node))
        node, n, token = node[order], n[order], token[order]
        begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else node
        for a in range(0, len(begin), 256):
            s = slice(begin[a], begin[a + 256] if a + 256 < len(begin) else len(node))
            keys, nodes, sizes = combinations(node[s], n[s], token[s], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(sizes), pa.array(common[np.searchsorted(known, nodes)])], names)

    tokens = tables.put("tokens", made.join(heavy, "node", "left_semi").mapInArrow(spread, "node long, n long, token long").distinct())
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    parts = max(parts, tokens.count() // 1_000_000)
    counted = tokens.join(df, "token").select("node", "n", "token", "df").repartition(parts, "node").sortWithinPartitions("node")
    return tables.put("keys", counted.mapInArrow(prefix, "key long, node long, n long, q long"))


def with_hubs(tables: Tables, keyed: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) to verify: those given, all pairs of keys of at most SMALL nodes, and of other keys those with the head."""
    stars = keyed.where(f"many > {SMALL} and node <> head.node").select(F.col("head.node").alias("u"), F.col("head.n").alias("un"), F.col("node").alias("v"), F.col("n").alias("vn"))
    more = couples(keyed.where(f"many <= {SMALL}"), "key", SMALL).unionByName(stars).where(fits("un", "vn", num, den)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return tables.put("pairs", pairs.unionByName(more).distinct())


def fits(x: str, y: str, num: int, den: int):
    return F.least(x, y) * den >= F.greatest(x, y) * num


def links(documents: DataFrame, tables: Tables, words: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sizes and fingerprints of all rows, and the links (x, y) between the smallest ids of linked classes of equal sets. Every link
    between classes is in the closure of these: a pair is left out only if other links join its classes already."""
    spark = documents.sparkSession
    rows = tables.put("prints", fingerprints(documents, words, id_col, text_col))
    classes = rows.where("n > 0 and d is not null").groupBy("a", "b", "n").agg(F.min("d").alias("first"))
    known = documents.where(F.col(id_col).isNotNull())
    volume = rows.agg(F.sum(F.least(F.col("n"), F.col("n") * (den - num) / den + 17 + F.col("n") / 16))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(64, 4 * parts, int(volume // 1_000_000))
    post = tables.put("postings", postings(known, words, num, den, buckets, text_col))

    # rare tokens: all pairs of a token's few sets. Similar sets share so many tokens of their extended prefixes that the rare ones
    # they share and all their frequent ones can't be fewer
    rare = post.where("not frequent")
    shared = tables.put("shared", couples(rare.withColumn("c", F.col("node")), "token", FREQUENT).where(fits("un", "vn", num, den)).groupBy("u", "v", "un", "vn").agg(F.count("*").alias("c")))
    often = tables.put("often", post.where("frequent").groupBy("node", "n").agg(F.countDistinct("token").alias("f")))
    f = often.select("node", "f")
    joined = shared.join(f.toDF("u", "uf"), "u", "left").join(f.toDF("v", "vf"), "v", "left")
    need = F.least(F.greatest(F.lit(16), F.floor(F.least("un", "vn") / 16)) + 1, F.ceil(F.greatest("un", "vn") * num / den))
    pairs = tables.put("pairs", joined.where(F.col("c") + F.least(F.coalesce("uf", F.lit(0)), F.coalesce("vf", F.lit(0))) >= need).select("u", "v"))
    # sets with so many frequent tokens that they might share no rare one with a similar set. Two such sets meet among
    # themselves; any other set shares a rare token with each similar one
    less = F.floor(F.col("n") * num / den)
    heavy = tables.put("heavy", often.where(F.col("f") >= F.least(F.greatest(F.lit(16), F.floor(less / 16)) + 1, F.ceil(F.col("n") * num / den))).select("node"))
    nodes = pairs.select(F.col("u").alias("a")).unionByName(pairs.select(F.col("v").alias("a"))).unionByName(heavy.select(F.col("node").alias("a"))).distinct()
    made = set_table(documents, tables, classes, nodes, words, id_col, text_col)
    keyed = counted_keys(tables, heavy_keys(made, heavy, tables, num, den, parts))
    found = verified(tables, made, with_hubs(tables, keyed.withColumn("c", F.col("node")), pairs, num, den), num, den)
    big = keyed.where(f"many > {SMALL}")
    if big.limit(1).count():  # combinations of many sets that their hub did not join
        named = tables.put("named", connected_components(tables, found.select(F.col("u").alias("a"), F.col("v").alias("b")), "inner"))
        placed = tables.put("placed", big.join(named, "node", "left").select("key", "node", "n", "q", F.coalesce("component", "node").alias("c")))
        count = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
        open_ = count.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("most")).where("parts > 1")
        # one group for all keys of which most sets are of one component
        group = tables.put("group", open_.select("key", F.col("most.c").alias("g")))
        members = tables.put("members", placed.select("key", "node", "n", "c").join(group, "key").select("g", "node", "n", "c").distinct())
        found = tables.put("found", found.unionByName(solved(tables, made, members, num, den)).distinct())
    name = classes.select(F.col("a").alias("node"), "first")
    out = found.join(name.toDF("u", "x"), "u").join(name.toDF("v", "y"), "v").select("x", "y").where("x <> y").distinct()
    return rows, tables.put("links", out)


def near_groups(documents: DataFrame, words: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row. Sets of word shingles with den * overlap >= num * union are linked; a component's id is
    the smallest document id in it.

    A null or empty text has no shingles and is alone; a null id is alone, with a null component; rows with one id count as one
    document whose links are united; repeated rows are each returned; other columns play no part."""
    tables = Tables(documents.sparkSession, "shingles")
    documents = documents.select(id_col, text_col)
    rows, found = links(documents, tables, words, num, den, id_col, text_col)
    comps = connected_components(tables, found.select(F.col("x").alias("a"), F.col("y").alias("b")), "outer").withColumnRenamed("node", "first")
    # a class with very many rows is dealt to SALTS tasks
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("d", F.lit(3)), F.lit(SALTS)))
    dealt = tables.put("dealt", rows.where("n > 0 and d is not null").groupBy("a", "b", "n", "salt").agg(F.min("d").alias("first")))
    classes = dealt.groupBy("a", "b", "n").agg(F.min("first").alias("first"))
    named = classes.join(comps, "first", "left").select("a", "b", "n", F.coalesce("component", "first").alias("component_id"))
    named = tables.put("classes", dealt.select("a", "b", "n", "salt").join(named, ["a", "b", "n"]))
    # rows with one id unite the classes they are in
    out = rows.join(named, ["a", "b", "n", "salt"], "left").select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.coalesce("component_id", "d")).alias("component_id"))
    out = tables.put("out", out)
    tables.drop("postings", "shared", "often", "heavy", "sets", "tokens", "keys", "keyed", "pairs", "named", "placed", "group", "members", "pools", "found", "dealt", "classes", "links", "prints", "inner-edges", "outer-edges")
    return out
