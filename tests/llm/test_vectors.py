"""Vector operators against brute force."""

import numpy as np
import pytest

from lectern.llm import common, embedding_join, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(rng, n=700, d=16):
    x = rng.normal(size=(n, d))
    x[50:150] = x[:100] + rng.normal(size=(100, d)) * 0.05 * np.linalg.norm(x[:100], axis=1, keepdims=True) / 2  # near copies
    x[200:300] = x[7] + rng.normal(size=(100, d)) * 0.1  # one large near group
    x[300:340] = x[9]  # equal ones
    x[340:345] = 2 * x[9]  # the same direction
    return x.astype(np.float32)


def rows_of(x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return [(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)]


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [1.0] * 3, 1), (9005, [None] + [1.0] * 15, 1), (9006, [float("inf")] + [0.0] * 15, 1), (9007, [], 1)]


def brute_join(x, ids, cosine):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], label.max()).min(1))
        if (new == label).all():
            return {i: (int(hit[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
        label = new


@pytest.mark.parametrize("group,leaf,cosine", [(4096, 256, 0.95), (64, 16, 0.95), (64, 16, 0.8)])
def test_near_vectors(spark, monkeypatch, group, leaf, cosine):
    monkeypatch.setattr(embedding_join, "GROUP", group)
    monkeypatch.setattr(embedding_join, "LEAF", leaf)
    monkeypatch.setattr(common, "EDGES_A_TASK", 40)
    x = cloud(np.random.default_rng(3))
    ids = [int(i) for i in np.random.default_rng(4).permutation(len(x))]
    df = spark.createDataFrame(rows_of(x, ids) + ODD, SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(df, cosine).collect()}
    want = brute_join(x, ids, cosine) | {r[0]: (0, r[0], True) for r in ODD}
    assert got == want


def test_near_vectors_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 2), (None, [1.0, 0.0], 3)], SCHEMA)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(df).collect())
    assert got == [(-1, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert embedding_join.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embedding_join.near_vectors(spark.createDataFrame([(5, None, 0)], SCHEMA)).collect()[0].component_id == 5


def brute_nearest(x, ids, q, k):
    order = np.argsort(ids)
    x, ids = x[order].astype(float), np.array(ids)[order]
    out = {}
    for i in q:
        at = int(np.searchsorted(ids, i))
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != at][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block,asked,part", [(2048, 512, 16_384), (16, 3, 40)])
def test_nearest_all_buckets_is_exact(spark, monkeypatch, block, asked, part):
    """With every neighbouring bucket visited and whole comparison of the rest, ties and equal vectors are in order, whatever the blocks."""
    for name, value in (("BLOCK", block), ("ASKED", asked), ("PART", part), ("fitted", lambda sample, near, n, tables, recall: (nearest.Hashes(sample.shape[1], 60.0, tables, 4), 81))):
        monkeypatch.setattr(nearest, name, value)
    x = cloud(np.random.default_rng(5), 400)
    ids = [int(i) for i in np.random.default_rng(6).permutation(len(x))]
    df = spark.createDataFrame(rows_of(x, ids) + ODD, SCHEMA).repartition(3)
    q = [i for i in ids if i % 20 == 0]
    got = found(nearest.nearest(df, df.where("vec_id % 20 = 0")))
    want = brute_nearest(x, ids, q, 10)
    assert set(got) == set(q)
    for i in q:
        assert [v for v, _ in got[i]] == [v for v, _ in want[i]] and np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=0, atol=1e-12)


def test_nearest_recall(spark):
    x = np.random.default_rng(7).normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(rows_of(x), SCHEMA).repartition(3)
    got, want = found(nearest.nearest(df, df.where("vec_id % 100 = 0"))), brute_nearest(x, range(3000), range(0, 3000, 100), 10)
    hits = sum(len({v for v, _ in got[i]} & {v for v, _ in want[i]}) for i in want)
    assert hits >= 0.9 * 10 * len(want)


def test_share_compared_falls_as_the_table_grows():
    """The parameters that a table gets find 0.9 of the true nearest of other queries, with a falling share of the vectors compared."""
    shares = []
    for n in (2000, 30_000):
        x = np.random.default_rng(8).normal(size=(n, 24))
        x /= np.linalg.norm(x, axis=1)[:, None]
        true = lambda q: [x[np.argsort(((x - x[i]) ** 2).sum(1))[1:11]] for i in q]  # noqa: B023, E731
        fit, ask = range(48), range(100, 140)
        hashes, probes = nearest.fitted(x[list(fit)], true(fit), n, 6, 0.96)
        cells = [hashes.buckets(x, t) for t in range(6)]
        got, hits = 0, 0
        for i, near in zip(ask, true(ask), strict=True):
            seen = np.any([np.isin(cells[t], hashes.probes(x[i : i + 1], t, probes)[0]) for t in range(6)], axis=0)
            got += seen.sum()
            hits += sum(bool(seen[np.flatnonzero((x == v).all(1))[0]]) for v in near)
        assert hits >= 0.9 * 10 * len(ask)
        shares.append(got / n / len(ask))
    assert shares[1] < 0.9 * shares[0] < 0.9


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (100, [0.0, 5.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], SCHEMA)
    got = found(nearest.nearest(df, df.where("vec_id % 100 = 0")))
    assert [v for v, _ in got[0]] == [3, 100] and [v for v, _ in got[100]] == [0, 3] and got[0][0][1] == 0.0
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest.nearest(empty, empty).count() == 0


def test_probes_are_in_order_and_start_at_home():
    h = nearest.Hashes(8, 1.0, 2, 4)
    x = np.random.default_rng(1).normal(size=(5, 8))
    keys = h.probes(x, 1, 81)
    assert (keys[:, 0] == h.buckets(x, 1)).all() and len({*keys[0].tolist()}) == 81
