"""Induced sorting against plain sorting."""

import random

import pytest

from lectern.llm.induced import Queue, Shard


@pytest.mark.parametrize("seed", range(40))
def test_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    depth, most = rng.choice([3, 8, 20, 100]), rng.choice([20, 1 << 20])
    letters = rng.choice([b"ab", b"abc", bytes(range(248)), b"\x00\x01\xf6"])
    base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(3)]
    strings = []
    for _ in range(rng.randint(1, 12)):
        x = rng.choice(base)
        i = rng.randint(0, len(x))
        strings.append(x[i : i + rng.randint(0, 150)] or b"a")
    shard = Shard(strings, depth, most)
    position, common = shard.suffixes()
    t = shard.t.tolist()
    assert sorted(position.tolist()) == list(range(shard.n - 1))
    for i in range(1, len(position)):
        x, y = (t[p : p + depth] for p in position[i - 1 : i + 1])
        assert x <= y
        n = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        if 1 not in x[:n] and position[i] + n < shard.n - 1:  # beyond a separator it doesn't count
            assert n == common[i]


def test_shard_larger_than_its_queue(monkeypatch):
    """With a queue of a sixteenth of the shard, tuples go to the file and come back, and the order is the same."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    strings = [" ".join(rng.choice(words) for _ in range(60)).encode() for _ in range(400)]
    spills = []
    spill = Queue.spill
    monkeypatch.setattr(Queue, "spill", lambda self, c: spills.append(c) or spill(self, c))
    large = Shard(strings, 100, 1 << 30)
    want = large.suffixes()
    assert not spills
    got = Shard(strings, 100, large.n // 16).suffixes()
    assert len(spills) > 20 and all((x == y).all() for x, y in zip(got, want, strict=True))


def test_queue_spills_in_order():
    import numpy as np

    q = Queue(3, 10)
    for k in range(20):
        q.put(k % 3, np.arange(k, k + 3, dtype=np.int32), np.full(3, k, np.uint8))
    for c in range(3):
        position, prefix = q.take(c)
        assert prefix.tolist() == [k for k in range(20) if k % 3 == c for _ in range(3)]
        assert position.tolist() == [x for k in range(20) if k % 3 == c for x in range(k, k + 3)]
    q.close()
