"""Repeated passages by lines or words against brute force."""

import hashlib
import random

import pytest

from lectern.llm import line_dedup

SCHEMA = "doc_id long, text string"


def brute_passages(rows, m, words):
    """Every run, of every length, that counts and starts earlier, too."""
    docs = [(k, t.split("\n")) for k, t in sorted(rows)]
    texts, gone, seen = dict(docs), {k: set() for k, _ in docs}, set()
    for k, lines in docs:
        at = [i for i, x in enumerate(lines) if x.strip()]
        deleted = set()
        for s in range(len(at)):
            for e in range(s + 1, len(at) + 1):
                run = tuple(texts[k][i] for i in at[s:e])
                if e - s >= m or sum(len(x.split()) for x in run) >= words:
                    if run in seen:
                        deleted.update(range(s, e))
                    seen.add(run)
        for s in deleted:  # and the blank lines up to a next one that goes, too
            gone[k].update(range(at[s], at[s + 1] if s + 1 in deleted else at[s] + 1))
    out = {}
    for k, lines in docs:
        runs = sum(i - 1 not in gone[k] for i in gone[k])
        out[k] = (len(lines), len(gone[k]), runs, hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone[k]).encode()).hexdigest())
    return out


def digest(spark, rows, m, words):
    got = line_dedup.line_dedup_digest(spark.createDataFrame(rows, SCHEMA).repartition(3), m, min_words=words)
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in got.collect()}


@pytest.mark.parametrize("m, words", [(3, 5), (4, 3)])
def test_passages(spark, m, words):
    rng = random.Random(m)
    lines = ["a", "b b", "c c c", "d d d d", "e e e e e e", "f", "", " "]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for k in range(40)]
    assert digest(spark, rows, m, words) == brute_passages(rows, m, words)


def test_long_lines_and_whole_copies_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long), (3, f"own\n{long}\nend"), (4, "x\ny"), (5, "x\ny")]
    assert {k: v[1] for k, v in digest(spark, rows, 3, 50).items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_blank_lines_do_not_end_a_run(spark):
    text = "one\n\ntwo\n \nthree\n\nfour"
    rows = [(1, text), (2, text), (3, "head\n\n" + text.replace("\n\n", "\n\n\n") + "\n\ntail")]
    assert {k: v[:3] for k, v in digest(spark, rows, 3, 50).items()} == {1: (7, 0, 0), 2: (7, 7, 1), 3: (13, 9, 1)}
