"""Operators on texts against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe, common, line_dedup, packing, shingle_join, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string"
ODD_TEXTS = ["<|endoftext|> a", "Σας ΟΔΟΣ Σ", "a\x1cb\u0085c  d\te f é", "a 　 b\n\n  c", "it's 12 34’s 你好 ̀", "", " ", "x" * 3000, "İı ǅ ﬁ", "😀👍🏽 ok"]


def odd(spark):
    """Clashing extra columns, repeated rows, null ids."""
    rows = [(1, "a b", "x", 9), (1, "a b", "x", 9), (None, "q r s", None, None), (2, None, "y", 1), (3, "", "z", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, n_tokens int")


def test_token_counts(spark, corpus):
    rows = corpus + [(9000 + k, t) for k, t in enumerate(ODD_TEXTS)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), P.path("byte_bpe_50k.json"), limit=100).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100), t[:50]


def test_token_counts_odd_rows(spark):
    got = token_counts.count_tokens(odd(spark), P.path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 5
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).count() == 0


def test_proven_strings_are_single_tokens():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = f.read()
    lib = Tokenizer.from_str(vocab)
    proven = sorted(token_counts.proven(vocab))
    assert len(proven) > 40_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(proven, add_special_tokens=False))


def test_chunk_encoder(corpus):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = f.read()
    lib, enc = Tokenizer.from_str(vocab), bpe.ChunkEncoder(vocab, most=50)
    texts = [t for _, t in corpus if t is not None] + ODD_TEXTS
    for _ in range(2):
        ids, off = enc.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]


def check_packing(got, texts, lib, limit=2048):
    ids = {k: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts}
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        parts[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for k, x in ids.items():
        at = 0
        for start, n in sorted(parts[k]):
            assert start == at and n > 0
            at += n
        assert at == len(x)
    padded = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= limit
        padded += 0 if at & (at - 1) == 0 else limit - at
    return padded


@pytest.mark.parametrize("tiers", [(2048, 1024, 512, 256), (64, 16)])
def test_packing(spark, corpus, tiers, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    steps = 4 * tiers[0]
    got = packing.pack(spark.read.parquet(str(tmp_path / "t")), P.path("word_bpe_49k.json"), tiers=tiers, pool=4, step_tokens=steps).collect()
    assert check_packing(got, corpus, Tokenizer.from_file(P.path("word_bpe_49k.json")), tiers[0]) == 0
    assert len({(r.sequence_id, r.window) for r in got}) == len({r.sequence_id for r in got})
    groups = defaultdict(lambda: defaultdict(int))
    for r in got:
        groups[r.window][r.step_group] += r.length
    assert len({r.sequence_id >> 40 for r in got}) > 1
    for window, of in groups.items():  # over all tasks, the groups of a size but the last one are equal
        assert [of[g] for g in sorted(of)][:-1] == [max(steps // window, 1) * window] * (len(of) - 1) and of[max(of)] <= max(steps, window)


def test_packing_odd_rows(spark):
    got = packing.pack(odd(spark), P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in got) == 3 + 3 + 4 + 1 + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd(spark), P.path("word_bpe_49k.json"), tiers=(100, 50))


def shingles(t):
    space = " \t\n\x0b\x0c\r"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w, cur = [], ""
    for c in low + " ":
        if c in space:
            if cur:
                w.append(cur)
            cur = ""
        else:
            cur += c
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows, num=75, den=100):
    s = {k: shingles(t) for k, t in rows}
    root = {k: k for k in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(s[a] & s[b])
            if n and den * n >= num * (len(s[a]) + len(s[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s[k]), find(k)) for k in s}


def groups_of(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_groups(df, **kw).collect()}


def test_shingle_join(spark, corpus):
    assert groups_of(spark.createDataFrame(corpus, SCHEMA).repartition(4)) == brute_groups(corpus)


@pytest.mark.parametrize("frequent,small,num", [(2, 2, 75), (3, 2, 60), (12, 3, 75), (1000, 8, 50)])
def test_shingle_join_classes(spark, corpus, monkeypatch, frequent, small, num):
    """Whatever counts as frequent, and with more than one task of edges, the groups are the same."""
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "HELD", 50)
    monkeypatch.setattr(shingle_join, "SOLVED", 12 * small)
    monkeypatch.setattr(shingle_join, "BLOCK", 4 * small)
    monkeypatch.setattr(common, "EDGES_A_TASK", 7)
    rows = corpus[::2]
    assert groups_of(spark.createDataFrame(rows, SCHEMA).repartition(3), num=num) == brute_groups(rows, num)


@pytest.mark.parametrize("seed,small,few,tokens", [(1, 3, 2048, 4_000_000), (2, 2, 20, 4_000_000), (3, 2, 2048, 900)])
def test_shingle_join_of_families(spark, monkeypatch, seed, small, few, tokens):
    """Copies of copies with words changed, put in and taken out, so that many pairs are just similar enough or just not: no
    link is lost, whatever the blocks."""
    monkeypatch.setattr(shingle_join, "FREQUENT", 3)
    monkeypatch.setattr(shingle_join, "SMALL", small)
    for name, value in (("SOLVED", few), ("BLOCK", 10), ("TOKENS", tokens)):
        monkeypatch.setattr(shingle_join, name, value)
    rng = random.Random(seed)
    family = [[f"w{k}" for k in range(70)]]
    for _ in range(110):
        t = family[rng.randrange(1 + len(family) // 3)][:]
        for _ in range(rng.randint(1, 5)):
            k = rng.randrange(len(t))
            t[k : k + 1] = [[f"x{rng.randrange(900)}"], [t[k], f"y{rng.randrange(9)}"], []][rng.randrange(3)]
        family.append(t)
    rows = list(enumerate(" ".join(t) for t in family))
    assert groups_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_groups(rows)


def test_shingle_join_odd_rows(spark):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in shingle_join.near_groups(odd(spark)).collect())
    assert got == [(-1, 1, None), (1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 0, 3)]
    assert shingle_join.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_bytes(rows, length):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length,hot", [(100, 20_000), (100, 2), (40, 5)])
def test_suffix_dedup(spark, corpus, monkeypatch, length, hot):
    """Whatever counts as a hot anchor, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus + [(5000, "é" * 300), (5001, "x" * 99), (5002, "x" * 100), (5003, "ab" * 200 + "é" * 80)]
    got = suffix_dedup.suffix_digest(spark.createDataFrame(rows, SCHEMA).repartition(4), length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute_bytes(rows, length)


def test_suffix_dedup_texts_and_odd_rows(spark):
    same = "word " * 30
    rows = [(1, same, "p"), (2, "head " + same, "q"), (3, None, "r"), (None, same, "s"), (4, "", None), (1, same, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted((r.doc_id or -1, r.text, r.spans or "") for r in suffix_dedup.dedup_bytes(df).collect())
    ours = brute_bytes([(1, same), (2, "head " + same)], 100)
    assert len(out) == 6 and out[0][1] == same
    assert [hashlib.sha256((t or "").encode()).hexdigest() for k, t, _ in out if k == 2] == [ours[2][3]]
    assert suffix_dedup.suffix_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def passages(n):
    """Texts of their own around one passage."""
    import random

    rng = random.Random(3)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    passage = text(60)
    return [(k, f"{text(rng.randint(3, 30))} {passage} {text(rng.randint(3, 30))}") for k in range(n)]


def test_copies_make_no_hot_anchor(spark, monkeypatch):
    """Copies within a task are sent once, so only pieces that differ make an anchor hot."""
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    texts = lambda rows: spark.createDataFrame([(k, 0, t) for k, t in rows], "d long, h long, text string").coalesce(2)
    copies = suffix_dedup.repeated_anchors(texts([(k, passages(1)[0][1]) for k in range(60)]), 100, 8)
    assert copies.where("anchor >= 0").count() > 0 and copies.where("anchor < 0").count() == 0
    assert suffix_dedup.repeated_anchors(texts(passages(60)), 100, 8).where("anchor < 0").count() > 0


@pytest.mark.parametrize("flush", [50, 1 << 20])
def test_hot_windows_in_the_same_pass(spark, monkeypatch, flush):
    """No table has a row for each window of a hot anchor, texts are joined with their anchors once, and windows that touch are one span."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "FLUSH_WINDOWS", flush, raising=False)
    put, seen = common.Tables.put, {}

    def counted(self, key, df):
        table = put(self, key, df)
        seen[key] = table.count()
        if key == "spans":
            seen["joins"] = df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
            seen["longest"] = table.selectExpr("max(size(spans))").first()[0]
        return table

    monkeypatch.setattr(common.Tables, "put", counted)
    rows = passages(40)
    got = suffix_dedup.suffix_digest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute_bytes(rows, 100)
    assert seen["joins"] == 1 and seen["longest"] == 1
    assert max(seen.values()) < 40 * 20  # pieces; windows are some 40 * 260


def brute_lines(rows, m):
    seen, out = {}, {}
    docs = [(k, t.split("\n")) for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])]
    for k, lines in docs:
        gone = [False] * len(lines)
        for i in range(len(lines) - m + 1):
            w = tuple(lines[i : i + m])
            if all(x.strip() for x in w):
                if w in seen:
                    gone[i : i + m] = [True] * m
                seen[w] = True
        runs = sum(1 for i in range(len(lines)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out[k] = (len(lines), sum(gone), runs, hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    import random

    rng = random.Random(m)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", "d  ", " "]) for _ in range(rng.randint(0, 14)))) for k in range(40)]
    rows += [(100, "\n".join(f"l{i}" for i in range(30))), (101, "\n".join(f"l{i}" for i in range(5, 25))), (102, "")]
    got = line_dedup.line_dedup_digest(spark.createDataFrame(rows, SCHEMA), m)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in got.collect()} == brute_lines(rows, m)


def test_line_dedup_odd_rows_and_plan(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(1, text, "u"), (2, text, "v"), (2, text, "v"), (3, None, "w"), (None, text, "x"), (4, "a\nb\nx", "y")], "doc_id long, text string, rank string")
    out = line_dedup.dedup_lines(df)
    assert sorted((r.doc_id or -1, r.text, r["rank"]) for r in out.collect() if r.text is not None) == [(-1, text, "x"), (1, text, "u"), (2, "", "v"), (2, "", "v"), (4, "a\nb\nx", "y")]
    assert out.columns == df.columns and out.count() == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert line_dedup.line_dedup_digest(spark.createDataFrame([], SCHEMA)).count() == 0
