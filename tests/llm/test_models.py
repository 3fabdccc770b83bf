"""SentencePiece, WARC, toxicity and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from lectern.llm import pieces, toxicity, warc
from lectern.llm import registry

MODEL = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(2)
    fixed = ["Hello  world\nfoo　x é", "", "  lead", "trail  ", "\n\n a\t b", "你好 <s> </s> <0x0A> ▁x▁▁y ▁ ▁z", "a" * 5000, " ", " \n ", "émoji 😀 ok\r\n"]
    return fixed + ["".join(rng.choice("ab \n▁é你😀<s>0x the ") for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_pieces_match_the_library_and_come_back():
    with open(MODEL, "rb") as f:
        enc = pieces.Encoder(f.read(), most=100)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = texts()
    for _ in range(2):
        ids, off = enc.encode(pa.array(rows))
        for k, t in enumerate(rows):
            mine = ids[off[k] : off[k + 1]]
            assert mine.tolist() == lib.encode(t), t
            assert enc.decode(mine) == lib.decode(mine.tolist())


def test_viterbi_finds_the_best_sum():
    """Against all segmentations of short words."""
    with open(MODEL, "rb") as f:
        coder = pieces.Coder(f.read())
    score = {p: float(s) for p, s, t in zip(coder.v.pieces, coder.v.scores, coder.v.types, strict=True) if t == pieces.NORMAL}
    rng = random.Random(1)
    for length in (1, 2, 5, 9):
        words = ["".join(rng.choice("theraion你") for _ in range(length)) for _ in range(20)]
        run = coder.prefixes(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1))
        cut = coder.viterbi(run)
        for w, c in zip(words, cut, strict=True):
            def total(edges, w=w):
                return sum(score.get(w[a:b], float(coder.unknown) if b - a == 1 else -np.inf) for a, b in zip(edges, edges[1:], strict=False))

            best = max(total([0, *[i for i in range(1, length) if m >> i & 1], length]) for m in range(0, 1 << length, 2))
            assert total(np.flatnonzero(c).tolist()) == best


def test_pieces_query(spark):
    rows = [(k, t) for k, t in enumerate(texts()[:50])] + [(900, None), (None, "x"), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.encode_texts(df, MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    by = dict(rows)
    for r in got.collect():
        want = lib.encode(by[r.doc_id] or "")
        assert r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.round_trip == (lib.decode(want) == (by[r.doc_id] or ""))
    back = pieces.decode_ids(got.where("doc_id < 50"), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {k: lib.decode(lib.encode(t)) for k, t in rows[:50]}
    assert pieces.encode_texts(spark.createDataFrame([], df.schema), MODEL).count() == 0


def block(kind, name, url, at, http, more=""):
    b = http.encode()
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:{at:02d}Z\r\n{more}Content-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"


def test_revisits(spark):
    full = lambda tag, body, more="": f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{more}ETag: \"{tag}\"\r\n\r\n{body}"
    again = lambda h: f"HTTP/1.1 304 Not Modified\r\n{h}\r\n"
    data = [
        block("response", "r1", "http://www.A.org:80/x/?b=1&utm_source=q&a=2#top", 1, full("t1", "one")) + block("response", "r2", "https://a.org/x?a=2&b=1", 5, full("t2", "two")),
        block("revisit", "v0", "https://a.org/x?a=2&b=1", 1, again('ETag: "t1"\r\n')),  # nothing earlier
        block("revisit", "v1", "https://a.org/x?a=2&b=1", 4, again('ETag: W/"t1"\r\nDate: d\r\nX-Own: no\r\n')),
        block("revisit", "v2", "https://a.org/x?a=2&b=1", 6, again('ETag: "t1"\r\n')),  # the latest has another tag
        block("revisit", "v3", "https://a.org/x?a=2&b=1", 7, again("Date: e\r\n")),  # nothing to compare
        block("revisit", "v4", "https://a.org/x?a=2&b=1", 8, again(""), "WARC-Payload-Digest: sha256:" + __import__("hashlib").sha256(b"two").hexdigest() + "\r\n"),
        block("revisit", "v5", "https://b.org/", 9, again('ETag: "t1"\r\n')),
        block("response", "r3", "https://b.org/", 3, "HTTP/1.1 500 No\r\n\r\n") + block("metadata", "m", "https://b.org/", 3, "x") + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort",
        block("revisit", "v6", "https://c.org/", 9, "HTTP/1.1 200 OK\r\nX-Own: yes\r\n\r\n", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Payload-Digest: sha256:two\r\nX-Long: " + "y" * 70000 + "\r\n") + block("response", "r4", "https://c.org/", 2, full("t1", "three"), "WARC-Payload-Digest: sha256:two\r\n"),
        block("revisit", "v7", "https://c.org/", 9, again('ETag: "t1"\r\n'), "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Payload-Digest: sha256:four\r\n"),
        None, b"", b"junk",
    ]
    df = spark.createDataFrame([(d,) for d in data], "warc binary").repartition(4)
    got = {r.record_id: r for r in warc.resolve_revisits(warc.read_records(df)).collect()}
    assert {k: (r.state, r.source_id) for k, r in got.items()} == {"v0": ("no response", None), "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("unverified", None), "v4": ("resolved", "r2"), "v5": ("no response", None), "v6": ("resolved", "r4"), "v7": ("mismatch", None)}
    assert got["v6"].headers == {"x-own": "yes"}
    assert got["v1"].headers == {"content-type": "text/html", "etag": 'W/"t1"', "date": "d"}
    assert got["v1"].canonical == "https://a.org/x?a=2&b=1"


def test_revisits_of_one_url_over_many_partitions(spark):
    """More captures of one address than a partition holds."""
    pages = spark.createDataFrame([(k, "http://one.org/p" if k % 5 else f"http://o{k % 20}.org/", f"html {k // 50}") for k in range(400)], "page_id long, url string, html string")
    got = warc.revisits_of_pages(pages)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(registry.oracle_sql()["op7_warc_revisits"])
    cols = sorted(want.columns)
    states = [r.state for r in got.where("record_id like 'urn:again%' and coalesce(substr(source_id, 12) <> substr(record_id, 11), true)").collect()]
    assert set(states) == {"resolved", "mismatch", "unverified", "no response"}  # by other pages' captures
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert warc.revisits_of_pages(spark.createDataFrame([(None, None, None)], pages.schema)).count() == 0


def labelled(n=600):
    rng = random.Random(3)
    syl = ["er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    rows, y = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(5, 150))]
        bad = k % 6 == 0
        if bad:
            for _ in range(max(1, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "Moron", "scum", "trash!"])
        rows.append((k, " ".join(w), "en"))
        y.append((k, int(bad)))
    return rows, y


def test_toxicity_held_out(spark):
    rows, y = labelled()
    docs = spark.createDataFrame([*rows, (9000, None, "x"), (None, "he idiot", "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*[(k, v, 0) for k, v in y], (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    truth = dict(y)
    held = [r for k, r in got.items() if k in truth and r.held_out]
    assert len(held) > 60 and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9000].score == got[9001].score < 0.5 and got[None].score > 0.5


def test_toxicity_one_class_and_empty(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(20)], "doc_id long, text string")
    for label, want in ((0, 0), (1, 1)):
        labels = spark.createDataFrame([(k, label) for k in range(20)], "doc_id long, toxic int")
        assert {r.predicted for r in toxicity.score_documents(docs, labels).collect()} == {want}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs, none).collect()} == {0}
    assert toxicity.score_documents(docs.where("false"), none).count() == 0


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    """Every stage on its predecessor's rows, held against plain Python."""
    from tokenizers import Tokenizer

    from test_texts import brute_bytes, brute_groups, brute_lines, check_packing

    rows, y = labelled(200)
    spans = "\n".join(f"line {k} of a passage that several documents have in common" for k in range(6))
    docs = rows[:200] + [(1000 + k, t, "en") for k, t in corpus] + [(5000 + k, f"own {k}\n{spans}\nend {k}", "en") for k in range(5)]
    spark.createDataFrame([(*r, "s", 0) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(y[:200], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in at.collect()}
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert check_packing(at.collect(), list(before.items()), Tokenizer.from_file(P.path("word_bpe_49k.json"))) == 0
            break
        after = {r.doc_id: r.text for r in at.collect()}
        assert at.columns == names and len(after) == at.count()
        if name == "toxicity":
            gone = set(before) - set(after)
            assert gone <= {k for k, v in y if v} and len(gone) > 20
        elif name == "line_dedup":
            want = brute_lines(before.items(), 3)
            assert set(after) == set(before) and sum(w[1] for w in want.values()) > 20
            import hashlib

            assert all(t is None or hashlib.sha256(t.encode()).hexdigest() == want[k][3] for k, t in after.items())
        elif name == "shingle_join":
            assert set(after) == {k for k, (_, c) in brute_groups(before.items()).items() if c == k}
        else:
            import hashlib

            want = brute_bytes(before.items(), 100)
            assert set(after) == set(before) and all(hashlib.sha256((t or "").encode()).hexdigest() == want[k][3] for k, t in after.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


@pytest.mark.parametrize("name", ["op7_warc_revisits", "op10_line_dedup"])
def test_oracles(spark, name):


    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
