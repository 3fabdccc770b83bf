"""Very long words, columns with internal names, and a classifier against plain counting."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from lectern.llm import bpe, common, line_dedup, pieces, suffix_dedup, token_counts, toxicity

LETTERS = "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(60_000))
BASE64 = "".join(random.Random(2).choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000))
LONG = [LETTERS, BASE64, "a" * 30_000, "ab" * 300 + " " + "x" * 257, "é" * 5000]


def test_long_words_as_the_library():
    text = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    lib = bpe.tokenizer(text)
    assert token_counts.Counter(text, token_counts.proven(text)).count(LONG) == [len(lib.encode(t, add_special_tokens=False).ids) for t in LONG]
    text = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    lib = bpe.tokenizer(text)
    ids, off = bpe.ChunkEncoder(text).encode(pa.array(LONG))
    for k, t in enumerate(LONG):
        assert ids[off[k] : off[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, off = pieces.Encoder(open(path, "rb").read()).encode(pa.array(LONG))
    for k, t in enumerate(LONG):
        assert ids[off[k] : off[k + 1]].tolist() == lib.encode(t)


def test_a_megabyte_without_spaces_takes_seconds():
    import time

    text = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    merger = bpe.Merger(text)
    word = (LETTERS * 18)[: 1 << 20].encode()
    began = time.process_time()
    ids, _ = merger.merge([word])
    assert time.process_time() - began < 60
    back = {i: s for s, i in merger.vocab.items()}
    assert b"".join(bytes(merger.value[c] for c in back[i]) for i in ids.tolist()) == word


@pytest.mark.parametrize("names", [("_d", "_h", "_runs"), ("_D", "_spans", "run"), ("d", "h", "_runs_")])
def test_columns_with_internal_names(spark, names):
    text = "\n".join(f"line {k} of a text that is long enough" for k in range(5))
    docs = spark.createDataFrame([(1, text, 1, "x", None), (2, text, 2, "y", 0.5), (3, "other", 3, None, 1.0), (4, None, 4, "z", 2.0)], "doc_id long, text string, a int, b string, c double").toDF("doc_id", "text", *names)
    for fn in (line_dedup.dedup_lines, suffix_dedup.dedup_bytes):
        got = fn(docs)
        assert got.columns == docs.columns
        rows = {r[0]: tuple(r)[1:] for r in got.collect()}
        assert rows == {1: (text, 1, "x", None), 2: ("", 2, "y", 0.5), 3: ("other", 3, None, 1.0), 4: (None, 4, "z", 2.0)}


def test_fresh_names():
    assert common.fresh(["A", "_d", "_d_"], "_d", "a", "b") == ["_d__", "a_", "b"]


def test_merge_long_is_merge_all():
    rng = np.random.default_rng(4)
    merger = bpe.Merger(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for n in (1, 2, 3, 50, 200):
        word = bytes(rng.choice(list(b"theanding "), n).tolist())
        ids, _ = merger.merge([word])
        assert merger.long(np.frombuffer(word, np.uint8)) == ids.tolist()


def hashes_of(text):
    """Each n-gram of a text by slicing, hashed one at a time."""
    low = text.lower()
    return {int(h[0]) for n in toxicity.ORDERS for i in range(len(low) - n + 1) for h, _, ok in list(toxicity.grams([low[i : i + n]]))[-1:] if ok[0]}


def test_toxicity_against_plain_counting(spark, monkeypatch):
    """Counts, ratios, the choice of n-grams, the fit and the scores, each against a plain form of it."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "Idiot", "scum", "rho"]
    rows = [(k, " ".join(rng.choice(words[: 7 if k % 3 == 0 else 4]) for _ in range(rng.randint(1, 6)))) for k in range(90)]
    labels = [(k, int(k % 3 == 0)) for k in range(90)]
    held = []
    plain_fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, y, r, **kw: held.append((x, y, r)) or plain_fit(x, y, r, **kw))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), most_features=60)
    (x, y, r), = held
    learn = [(hashes_of(t), lab) for (k, t), (_, lab) in zip(rows, labels, strict=True) if __import__("zlib").crc32(str(k).encode()) % 5]
    big = [sum(1 for _, lab in learn if lab == c) for c in (0, 1)]
    counts = {h: [sum(h in g for g, lab in learn if lab == c) for c in (0, 1)] for h in set().union(*(g for g, _ in learn))}
    counts = {h: n for h, n in counts.items() if sum(n) >= 4}

    def z(n):
        share = (sum(n) + 1) / (sum(big) + 2)
        return abs(n[1] - big[1] * share) / np.sqrt(big[1] * share * (1 - share))

    top = sorted(sorted(counts, key=lambda h: (-round(z(counts[h]), 9), h))[:60])
    ratio = [np.log((counts[h][1] + 1) / (big[1] + 2)) - np.log((counts[h][0] + 1) / (big[0] + 2)) for h in top]
    assert np.allclose(r, ratio)
    seen = sorted((lab, tuple(k for k, h in enumerate(top) if h in g)) for g, lab in learn)
    assert sorted((int(lab), tuple(k.tolist())) for k, lab in zip(x, y, strict=True)) == seen

    # the fit: slow steps from zero reach no smaller loss
    m = np.zeros((len(x), len(r)))
    for k, cols in enumerate(x):
        m[k, cols] = r[cols]
    loss = lambda w, b: np.mean(np.logaddexp(0, m @ w + b) - y * (m @ w + b)) + 2e-4 * np.abs(w).sum() + 5e-5 * (w @ w)
    w, b, step = np.zeros(len(r)), 0.0, 2.0 / max((m * m).sum(1).max(), 1)
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-(m @ w + b))) - y) / len(y)
        w = w - step * (m.T @ g + 1e-4 * w)
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * 2e-4, 0), b - step * g.sum()
    got_w, got_b = plain_fit(x, y, r)
    assert loss(got_w, got_b) <= loss(w, b) + 2e-3

    texts = ["an idiot", "alpha beta", "", "SCUM scum"]
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    want = [1 / (1 + np.exp(-(model.bias + sum(weight.get(h, 0.0) for h in hashes_of(t))))) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-6)


def test_toxicity_features_are_bounded(spark):
    with pytest.raises(ValueError):
        toxicity.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"), most_features=1 << 15)


def test_clear_deletes_all_tables(spark):
    import os

    line_dedup.line_dedup_digest(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    where = common.FOLDERS[-1].removeprefix("file://")
    assert os.path.isdir(where)
    common.clear(spark)
    assert not os.path.exists(where) and not common.FOLDERS
