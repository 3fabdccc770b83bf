"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

ORDERS = (3, 4, 5)
BITS = 21
STEP = 400  # texts at a time


def grams(texts: list[str]):
    """For each order: the hashed n-gram at each character of the texts and the text it is in; n-grams don't cross texts. Lower case."""
    low = [t.lower() for t in texts]
    n = np.fromiter(map(len, low), np.int64, len(low))
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(n)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), n)
    room = np.repeat(end, n) - np.arange(len(chars))
    run, factor = np.zeros(len(chars), np.uint32), 1
    for order in range(1, max(ORDERS) + 1):
        m = len(chars) - order + 1
        if m <= 0:
            return
        run = run[:m] + chars[order - 1 :] * np.uint32(factor)
        factor = factor * 0x01000193 * 5 % (1 << 32) | 1
        if order in ORDERS:
            h = (run + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h = h * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
            ok = room[:m] >= order
            yield h, doc[:m], ok


@dataclass
class Model:
    """feature: the hashed n-grams that count, weight: what each adds (its log-count ratio times its learned weight)."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        place = np.full(1 << BITS, -1, np.int16)
        place[self.feature] = np.arange(len(self.feature))
        out = []
        for a in range(0, len(texts), STEP):
            part = texts[a : a + STEP]
            seen = np.zeros((len(part), len(self.feature) + 1), np.float32)
            for h, doc, ok in grams(part):
                k = place[h]
                at = np.flatnonzero((k >= 0) & ok)
                seen[doc[at], k[at]] = 1
            out.append(self.bias + seen[:, :-1].astype(np.float64) @ self.weight)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def crc_mod(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, most_rows: int = 20_000, least_df: int = 4, most_features: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most `most_rows` labelled documents outside fold 0 (crc32 of the id as text, modulo `folds`), those with
    the smallest hashes of their ids: that bound is what is broadcast, and what comes to the driver is, for each, its places among
    `most_features` n-grams. Presence of n-grams is counted for each class over the sample, the ratio r of an n-gram is
    log((n1 + 1) / (N1 + 2)) - log((n0 + 1) / (N0 + 2)), those with the largest standardised difference are kept, and a logistic
    regression with L1 and L2 penalties is fitted to presence times r. Labels other than 0 and 1, and null ids, are left out; ids
    with several labels count as the larger. With one class only the score is constant. most_features: 32,767 at most."""
    if not 0 < most_features < 1 << 15:
        raise ValueError("most_features: 1 to 32767")
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit(8)), "_id").limit(most_rows)
    sample = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_y")

    def presence(batches):
        count = np.zeros((2, 1 << BITS), np.int32)
        rows = np.zeros(2, np.int64)
        for b in batches:
            texts, y = [t or "" for t in b.column(0).to_pylist()], b.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, len(texts), STEP):
                part = y[a : a + STEP]
                rows += np.bincount(part, minlength=2)
                for h, doc, ok in grams(texts[a : a + STEP]):
                    key = np.unique(doc[ok].astype(np.int64) << BITS | h[ok])
                    for c in (0, 1):
                        count[c] += np.bincount(key[part[key >> BITS] == c] & (1 << BITS) - 1, minlength=1 << BITS).astype(np.int32)
        f = np.flatnonzero(count.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1), pa.int64()), pa.array(np.append(count[0, f], rows[0]), pa.int64()), pa.array(np.append(count[1, f], rows[1]), pa.int64())], ["f", "n0", "n1"])

    counts = sample.mapInArrow(presence, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    tables = Tables(documents.sparkSession, "toxicity")
    counts = tables.put("counts", counts.where(f"f = -1 or n0 + n1 >= {least_df}"))
    total = counts.where("f = -1").first()
    if not total or not total.n0 or not total.n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 50.0 if total and total.n1 else -50.0)
    big0, big1 = total.n0, total.n1
    share = (F.col("n0") + F.col("n1") + 1) / F.lit(big0 + big1 + 2)
    z = F.abs(F.col("n1") - big1 * share) / F.sqrt(big1 * share * (1 - share))
    top = counts.where("f >= 0").select("f", "n0", "n1", z.alias("z")).orderBy(F.desc("z"), "f").limit(most_features).toPandas()
    tables.drop("counts")
    top = top.sort_values("f")
    feature = top.f.to_numpy(np.int64)
    r = np.log((top.n1.to_numpy() + 1) / (big1 + 2)) - np.log((top.n0.to_numpy() + 1) / (big0 + 2))

    def places(batches):
        place = np.full(1 << BITS, -1, np.int16)
        place[feature] = np.arange(len(feature))
        for b in batches:
            texts, rows = [t or "" for t in b.column(0).to_pylist()], []
            for a in range(0, len(texts), STEP):
                part = texts[a : a + STEP]
                seen = np.zeros((len(part), len(feature)), bool)
                for h, doc, ok in grams(part):
                    k = place[h]
                    at = np.flatnonzero((k >= 0) & ok)
                    seen[doc[at], k[at]] = True
                rows += [np.flatnonzero(s).astype("<i2").tobytes() for s in seen]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], ["k", "y"])

    got = sample.mapInArrow(places, "k binary, y int").toPandas().sort_values(["y", "k"])
    weight, bias = fit([np.frombuffer(k, "<i2").astype(np.int64) for k in got.k], got.y.to_numpy(float), r)
    weight = weight * r
    strong = np.abs(weight) > 1e-4
    return Model(feature[strong], weight[strong], bias)


def fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, l1: float = 2e-4, l2: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence times r: accelerated proximal gradient steps over all rows."""
    row = np.repeat(np.arange(len(rows)), [len(k) for k in rows])
    col = np.concatenate(rows) if len(row) else np.zeros(0, np.int64)
    scale = r[col]
    norm = np.bincount(row, scale * scale, len(rows)).max(initial=1.0) + 1
    step = 4.0 / max(np.bincount(row, scale * scale, len(rows)).mean() + 1, norm / 50)
    w, b = np.zeros(len(r)), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    loss = np.inf
    for _ in range(rounds):
        z = vb + np.bincount(row, v[col] * scale, len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        g = (p - y) / len(y)
        grad = np.bincount(col, g[row] * scale, len(r)) + l2 * v
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * g.sum()
        zn = nb + np.bincount(row, new[col] * scale, len(rows))
        now = float(np.mean(np.logaddexp(0, zn) - y * zn) + l1 * np.abs(new).sum() + l2 / 2 * (new @ new))
        if now > loss + 1e-12:  # too long a step: shorten it and start the momentum anew
            step, v, vb, t = step / 2, w.copy(), b, 1.0
            if step < 1e-6:
                break
            continue
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, t = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b), t2
        w, b = new, nb
        if loss - now < 1e-9:
            break
        loss = now
    return w, b


def score(model: Model, text_col: str = "text") -> Column:
    """The score of a text column, 0 to 1; null counts as empty. Vectorised, without a shuffle."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in texts]))

    return run(F.col(text_col))


def score_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, **options) -> DataFrame:
    """(id, held_out, score, predicted) for each row: a null text is scored as empty, a null id is never held out, repeated rows get
    the same score, other columns play no part."""
    model = train(documents, labels, id_col=id_col, text_col=text_col, folds=folds, **options)
    got = documents.select(id_col, F.coalesce(crc_mod(id_col, folds) == 0, F.lit(False)).alias("held_out"), score(model, text_col).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
