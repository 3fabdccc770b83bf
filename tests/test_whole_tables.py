"""Queries over all events, and terms against plain Python."""

import datetime
import math
import random
import re
from collections import defaultdict

from lectern.operators import text
from lectern.plans import queries as plain


def events(spark, path, rows):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(k, u, at(h), e, v) for k, (u, h, e, v) in enumerate(rows)], "event_id long, user_id long, ts timestamp, event_type string, value double")
    df.write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")


def test_every_event_counts(spark, tmp_path):
    same = [(u, h, "view", 1.0) for u in (3, 6) for h in range(20)]
    events(spark, tmp_path / "a", same)
    events(spark, tmp_path / "b", [*same, (3, 23, "late", 99.0)])  # the 21st event of user 3, of a high value
    kappa = [plain.QUERIES["fleiss_kappa_all"](spark, str(tmp_path / x)).collect()[0] for x in "ab"]
    assert kappa[0].n_raters == kappa[1].n_raters == 24 and kappa[0].kappa != kappa[1].kappa
    assert {r.user_id: r.tags for r in plain.QUERIES["tag_listed_all"](spark, str(tmp_path / "b")).collect()} == {3: "late;view", 6: "view"}


def page_rank(words):
    near = defaultdict(set)
    for a, b in zip(words, words[1:], strict=False):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = dict.fromkeys(near, 1.0)
    while True:
        new = {w: 0.15 + 0.85 * sum(score[x] / len(near[x]) for x in near[w]) for w in near}
        if max(abs(new[w] - score[w]) for w in near) < 1e-13:
            return new
        score = new


def test_textrank_is_page_rank(spark, tmp_path):
    rng = random.Random(3)
    names = [f"word{k}" for k in range(40)]
    docs = {k: [rng.choice(names) for _ in range(n)] for k, n in enumerate((5, 30, 90))}
    spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = defaultdict(dict)
    for r in plain.QUERIES["textrank_terms"](spark, str(tmp_path)).collect():
        got[r.item_id][r.term] = r.score
    for k, words in docs.items():
        want = page_rank(words)
        assert set(got[k]) == set(want) and all(abs(got[k][w] - want[w]) < 1e-5 for w in want)


def test_yake_has_phrases(spark):
    body = "Deep neural network. The deep neural network, state of art methods. Network of networks"
    got = {r.term: r.score for r in text.yake(spark.createDataFrame([(1, body)], "d long, t string"), "d", "t").collect()}
    want, stop = set(), text.STOPWORDS
    for part in re.split(r"[.,]", body.lower()):
        w = part.split()
        want |= {" ".join(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1) if all(x not in stop and len(x) > 2 for x in (w[j], w[j + k - 1]))}
    assert set(got) == want and "deep neural network" in want and "state of art" in want and "network state" not in want
    s = [got[w] for w in ("deep", "neural", "network")]  # the phrase stands twice
    assert math.isclose(got["deep neural network"], math.prod(s) / (2 * (1 + sum(s))))


def test_fuzzy_title_reads_all_digits(spark, tmp_path):
    spark.createDataFrame([(7, "Supplier#000000007")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in (7, 8, 1200007)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(r.c_custkey for r in plain.QUERIES["fuzzy_title_whole"](spark, str(tmp_path)).collect()) == [7, 8]
