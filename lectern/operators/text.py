"""Term extraction and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A short list of English function words.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def phrases(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Runs of words between stop words and punctuation, in small letters."""
    stop = r"\b(?:" + "|".join(stopwords) + r")\b"
    cut = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s'-]+", "|"), r"\s+", " ")
    cut = F.regexp_replace(cut, rf"(?U){stop}", "|")
    return F.filter(F.transform(F.split(cut, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def rake(docs: DataFrame, item: str, text: str, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(item, term, score): a word's score is its degree (the lengths of the phrases it is in) over its frequency, a phrase's the sum of
    its words' (Rose et al., 2010), within each document. Phrases of a document stay in its row, so nothing is shuffled but the
    result of the explode by (document, word)."""
    p = docs.select(item, F.explode(phrases(F.col(text), stopwords)).alias("term"))
    # equal phrases of a document count once as a term, each time in the frequencies
    p = p.groupBy(item, "term").agg(F.count("*").alias("times"))
    w = p.select(item, "term", "times", F.split("term", " ").alias("words"))
    each = w.select(item, "term", F.explode("words").alias("word"), (F.col("times") * F.size("words")).alias("degree"), "times")
    score = each.groupBy(item, "word").agg((F.sum("degree") / F.sum("times")).alias("s"))
    return each.select(item, "term", "word").join(score, [item, "word"]).groupBy(item, "term").agg(F.sum("s").alias("score"))


def top_terms(terms: DataFrame, item: str, n: int | None = 50, ascending: bool = False) -> DataFrame:
    """Each document's n best terms, ties by the term (O3); all of them, ranked, if n is None."""
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("term")]
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def global_terms(terms: DataFrame) -> DataFrame:
    """(term, nb, inv_mean_score): in how many documents, and that number over the sum of the scores; 0 where the sum is 0."""
    total = F.sum("score")
    return terms.groupBy("term").agg(F.count("*").alias("nb"), F.coalesce(F.count("*") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("inv_mean_score"))


def textrank(docs: DataFrame, item: str, text: str, window: int = 2, rounds: int = 10, damping: float = 0.85, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(item, term, score): PageRank over the words of each document, linked where they are less than `window` words apart (Mihalcea and
    Tarau, 2004). A fixed number of rounds; what is missing to the limit falls by `damping` a round (100 rounds: below 1e-6). A
    document's graph is one row, so no round shuffles anything."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\s]+", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))
    seq = docs.select(item, words.alias("w"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window - 1)), lambda d: F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - d, F.lit(0))), F.slice("w", d + 1, F.greatest(F.size("w") - d, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    e = seq.select(item, F.explode(pairs).alias("p")).select(item, "p.a", "p.b").where("a <> b")
    e = e.unionByName(e.select(item, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = e.groupBy(item, "a").agg(F.array_sort(F.collect_list("b")).alias("near"))
    g = near.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("a", "near"))).alias("g"))
    g = g.select(item, F.transform("g", lambda x: x["a"]).alias("terms"), F.transform("g", lambda x: x["near"]).alias("near"))
    place = F.map_from_arrays("terms", F.sequence(F.lit(0), F.size("terms") - 1))
    g = g.withColumn("place", place)
    g = g.select(item, "terms", F.transform("near", lambda x: F.transform(x, lambda b: F.element_at("place", b))).alias("near"))
    g = g.select(item, "terms", "near", F.transform("near", lambda x: F.size(x).cast("double")).alias("deg"))

    def turn(scores: Column, _: Column) -> Column:
        given = F.zip_with(scores, "deg", lambda s, n: s / n)
        # an array of one struct holds what is given, so that it is computed once a round
        whole = F.transform(F.array(F.struct(given.alias("x"))), lambda one: F.transform("near", lambda to: F.aggregate(to, F.lit(0.0), lambda acc, j: acc + F.get(one["x"], j))))
        return F.transform(F.get(whole, F.lit(0)), lambda v: F.lit(1 - damping) + F.lit(damping) * v)

    scores = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("terms", lambda _: F.lit(1.0)), turn) if rounds else F.transform("terms", lambda _: F.lit(1.0))
    return g.select(item, F.explode(F.arrays_zip(F.col("terms").alias("term"), scores.alias("score"))).alias("x")).select(item, "x.term", "x.score")


def yake(docs: DataFrame, item: str, text: str, n: int = 50, stopwords: list[str] = STOPWORDS, size: int = 3) -> DataFrame:
    """(item, term, score): candidates of one to `size` words, lower is better (after Campos et al., 2020). A word's score is made of
    casing, position of the sentences, frequency, relatedness to different neighbours, spread over sentences; a candidate's is the
    product of its words' over its frequency times one plus their sum. Candidates are runs of words without punctuation that neither
    begin nor end with a stop word; one within counts by how often it stands between its neighbours. Similar candidates all stay.
    One vectorised pass, document by document."""
    kind = docs.schema[item].dataType.simpleString()

    def run(frames):
        import math
        import re
        import statistics
        from collections import Counter, defaultdict

        import pandas as pd

        for frame in frames:
            rows = []
            for key, body in zip(frame[item], frame[text], strict=True):
                chunks = [[re.findall(r"\w+", c) for c in re.split(r"[^\w\s'’-]+", s)] for s in re.split(r"[.!?\n]+", body or "")]
                sentences = [sum(s, []) for s in chunks]
                sentences = [s for s in sentences if s]
                tf, caps, where, left, right = Counter(), Counter(), defaultdict(list), defaultdict(Counter), defaultdict(Counter)
                for k, s in enumerate(sentences):
                    for j, word in enumerate(s):
                        w = word.lower()
                        tf[w] += 1
                        caps[w] += j > 0 and word[:1].isupper()
                        where[w].append(k)
                        if j:
                            left[w][s[j - 1].lower()] += 1
                            right[s[j - 1].lower()][w] += 1
                words = [w for w in tf if len(w) > 2 and w not in stopwords]
                if not words:
                    continue
                counts = [tf[w] for w in words]
                mean, sd, most = statistics.fmean(counts), statistics.pstdev(counts), max(tf.values())
                single = {}
                for w in words:
                    case = caps[w] / (1 + math.log(tf[w]))
                    position = math.log(math.log(3 + statistics.median(where[w])))
                    frequency = tf[w] / (mean + sd)
                    spread = len(set(where[w])) / len(sentences)
                    apart = sum(len(side[w]) / max(1, sum(side[w].values())) for side in (left, right))
                    related = 1 + apart * tf[w] / most
                    single[w] = related * position / (case + frequency / related + spread / related)
                times = Counter()
                for c in (c for s in chunks for c in s):
                    c = [w.lower() for w in c]
                    times.update(tuple(c[j : j + k]) for k in range(1, size + 1) for j in range(len(c) - k + 1) if c[j] in single and c[j + k - 1] in single)
                found = []
                for run_, count in times.items():
                    if len(run_) == 1:
                        found.append((single[run_[0]], run_[0]))
                        continue
                    product, total = 1.0, 0.0
                    for j, w in enumerate(run_):
                        if w in single:
                            product *= single[w]
                            total += single[w]
                        else:  # 1 - P(before, w) P(w, after)
                            chance = 1 - right[run_[j - 1]][w] / tf[run_[j - 1]] * right[w][run_[j + 1]] / tf[run_[j + 1]]
                            product *= 1 + chance
                            total -= chance
                    found.append((product / (count * (1 + total)), " ".join(run_)))
                rows += [(key, w, s) for s, w in sorted(found)[:n]]
            yield pd.DataFrame(rows, columns=[item, "term", "score"])

    return docs.select(item, text).mapInPandas(run, f"`{item}` {kind}, term string, score double")


def corpus(docs: DataFrame, collection: Column, year: Column, label: Column, body: Column) -> DataFrame:
    """(collection, value): a header line of starred variables, then the text (K8)."""
    head = F.concat(F.lit("**** *coll_"), collection, F.lit(" *year_"), F.coalesce(year.cast("string"), F.lit("NA")), F.lit(" *label_"), label)
    return docs.select(collection.alias("collection"), F.concat(head, F.lit("\n"), F.coalesce(body, F.lit(""))).alias("value"))
