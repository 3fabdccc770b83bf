"""Triples: lookups by title, paths, and tags from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import norm_missing

from ..functions.strings import swap_namespace, tag_value, title_key


def objects(triples: DataFrame, predicate: str, subject: str = "s", name: str = "o") -> DataFrame:
    """(subject, name) of one predicate."""
    return triples.where(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(name))


def path(triples: DataFrame, *predicates: str, subject: str = "s", name: str = "o") -> DataFrame:
    """(subject, name): what the predicates lead to, one after the other."""
    out = objects(triples, predicates[0], subject, name)
    for p in predicates[1:]:
        step = objects(triples, p, "_s", "_o")
        out = out.join(step, out[name] == step["_s"]).select(subject, F.col("_o").alias(name))
    return out


def unique_match(items: DataFrame, subjects: DataFrame, title: str, subject: str = "s", subject_title: str = "o", exact: bool = False) -> DataFrame:
    """Items with the only subject of their title: small letters, without a final full stop (J15); exact: as they are. Titles that several
    subjects have match nothing."""
    key = (lambda c: c) if exact else title_key
    one = subjects.select(key(F.col(subject_title)).alias("_t"), F.col(subject).alias("subject")).distinct().groupBy("_t").agg(F.count("*").alias("_n"), F.min("subject").alias("subject")).where("_n = 1")
    return items.join(one, key(F.col(title)) == F.col("_t")).drop("_t", "_n")


def fallback(items: DataFrame, *lookups: tuple[DataFrame, str, str], name: str = "value") -> DataFrame:
    """The value of the first lookup (frame, key, value) that has the item's key; each frame's first value of a key counts."""
    cols = []
    for k, (frame, key, value) in enumerate(lookups):
        one = frame.groupBy(F.col(key).alias(f"_k{k}")).agg(F.min(value).alias(f"_v{k}"))
        items = items.join(one, F.col(key) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        cols.append(F.col(f"_v{k}"))
    return items.withColumn(name, F.coalesce(*cols)).drop(*[f"_v{k}" for k in range(len(cols))])


def new_tags(tags: Column, dim: str, names: Column, min_bindings: int = 2) -> Column:
    """Tags of a dimension that an item has none of, from at least min_bindings names, less those it has in any case."""
    none = F.array().cast("array<string>")
    empty = ~F.exists(tags, lambda t: F.startswith(t, F.lit(dim + ":")) & ~F.contains(t, F.lit("?")))
    own = F.transform(tags, lambda t: F.upper(t))
    made = F.filter(F.array_distinct(F.transform(F.coalesce(names, none), lambda n: tag_value(dim, n))), lambda t: ~F.array_contains(own, F.upper(t)))
    return F.when(empty & (F.size(F.coalesce(names, none)) >= min_bindings), made).otherwise(none)


def enrich_items(items: DataFrame, triples: DataFrame, predicates: dict[str, tuple[str, ...]], model: tuple[str, ...], repository: tuple[str, ...], vocabulary: list[str], namespaces: tuple[str, str], min_bindings: int = 2) -> DataFrame:
    """Items (key, title, tags, shortTitle, archive, archiveLocation) that match one subject, with tags for empty dimensions; methods in the
    vocabulary of models go to PTM instead of ARCHI; a short title if there is one model and none yet; the subject's
    address as archive; its repository, if it has one only (G5)."""
    matched = unique_match(items, objects(triples, "dcterms:title"), "title")
    for dim, steps in predicates.items():
        found = path(triples, *steps).groupBy(F.col("s").alias("_s")).agg(F.array_sort(F.collect_set("o")).alias(f"_{dim}"))
        matched = matched.join(found, F.col("subject") == F.col("_s"), "left").drop("_s")
    for steps, name in ((model, "_models"), (repository, "_repos")):
        found = path(triples, *steps).groupBy(F.col("s").alias("_s")).agg(F.array_sort(F.collect_set("o")).alias(name))
        matched = matched.join(found, F.col("subject") == F.col("_s"), "left").drop("_s")
    words = [v.upper() for v in vocabulary]
    if "ARCHI" in predicates:
        known = lambda x: F.upper(x).isin(words)
        matched = matched.withColumn("_PTM", F.filter("_ARCHI", known)).withColumn("_ARCHI", F.filter("_ARCHI", lambda x: ~known(x)))
    dims = [*predicates, *(["PTM"] if "ARCHI" in predicates else [])]
    added = F.array_distinct(F.flatten(F.array(*[new_tags(F.col("tags"), d, F.col(f"_{d}"), 1 if d == "PTM" else min_bindings) for d in dims])))
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    short = F.when(F.length(F.coalesce("shortTitle", F.lit(""))) < 2, F.coalesce(only("_models"), "shortTitle")).otherwise(F.col("shortTitle"))
    return matched.select("key", "title", F.concat("tags", added).alias("tags"), short.alias("shortTitle"), swap_namespace("subject", *namespaces).alias("archive"), F.coalesce(only("_repos"), "archiveLocation").alias("archiveLocation"))


def papers_by_doi(items: DataFrame, triples: DataFrame, predicate: str, doi: str = "DOI") -> DataFrame:
    """The items whose DOI exactly one subject of the triples (s, p, o) has under the predicate, with that subject as `paper` (S26). Missing DOIs find nothing."""
    found = triples.where(F.col("p") == predicate).groupBy(F.col("o").alias("_doi")).agg(F.countDistinct("s").alias("_n"), F.min("s").alias("paper")).where("_n = 1").drop("_n")
    return items.where(norm_missing(doi).isNotNull()).join(found, F.col(doi) == F.col("_doi")).drop("_doi")
