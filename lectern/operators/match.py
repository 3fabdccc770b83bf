"""Fuzzy matching of titles and repair of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import squash, within_one_edit
from .filters import valid_doi


def deletions(s: Column) -> Column:
    """Hashes of the text and of all that it becomes without one of its characters: 8 bytes for each, whatever its length. Two texts within one edit
    share one of these."""
    less = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.xxhash64(F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(s)), F.when(F.length(s) > 0, less).otherwise(F.array().cast("array<bigint>"))))


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_id: str, left_key: str, right_id: str, right_key: str) -> DataFrame:
    """(left_id, right_id) whose keys are within one edit. Equal keys meet directly; the rest by their one-deletion neighbourhoods, so that
    only candidates are compared."""
    a = left.select(F.col(left_id).alias("l"), F.col(left_key).alias("lk")).where("lk is not null")
    b = right.select(F.col(right_id).alias("r"), F.col(right_key).alias("rk")).where("rk is not null")
    x = a.select("l", "lk", F.explode(deletions(F.col("lk"))).alias("h"))
    y = b.select("r", "rk", F.explode(deletions(F.col("rk"))).alias("h"))
    met = x.join(y, "h").select("l", "lk", "r", "rk").distinct()
    return met.where(within_one_edit("lk", "rk")).select(F.col("l").alias(left_id), F.col("r").alias(right_id))


def first_match(left: DataFrame, right: DataFrame, on: str, order: str, columns: list[str]) -> DataFrame:
    """Left join with the first row of each key."""
    one = right.groupBy(F.col(on).alias("_k")).agg(*[F.min_by(c, order).alias(c) for c in columns])
    return left.join(one, left[on] == one["_k"], "left").drop("_k")


def top_candidates(candidates: DataFrame, item: str, n: int = 2, rank: str = "rank") -> DataFrame:
    """Each item's n most relevant (O2)."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(rank))).where(F.col("_r") <= n).drop("_r")


def doi_by_title(items: DataFrame, candidates: DataFrame, key: str = "key", n: int = 2) -> DataFrame:
    """(key, found_doi): of an item's first n candidates (key, rank, title, DOI) the first whose squashed title is within one edit."""
    top = top_candidates(candidates, key, n).select(F.col(key).alias("_k"), F.col("rank").alias("_r"), squash("title").alias("_t"), F.col("DOI").alias("_d"))
    met = items.select(key, squash("title").alias("_own")).join(top, F.col(key) == F.col("_k")).where(within_one_edit("_own", "_t"))
    return met.groupBy(key).agg(F.min_by("_d", "_r").alias("found_doi"))


def repair_dois(items: DataFrame, candidates: DataFrame, key: str = "key", n: int = 2) -> DataFrame:
    """Items without a valid DOI get the one of their title, else "not found"; others keep theirs."""
    missing = items.where(~valid_doi("DOI"))
    got = doi_by_title(missing, candidates, key, n).withColumnRenamed(key, "_key")
    joined = items.join(got, items[key] == got["_key"], "left")
    return joined.select(*[F.when(valid_doi("DOI"), F.col("DOI")).otherwise(F.coalesce("found_doi", F.lit("not found"))).alias("DOI") if c == "DOI" else items[c] for c in items.columns])
