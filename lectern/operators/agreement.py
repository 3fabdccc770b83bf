"""Annotation differences and inter-annotator agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import clean_tag

EMPTY = "array<string>"


def dim_of(t: Column) -> Column:
    return F.trim(F.substring_index(t, ":", 1))


def compare(init: Column, annotated: Column, clean: bool = True, compat: bool = False) -> Column:
    """struct(same, updated, deleted, added) of two tag sets (M1). Of the first set's tags that are gone, an unfilled one whose dimension the
    annotator has is updated to the annotator's tags of that dimension, others are deleted; what is new, not an update and not unfilled
    is added. compat: the dimension may stand anywhere in a tag."""
    none = F.array().cast(EMPTY)
    a = F.array_distinct(F.transform(F.coalesce(init, none), clean_tag) if clean else F.coalesce(init, none))
    b = F.array_distinct(F.transform(F.coalesce(annotated, none), clean_tag) if clean else F.coalesce(annotated, none))
    of = (lambda t, d: F.contains(t, d)) if compat else (lambda t, d: dim_of(t) == d)
    gone = F.array_except(a, b)
    open_ = F.filter(gone, lambda t: F.contains(t, F.lit("?")) & F.exists(b, lambda n: of(n, dim_of(t))))
    updated = F.array_distinct(F.flatten(F.transform(open_, lambda t: F.filter(b, lambda n: of(n, dim_of(t))))))
    added = F.filter(F.array_except(F.array_except(b, a), updated), lambda t: ~F.contains(t, F.lit("?")))
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("same"), F.array_sort(updated).alias("updated"), F.array_sort(F.array_except(gone, open_)).alias("deleted"), F.array_sort(added).alias("added"))


def differences(cube: DataFrame, base: str = "init") -> DataFrame:
    """(doc_type, url, annotator, diff) from the long table (doc_type, url, annotator, tag): each annotator against the base of
    the same url (J25)."""
    sets = cube.groupBy("doc_type", "url", "annotator").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    first = sets.where(F.col("annotator") == base).select("doc_type", "url", F.col("tags").alias("base_tags"))
    return sets.where(F.col("annotator") != base).join(first, ["doc_type", "url"]).withColumn("diff", compare(F.col("base_tags"), F.col("tags")))


def categories(diffs: DataFrame, kept: Column) -> DataFrame:
    """(doc_type, url, annotator, dim, category): the sorted values of each dimension, joined; kept: the tags that count."""
    rows = diffs.select("doc_type", "url", "annotator", F.explode(kept).alias("tag"))
    rows = rows.withColumn("dim", dim_of(F.col("tag")))
    return rows.groupBy("doc_type", "url", "annotator", "dim").agg(F.array_join(F.array_sort(F.collect_set("tag")), ";").alias("category"))


def dense(cats: DataFrame, raters: DataFrame, dims: DataFrame) -> DataFrame:
    """Every (doc_type, url, annotator) with every dimension of its type; an absent one is DIM:?."""
    grid = raters.join(dims, "doc_type")
    return grid.join(cats, ["doc_type", "url", "annotator", "dim"], "left").withColumn("category", F.coalesce("category", F.concat("dim", F.lit(":?"))))


def contingency(cats: DataFrame, keys: list[str], subject: str = "url") -> DataFrame:
    """Raters for each (keys, subject, category)."""
    return cats.groupBy(*keys, subject, "category").agg(F.count("*").alias("n"))


def fleiss(table: DataFrame, keys: list[str], subject: str = "url", category: str = "category", n: str = "n") -> DataFrame:
    """(keys, n_subjects, n_raters, kappa) from counts (M2): P_i = (sum n_ic^2 - n) / (n (n - 1)), kappa = (mean P_i - P_e) / (1 - P_e).
    Keys whose subjects have different numbers of raters, or fewer than two, or one category only (P_e = 1), have a NULL kappa."""
    by_subject = table.groupBy(*keys, subject).agg(F.sum(n).alias("r"), F.sum(F.col(n) * F.col(n)).alias("sq"))
    p = F.when(F.col("r") > 1, (F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1)))
    subjects = by_subject.groupBy(*keys).agg(F.count("*").alias("n_subjects"), F.max("r").alias("n_raters"), F.min("r").alias("r0"), F.avg(p).alias("p_mean"))
    totals = table.groupBy(*keys, category).agg(F.sum(n).alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum("c").alias("c1"))
    joined = subjects.join(totals, keys)
    pe = F.col("c2") / (F.col("c1") * F.col("c1"))
    kappa = F.when((F.col("r0") == F.col("n_raters")) & (F.col("r0") > 1) & (pe < 1), (F.col("p_mean") - pe) / (1 - pe))
    return joined.select(*keys, "n_subjects", "n_raters", kappa.alias("kappa"))


def cohen(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, n, kappa) of rated items (M3): po is the share of equal codes, pe the sum over codes of the product of both shares. NULL where pe
    is 1."""
    n = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    each = pairs.select(*keys, F.explode(F.array(F.struct(F.col(a).alias("code"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).alias("code"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("e"))
    shares = each.groupBy(*keys, "e.code").agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y")).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    joined = n.join(shares, keys)
    pe = F.col("xy") / (F.col("n") * F.col("n"))
    return joined.select(*keys, "n", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def annotator_pairs(cats: DataFrame, code: str = "category") -> DataFrame:
    """(doc_type, url, annotator1, annotator2, dim, a, b): unordered pairs of annotators of one url (J24). A url has a handful of
    annotators, so pairs stay few."""
    x = cats.select("doc_type", "url", "dim", F.col("annotator").alias("annotator1"), F.col(code).alias("a"))
    y = cats.select("doc_type", "url", "dim", F.col("annotator").alias("annotator2"), F.col(code).alias("b"))
    return x.join(y, ["doc_type", "url", "dim"]).where("annotator1 < annotator2")


def ordinal_codes(cats: DataFrame) -> DataFrame:
    """code: the rank of the category within its dimension, from 0, shared across dimensions as in the original (M3)."""
    distinct = cats.select("doc_type", "dim", "category").distinct()
    ranked = distinct.groupBy("doc_type", "dim").agg(F.array_sort(F.collect_set("category")).alias("all"))
    return cats.join(ranked, ["doc_type", "dim"]).withColumn("code", F.array_position("all", F.col("category")) - 1).drop("all")


def all_finished(cube: DataFrame) -> DataFrame:
    """(doc_type, url) of which every annotator has the tag DONE (F14); init and resolution don't count."""
    done = cube.where(~F.col("annotator").isin("init", "resolution")).groupBy("doc_type", "url", "annotator").agg(F.bool_or(F.col("tag") == "DONE").alias("d"))
    return done.groupBy("doc_type", "url").agg(F.bool_and("d").alias("d")).where("d").drop("d")


def roll_up(values: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Sum, number and mean by each of dims alone, in one pass."""
    sets = [[F.col(d)] for d in dims]
    out = values.groupingSets(sets, *dims).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.grouping(d).alias(f"_g{k}") for k, d in enumerate(dims)])
    by = F.coalesce(*[F.when(F.col(f"_g{k}") == 0, F.lit(d)) for k, d in enumerate(dims)])
    member = F.coalesce(*[F.when(F.col(f"_g{k}") == 0, F.col(d).cast("string")) for k, d in enumerate(dims)])
    return out.select(by.alias("level"), member.alias("member"), "total", "n", "mean")


def activity(diffs: DataFrame) -> dict[str, DataFrame]:
    """The activity statistics (A22) over (doc_type, url, annotator, diff) rows, base excluded, resolution included."""
    changed = F.concat("diff.added", "diff.updated", "diff.deleted")
    long = diffs.select("doc_type", "url", "annotator", F.explode(changed).alias("tag")).withColumn("dim", dim_of(F.col("tag")))
    held = diffs.select("doc_type", "url", "annotator", F.explode(F.concat("diff.added", "diff.updated", "diff.same")).alias("tag")).withColumn("dim", dim_of(F.col("tag")))
    per = held.groupBy("doc_type", "url", "annotator", "dim").agg(F.countDistinct("tag").alias("n"))
    count = F.count("*").alias("n")
    return {
        "act_by_papers": long.groupBy("url").agg(count),
        "act_by_user": long.groupBy("annotator").agg(count),
        "act_by_type": long.groupBy("doc_type").agg(count),
        "tags_by_type": held.groupBy("doc_type").agg(count),
        "tags_by_dim": held.groupBy("dim").agg(count),
        "tags_by_papers": held.groupBy("url").agg(count),
        "ambiguous_dims": held.groupBy("url", "dim").agg(F.countDistinct("tag").alias("n")).where("n > 1").groupBy("dim").agg(count),
        "multi_valued_dims": per.where("n > 1").groupBy("dim").agg(count),
        "deleted_by_dim": diffs.select(F.explode("diff.deleted").alias("tag")).groupBy(dim_of(F.col("tag")).alias("dim")).agg(count),
    }
