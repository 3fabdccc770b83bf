"""Tag vocabularies: counts, roll-ups, pivots, rewriting and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import dimension, title_case
from ..schema import norm_missing


def exploded(df: DataFrame, *columns: str, sep: str = ";") -> DataFrame:
    """One row for each tag of the ;-joined columns; missing ones give none."""
    lists = [F.coalesce(F.split(c, sep), F.array().cast("array<string>")) for c in columns]
    return df.withColumn("tag", F.explode(F.concat(*lists))).where(norm_missing("tag").isNotNull())


def frequency(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, nb)."""
    return tags.where(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("nb"))


def thresholds(freq: DataFrame, levels: tuple[int, ...] = (1, 100, 1000)) -> DataFrame:
    """How many tags occur more often than each level."""
    return freq.agg(*[F.count_if(F.col("nb") > n).alias(f"over_{n}") for n in levels])


def roll_up(freq: DataFrame) -> DataFrame:
    """Sums by the upper-case prefix before the colon."""
    level = F.upper(F.trim(F.substring_index("tag", ":", 1)))
    return freq.groupBy(level.alias("level1")).agg(F.sum("nb").alias("nb"))


def key_values(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, key, value, nb) of trimmed upper-case tags."""
    t = F.upper(F.trim(tag))
    k = F.trim(F.substring_index(t, ":", 1))
    v = F.when(F.contains(t, F.lit(":")), F.trim(F.substring(t, F.length(F.substring_index(t, ":", 1)) + 2, F.lit(1_000_000))))
    return tags.select(t.alias("tag"), k.alias("key"), v.alias("value")).groupBy("tag", "key", "value").agg(F.count("*").alias("nb"))


def pivoted(tags: DataFrame, item: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """One column a key with the values, sorted and ,-joined (A14). The keys are given, so no job is spent on finding them."""
    return tags.groupBy(item).pivot(key, keys).agg(F.array_join(F.array_sort(F.collect_set(value)), ","))


def prefixes(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """Distinct dimensions."""
    return tags.select(F.trim(F.substring_index(tag, ":", 1)).alias("prefix")).distinct()


def vocabulary(names: Column) -> Column:
    """Distinct upper-case names."""
    return F.array_distinct(F.transform(names, lambda x: F.upper(x)))


def replace_tags(tags: DataFrame, table: DataFrame, item: str, dimensions: list[str]) -> DataFrame:
    """(item, tags, changed): each tag by its rule: replace_by, else keep, else delete, else the values of the dimension columns as DIM:value;
    a tag without a rule stays. PWC: goes from all (G6, J20). The table of rules is a vocabulary; it is joined by Spark's own choice."""
    old = F.col("tag")
    cells = [F.when(norm_missing(d).isNotNull(), F.concat(F.lit(dimension(d) + ":"), F.col(d))) for d in dimensions]
    by_dim = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<string>")
    new = (
        F.when(F.col("_rule").isNull(), F.array(old))
        .when(norm_missing("replace_by").isNotNull(), F.array("replace_by"))
        .when(norm_missing("keep").isNotNull(), F.array(old))
        .when(norm_missing("delete").isNotNull(), F.array().cast("array<string>"))
        .when(F.size(by_dim) > 0, by_dim)
        .otherwise(F.array(old))
    )
    rules = table.select(F.col("tag").alias("_rule"), "replace_by", "keep", "delete", *dimensions)
    joined = tags.join(rules, tags["tag"] == rules["_rule"], "left")
    rows = joined.select(item, old.alias("old"), F.explode_outer(new).alias("new")).withColumn("new", F.replace("new", F.lit("PWC:"), F.lit("")))
    out = rows.groupBy(item).agg(F.array_sort(F.collect_set("old")).alias("before"), F.array_sort(F.collect_set("new")).alias("tags"))
    return out.select(item, "tags", (F.col("before") != F.col("tags")).alias("changed"))


def fill_required(tags: Column, required: list[str], normalise: bool = True) -> Column:
    """The tags of required dimensions that are filled, in canonical form and distinct, then DIM:? for each dimension that has none
    (G7)."""
    dim = lambda t: F.trim(F.substring_index(t, ":", 1))
    value = lambda t: F.substring(t, F.length(F.substring_index(t, ":", 1)) + 2, F.lit(1_000_000))
    held = F.filter(tags, lambda t: dim(t).isin(required) & ~F.contains(t, F.lit("?")))
    if normalise:
        held = F.transform(held, lambda t: F.concat(dim(t), F.lit(":"), F.regexp_replace(title_case(value(t)), r"\s", "")))
    held = F.array_distinct(held)
    there = F.transform(held, dim)
    need = F.filter(F.array(*[F.lit(r) for r in required]).cast("array<string>"), lambda r: ~F.array_contains(there, r))
    return F.concat(held, F.transform(need, lambda r: F.concat(r, F.lit(":?"))))


def apply_policy(tags: Column, keep: list[str], add: list[str], delete: list[str]) -> Column:
    """Unfilled tags of `delete` go; each prefix of `keep` and `add` that is absent comes in as DIM:?."""
    there = F.transform(tags, lambda t: F.trim(F.substring_index(t, ":", 1)))
    rest = F.filter(tags, lambda t: ~t.isin([f"{d}:?" for d in delete]))
    need = F.filter(F.array(*[F.lit(k) for k in [*keep, *add]]).cast("array<string>"), lambda k: ~F.array_contains(there, k))
    return F.concat(rest, F.transform(need, lambda k: F.concat(k, F.lit(":?"))))


def add_missing(tags: Column, tag: str) -> Column:
    """With the tag, if it was not there."""
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, tag))


def tag_listed(items: DataFrame, ids: DataFrame, key: str, tags: str, tag: str) -> DataFrame:
    """Items of the list get the tag."""
    listed = ids.select(F.col(key).alias("_id")).distinct()
    joined = items.join(listed, items[key] == listed["_id"], "left")
    return joined.select(*[F.when(F.col("_id").isNotNull(), add_missing(F.col(tags), tag)).otherwise(F.col(tags)).alias(c) if c == tags else items[c] for c in items.columns])


def children(collections: DataFrame) -> DataFrame:
    """Collections with their parent's name."""
    parent = collections.select(F.col("key").alias("_p"), F.col("name").alias("parent_name"))
    return collections.join(parent, F.col("parentCollection") == F.col("_p"), "left").drop("_p")
