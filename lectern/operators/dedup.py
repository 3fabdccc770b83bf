"""Entity resolution: quality-ranked survivors with field-wise completion and provenance (G1, A1-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality(columns: list[str]) -> Column:
    """How many of the columns are there (A2)."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of several rows, with their number (A1); a NULL key is no key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dedup_pass(df: DataFrame, key: str, columns: list[str], order: str, archive: str = "archive", count: str | None = None) -> DataFrame:
    """One row for each key: the survivor is the first of the rows with the largest quality; each column it lacks is filled with the first
    value that is there, in row order; archive lists all archives in row order, each occurrence of the survivor's with a star. Single
    rows stay as they are. The order column becomes one that sorts merged rows behind the others, by key.

    `count`: name of a further column with the number of rows that each has been. Rows without a key don't take part in the shuffle. All aggregates but the list of archives, which is the result itself,
    combine before the shuffle."""
    own = F.struct(F.lit(0).alias("late"), F.lit("").alias("key"), F.col(order).alias("ord"))
    names = [c for c in columns if c not in (key, archive)]
    value = F.struct(*[F.col(c).alias(c) for c in [*names, archive]])
    place = F.col(order)
    aggregates = [F.count("*").alias("_n"), F.min_by(value, F.struct((-F.col("_q")).alias("q"), place.alias("o"))).alias("_s"), F.min(place).alias("_o")]
    aggregates += [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_first_{c}") for c in names]
    aggregates.append(F.array_sort(F.collect_list(F.when(F.col(archive).isNotNull(), F.struct(place.alias("o"), F.col(archive).alias("a"))))).alias("_all"))
    keyed = df.where(F.col(key).isNotNull()).withColumn("_q", quality(columns)).groupBy(key).agg(*aggregates)
    several = F.col("_n") > 1
    joined = F.array_join(F.transform("_all", lambda x: x["a"]), ";")
    winner = F.col("_s").getField(archive)
    starred = F.when(winner.isNotNull(), F.replace(joined, winner, F.concat(winner, F.lit("*")))).otherwise(F.nullif(joined, F.lit("")))
    out = [F.col(key)]
    out += [F.coalesce(F.col("_s").getField(c), F.col(f"_first_{c}")).alias(c) for c in names]
    out.append(F.when(several, starred).otherwise(winner).alias(archive))
    late = F.struct(several.cast("int").alias("late"), F.when(several, F.col(key).cast("string")).otherwise("").alias("key"), F.col("_o").alias("ord"))
    rows = [] if count is None else [F.col("_n").alias(count)]
    one = [] if count is None else [F.lit(1).cast("long").alias(count)]
    merged = keyed.select(*out, late.alias(order), *rows)
    without = df.where(F.col(key).isNull()).select(*[F.col(c) for c in columns], own.alias(order), *one)
    return merged.select(*columns, order, *([] if count is None else [count])).unionByName(without)


def deduplicate(df: DataFrame, columns: list[str], order: str, keys: tuple[str, ...] = ("DOI", "title"), archive: str = "archive") -> DataFrame:
    """The passes one after the other; a later one sees what an earlier one has merged. Not a closure over both keys."""
    for key in keys:
        df = dedup_pass(df, key, columns, order, archive)
    return df
