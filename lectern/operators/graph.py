"""Citation graphs: edges from older to newer works, and their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import doi_url, parse_citations
from .filters import valid_doi


def mentions(papers: DataFrame, doi: str = "DOI", extra: str = "Extra", extra_format: str = "map") -> DataFrame:
    """(own, other, outward, ord, pos): every neighbour a row mentions, in order; outward where the neighbour is the newer work. extra_format
    "list": a plain list of newer works (G2a)."""
    if extra_format == "list":
        got = F.transform(F.coalesce(F.from_json(F.replace(F.col(extra), F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("other"), F.lit(True).alias("outward")))
    else:
        m = parse_citations(extra)
        none = F.array().cast("array<string>")
        got = F.concat(F.transform(F.coalesce(m["citing"], none), lambda x: F.struct(x.alias("other"), F.lit(True).alias("outward"))), F.transform(F.coalesce(m["cited"], none), lambda x: F.struct(x.alias("other"), F.lit(False).alias("outward"))))
    rows = papers.select(F.col(doi).alias("own"), "ord", F.posexplode(got).alias("pos", "m"))
    return rows.select("own", "ord", "pos", "m.other", "m.outward")


def edges(found: DataFrame) -> DataFrame:
    """Distinct (Source, Target) without loops; rows without a valid DOI of their own give none."""
    e = found.where(valid_doi("own") & F.col("other").isNotNull())
    e = e.select(F.when(F.col("outward"), F.col("own")).otherwise(F.col("other")).alias("Source"), F.when(F.col("outward"), F.col("other")).otherwise(F.col("own")).alias("Target"))
    return e.where("Source <> Target").distinct()


def nodes(papers: DataFrame, found: DataFrame, end_date: str = "2023", columns: tuple[str, ...] = ("Label", "origin", "Year", "Url", "Title")) -> DataFrame:
    """Every neighbour and every known paper with a DOI: the known ones with their own attributes (the first row of a DOI), the others as
    stubs "new_<n>", numbered in the order of their first mention, with the year of the row that mentions them first.

    Stubs are numbered by position, which needs their total order: their first mentions are range-partitioned and only counts by
    range meet."""
    known = papers.where(valid_doi("DOI")).groupBy(F.col("DOI").alias("Id")).agg(*[F.min_by(c, "ord").alias(c) for c in columns])
    first = found.where(F.col("other").isNotNull()).groupBy(F.col("other").alias("Id")).agg(F.min(F.struct("ord", "outward", "pos")).alias("at"))
    stubs = first.join(known.select("Id"), "Id", "left_anti")
    years = papers.select(F.col("ord").alias("o"), F.col("Year").alias("y"))
    stubs = stubs.join(years, F.col("at.ord") == F.col("o"))
    numbered = ranked(stubs, [F.col("at.ord"), ~F.col("at.outward"), F.col("at.pos"), F.col("Id")], F.col("at.ord"))
    made = numbered.select("Id", F.concat(F.lit("new_"), F.col("rank")).alias("Label"), F.lit("new paper").alias("origin"), F.col("y").alias("Year"), doi_url("Id").alias("Url"), F.lit(None).cast("string").alias("Title"))
    made = made.select("Id", *[F.col(c) if c in made.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return known.select("Id", *columns).unionByName(made).withColumn("End_Date", F.lit(end_date))


def ranked(df: DataFrame, order: list, by: Column) -> DataFrame:
    """rank: 0, 1, ... in a total order that begins with the number `by`, without bringing the rows together: ranges of equal width of that number,
    ranks within them, and the ranges' sizes, one row each, added up. The ranges follow from the data alone, so a
    recomputed task gives the same ranks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    keyed = df.crossJoin(F.broadcast(ends)).withColumn("_p", F.floor((by - F.col("_low")) * parts / (F.col("_high") - F.col("_low") + 1)))  # one row
    within = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return within.join(F.broadcast(before), "_p").withColumn("rank", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before", "_low", "_high")


def build(papers: DataFrame, extra_format: str = "map", **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers with the columns ord, DOI, Extra, Year, Label, Title, Url, origin; more columns, such as code and
    bench, come along if they are named in columns (G2b)."""
    found = mentions(papers, extra_format=extra_format)
    return nodes(papers, found, **options), edges(found)
