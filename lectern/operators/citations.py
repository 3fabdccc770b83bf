"""Citation enrichment, counts and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import bare_doi, parse_citations, year_of
from .filters import has_citations


def enrich(records: DataFrame, citations: DataFrame, doi: str = "DOI") -> DataFrame:
    """Records with extra (JSON), nb_cited (references) and nb_citation (citing works), from an edge table (citing, cited). One pass
    over the edges in each direction; a record without edges gets zeros (J2, A6)."""
    refs = citations.groupBy(F.col("citing").alias("_a")).agg(F.array_sort(F.collect_set("cited")).alias("_cited"))
    cits = citations.groupBy(F.col("cited").alias("_b")).agg(F.array_sort(F.collect_set("citing")).alias("_citing"))
    keyed = records.withColumn("_doi", bare_doi(doi))
    joined = keyed.join(refs, F.col("_doi") == F.col("_a"), "left").join(cits, F.col("_doi") == F.col("_b"), "left")
    none = F.array().cast("array<string>")
    cited, citing = F.coalesce("_cited", none), F.coalesce("_citing", none)
    return joined.select(*records.columns, F.to_json(F.struct(citing.alias("citing"), cited.alias("cited"))).alias("extra"), F.size(cited).cast("long").alias("nb_cited"), F.size(citing).cast("long").alias("nb_citation"))


def counts(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Distinct partners of each key."""
    return edges.groupBy(key).agg(F.countDistinct(other).alias("n"))


def stored_counts(df: DataFrame, extra: str = "extra") -> DataFrame:
    """nb_cited and nb_citation from the stored map; 0 where it can't be read."""
    m = parse_citations(extra)
    return df.withColumns({"nb_cited": F.coalesce(F.size(m["cited"]), F.lit(0)).cast("long"), "nb_citation": F.coalesce(F.size(m["citing"]), F.lit(0)).cast("long")})


def quality_counts(df: DataFrame, doi: str = "DOI", extra: str = "Extra") -> DataFrame:
    """Rows, rows without DOI, rows with citations, rows whose DOI (or its absence) came before, distinct DOIs."""
    distinct = F.countDistinct(doi) + F.coalesce(F.max(F.col(doi).isNull().cast("int")), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(doi).isNull()).alias("n_no_doi"), F.count_if(has_citations(extra)).alias("n_with_extra"), (F.count("*") - distinct).alias("n_duplicated"), F.countDistinct(doi).alias("n_doi"))


def velocity(df: DataFrame, year, n, ref_year: int = 2024, min_year: int = 2018, min_ratio: float = 1.0) -> DataFrame:
    """Rows younger than min_year with duration, ratio (citations a year) and interest: ratio over min_ratio, or any citation in the
    reference year (G3)."""
    out = df.withColumn("year", year).withColumn("n_citations", n).where(F.col("year") > min_year)
    out = out.withColumn("duration", F.lit(ref_year) - F.col("year"))
    ratio = F.when((F.col("duration") > 0) & (F.col("n_citations") > 0), F.col("n_citations") / F.col("duration"))
    out = out.withColumn("ratio", ratio)
    interest = F.when(F.col("ratio").isNotNull(), (F.col("ratio") > min_ratio).cast("int")).when(F.col("n_citations") > 0, 1).otherwise(0)
    return out.withColumn("interest", interest)


def select_by_velocity(df: DataFrame, library: DataFrame, doi: str = "doi", date: str = "date", n: str = "n", **options) -> DataFrame:
    """The interesting rows that the library has not, by DOI whatever its case."""
    rows = velocity(df, year_of(date), F.col(n), **options).where("interest = 1")
    own = library.select(F.lower(doi).alias("_k")).distinct()
    return rows.join(own, F.lower(rows[doi]) == own["_k"], "left_anti").select(*df.columns)


def refresh(items: DataFrame, fetched: DataFrame, key: str = "key", stored: str = "extra") -> DataFrame:
    """Items keep the citations they have; others get the fetched ones."""
    got = fetched.select(F.col(key).alias("_k"), F.col(stored).alias("_fetched"))
    has = has_citations(stored)
    joined = items.join(got, items[key] == got["_k"], "left")
    return joined.select(*[F.when(has, F.col(stored)).otherwise(F.coalesce("_fetched", stored)).alias(c) if c == stored else items[c] for c in items.columns])
