"""The canonical bibliographic record and the one rule for missing values.

Inside the engine only NULL is missing; "NA" is written by sinks alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the canonical record, in order, and the two that some sources add.
CANONICAL = ["title", "publisher", "itemType", "authors", "language", "abstract", "archiveID", "archive", "date", "DOI", "url", "rights", "pages", "journalAbbreviation", "volume", "serie", "issue"]
LATE = ["conferenceName", "series"]
COLUMNS = CANONICAL + LATE
MISSING = ["", "NA", "NAN", "NONE", "NOT FOUND"]
# The tags that say what a paper has.
HAVE_CODE, NO_CODE = "STATUT:have code", "STATUT:donthave code"
BENCHMARKED, NOT_BENCHMARKED = "STATUT:is benchmarked", "STATUT:not benchmarked"

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def norm_missing(col: Column | str, strict: bool = False) -> Column:
    """NULL for every spelling of missing: empty, NA, nan, None, not found. strict: "" stays a value, as it is for the compatible
    form of deduplication."""
    c = F.col(col) if isinstance(col, str) else col
    if strict:
        return F.when(F.upper(F.trim(c)).isin(MISSING[1:]), None).otherwise(c)
    return F.when(F.upper(F.trim(c)).isin(MISSING), None).otherwise(c)


def nan_null(col: Column | str) -> Column:
    """NULL for NaN (X2); Spark holds NaN equal to itself, so it is turned into NULL before any comparison."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), None).otherwise(c)


def record(**fields: Column) -> list[Column]:
    """The canonical columns as strings, NULL where a source gives none."""
    unknown = set(fields) - set(COLUMNS)
    if unknown:
        raise ValueError(f"not in the canonical record: {sorted(unknown)}")
    return [norm_missing(fields[c].cast("string")).alias(c) if c in fields else F.lit(None).cast("string").alias(c) for c in COLUMNS]


def aligned_union(*frames: DataFrame) -> DataFrame:
    """Bag union by name; what a frame lacks is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
