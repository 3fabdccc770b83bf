"""Predicates (F1-F15) and per-source search predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import norm_missing


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def has(col: Column | str, word: str) -> Column:
    """The word anywhere, whatever its case; NULL has none (F2)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))


def keyword_filter(df: DataFrame, keywords: list[str], title: str = "title", abstract: str = "abstract", compat: bool = False) -> DataFrame:
    """Rows with any keyword in title or abstract (F1). compat: all rows, which is what the original does in effect."""
    if compat:
        return df
    return df.where(_any([has(c, k) for k in keywords for c in (title, abstract)]))


def abstract_text(variant: Column) -> Column:
    """An abstract that is a string, or an object with a list of paragraphs."""
    return F.coalesce(F.array_join(F.try_variant_get(variant, "$.p", "array<string>"), " "), F.try_variant_get(variant, "$", "string"))


def search_predicate(groups: list[list[str]], fields: list[str], per_field: str = "any") -> Column:
    """Groups of alternatives that all must hold. per_field "any": each group in any field; "same": all groups in one and the same
    field; "each": all groups in every field."""
    if per_field == "any":
        return _all([_any([has(f, w) for w in g for f in fields]) for g in groups])
    whole = [_all([_any([has(f, w) for w in g]) for g in groups]) for f in fields]
    return _any(whole) if per_field == "same" else _all(whole)


def published_in(date: Column | str, year: int) -> Column:
    """The year stands in the date's text."""
    return F.coalesce(F.contains(F.col(date) if isinstance(date, str) else date, F.lit(str(year))), F.lit(False))


def relevant(col: Column | str) -> Column:
    """Marked 1; missing is not."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).try_cast("int"), F.lit(-1)) == 1


def in_focus(col: Column | str, focus: list[str]) -> Column:
    """In the list, whatever the case."""
    return F.coalesce(F.lower(F.col(col) if isinstance(col, str) else col).isin([f.lower() for f in focus]), F.lit(False))


def is_document(item_type: str = "itemType", title: str = "title") -> Column:
    """Neither attachment nor note, and with a title."""
    return ~F.coalesce(F.col(item_type).isin("attachment", "note"), F.lit(False)) & norm_missing(title).isNotNull()


def valid_doi(doi: Column | str) -> Column:
    """There, and with a slash."""
    c = F.col(doi) if isinstance(doi, str) else doi
    return F.coalesce(norm_missing(c).isNotNull() & F.contains(c, F.lit("/")), F.lit(False))


def is_preprint(url: Column | str) -> Column:
    """An arXiv address (F8)."""
    return has(url, "arxiv")


def has_citations(extra: str) -> Column:
    """Both lists are stored."""
    return F.coalesce(F.contains(extra, F.lit("citing")) & F.contains(extra, F.lit("cited")), F.lit(False))


def pushable(item_type: str = "itemType", url: str = "url") -> Column:
    """With a type and an address."""
    return norm_missing(item_type).isNotNull() & F.col(url).isNotNull()


def prefixed(tag: Column | str, prefix: str) -> Column:
    """The prefix stands in the upper-case tag."""
    c = F.col(tag) if isinstance(tag, str) else tag
    return F.coalesce(norm_missing(c).isNotNull() & F.contains(F.upper(c), F.lit(prefix)), F.lit(False))


def is_power(tag: Column | str) -> Column:
    """A count given as a power of ten."""
    c = F.col(tag) if isinstance(tag, str) else tag
    return F.contains(c, F.lit("NB")) & F.contains(c, F.lit("10"))


def finished(tags: Column | str) -> Column:
    """Has the tag DONE."""
    return F.coalesce(F.array_contains(tags, "DONE"), F.lit(False))


def enough_annotators(df: DataFrame, key: str = "url", annotator: str = "annotator", least: int = 3) -> DataFrame:
    """Keys with more than `least` annotators, among them init and resolution."""
    return df.groupBy(key).agg(F.countDistinct(annotator).alias("n_annotators")).where(F.col("n_annotators") > least)
