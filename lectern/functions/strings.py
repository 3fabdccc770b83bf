"""Scalar functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BENCHMARKED, HAVE_CODE


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def field(struct: Column | str, *path: str) -> Column:
    """Nested access; absent, null and empty are NULL."""
    out = _c(struct)
    for name in path:
        out = out.getField(name)
    return F.nullif(out.cast("string"), F.lit(""))


def has_field(struct: Column | str, *path: str) -> Column:
    return field(struct, *path).isNotNull()


def title_case(x: Column | str) -> Column:
    """Every run of letters with a capital and then small letters, as Python's str.title does; initcap would only look at spaces."""
    runs = F.regexp_extract_all(_c(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def tag_value(dim: Column | str, value: Column | str) -> Column:
    """DIM:Value, the value in title case without white space."""
    d = F.lit(dim) if isinstance(dim, str) else dim
    return F.concat(d, F.lit(":"), F.regexp_replace(title_case(value), r"\s", ""))


def title_key(x: Column | str) -> Column:
    """Lower case without one final full stop."""
    return F.regexp_replace(F.lower(_c(x)), r"\.$", "")


def bare_doi(x: Column | str) -> Column:
    """Without the resolver's address."""
    return F.replace(_c(x), F.lit("https://doi.org/"), F.lit(""))


def squash(x: Column | str) -> Column:
    """Lower-case ASCII letters and digits only; NULL if none is left."""
    return F.nullif(F.lower(F.regexp_replace(_c(x), "[^A-Za-z0-9]+", "")), F.lit(""))


def url_quote(x: Column | str) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def swap_namespace(x: Column | str, old: str, new: str) -> Column:
    """The same address in another namespace."""
    return F.replace(_c(x), F.lit(old), F.lit(new))


def within_one_edit(a: Column | str, b: Column | str) -> Column:
    """Damerau-Levenshtein distance of at most 1: equal, one insertion, deletion or substitution, or one swap of neighbours."""
    a, b = _c(a), _c(b)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: a == F.concat(b.substr(F.lit(1), i - 1), b.substr(i + 1, F.lit(1)), b.substr(i, F.lit(1)), b.substr(i + 2, F.length(b))),
    )
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)


CITATIONS = "struct<citing:array<string>,cited:array<string>>"


def parse_citations(extra: Column | str) -> Column:
    """The citation map that is stored with single quotes; NULL where it can't be read."""
    return F.from_json(F.replace(_c(extra), F.lit("'"), F.lit('"')), CITATIONS)


def repair_authors(x: Column | str) -> Column:
    """Without a leading comma and the character after it (X11)."""
    return F.when(F.startswith(_c(x), F.lit(",")), F.substring(_c(x), 3, 1_000_000)).otherwise(_c(x))


def year_text(x: Column | str) -> Column:
    """A year that a CSV has made 2021.0."""
    return F.replace(_c(x), F.lit(".0"), F.lit(""))


def year_of(date: Column | str) -> Column:
    """The year of an ISO date's text."""
    return F.substring(_c(date), 1, 4).try_cast("int")


def any_year(text: Column | str) -> Column:
    """The year of a free-form date: ISO forms, else the first number that looks like one."""
    c = _c(text)
    return F.coalesce(F.year(F.try_to_timestamp(c)), F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int"))


def graph_label(short_title: Column | str, author: Column | str, year: Column | str) -> Column:
    """Short title up to its first comma, else the first author's first word, then _year."""
    short, who = _c(short_title), _c(author)
    first = F.element_at(F.filter(F.split(F.regexp_replace(who, r"^,\s*", ""), r"[;,\s]+"), lambda w: w != ""), 1)
    known = F.nullif(F.trim(F.element_at(F.split(short, ", "), 1)), F.lit(""))
    return F.regexp_replace(F.concat_ws("_", F.coalesce(known, first), F.nullif(year_text(year), F.lit(""))), " {2,}", " ")


def flag_tags(tags: Column | str) -> tuple[Column, Column]:
    """(code, bench) flags of a ;-joined tag list."""
    t = F.coalesce(_c(tags), F.lit(""))
    code = F.when(F.contains(t, F.lit(HAVE_CODE)), "1").otherwise("0")
    bench = F.when(F.contains(t, F.lit(BENCHMARKED)), "1").otherwise("0")
    return code, bench


def page_range(first: Column | str, last: Column | str) -> Column:
    """first-last if both are there."""
    a, b = F.nullif(_c(first).cast("string"), F.lit("")), F.nullif(_c(last).cast("string"), F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("-"), b))


def join_names(names: Column) -> Column:
    """;-joined, without empty ones; NULL if none is left."""
    return F.nullif(F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ";"), F.lit(""))


def strip_markup(x: Column | str) -> Column:
    """Without paragraph tags of abstracts."""
    return F.replace(F.replace(_c(x), F.lit("<jats:p>"), F.lit("")), F.lit("</jats:p>"), F.lit(""))


def keyword_list(x: Column | str) -> Column:
    """Comma-separated, trimmed, lower case."""
    return F.transform(F.split(_c(x), ","), lambda k: F.lower(F.trim(k)))


def dimension(column_name: str) -> str:
    """The dimension that a numbered column of a replacement table stands for."""
    return column_name.rstrip("12")


def write_token() -> Column:
    """32 random characters for a write request (X22); never in queries with an oracle."""
    return F.randstr(F.lit(32))


def kappa_band(k: Column | str) -> Column:
    """The label of an agreement value; exactly 0 is Slight, 0.8 is almost perfect."""
    c = _c(k)
    return F.when(c.isNull(), None).when(c < 0, "Poor").when(c <= 0.2, "Slight").when(c <= 0.4, "Fair").when(c <= 0.6, "Moderate").when(c < 0.8, "Substantial").otherwise("Almost perfect")


def doi_url(doi: Column | str) -> Column:
    """The address of a DOI."""
    return F.concat(F.lit("https://doi.org/"), _c(doi))


def clean_tag(tag: Column | str) -> Column:
    """A tag with its value in canonical form: unspecified values become ?, powers of ten 10^n."""
    t = F.trim(_c(tag))
    dim, value = F.trim(F.substring_index(t, ":", 1)), F.trim(F.substring(t, F.length(F.substring_index(t, ":", 1)) + 2, F.lit(1_000_000)))
    power = F.regexp_extract(value, r"10\^?\s*(\d+)", 1)
    value = F.when(F.upper(value).isin("NSP", "NONE", "?", ""), "?").when(F.contains(F.upper(dim), F.lit("NB")) & (power != ""), F.concat(F.lit("10^"), power)).otherwise(value)
    return F.when(F.contains(t, F.lit(":")), F.concat(dim, F.lit(":"), value)).otherwise(t)
