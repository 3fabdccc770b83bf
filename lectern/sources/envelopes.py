"""Response bodies of the services as page envelopes: where each has its total and its records, and what a collector keeps of a record
(S5-S14, P12)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Envelope:
    """Paths of the number of hits and of the list of records in a JSON body."""

    total: str
    records: str


# The services' response formats.
ENVELOPES: dict[str, Envelope] = {
    "semanticscholar": Envelope("$.total", "$.data"),
    "ieee": Envelope("$.total_records", "$.articles"),
    "elsevier": Envelope("$['search-results']['opensearch:totalResults']", "$['search-results'].entry"),
    "dblp": Envelope("$.result.hits['@total']", "$.result.hits.hit"),
    "openalex": Envelope("$.meta.count", "$.results"),
    "hal": Envelope("$.response.numFound", "$.response.docs"),
    "istex": Envelope("$.total", "$.hits"),
    "springer": Envelope("$.result[0].total", "$.records"),
    "googlescholar": Envelope("$.search_information.total_results", "$.organic_results"),
}
FEED = "struct<totalResults:long,entry:array<struct<id:string,updated:string,published:string,title:string,summary:string,author:array<struct<name:string>>,doi:string,journal_ref:string,link:array<struct<_href:string,_title:string>>,category:array<struct<_term:string>>>>>"


def _feed_entry(e: Column) -> Column:
    """An Atom entry as the record that the Arxiv normaliser reads; its pdf is the address of the link with that title."""
    pdf = F.try_element_at(F.filter(e["link"], lambda x: x["_title"] == "pdf"), F.lit(1))["_href"]
    fields = F.struct(e["id"].alias("id"), e["updated"].alias("updated"), e["published"].alias("published"), e["title"].alias("title"), e["summary"].alias("abstract"), F.transform(e["author"], lambda a: a["name"]).alias("authors"), e["doi"].alias("doi"), pdf.alias("pdf"), e["journal_ref"].alias("journal"), F.transform(e["category"], lambda c: c["_term"]).alias("categories"))
    return F.parse_json(F.to_json(fields))


def page_envelopes(responses: DataFrame) -> DataFrame:
    """(api, id_collect, page, total, n, results) of responses (api, id_collect, page, body). A body that is no such response, or null, has total 0 and
    no records; an api without a known format, too. n counts the records, on which paging depends."""
    api, body = F.lower("api"), F.try_parse_json("body")
    feed = F.from_xml(F.when(api == "arxiv", F.col("body")), FEED, {"ignoreNamespace": "true"})
    total, found = F.when(api == "arxiv", feed["totalResults"]), F.when(api == "arxiv", F.transform(feed["entry"], _feed_entry))
    for name, e in ENVELOPES.items():
        total = total.when(api == name, F.try_variant_get(body, e.total, "string").try_cast("long"))
        found = found.when(api == name, F.try_variant_get(body, e.records, "array<variant>"))
    none = F.array().cast("array<variant>")
    return responses.select("api", "id_collect", "page", F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(found, none).alias("results")).select("api", "id_collect", "page", "total", F.size("results").alias("n"), "results")


def of_year(records: DataFrame, year: Column | int, path: str = "$.published") -> DataFrame:
    """Records r of the year, for services that cannot be asked for it; how long the page was is in its envelope."""
    y = F.lit(year) if isinstance(year, int) else year
    return records.where(F.coalesce(F.contains(F.try_variant_get("r", path, "string"), y.cast("string")), F.lit(False)))


def _text(path: str) -> Column:
    return F.try_variant_get("r", path, "string")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "r"]


def scan_ieee(df: DataFrame) -> DataFrame:
    """What a collector keeps of an IEEE article."""
    people = F.try_variant_get("r", "$.authors.authors", "array<struct<full_name:string,affiliation:string>>")
    plain = ["doi", "title", "publisher", "isbn", "issn", "access_type", "content_type", "abstract", "article_number", "pdf_url"]
    authors = F.transform(people, lambda p: F.struct(p["full_name"].alias("name"), p["affiliation"].alias("affiliation")))
    return df.select(*_keys(df), *[_text(f"$.{c}").alias(c) for c in plain], F.coalesce(F.try_variant_get("r", "$.rank", "long"), F.lit(0)).alias("rank"), authors.alias("authors"))


def scan_arxiv(df: DataFrame) -> DataFrame:
    """What a collector keeps of an Arxiv entry, as page_envelopes() gives it."""
    lists = [F.try_variant_get("r", f"$.{c}", "array<string>").alias(c) for c in ("authors", "categories")]
    return df.select(*_keys(df), *[_text(f"$.{c}").alias(c) for c in ("id", "updated", "published", "title", "abstract", "doi", "pdf", "journal")], *lists)
