"""Sources: limits, paging and the predicate that each one is sent (S1-S14 and the push-down table)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column

from ..operators.filters import published_in, search_predicate


@dataclass(frozen=True)
class SourceSpec:
    """name; rows a page; calls a second; compile(keywords, year) gives the query text, in which {} is the place of the offset;
    offset(page) is what stands there; endpoints: the service's paths, each paged by itself and their pages concatenated (U6); fields and
    shape: the same predicate over local records; most_rows: what the service gives at most for a query. Where a response has its total and its
    records is in envelopes.py."""

    name: str
    page_size: int
    calls_per_second: float
    compile: Callable[[list[str], int], str]
    by_page: bool = False
    single_page: bool = False
    any_word: bool = False
    fields: tuple[str, ...] = ("title", "abstract")
    shape: str = "any"
    residual_year: bool = False
    by_year: bool = True
    most_rows: int | None = None
    endpoints: tuple[str, ...] = ("",)

    def offset(self, page: int) -> int:
        return page if self.by_page else (page - 1) * self.page_size

    def predicate(self, keywords: list[str], year: int, date: str = "date") -> Column:
        groups = [keywords] if self.any_word else [[k] for k in keywords]
        p = search_predicate(groups, list(self.fields), self.shape)
        return p & published_in(date, year) if self.by_year else p


def _and(words: list[str], joiner: str = " AND ") -> str:
    return joiner.join(words)


# The services' names, page sizes, limits, query forms, requested fields and orders.
S2_FIELDS = "title,abstract,url,venue,publicationVenue,citationCount,externalIds,referenceCount,s2FieldsOfStudy,publicationTypes,publicationDate,isOpenAccess,openAccessPdf,authors,journal,fieldsOfStudy"
HAL_FIELDS = "title_s,abstract_s,label_s,arxivId_s,audience_s,authFullNameIdHal_fs,bookTitle_s,classification_s,conferenceTitle_s,docType_s,doiId_id,files_s,halId_s,jel_t,journalDoiRoot_s,journalTitle_t,keyword_s,type_s,submittedDateY_i"
SOURCES: dict[str, SourceSpec] = {
    s.name.lower(): s
    for s in (
        SourceSpec("SemanticScholar", 100, 100, lambda k, y: f"query={quote('|'.join(k))}&year={y}&fieldsOfStudy=Computer%20Science&fields={S2_FIELDS}", single_page=True, any_word=True),
        SourceSpec("IEEE", 25, 200, lambda k, y: f"format=json&max_records=25&sort_order=asc&sort_field=article_number&querytext={quote('(' + _and(k) + ')')}&publication_year={y}&start_record={{}}"),
        SourceSpec("Elsevier", 100, 8, lambda k, y: f"query=TITLE-ABS({_and(k)})&date={y}&count=100&start={{}}"),
        SourceSpec("DBLP", 1000, 10, lambda k, y: "q=" + "+".join(w for x in k for w in x.split(" ")) + f" year:{y}:&h=1000&f={{}}", fields=("title",)),
        SourceSpec("OpenAlex", 200, 10, lambda k, y: "filter=" + ",".join(f"abstract.search:{x},title.search:{x}" for x in k) + f",publication_year:{y}&page={{}}", by_page=True, shape="each"),
        SourceSpec("HAL", 500, 10, lambda k, y: f"q=({_and(k, '%20AND%20')})&fl={HAL_FIELDS}&submittedDateY_i:[{y}]&wt=json&rows=500&start={{}}"),
        SourceSpec("Arxiv", 500, 3, lambda k, y: "search_query=" + "+AND+".join(f'(ti:"{x}"+OR+abs:"{x}")' for x in k) + "&sortBy=relevance&sortOrder=descending&max_results=500&start={}", residual_year=True),
        SourceSpec("Istex", 500, 3, lambda k, y: f"q=(publicationDate:{y} AND (title:({_and(k)}) OR abstract:({_and(k)})))&size=500&from={{}}", shape="same"),
        SourceSpec("Springer", 100, 8, lambda k, y: "q=" + " AND ".join(f'"{x}"' for x in k) + "&p=100&s={}", by_year=False, by_page=True, most_rows=10_000, endpoints=("meta", "openaccess")),
        SourceSpec("GoogleScholar", 100, 3, lambda k, y: "q=" + "+".join(k) + f"&as_ylo={y}&as_yhi={y + 1}", single_page=True),
    )
}


def source(name: str) -> SourceSpec:
    """By name, whatever its case."""
    try:
        return SOURCES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown source {name!r}; there are {sorted(SOURCES)}") from None


def compile_groups(name: str, groups: list[list[str]]) -> str:
    """The older form: groups of alternatives that must all hold."""
    inner = [" OR ".join(f'"{w}"' for w in g) for g in groups]
    if name.lower() == "semanticscholar":
        return "+".join("(" + "|".join(f'"{w}"' for w in g) + ")" for g in groups)
    if name.lower() == "elsevier":
        return " AND ".join(f"TITLE({x})" for x in inner)
    return " AND ".join(f"({' OR '.join(g)})" for g in groups)
