"""One normaliser for each source: raw records to the canonical record (P1-P12). Each takes a frame with a variant column r."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import join_names, page_range
from ..schema import aligned_union, record

NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def normalizer(*names: str):
    """Registers a normaliser, whatever the case of the name; a new source needs no more than this."""

    def wrap(f):
        for n in names:
            NORMALIZERS[n.lower()] = f
        return f

    return wrap


def s(path: str) -> Column:
    """A text at a path of r; empty is NULL."""
    return F.nullif(F.try_variant_get("r", f"$.{path}", "string"), F.lit(""))


def q(name: str) -> Column:
    """The same for names with : or - in them."""
    return F.nullif(F.try_variant_get("r", f"$['{name}']", "string"), F.lit(""))


def a(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("r", f"$.{path}", f"array<{kind}>")


def one(path: str) -> Column:
    """The only element of a list."""
    return F.when(F.size(a(path)) == 1, F.element_at(a(path), 1))


def select(df: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    return df.select(*keep, *record(**fields))


def rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "r"]


@normalizer("SemanticScholar")
def semantic_scholar(df: DataFrame) -> DataFrame:
    kinds = a("publicationTypes")
    n = F.coalesce(F.size(kinds), F.lit(0))
    has = lambda k: F.array_contains(kinds, k)
    single = F.when(has("JournalArticle"), "journalArticle").when(has("Conference") | has("Conferences"), "conferencePaper").when(has("Book"), "book")
    several = F.when(has("Book"), "book").when(has("Conference"), "conferencePaper").when(has("JournalArticle"), "journalArticle")
    kind = F.when(n == 1, single).when(n > 1, several)
    venue = s("venue.type")
    kind = F.when(venue == "journal", "journalArticle").when(venue == "conference", "conferencePaper").otherwise(kind)
    journal = F.try_variant_get("r", "$.journal", "struct<name:string,pages:string,volume:string>")
    kind = F.when((kind == "book") & F.nullif(journal["pages"], F.lit("")).isNotNull(), "bookSection").otherwise(kind)
    kind = F.coalesce(kind, F.when(journal.isNotNull(), "journalArticle"), F.lit("Manuscript"))
    return select(df, rest(df), archive=F.lit("SemanticScholar"), archiveID=s("paper_id"), title=s("title"), authors=join_names(F.transform(a("authors", "struct<name:string>"), lambda x: x["name"])), abstract=s("abstract"), date=s("publication_date"), DOI=s("DOI"), url=s("url"), rights=s("open_access_pdf"), pages=journal["pages"], journalAbbreviation=F.coalesce(F.nullif(journal["name"], F.lit("")), F.when(venue == "journal", s("venue.name"))), conferenceName=F.when(venue == "conference", s("venue.name")), volume=journal["volume"], itemType=kind)


@normalizer("Istex")
def istex(df: DataFrame) -> DataFrame:
    genre = one("genre")
    kind = F.when(genre == "research-article", "journalArticle").when(genre == "conference", "conferencePaper").when(genre == "article", "bookSection")
    return select(df, rest(df), archive=F.lit("Istex"), archiveID=s("arkIstex"), title=s("title"), authors=join_names(F.transform(a("author", "struct<name:string>"), lambda x: x["name"])), abstract=s("abstract"), date=s("publicationDate"), DOI=join_names(a("doi")), url=s("url"), rights=s("accessCondition.contentType"), pages=page_range(s("host.pages.first"), s("host.pages.last")), journalAbbreviation=s("host.title"), volume=s("host.volume"), issue=s("host.issue"), publisher=one("host.publisherId"), language=one("language"), series=s("series.title"), itemType=kind)


@normalizer("Arxiv")
def arxiv(df: DataFrame) -> DataFrame:
    return select(df, rest(df), archive=F.lit("Arxiv"), archiveID=s("id"), title=s("title"), authors=join_names(a("authors")), abstract=s("abstract"), date=s("published"), DOI=s("doi"), rights=F.lit("True"), journalAbbreviation=s("journal"), itemType=F.lit("Manuscript"))


@normalizer("DBLP")
def dblp(df: DataFrame) -> DataFrame:
    many = F.transform(F.try_variant_get("r", "$.info.authors.author", "array<struct<text:string>>"), lambda x: x["text"])
    names = F.coalesce(many, F.array(s("info.authors.author.text")))
    t = s("info.type")
    kind = F.when(t == "Journal Articles", "journalArticle").when(t == "Conference and Workshop Papers", "conferencePaper").when(t.isin("Informal Publications", "Informal and Other Publications"), "Manuscript")
    return select(df, rest(df), archive=F.lit("DBLP"), archiveID=q("@id"), title=s("info.title"), authors=join_names(names), date=s("info.year"), DOI=s("info.doi"), url=s("info.url"), rights=s("info.access"), pages=s("info.pages"), journalAbbreviation=F.when(kind == "journalArticle", s("info.venue")), conferenceName=F.when(kind == "conferencePaper", s("info.venue")), itemType=kind)


@normalizer("HAL")
def hal(df: DataFrame) -> DataFrame:
    t = s("docType_s")
    kind = F.when(t == "ART", "journalArticle").when(t.isin("COMM", "PROCEEDINGS"), "conferencePaper").when(t == "Informal Publications", "Manuscript")
    return select(df, rest(df), archive=F.lit("HAL"), archiveID=s("halId_s"), title=F.try_element_at(a("title_s"), F.lit(1)), abstract=F.try_element_at(a("abstract_s"), F.lit(1)), date=s("submittedDateY_i"), DOI=s("doiId_id"), journalAbbreviation=s("journalTitle_t"), conferenceName=s("conferenceTitle_s"), series=s("bookTitle_s"), itemType=kind)


@normalizer("OpenAlex")
def openalex(df: DataFrame) -> DataFrame:
    t, host = s("type"), s("host_venue.type")
    kind = F.when(t.isin("journal-article", "article"), "journalArticle").when(t == "book", "book").when(t == "book-chapter", "bookSection").when(t == "proceedings-article", "conferencePaper")
    kind = F.when(host == "conference", "conferencePaper").when(host == "journal", "journalArticle").otherwise(kind)
    names = F.transform(a("authorships", "struct<author:struct<display_name:string>>"), lambda x: x["author"]["display_name"])
    name = s("host_venue.display_name")
    return select(df, rest(df), archive=F.lit("OpenAlex"), archiveID=s("id"), title=s("title"), authors=join_names(names), date=s("publication_date"), DOI=s("doi"), rights=F.initcap(F.try_variant_get("r", "$.open_access.is_oa", "boolean").cast("string")), pages=page_range(s("biblio.first_page"), s("biblio.last_page")), journalAbbreviation=F.when(host == "journal", name), conferenceName=F.when(host == "conference", name), volume=s("biblio.volume"), issue=s("biblio.issue"), publisher=s("host_venue.publisher"), itemType=kind)


@normalizer("IEEE")
def ieee(df: DataFrame) -> DataFrame:
    kind = "struct<full_name:string,name:string>"
    people = F.coalesce(a("authors.authors", kind), a("authors", kind))
    t = s("content_type")
    return select(df, rest(df), archive=F.lit("IEEE"), archiveID=s("article_number"), title=s("title"), authors=join_names(F.transform(people, lambda x: F.coalesce(x["full_name"], x["name"]))), abstract=s("abstract"), date=F.coalesce(s("publication_date"), s("publication_year")), DOI=s("doi"), url=s("html_url"), rights=s("access_type"), pages=page_range(s("start_page"), s("end_page")), journalAbbreviation=s("publication_title"), volume=s("volume"), issue=s("issue"), publisher=s("publisher"), itemType=F.when(t == "Journals", "journalArticle").when(t == "Conferences", "conferencePaper"))


def by_substring(t: Column) -> Column:
    return F.when(t.contains("Conference"), "conferencePaper").when(t.contains("Article"), "journalArticle").when(t.contains("Chapter"), "bookSection")


@normalizer("Springer")
def springer(df: DataFrame) -> DataFrame:
    names = F.transform(a("creators", "struct<creator:string>"), lambda x: x["creator"])
    return select(df, rest(df), archive=F.lit("Springer"), archiveID=s("identifier"), title=s("title"), authors=join_names(names), abstract=s("abstract"), date=s("publicationDate"), DOI=s("doi"), rights=s("openaccess"), pages=page_range(s("startingPage"), s("endingPage")), journalAbbreviation=s("publicationName"), publisher=s("publisher"), itemType=by_substring(s("contentType")))


@normalizer("Elsevier")
def elsevier(df: DataFrame) -> DataFrame:
    return select(df, rest(df), archive=F.lit("Elsevier"), archiveID=q("source-id"), title=q("dc:title"), authors=q("dc:creator"), date=q("prism:coverDate"), DOI=q("prism:doi"), url=q("prism:url"), rights=s("openaccess"), pages=q("prism:pageRange"), journalAbbreviation=q("prism:publicationName"), volume=q("prism:volume"), issue=q("prism:issueIdentifier"), publisher=s("publisher"), itemType=by_substring(s("subtypeDescription")))


@normalizer("PaperWithCode")
def paper_with_code(df: DataFrame) -> DataFrame:
    held = s("proceeding")
    kind = F.when(held.isNotNull(), "conferencePaper").when(s("url_abs").contains("arxiv"), "preprint").otherwise("journalArticle")
    return select(df, rest(df), archive=F.lit("PaperWithCode"), archiveID=s("paper_url"), title=s("title"), authors=join_names(a("authors")), abstract=s("abstract"), date=s("date"), url=s("url_abs"), conferenceName=held, itemType=kind)


def normalize(df: DataFrame, api: str) -> DataFrame:
    """The records of one source (P11); a source without a normaliser is an error, not a loss."""
    try:
        return NORMALIZERS[api.lower()](df)
    except KeyError:
        raise ValueError(f"no normaliser for {api!r}; there are {sorted(NORMALIZERS)}") from None


def normalize_all(records: DataFrame, apis: list[str]) -> DataFrame:
    """All sources of a landing zone in one frame."""
    return aligned_union(*[normalize(records.where(F.lower("api") == x.lower()), x) for x in apis])


def abstract_scan(df: DataFrame) -> DataFrame:
    """What a collector keeps of a raw SemanticScholar record (P12), null-safe."""
    return df.select(*rest(df), s("title").alias("title"), s("abstract").alias("abstract"), s("url").alias("url"), F.coalesce(s("venue.name"), s("venue")).alias("venue"), s("openAccessPdf.url").alias("open_access_pdf"))
