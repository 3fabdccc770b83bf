"""Registered queries over records: raw shapes of every source are made from the driver tables, normalised, and held against SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import agreement, citations, compose, dump, kg, tags
from ..schema import COLUMNS
from ..sources.files import raw_records
from ..sources.normalize import abstract_scan, normalize
from .aggregate import aggregate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


def part(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


def st(c):
    return F.col(c).cast("string")


def raw(df: DataFrame, body, keep: str = "p_partkey") -> DataFrame:
    """(keep, r): a JSON object as a variant."""
    return df.select(keep, F.parse_json(F.to_json(body)).alias("r"))


def some(c, rest: int, modulus: int = 4):
    """The value, but for one residue of the key, where there is none."""
    return F.when(F.col("p_partkey") % modulus != rest, c)


def shown(df: DataFrame, key: str = "p_partkey") -> DataFrame:
    """Key and the columns of the record that a source fills."""
    return df.select(key, *COLUMNS)


def oracle(**cols: str) -> str:
    """All columns of the record over part; those not given are NULL."""
    return "SELECT p_partkey, " + ", ".join(f'{cols.get(c, "CAST(NULL AS VARCHAR)")} AS "{c}"' for c in COLUMNS) + " FROM part"


@query(oracle(
    title="p_name", archive="'SemanticScholar'", archiveID="CAST(p_partkey AS VARCHAR)", authors="CASE WHEN p_partkey % 4 <> 1 THEN p_brand || ';B' END", abstract="CASE WHEN p_partkey % 4 <> 2 THEN p_type END", date="'2020-01-02'", DOI="'10/' || p_partkey", url="'u'",
    pages="CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN p_size % 2 = 0 THEN '1-9' END END", journalAbbreviation="CASE WHEN p_partkey % 4 <> 3 THEN 'J' END", volume="CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS VARCHAR) END",
    itemType="CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_partkey % 4 <> 3 AND p_size % 2 = 0 THEN 'bookSection' ELSE 'book' END WHEN p_size % 5 = 1 THEN 'conferencePaper' WHEN p_size % 5 = 2 THEN CASE WHEN p_partkey % 4 <> 3 THEN 'journalArticle' ELSE 'Manuscript' END ELSE 'journalArticle' END",
))
def normalize_semanticscholar(spark, d):
    kinds = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("JournalArticle"), F.lit("Book"))).when(F.col("p_size") % 5 == 1, F.array(F.lit("Conference"))).when(F.col("p_size") % 5 == 2, F.array(F.lit("Review"))).otherwise(F.array(F.lit("JournalArticle")))
    journal = some(F.struct(F.lit("J").alias("name"), F.when(F.col("p_size") % 2 == 0, "1-9").alias("pages"), st("p_size").alias("volume")), 3)
    body = F.struct(st("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), some(F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("B").alias("name"))), 1).alias("authors"), some(F.col("p_type"), 2).alias("abstract"), F.lit("2020-01-02").alias("publication_date"), F.concat(F.lit("10/"), st("p_partkey")).alias("DOI"), F.lit("u").alias("url"), kinds.alias("publicationTypes"), journal.alias("journal"), F.lit("").alias("venue"))
    return shown(normalize(raw(part(spark, d), body), "SemanticScholar"))


@query(oracle(title="p_name", archive="'Istex'", archiveID="'ark' || p_partkey", authors="p_brand", abstract="p_type", date="'2019'", DOI="CASE WHEN p_partkey % 4 <> 1 THEN 'a;b' ELSE 'a' END", language="CASE WHEN p_partkey % 4 <> 1 THEN NULL ELSE 'eng' END", volume="CAST(p_size AS VARCHAR)", pages="CASE WHEN p_size % 2 = 0 THEN '1-' || p_size END", itemType="CASE WHEN p_partkey % 4 <> 2 THEN 'bookSection' END", journalAbbreviation="'H'", publisher="'P'"))
def normalize_istex(spark, d):
    host = F.struct(st("p_size").alias("volume"), F.lit("H").alias("title"), F.array(F.lit("P")).alias("publisherId"), F.struct(F.lit("1").alias("first"), F.when(F.col("p_size") % 2 == 0, st("p_size")).alias("last")).alias("pages"))
    two = F.col("p_partkey") % 4 != 1
    body = F.struct(F.concat(F.lit("ark"), st("p_partkey")).alias("arkIstex"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("author"), F.col("p_type").alias("abstract"), F.lit("2019").alias("publicationDate"), F.when(two, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("doi"), F.when(two, F.array(F.lit("eng"), F.lit("fre"))).otherwise(F.array(F.lit("eng"))).alias("language"), F.when(F.col("p_partkey") % 4 == 2, F.array(F.lit("article"), F.lit("conference"))).otherwise(F.array(F.lit("article"))).alias("genre"), host.alias("host"))
    return shown(normalize(raw(part(spark, d), body), "ISTEX"))


@query(oracle(title="p_name", archive="'Arxiv'", archiveID="'id' || p_partkey", authors="p_brand || ';' || p_type", abstract="p_type", date="'2021-05-05'", DOI="CASE WHEN p_partkey % 4 <> 0 THEN '10/' || p_partkey END", rights="'True'", itemType="'Manuscript'"))
def normalize_arxiv(spark, d):
    body = F.struct(F.concat(F.lit("id"), st("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), F.col("p_type").alias("abstract"), F.lit("2021-05-05").alias("published"), some(F.concat(F.lit("10/"), st("p_partkey")), 0).alias("doi"), F.lit("").alias("journal"))
    return shown(normalize(raw(part(spark, d), body), "Arxiv"))


@query(oracle(title="p_name", archive="'DBLP'", archiveID="CAST(p_partkey AS VARCHAR)", authors="CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || ';' || p_type END", date="'2020'", DOI="'10/' || p_partkey", url="'u'", rights="'open'", pages="'1-2'", conferenceName="CASE WHEN p_size % 3 = 0 THEN p_brand END", journalAbbreviation="CASE WHEN p_size % 3 = 1 THEN p_brand END", itemType="CASE p_size % 3 WHEN 0 THEN 'conferencePaper' WHEN 1 THEN 'journalArticle' ELSE 'Manuscript' END"))
def normalize_dblp(spark, d):
    p = part(spark, d)
    kind = F.when(F.col("p_size") % 3 == 0, "Conference and Workshop Papers").when(F.col("p_size") % 3 == 1, "Journal Articles").otherwise("Informal and Other Publications")
    info = [F.col("p_name").alias("title"), F.lit("2020").alias("year"), F.concat(F.lit("10/"), st("p_partkey")).alias("doi"), F.lit("u").alias("url"), F.lit("open").alias("access"), F.lit("1-2").alias("pages"), F.col("p_brand").alias("venue"), kind.alias("type")]
    one = F.struct(F.struct(F.col("p_brand").alias("text")).alias("author")).alias("authors")
    many = F.struct(F.array(F.struct(F.col("p_brand").alias("text")), F.struct(F.col("p_type").alias("text"))).alias("author")).alias("authors")
    body = lambda a: F.struct(st("p_partkey").alias("@id"), F.struct(*info, a).alias("info"))
    both = raw(p.where("p_partkey % 2 = 0"), body(one)).unionByName(raw(p.where("p_partkey % 2 = 1"), body(many)))
    return shown(normalize(both, "DBLP"))


@query(oracle(title="p_name", archive="'HAL'", archiveID="'hal-' || p_partkey", abstract="CASE WHEN p_partkey % 4 <> 1 THEN p_type END", date="CAST(2000 + p_size AS VARCHAR)", DOI="'10/' || p_partkey", conferenceName="CASE WHEN p_size % 2 = 0 THEN p_brand END", itemType="CASE WHEN p_size % 2 = 0 THEN 'conferencePaper' ELSE 'journalArticle' END"))
def normalize_hal(spark, d):
    even = F.col("p_size") % 2 == 0
    body = F.struct(F.concat(F.lit("hal-"), st("p_partkey")).alias("halId_s"), F.array(F.col("p_name"), F.lit("other")).alias("title_s"), some(F.array("p_type"), 1).alias("abstract_s"), (2000 + F.col("p_size")).alias("submittedDateY_i"), F.concat(F.lit("10/"), st("p_partkey")).alias("doiId_id"), F.when(even, F.col("p_brand")).alias("conferenceTitle_s"), F.when(even, "COMM").otherwise("ART").alias("docType_s"))
    return shown(normalize(raw(part(spark, d), body), "HAL"))


@query(oracle(title="p_name", archive="'OpenAlex'", archiveID="'W' || p_partkey", authors="p_brand", date="'2022-01-01'", DOI="'https://doi.org/10/' || p_partkey", rights="CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END", pages="CASE WHEN p_partkey % 4 <> 1 THEN '3-' || p_size END", volume="CAST(p_size AS VARCHAR)", publisher="'P'", conferenceName="CASE WHEN p_size % 3 = 0 THEN p_type END", journalAbbreviation="CASE WHEN p_size % 3 = 1 THEN p_type END", itemType="CASE p_size % 3 WHEN 0 THEN 'conferencePaper' WHEN 1 THEN 'journalArticle' ELSE 'bookSection' END"))
def normalize_openalex(spark, d):
    host = F.struct(F.lit("P").alias("publisher"), F.col("p_type").alias("display_name"), F.when(F.col("p_size") % 3 == 0, "conference").when(F.col("p_size") % 3 == 1, "journal").alias("type"))
    biblio = F.struct(st("p_size").alias("volume"), F.lit("3").alias("first_page"), some(st("p_size"), 1).alias("last_page"))
    body = F.struct(F.concat(F.lit("W"), st("p_partkey")).alias("id"), F.concat(F.lit("https://doi.org/10/"), st("p_partkey")).alias("doi"), F.col("p_name").alias("title"), F.lit("2022-01-01").alias("publication_date"), F.when(F.col("p_size") % 3 == 2, "book-chapter").otherwise("article").alias("type"), F.struct((F.col("p_size") % 2 == 0).alias("is_oa")).alias("open_access"), F.array(F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("author"))).alias("authorships"), biblio.alias("biblio"), host.alias("host_venue"))
    return shown(normalize(raw(part(spark, d), body), "openalex"))


@query(oracle(title="p_name", archive="'IEEE'", archiveID="CAST(p_partkey AS VARCHAR)", authors="CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END", abstract="p_type", date="CASE WHEN p_size % 2 = 0 THEN '1 May 2020' ELSE '2021' END", url="'h'", rights="'open'", pages="'1-' || p_size", journalAbbreviation="'T'", volume="'7'", publisher="'IEEE'", itemType="CASE WHEN p_size % 3 = 0 THEN 'journalArticle' WHEN p_size % 3 = 1 THEN 'conferencePaper' END"))
def normalize_ieee(spark, d):
    p = part(spark, d)
    rest = [st("p_partkey").alias("article_number"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.when(F.col("p_size") % 2 == 0, "1 May 2020").otherwise("").alias("publication_date"), F.lit("2021").alias("publication_year"), F.lit("h").alias("html_url"), F.lit("open").alias("access_type"), F.lit("").alias("doi"), F.lit("1").alias("start_page"), st("p_size").alias("end_page"), F.lit("T").alias("publication_title"), F.lit("7").alias("volume"), F.lit("IEEE").alias("publisher"), F.when(F.col("p_size") % 3 == 0, "Journals").when(F.col("p_size") % 3 == 1, "Conferences").otherwise("Early").alias("content_type")]
    a = F.struct(F.struct(F.array(F.struct(F.col("p_brand").alias("full_name"))).alias("authors")).alias("authors"), *rest)
    b = F.struct(F.array(F.struct(F.col("p_type").alias("name"))).alias("authors"), *rest)
    return shown(normalize(raw(p.where("p_partkey % 2 = 0"), a).unionByName(raw(p.where("p_partkey % 2 = 1"), b)), "IEEE"))


@query(oracle(title="p_name", archive="'Springer'", archiveID="'doi:' || p_partkey", authors="p_brand", abstract="p_type", date="'2020-02-02'", DOI="'10/' || p_partkey", rights="'true'", pages="CASE WHEN p_partkey % 4 <> 2 THEN '1-2' END", journalAbbreviation="'N'", publisher="'S'", itemType="CASE p_size % 3 WHEN 0 THEN 'conferencePaper' WHEN 1 THEN 'journalArticle' ELSE 'bookSection' END"))
def normalize_springer(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "ConferencePaper Article").when(F.col("p_size") % 3 == 1, "Article").otherwise("Chapter")
    body = F.struct(F.concat(F.lit("doi:"), st("p_partkey")).alias("identifier"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("creator"))).alias("creators"), F.col("p_type").alias("abstract"), F.lit("2020-02-02").alias("publicationDate"), F.concat(F.lit("10/"), st("p_partkey")).alias("doi"), F.lit("true").alias("openaccess"), some(F.lit("1"), 2).alias("startingPage"), F.lit("2").alias("endingPage"), F.lit("N").alias("publicationName"), F.lit("S").alias("publisher"), kind.alias("contentType"))
    return shown(normalize(raw(part(spark, d), body), "Springer"))


@query(oracle(title="p_name", archive="'Elsevier'", archiveID="CAST(p_partkey AS VARCHAR)", authors="p_brand", date="'2020-03-03'", DOI="CASE WHEN p_partkey % 4 <> 3 THEN '10/' || p_partkey END", url="'pu'", rights="'1'", pages="'5-6'", journalAbbreviation="'PN'", volume="'3'", issue="'4'", publisher="'E'", itemType="CASE p_size % 3 WHEN 0 THEN 'conferencePaper' WHEN 1 THEN 'journalArticle' ELSE 'bookSection' END"))
def normalize_elsevier(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "Conference Paper").when(F.col("p_size") % 3 == 1, "Article").otherwise("Book Chapter")
    body = F.struct(st("p_partkey").alias("source-id"), F.col("p_name").alias("dc:title"), F.col("p_brand").alias("dc:creator"), F.lit("pu").alias("prism:url"), some(F.concat(F.lit("10/"), st("p_partkey")), 3).alias("prism:doi"), F.lit("2020-03-03").alias("prism:coverDate"), F.lit("3").alias("prism:volume"), F.lit("4").alias("prism:issueIdentifier"), F.lit("PN").alias("prism:publicationName"), F.lit("5-6").alias("prism:pageRange"), F.lit("E").alias("publisher"), F.lit("1").alias("openaccess"), kind.alias("subtypeDescription"))
    return shown(normalize(raw(part(spark, d), body), "Elsevier"))


@query(oracle(title="p_name", archive="'PaperWithCode'", archiveID="'pw' || p_partkey", authors="p_brand", abstract="p_type", date="'2020-04-04'", url="CASE WHEN p_size % 2 = 0 THEN 'https://arxiv.org/x' ELSE 'https://x' END", conferenceName="CASE WHEN p_size % 3 = 0 THEN p_type END", itemType="CASE WHEN p_size % 3 = 0 THEN 'conferencePaper' WHEN p_size % 2 = 0 THEN 'preprint' ELSE 'journalArticle' END"))
def normalize_paperwithcode(spark, d):
    body = F.struct(F.concat(F.lit("pw"), st("p_partkey")).alias("paper_url"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("abstract"), F.lit("2020-04-04").alias("date"), F.when(F.col("p_size") % 2 == 0, "https://arxiv.org/x").otherwise("https://x").alias("url_abs"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("").alias("proceeding"))
    return shown(normalize(raw(part(spark, d), body), "PaperWithCode"))


@query("""
WITH r AS (SELECT p_partkey AS k, 'DBLP' AS archive, 'T' || (p_partkey % 700) AS title, CASE WHEN p_partkey % 3 <> 0 THEN '10/' || (p_partkey % 900) END AS doi FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'Arxiv', 'T' || (p_partkey % 700), CASE WHEN p_partkey % 3 <> 0 THEN '10/' || (p_partkey % 900) END FROM part WHERE p_partkey % 2 = 1)
SELECT count(DISTINCT title) AS n_titles, count(*) AS n_rows FROM (SELECT title FROM r GROUP BY title)""")
def aggregate_flow(spark, d):
    p = part(spark, d).withColumns({"t": F.concat(F.lit("T"), (F.col("p_partkey") % 700).cast("string")), "doi": F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("10/"), (F.col("p_partkey") % 900).cast("string")))})
    a = raw(p.where("p_partkey % 2 = 0"), F.struct(st("p_partkey").alias("@id"), F.struct(F.col("t").alias("title"), F.col("doi")).alias("info"))).withColumn("api", F.lit("DBLP"))
    b = raw(p.where("p_partkey % 2 = 1"), F.struct(st("p_partkey").alias("id"), F.col("t").alias("title"), F.col("doi"))).withColumn("api", F.lit("Arxiv"))
    rows = a.unionByName(b).select("api", F.lit(0).alias("id_collect"), F.lit(1).cast("long").alias("page"), F.col("p_partkey").alias("pos"), "r")
    out = aggregate(rows, ["DBLP", "Arxiv"], keywords=["t"])
    return out.agg(F.countDistinct("title").alias("n_titles"), F.count("*").alias("n_rows"))


@query("""
WITH t AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS title FROM supplier),
b AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT p_type)) AS types FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 2 = 0 GROUP BY 1)
SELECT t.k AS key, coalesce(array_to_string(list_transform(types, lambda x: 'TASK:' || upper(x[1]) || lower(x[2:])), ';'), '') AS tags, 'https://new.org/' || t.k AS archive FROM t LEFT JOIN b ON b.k = t.k""")
def kg_enrichment(spark, d):
    s, li, p = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("supplier", "lineitem", "part"))
    ident = lambda c: F.concat(F.lit("https://old.org/"), F.col(c).cast("string"))
    name = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    titles = s.select(ident("s_suppkey").alias("s"), F.lit("dcterms:title").alias("p"), F.concat(F.lower(name), F.lit(".")).alias("o"))
    tasks = li.where("l_suppkey % 2 = 0").join(p, F.col("l_partkey") == F.col("p_partkey")).select(ident("l_suppkey").alias("s"), F.lit("lpwc:hasTask").alias("p"), F.concat(F.lit("t:"), F.col("p_type")).alias("o")).distinct()
    names = p.select(F.concat(F.lit("t:"), F.col("p_type")).alias("s"), F.lit("foaf:name").alias("p"), F.col("p_type").alias("o")).distinct()
    items = s.select(F.col("s_suppkey").alias("key"), name.alias("title"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("shortTitle"), F.lit(None).cast("string").alias("archiveLocation"))
    out = kg.enrich_items(items, titles.unionByName(tasks).unionByName(names), {"TASK": ("lpwc:hasTask", "foaf:name")}, ("lpwc:hasModel", "foaf:name"), ("lpwc:hasRepository", "fabio:hasURL"), [], ("https://old.org/", "https://new.org/"))
    return out.select("key", F.array_join("tags", ";").alias("tags"), "archive")


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 5 = 0 THEN 't' || o_orderkey END AS "shortTitle" FROM orders""")
def fill_links(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0")
    none = F.lit(None).cast("string")
    items = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("archive"), F.col("o_orderkey").cast("string").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "own").otherwise("").alias("shortTitle"), none.alias("archiveLocation"), none.alias("callNumber"))
    by_url = c.select(F.col("c_custkey").cast("string").alias("url"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("shortTitle"), none.alias("archiveLocation"), none.alias("callNumber"))
    by_title = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("title"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("shortTitle"), none.alias("archiveLocation"), none.alias("callNumber"))
    return dump.fill_links(items, by_url, by_title).select("key", "shortTitle")


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'citing cited old' WHEN o_custkey % 2 = 0 THEN 'new' ELSE '' END AS extra FROM orders""")
def citation_refresh(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    items = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "citing cited old").otherwise("").alias("extra"))
    return citations.refresh(items, o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.lit("new").alias("extra")))


@query("""
WITH e AS (SELECT DISTINCT user_id, event_type || ':' || (round(value)::INT % 4) AS tag FROM events),
i AS (SELECT user_id, tag FROM e WHERE user_id < 30), a AS (SELECT user_id, tag FROM e WHERE user_id >= 30)
SELECT a.user_id, count(i.tag) AS n_same, count(*) FILTER (i.tag IS NULL) AS n_added FROM a LEFT JOIN i ON i.user_id = a.user_id % 30 AND i.tag = a.tag WHERE a.user_id % 30 IN (SELECT user_id FROM i) GROUP BY 1""")
def annotation_cube(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.concat("event_type", F.lit(":"), (F.round("value").cast("int") % 4).cast("string")).alias("tag")).distinct()
    cube = e.select(F.lit("x").alias("doc_type"), (F.col("user_id") % 30).alias("url"), F.when(F.col("user_id") < 30, "init").otherwise(F.col("user_id").cast("string")).alias("annotator"), "tag")
    out = agreement.differences(cube)
    return out.select(F.col("annotator").cast("long").alias("user_id"), F.size("diff.same").cast("long").alias("n_same"), F.size("diff.added").cast("long").alias("n_added"))


@query("""
WITH e AS (SELECT DISTINCT user_id, event_type || ':' || (round(value)::INT % 4) AS tag, event_type AS dim FROM events),
a AS (SELECT * FROM e WHERE user_id >= 30 AND user_id % 30 IN (SELECT user_id FROM e WHERE user_id < 30)),
n AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM e i WHERE i.user_id = a.user_id % 30 AND i.user_id < 30 AND i.tag = a.tag)),
x AS (SELECT i.dim, i.tag, u.user_id FROM e i JOIN (SELECT DISTINCT user_id FROM a) u ON i.user_id = u.user_id % 30 AND i.user_id < 30 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = u.user_id AND a.tag = i.tag))
SELECT 'act_by_user' AS stat, CAST(user_id AS VARCHAR) AS member, count(*) AS n FROM (SELECT user_id FROM n UNION ALL SELECT user_id FROM x) GROUP BY 2
UNION ALL SELECT 'deleted_by_dim', dim, count(*) FROM x GROUP BY 2
UNION ALL SELECT 'tags_by_dim', dim, count(*) FROM a GROUP BY 2""")
def activity_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.concat("event_type", F.lit(":"), (F.round("value").cast("int") % 4).cast("string")).alias("tag")).distinct()
    cube = e.select(F.lit("x").alias("doc_type"), (F.col("user_id") % 30).alias("url"), F.when(F.col("user_id") < 30, "init").otherwise(F.col("user_id").cast("string")).alias("annotator"), "tag")
    stats = agreement.activity(agreement.differences(cube))
    one = lambda k, c: stats[k].select(F.lit(k).alias("stat"), F.col(c).alias("member"), "n")
    return one("act_by_user", "annotator").unionByName(one("deleted_by_dim", "dim")).unionByName(one("tags_by_dim", "dim"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NB:10^3' WHEN 1 THEN 'LANG:?' WHEN 2 THEN 'LANG:?' ELSE 'LANG:' || p_type END AS tag FROM part""")
def clean_tags(spark, d):
    size = F.col("p_size") % 4
    return part(spark, d).select("p_partkey", S.clean_tag(F.when(size == 0, "NB:10^3 papers").when(size == 1, "LANG: NSP").when(size == 2, "LANG: none").otherwise(F.concat(F.lit("LANG:"), F.col("p_type")))).alias("tag"))


@query("SELECT p_partkey, replace(p_name, ' ', '%20') AS quoted, p_brand || ';' || p_type AS names FROM part")
def quoted_words(spark, d):
    return part(spark, d).select("p_partkey", S.url_quote("p_name").alias("quoted"), S.join_names(F.array(F.col("p_brand"), F.lit(""), F.lit(None).cast("string"), F.col("p_type"))).alias("names"))


@query("""
SELECT p_partkey, 'Pwc_method:' || p_name || ';' || 'Pwc_task:' || p_type AS tags, upper(p_name) AS words FROM part""")
def method_tags(spark, d):
    p = part(spark, d)
    return p.select("p_partkey", F.array_join(dump.method_tags(F.array("p_name"), F.array("p_type")), ";").alias("tags"), F.array_join(tags.vocabulary(F.array("p_name", "p_name")), ";").alias("words"))


@query("""
SELECT p_partkey, p_brand AS author, CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS code, CASE WHEN p_size % 3 = 0 THEN '1' ELSE '0' END AS bench, p_name AS abstract, CASE WHEN p_partkey % 4 <> 1 THEN p_type END AS venue, p_partkey % 4 <> 1 AS has_venue FROM part""")
def export_strings(spark, d):
    """Repaired authors, flags from tags, stripped markup, nested fields."""
    held = F.concat_ws(";", F.lit("x"), F.when(F.col("p_size") % 2 == 0, S.HAVE_CODE), F.when(F.col("p_size") % 3 == 0, S.BENCHMARKED))
    p = part(spark, d).select("p_partkey", F.concat(F.lit(", "), F.col("p_brand")).alias("author"), held.alias("held"), F.concat(F.lit("<jats:p>"), F.col("p_name"), F.lit("</jats:p>")).alias("abstract"), F.struct(F.struct(some(F.col("p_type"), 1).alias("name")).alias("venue")).alias("j"))
    code, bench = S.flag_tags("held")
    return p.select("p_partkey", S.repair_authors("author").alias("author"), code.alias("code"), bench.alias("bench"), S.strip_markup("abstract").alias("abstract"), S.field("j", "venue", "name").alias("venue"), S.has_field("j", "venue", "name").alias("has_venue"))


@query("SELECT event_type AS method, count(*) AS nb FROM events GROUP BY 1 UNION ALL SELECT 'k' || json_extract_string(props, '$.k'), count(*) FROM events GROUP BY 1")
def method_usage(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return dump.usage(e.select(F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("methods")))


def rated_cube(spark, d) -> DataFrame:
    """Users of a group of ten as annotators of one url, their event types as dimensions."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.lit("x").alias("doc_type"), F.floor(F.col("user_id") / 10).alias("url"), (F.col("user_id") % 10).cast("string").alias("annotator"), F.concat("event_type", F.lit(":"), (F.round("value").cast("int") % 2).cast("string")).alias("tag")).where("value > 12").distinct()


CUBE = "c AS (SELECT DISTINCT user_id // 10 AS url, CAST(user_id % 10 AS VARCHAR) AS annotator, event_type AS dim, event_type || ':' || (round(value)::INT % 2) AS tag FROM events WHERE value > 12), g AS (SELECT url, annotator, dim, string_agg(tag, ';' ORDER BY tag) AS category FROM c GROUP BY 1, 2, 3), r AS (SELECT DISTINCT url, annotator FROM c), d AS (SELECT DISTINCT dim FROM c), f AS (SELECT r.url, r.annotator, d.dim, coalesce(g.category, d.dim || ':?') AS category FROM r CROSS JOIN d LEFT JOIN g ON g.url = r.url AND g.annotator = r.annotator AND g.dim = d.dim)"


def grid(spark, d) -> DataFrame:
    cube = rated_cube(spark, d)
    cats = agreement.categories(cube.groupBy("doc_type", "url", "annotator").agg(F.collect_set("tag").alias("tags")), F.col("tags"))
    return agreement.dense(cats, cats.select("doc_type", "url", "annotator").distinct(), cats.select("doc_type", "dim").distinct())


@query("WITH " + CUBE + " SELECT dim, url, category, count(*) AS n FROM f GROUP BY 1, 2, 3")
def rating_grid(spark, d):
    return agreement.contingency(grid(spark, d), ["dim"])


@query("WITH " + CUBE + """, o AS (SELECT *, dense_rank() OVER (PARTITION BY dim ORDER BY category) - 1 AS code FROM f),
p AS (SELECT x.url, x.annotator AS annotator1, y.annotator AS annotator2, x.code AS a, y.code AS b FROM o x JOIN o y ON x.url = y.url AND x.dim = y.dim AND x.annotator < y.annotator),
n AS (SELECT url, annotator1, annotator2, count(*) AS n, avg((a = b)::INT) AS po FROM p GROUP BY 1, 2, 3),
s AS (SELECT url, annotator1, annotator2, a AS code, 1 AS x, 0 AS y FROM p UNION ALL SELECT url, annotator1, annotator2, b, 0, 1 FROM p),
e AS (SELECT url, annotator1, annotator2, sum(x * y)::DOUBLE AS xy FROM (SELECT url, annotator1, annotator2, code, sum(x) AS x, sum(y) AS y FROM s GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT n.url, n.annotator1, n.annotator2, n, CASE WHEN xy / (n * n) < 1 THEN round((po - xy / (n * n)) / (1 - xy / (n * n)), 9) END AS kappa FROM n JOIN e USING (url, annotator1, annotator2)""")
def cohen_pairs(spark, d):
    """Cohen's kappa of every pair of annotators over the dimensions, with codes shared across dimensions."""
    coded = agreement.ordinal_codes(grid(spark, d))
    k = agreement.cohen(agreement.annotator_pairs(coded, "code"), ["url", "annotator1", "annotator2"])
    return k.withColumn("kappa", F.round("kappa", 9))


@query("""
WITH a AS (SELECT user_id % 10 AS url, user_id, bool_or(event_type = 'signup' AND value > 25) AS done FROM events GROUP BY 1, 2) SELECT url FROM a GROUP BY 1 HAVING bool_and(done)""")
def finished_items(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    cube = e.select(F.lit("x").alias("doc_type"), (F.col("user_id") % 10).alias("url"), F.col("user_id").cast("string").alias("annotator"), F.when((F.col("event_type") == "signup") & (F.col("value") > 25), "DONE").otherwise("no").alias("tag"))
    return agreement.all_finished(cube).select("url")


@query("""
SELECT c_mktsegment AS api, c_nationkey AS id_collect, 1::BIGINT AS page, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def page_records(spark, d):
    """Records of the pages of those queries that the state has."""
    c, n = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    pages = c.groupBy(F.col("c_mktsegment").alias("api"), F.col("c_nationkey").alias("id_collect")).agg(F.collect_list(F.parse_json(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"))))).alias("results")).withColumn("page", F.lit(1).cast("long"))
    state = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("id_collect")).join(F.broadcast(c.select(F.col("c_mktsegment").alias("api")).distinct()), F.col("id_collect").isNotNull())
    return raw_records(pages, state).select("api", "id_collect", "page", F.try_variant_get("r", "$.id", "string").alias("id"))


@query("""
WITH p AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_suppkey, max(l_linenumber)::INT AS last_page, sum(n)::BIGINT AS coll_art, bool_or(n < 80) AS short FROM p GROUP BY 1)
SELECT s_suppkey::INT AS id_collect, CASE WHEN last_page IS NULL THEN -1 WHEN short THEN 1 ELSE 0 END AS state, coalesce(last_page, 0) AS last_page, coalesce(coll_art, 0) AS coll_art FROM supplier LEFT JOIN a ON s_suppkey = l_suppkey""")
def collection_progress(spark, d):
    """The state of every query after its pages have come."""
    s, li = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("supplier", "lineitem"))
    q = s.select(F.lit("x").alias("api"), F.col("s_suppkey").cast("int").alias("id_collect"), F.array("s_name").alias("keyword"), F.lit(2020).alias("year"))
    pages = li.groupBy(F.lit("x").alias("api"), F.col("l_suppkey").cast("int").alias("id_collect"), F.col("l_linenumber").alias("page")).agg(F.count("*").alias("n")).withColumns({"total": F.lit(0).cast("long"), "max_by_page": F.lit(80)})
    return compose.advance(compose.initial_state(q), pages).select("id_collect", "state", "last_page", "coll_art")


@query("""
SELECT user_id AS paper_url, '[' || string_agg('{"dataset":"' || event_type || '","metrics_json":"' || CAST(round(value)::INT AS VARCHAR) || '"}', ',' ORDER BY event_type, CAST(round(value)::INT AS VARCHAR)) || ']' AS "callNumber" FROM events GROUP BY 1""")
def results_json(spark, d):
    """Evaluation results as JSON."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("paper_url"), F.lit("m").alias("model_name"), F.col("event_type").alias("dataset"), F.round("value").cast("int").cast("string").alias("metrics_json"))
    return dump.results_by_paper(e).select("paper_url", "callNumber")


@query("""
SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 4 <> 1 THEN p_type END AS venue, CASE WHEN p_partkey % 4 <> 2 THEN 'pdf' END AS open_access_pdf FROM part""")
def collector_projection(spark, d):
    """What a collector keeps of raw records, with nulls where objects are null."""
    body = F.struct(F.col("p_name").alias("title"), some(F.struct(F.col("p_type").alias("name")), 1).alias("venue"), some(F.struct(F.lit("pdf").alias("url")), 2).alias("openAccessPdf"))
    return abstract_scan(raw(part(spark, d), body)).select("p_partkey", "title", "venue", "open_access_pdf")
