"""Registered queries over raw responses and over what the other modules leave out, held against SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dump, filters, kg, people
from ..sinks import with_index
from ..sources.envelopes import of_year, page_envelopes, scan_arxiv, scan_ieee
from ..sources.files import raw_records
from ..sources.normalize import normalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return wrap


#: How each service wraps its records; {n} is their number, {r} the list.
BODIES = {
    "SemanticScholar": '{"total":{n},"data":{r}}', "IEEE": '{"total_records":{n},"articles":{r}}', "Elsevier": '{"search-results":{"opensearch:totalResults":"{n}","entry":{r}}}', "DBLP": '{"result":{"hits":{"@total":"{n}","hit":{r}}}}', "OpenAlex": '{"meta":{"count":{n}},"results":{r}}',
    "HAL": '{"response":{"numFound":{n},"docs":{r}}}', "Istex": '{"total":{n},"hits":{r}}', "Springer": '{"result":[{"total":"{n}"}],"records":{r}}', "GoogleScholar": '{"search_information":{"total_results":{n}},"organic_results":{r}}', "nobody": '{"total":{n},"data":{r}}',
}


def responses(df: DataFrame, body, api: str, per: str) -> DataFrame:
    """(api, id_collect, page, body): a response of the api for each value of `per`, with a record for each row, as JSON made of `body`."""
    front, back = BODIES[api].replace("{r}", "\0").split("\0")
    rows = df.groupBy(F.col(per).alias("id_collect")).agg(F.count("*").cast("string").alias("n"), F.array_join(F.collect_list(F.to_json(body)), ",").alias("r"))
    text = F.concat(F.replace(F.lit(front), F.lit("{n}"), F.col("n")), F.lit("["), F.col("r"), F.lit("]"), F.lit(back))
    return rows.select(F.lit(api).alias("api"), "id_collect", F.lit(1).cast("long").alias("page"), text.alias("body"))


def part(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


@query(
    "SELECT x.api, p_size::INT AS id_collect, CASE WHEN x.api = 'nobody' THEN 0 ELSE count(*) END AS total, CASE WHEN x.api = 'nobody' THEN 0 ELSE count(*)::INT END AS n, CASE WHEN x.api <> 'nobody' THEN sum(p_partkey)::BIGINT END AS keys "
    f"FROM part, (SELECT unnest({list(BODIES)}) AS api) x GROUP BY 1, 2"
)
def response_envelopes(spark, d):
    """Totals and records of responses of every JSON service."""
    p = part(spark, d)
    all_ = None
    for api in BODIES:
        one = responses(p, F.struct(F.col("p_partkey").alias("k")), api, "p_size")
        all_ = one if all_ is None else all_.unionByName(one)
    got = page_envelopes(all_)
    keys = F.aggregate(F.transform("results", lambda r: F.try_variant_get(r, "$.k", "long")), F.lit(0).cast("long"), lambda a, k: a + k)
    return got.select("api", F.col("id_collect").cast("int"), "total", "n", F.when(F.col("n") > 0, keys).alias("keys"))


@query("SELECT p_partkey::VARCHAR AS \"archiveID\", p_name AS title, p_brand || ';B' AS authors, '2020' AS date, '10/' || p_partkey AS \"DOI\", CASE WHEN p_size % 2 = 0 THEN 'journalArticle' ELSE 'conferencePaper' END AS \"itemType\", CASE WHEN p_size % 2 = 0 THEN p_type END AS \"journalAbbreviation\" FROM part")
def response_to_records(spark, d):
    """From DBLP responses to canonical records: parsed, exploded, normalised."""
    kind = F.when(F.col("p_size") % 2 == 0, "Journal Articles").otherwise("Conference and Workshop Papers")
    people = F.struct(F.array(F.struct(F.col("p_brand").alias("text")), F.struct(F.lit("B").alias("text"))).alias("author"))
    info = F.struct(F.col("p_name").alias("title"), people.alias("authors"), F.lit("2020").alias("year"), F.concat(F.lit("10/"), F.col("p_partkey").cast("string")).alias("doi"), kind.alias("type"), F.col("p_type").alias("venue"))
    pages = page_envelopes(responses(part(spark, d), F.struct(F.col("p_partkey").cast("string").alias("@id"), info.alias("info")), "DBLP", "p_size"))
    return normalize(raw_records(pages), "DBLP").select("archiveID", "title", "authors", "date", "DOI", "itemType", "journalAbbreviation")


@query("SELECT p_partkey::VARCHAR AS article_number, p_name AS title, '10/' || p_partkey AS doi, p_brand AS name, CASE WHEN p_partkey % 4 <> 1 THEN p_type END AS affiliation, CASE WHEN p_partkey % 4 <> 2 THEN p_size::BIGINT ELSE 0 END AS rank, CASE WHEN p_partkey % 4 <> 3 THEN 'A' END AS access_type FROM part")
def scan_of_ieee(spark, d):
    """What a collector keeps of IEEE's articles."""
    rest = lambda c, k: F.when(F.col("p_partkey") % 4 != k, c)
    who = F.struct(F.array(F.struct(F.col("p_brand").alias("full_name"), rest(F.col("p_type"), 1).alias("affiliation"))).alias("authors"))
    body = F.struct(F.col("p_partkey").cast("string").alias("article_number"), F.col("p_name").alias("title"), F.concat(F.lit("10/"), F.col("p_partkey").cast("string")).alias("doi"), who.alias("authors"), rest(F.col("p_size"), 2).alias("rank"), rest(F.lit("A"), 3).alias("access_type"))
    got = scan_ieee(raw_records(page_envelopes(responses(part(spark, d), body, "IEEE", "p_size"))))
    return got.select("article_number", "title", "doi", F.col("authors")[0]["name"].alias("name"), F.col("authors")[0]["affiliation"].alias("affiliation"), "rank", "access_type")


@query("SELECT p_size::INT AS id_collect, 'http://arxiv.org/abs/' || p_partkey AS id, '2020-01-' || p_partkey % 10 AS published, p_name AS title, p_type AS abstract, p_brand || ';B' AS authors, 'http://pdf/' || p_partkey AS pdf, 'cs.' || p_size AS categories FROM part WHERE p_partkey % 2 = 0")
def scan_of_arxiv(spark, d):
    """Atom feeds parsed, records of another year left out."""
    k = F.col("p_partkey").cast("string")
    year = F.when(F.col("p_partkey") % 2 == 0, "2020").otherwise("2019")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    entry = F.concat(F.lit("<entry>"), tag("id", F.concat(F.lit("http://arxiv.org/abs/"), k)), tag("published", F.concat(year, F.lit("-01-"), (F.col("p_partkey") % 10).cast("string"))), tag("title", F.col("p_name")), tag("summary", F.col("p_type")), tag("author", tag("name", F.col("p_brand"))), F.lit("<author><name>B</name></author>"), F.lit('<link href="http://x" rel="alternate"/><link title="pdf" href="http://pdf/'), k, F.lit('"/><category term="cs.'), F.col("p_size").cast("string"), F.lit('"/></entry>'))
    rows = part(spark, d).groupBy(F.col("p_size").cast("int").alias("id_collect")).agg(F.count("*").cast("string").alias("n"), F.array_join(F.collect_list(entry), "").alias("r"))
    body = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><opensearch:totalResults>'), F.col("n"), F.lit("</opensearch:totalResults>"), F.col("r"), F.lit("</feed>"))
    pages = page_envelopes(rows.select(F.lit("Arxiv").alias("api"), "id_collect", F.lit(1).cast("long").alias("page"), body.alias("body")))
    got = scan_arxiv(of_year(raw_records(pages), 2020))
    return got.select("id_collect", "id", "published", "title", "abstract", F.array_join("authors", ";").alias("authors"), "pdf", F.array_join("categories", ";").alias("categories"))


@query("""
SELECT p_partkey AS url, p_name AS name, p_size::BIGINT AS num_papers, array_to_string(t, ';') AS tasks, CASE WHEN p_partkey % 5 <> 0 THEN 'u' || p_partkey END AS paper_url
FROM (SELECT *, list_filter([p_type, CASE WHEN p_size % 3 = 0 THEN 'Promo' ELSE 'x' END], lambda x: lower(x) IN ('economy', 'promo')) AS t FROM part) WHERE len(t) > 0""")
def kept_datasets(spark, d):
    """Datasets with a task in focus, and what is kept of them."""
    task = lambda c: F.struct(c.alias("task"), F.lit("u").alias("url"))
    tasks = F.array(task(F.col("p_type")), task(F.when(F.col("p_size") % 3 == 0, "Promo").otherwise("x")))
    paper = F.struct(F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).alias("url"))
    rows = part(spark, d).select(F.col("p_partkey").alias("url"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("num_papers"), F.lit("x").alias("other"), paper.alias("paper"), tasks.alias("tasks"))
    return dump.focused_datasets(rows, ["Economy", "PROMO"]).select("url", "name", "num_papers", F.array_join("tasks", ";").alias("tasks"), "paper_url")


@query("SELECT p_partkey, p_size % 5 NOT IN (0, 1) AND p_partkey % 7 <> 0 AS document, p_partkey % 3 = 0 AND p_size % 2 = 0 AS power FROM part")
def item_flags(spark, d):
    """Documents among items, and counts that are powers of ten."""
    kind = F.when(F.col("p_size") % 5 == 0, "attachment").when(F.col("p_size") % 5 == 1, "note").when(F.col("p_size") % 5 == 2, "book")
    title = F.when(F.col("p_partkey") % 14 == 0, "NA").when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    tag = F.concat(F.when(F.col("p_partkey") % 3 == 0, "NB: ").otherwise("LANG: "), F.when(F.col("p_size") % 2 == 0, "10^3").otherwise("3"))
    rows = part(spark, d).select("p_partkey", kind.alias("itemType"), title.alias("title"), tag.alias("tag"))
    return rows.select("p_partkey", filters.is_document().alias("document"), filters.is_power("tag").alias("power"))


@query("SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS index, o_orderkey, o_totalprice FROM orders")
def indexed_rows(spark, d):
    """The index column of an export (K3)."""
    return with_index(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("""
SELECT c_custkey::VARCHAR AS orcid, k.kwd, NULL AS org, NULL AS start, 'kwd' AS type FROM customer, (SELECT unnest(['nlp', 'ml']) AS kwd) k WHERE c_nationkey % 3 <> 0
UNION ALL SELECT c_custkey::VARCHAR, NULL, c_name, '2001', 'educ' FROM customer WHERE c_nationkey % 4 <> 0
UNION ALL SELECT c_custkey::VARCHAR, NULL, c_mktsegment, '2010', 'work' FROM customer WHERE c_nationkey % 5 <> 0""")
def merged_people(spark, d):
    """Persons from the answers of their sub-resources, then keywords and life paths."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    who, nation = F.col("c_custkey").cast("string").alias("orcid"), F.col("c_nationkey")
    step = lambda org, year: F.array(F.struct(F.struct(F.struct(F.lit(year).alias("value")).alias("year")).alias("start-date"), F.struct(org.alias("name")).alias("organization"), F.lit("dpt").alias("department-name")))
    words = F.to_json(F.struct(F.array(F.struct(F.lit("NLP, ml").alias("content"))).alias("keyword")))
    parts = c.where(nation % 3 != 0).select(who, F.lit("keywords").alias("resource"), words.alias("body"))
    parts = parts.unionByName(c.where(nation % 4 != 0).select(who, F.lit("educations").alias("resource"), F.to_json(F.struct(step(F.col("c_name"), "2001").alias("education-summary"))).alias("body")))
    parts = parts.unionByName(c.where(nation % 5 != 0).select(who, F.lit("employments").alias("resource"), F.to_json(F.struct(step(F.col("c_mktsegment"), "2010").alias("employment-summary"))).alias("body")))
    parts = parts.unionByName(c.select(who, F.lit("address").alias("resource"), F.lit("no json").alias("body")))
    persons = people.merged_parts(parts)
    none = F.lit(None).cast("string")
    words = people.keywords(persons).select("orcid", "kwd", none.alias("org"), none.alias("start"), F.lit("kwd").alias("type"))
    return words.unionByName(people.life_paths(persons).select("orcid", none.alias("kwd"), "org", "start", "type"))


@query("""
WITH t AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, 'http://r/' || min(l_suppkey) AS paper FROM lineitem GROUP BY 1)
SELECT o_orderkey, paper FROM orders JOIN t ON o_orderkey = k WHERE n = 1 AND o_orderstatus <> 'F'""")
def papers_in_graph(spark, d):
    """Items whose DOI exactly one paper of a triple store has (S26); a third of the orders have no DOI."""
    li, o = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "orders"))
    doi = F.concat(F.lit("10/"), F.col("l_orderkey").cast("string"))
    rows = li.select(F.concat(F.lit("http://r/"), F.col("l_suppkey").cast("string")).alias("s"), F.lit("P26").alias("p"), doi.alias("o"))
    rows = rows.unionByName(li.select(F.lit("http://other").alias("s"), F.lit("P1").alias("p"), doi.alias("o")))
    items = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("10/"), F.col("o_orderkey").cast("string"))).otherwise("NA").alias("DOI"))
    return kg.papers_by_doi(items, rows, "P26").select("o_orderkey", "paper")
