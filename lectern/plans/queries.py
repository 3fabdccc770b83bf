"""Registered queries: every operator over the whole driver tables, with the same rows in DuckDB where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import agreement, citations, compose, dedup, dump, filters, graph, kg, library, match, people, tags, text
from ..schema import aligned_union, nan_null, norm_missing
from ..sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return t(spark, d, "documents")


# ---- flagship -------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT doc_id AS ord, nullif(trim(text), '') AS title, lang AS language, source AS archive, CAST(n_chars AS VARCHAR) AS pages FROM documents),
k AS (SELECT * FROM r WHERE contains(lower(title), 'the') OR contains(lower(title), 'que')),
g AS (SELECT title, count(*) AS n, first(archive ORDER BY ord) AS w, string_agg(archive, ';' ORDER BY ord) AS a FROM k GROUP BY title)
SELECT CASE WHEN n > 1 THEN replace(a, w, w || '*') ELSE w END AS archive, count(*) AS n_records, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1""")
def aggregate_flagship(spark, d):
    r = docs(spark, d).select(F.col("doc_id").alias("ord"), norm_missing("text").alias("title"), F.col("lang").alias("language"), F.col("source").alias("archive"), F.col("n_chars").cast("string").alias("pages"), F.lit(None).cast("string").alias("abstract"), F.lit("1").alias("issue"))
    # text is trimmed as the oracle does; the filter reads title and abstract
    r = r.withColumn("title", F.trim("title"))
    k = filters.keyword_filter(r, ["the", "que"])
    cols = ["title", "language", "archive", "pages", "issue"]
    out = dedup.dedup_pass(k.select(*cols, "ord"), "title", cols, "ord", count="n").where("title is not null")
    return out.groupBy("archive").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_rows"))


# ---- filters --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(text), 'ment') OR contains(lower(source), 'tion') OR contains(lower(source), 'ment')")
def keyword_filter(spark, d):
    return filters.keyword_filter(docs(spark, d), ["TION", "ment"], title="source", abstract="text").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'und')) AND (contains(lower(text), 'ing') OR contains(lower(text), 'aux'))")
def search_predicate_cnf(spark, d):
    return docs(spark, d).where(filters.search_predicate([["the", "und"], ["ing", "aux"]], ["text"])).select("doc_id")


@query("""
SELECT 'same' AS shape, doc_id FROM documents WHERE (contains(lower(text), 'en') AND contains(lower(text), 'es')) OR (contains(lower(lang), 'en') AND contains(lower(lang), 'es'))
UNION ALL SELECT 'each', doc_id FROM documents WHERE contains(lower(text), 'en') AND contains(lower(lang), 'en')
UNION ALL SELECT 'words', doc_id FROM documents WHERE contains(lower(text), 'elle') OR contains(lower(lang), 'elle') OR contains(lower(text), 'ble') OR contains(lower(lang), 'ble')""")
def search_predicate_sources(spark, d):
    x = docs(spark, d)
    same = x.where(filters.search_predicate([["en"], ["es"]], ["text", "lang"], "same")).select(F.lit("same").alias("shape"), "doc_id")
    each = x.where(filters.search_predicate([["en"]], ["text", "lang"], "each")).select(F.lit("each").alias("shape"), "doc_id")
    words = x.where(registry.SourceSpec("any", 1, 1, lambda k, y: "", fields=("text", "lang"), any_word=True, by_year=False).predicate(["elle", "ble"], 2020)).select(F.lit("words").alias("shape"), "doc_id")
    return same.unionByName(each).unionByName(words)


@query("SELECT o_orderkey FROM orders WHERE contains(strftime(o_orderdate, '%Y-%m-%d'), '1997')")
def year_residual(spark, d):
    return t(spark, d, "orders").where(filters.published_in(F.date_format("o_orderdate", "yyyy-MM-dd"), 1997)).select("o_orderkey")


@query("SELECT doc_id FROM labels WHERE coalesce(quality, -1) = 1")
def relevance_filter(spark, d):
    return t(spark, d, "labels").where(filters.relevant("quality")).select("doc_id")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) IN ('economy', 'small')")
def focus_filter(spark, d):
    return t(spark, d, "part").where(filters.in_focus("p_type", ["Economy", "small"])).select("p_partkey", "p_type")


@query("SELECT page_id, (contains(lower(url), '/fr/') ) AS is_fr, url LIKE '%/%' AS with_slash FROM pages")
def predicate_flags(spark, d):
    return t(spark, d, "pages").select("page_id", filters.has("url", "/FR/").alias("is_fr"), filters.valid_doi("url").alias("with_slash"))


@query("""
WITH a AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_annotators FROM orders GROUP BY 1)
SELECT o_custkey, n_annotators FROM a WHERE n_annotators > 3""")
def enough_annotators(spark, d):
    return filters.enough_annotators(t(spark, d, "orders"), "o_custkey", "o_orderpriority")


# ---- composition and state ------------------------------------------------------------------------------------


@query("""
WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders)
SELECT r_name AS api, n_name AS keyword, year, row_number() OVER (PARTITION BY r_name ORDER BY n_name, year) - 1 AS id_collect FROM region, nation, y""")
def query_matrix(spark, d):
    years = t(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct()
    m = compose.product(t(spark, d, "region").select(F.col("r_name").alias("api")), t(spark, d, "nation").select(F.col("n_name").alias("keyword")), years)
    return compose.number_queries(m, "api", ["keyword", "year"]).withColumn("id_collect", F.col("id_collect").cast("long"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 ELSE -1 END AS state FROM orders),
a AS (SELECT o_custkey, CASE WHEN bool_and(state = 1) THEN 1 ELSE 0 END AS api_state FROM s GROUP BY 1)
SELECT o_custkey, api_state, (SELECT min(api_state) FROM a) AS global_state, count(*) FILTER (state <> 1) AS n_pending FROM s JOIN a USING (o_custkey) GROUP BY 1, 2""")
def state_rollup(spark, d):
    s = t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 0).otherwise(-1).alias("state"))
    return compose.rolled_up(s, "o_custkey").groupBy("o_custkey", "api_state", "global_state").agg(F.count_if(F.col("state") != 1).alias("n_pending"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 ELSE -1 END AS state FROM orders),
a AS (SELECT o_custkey, bool_and(state = 1) AS done FROM s GROUP BY 1)
SELECT o_orderkey, o_custkey FROM s JOIN a USING (o_custkey) WHERE NOT done AND state <> 1 AND NOT (SELECT bool_and(done) FROM a)""")
def pending_jobs(spark, d):
    s = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 0).otherwise(-1).alias("state"))
    return compose.pending(s, "o_custkey").select("o_orderkey", "o_custkey")


@query("""
WITH old AS (SELECT DISTINCT c_mktsegment AS api, CAST(c_nationkey AS VARCHAR) AS keyword, 0 AS year FROM customer WHERE c_nationkey < 10),
o AS (SELECT *, row_number() OVER (PARTITION BY api ORDER BY keyword) - 1 AS id FROM old),
n AS (SELECT DISTINCT c_mktsegment AS api, CAST(c_nationkey AS VARCHAR) AS keyword, 0 AS year FROM customer),
j AS (SELECT n.api, n.keyword, o.id, (SELECT max(id) FROM o x WHERE x.api = n.api) AS top FROM n LEFT JOIN o USING (api, keyword))
SELECT api, keyword, coalesce(id, top + row_number() OVER (PARTITION BY api, id IS NULL ORDER BY keyword))::BIGINT AS id_collect FROM j""")
def collection_registry(spark, d):
    c = t(spark, d, "customer").select(F.col("c_mktsegment").alias("api"), F.col("c_nationkey").cast("string").alias("keyword"), F.lit(0).alias("year"), "c_nationkey")
    old = compose.number_queries(c.where("c_nationkey < 10").drop("c_nationkey").distinct(), "api", ["keyword"])
    return compose.register(old, c.drop("c_nationkey").distinct()).select("api", "keyword", F.col("id_collect").cast("long").alias("id_collect"))


# ---- union, missing values, deduplication -----------------------------------------------------------------------


@query("""
SELECT c_name AS name, c_acctbal AS acctbal, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, s_nationkey, NULL FROM supplier""")
def union_align(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    return aligned_union(c, s)


@query("""
WITH r AS (SELECT d.doc_id, nullif(d.lang, 'en') AS lang, CASE WHEN upper(trim(d.source)) IN ('', 'NA', 'SRC3') THEN NULL ELSE d.source END AS source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) AS quality_score FROM r""")
def record_quality(spark, d):
    r = docs(spark, d).select("doc_id", norm_missing(F.when(F.col("lang") == "en", "NA").otherwise(F.col("lang"))).alias("lang"), norm_missing(F.when(F.col("source") == "src3", " nan ").otherwise(F.col("source"))).alias("source")).join(t(spark, d, "labels"), "doc_id", "left")
    return r.select("doc_id", dedup.quality(["lang", "source", "quality", "toxic"]).alias("quality_score"))


@query("""
WITH k AS (SELECT nullif(lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')), '') AS key FROM documents)
SELECT md5(key) AS key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY k.key HAVING count(*) > 1""")
def dup_keys(spark, d):
    return dedup.duplicate_keys(docs(spark, d).select(F.md5(S.squash("text")).alias("key")), "key")  # digests, not texts, are shuffled


PART = """
p AS (SELECT p_partkey AS ord, {key1} AS key1, p_name AS title, p_brand AS archive, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS pages, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS volume, CASE WHEN p_partkey % 5 < 3 THEN NULL ELSE CAST(p_partkey AS VARCHAR) END AS issue FROM part),
q AS (SELECT *, (archive IS NOT NULL)::INT + (pages IS NOT NULL)::INT + (volume IS NOT NULL)::INT + (issue IS NOT NULL)::INT + (title IS NOT NULL)::INT + (key1 IS NOT NULL)::INT AS quality FROM p)
"""


def parts(spark, d, key1):
    p = t(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), key1.alias("key1"), F.col("p_name").alias("title"), F.col("p_brand").alias("archive"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).alias("pages"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("volume"), F.when(F.col("p_partkey") % 5 >= 3, F.col("p_partkey").cast("string")).alias("issue"),
    )


def one_pass(name: str, source: str, key: str, others: list[str]) -> str:
    fill = ", ".join(f"coalesce(first({c} ORDER BY quality DESC, o), first({c} ORDER BY o) FILTER ({c} IS NOT NULL)) AS {c}" for c in others)
    return f"""{name} AS (SELECT {key}, {fill}, CASE WHEN count(*) > 1 THEN replace(string_agg(archive, ';' ORDER BY o), first(archive ORDER BY quality DESC, o), first(archive ORDER BY quality DESC, o) || '*') ELSE first(archive) END AS archive,
  CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS late, CASE WHEN count(*) > 1 THEN {key} ELSE '' END AS lk, min(o) AS mo FROM {source} WHERE {key} IS NOT NULL GROUP BY {key})"""


@query("WITH " + PART.format(key1="CAST(NULL AS VARCHAR)") + ", x AS (SELECT *, ord AS o FROM q), " + one_pass("m", "x", "title", ["pages", "volume", "issue"]) + " SELECT title, archive, pages, volume, issue FROM m")
def dedup_survivor(spark, d):
    cols = ["key1", "title", "archive", "pages", "volume", "issue"]
    return dedup.dedup_pass(parts(spark, d, F.lit(None).cast("string")), "title", cols, "ord").select("title", "archive", "pages", "volume", "issue")


@query(
    "WITH " + PART.format(key1="CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'k' || CAST(p_partkey % 900 AS VARCHAR) END") + ", x AS (SELECT *, ord AS o FROM q), "
    + one_pass("m", "x", "key1", ["title", "pages", "volume", "issue"])
    + """, u AS (SELECT key1, title, pages, volume, issue, archive, late, lk, mo FROM m UNION ALL SELECT key1, title, pages, volume, issue, archive, 0, '', ord FROM x WHERE key1 IS NULL),
y AS (SELECT *, row_number() OVER (ORDER BY late, lk, mo) AS o, (archive IS NOT NULL)::INT + (pages IS NOT NULL)::INT + (volume IS NOT NULL)::INT + (issue IS NOT NULL)::INT + (title IS NOT NULL)::INT + (key1 IS NOT NULL)::INT AS quality FROM u), """
    + one_pass("z", "y", "title", ["key1", "pages", "volume", "issue"]) + " SELECT title, key1, archive, pages, volume, issue FROM z"
)
def dedup_two_pass(spark, d):
    cols = ["key1", "title", "archive", "pages", "volume", "issue"]
    p = parts(spark, d, F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("k"), (F.col("p_partkey") % 900).cast("string"))))
    return dedup.deduplicate(p, cols, "ord", ("key1", "title")).select("title", "key1", "archive", "pages", "volume", "issue")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN NULL ELSE o_totalprice END AS price FROM orders")
def nan_to_null(spark, d):
    price = F.when(F.col("o_totalprice") > 250000, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return t(spark, d, "orders").select("o_orderkey", nan_null(price).alias("price"))


# ---- citations and graph ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS citing, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def citation_counts(spark, d):
    return citations.counts(t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "citing"), "citing", "l_partkey")


@query("""
WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS citing, 'p' || l_partkey AS cited FROM lineitem),
a AS (SELECT citing, count(*) AS nb_cited, string_agg(cited, '","' ORDER BY cited) AS l FROM e GROUP BY 1)
SELECT 'o' || o_orderkey AS doi, coalesce(nb_cited, 0) AS nb_cited, 0::BIGINT AS nb_citation, '{"citing":[],"cited":[' || coalesce('"' || l || '"', '') || ']}' AS extra FROM orders LEFT JOIN a ON a.citing = 'o' || o_orderkey""")
def citation_enrichment(spark, d):
    e = t(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("citing"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("cited"))
    r = t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doi"))
    return citations.enrich(r, e, "doi")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'broken' ELSE '{''citing'': [''' || event_type || '''], ''cited'': [''a'', ''b'']}' END AS extra FROM events)
SELECT event_id, CASE WHEN extra = 'broken' THEN 0 ELSE 2 END::BIGINT AS nb_cited, CASE WHEN extra = 'broken' THEN 0 ELSE 1 END::BIGINT AS nb_citation FROM e""")
def stored_citation_counts(spark, d):
    extra = F.when(F.col("event_id") % 5 == 0, "broken").otherwise(F.concat(F.lit("{'citing': ['"), F.col("event_type"), F.lit("'], 'cited': ['a', 'b']}")))
    return citations.stored_counts(t(spark, d, "events").select("event_id", extra.alias("extra"))).select("event_id", "nb_cited", "nb_citation")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (p_size % 6 = 0) AS n_no_doi, count(*) FILTER (p_type = 'SMALL') AS n_with_extra,
 count(*) - count(DISTINCT CASE WHEN p_size % 6 <> 0 THEN p_name END) - CASE WHEN count(*) FILTER (p_size % 6 = 0) > 0 THEN 1 ELSE 0 END AS n_duplicated, count(DISTINCT CASE WHEN p_size % 6 <> 0 THEN p_name END) AS n_doi FROM part""")
def quality_counters(spark, d):
    p = t(spark, d, "part").select(F.when(F.col("p_size") % 6 != 0, F.col("p_name")).alias("DOI"), F.when(F.col("p_type") == "SMALL", "{'citing': [], 'cited': []}").alias("Extra"))
    return citations.quality_counts(p)


@query("""
WITH f AS (SELECT l_partkey AS doi, strftime(min(l_shipdate), '%Y-%m-%d') AS date, count(*) AS n FROM lineitem GROUP BY 1),
v AS (SELECT *, year(date::DATE) AS y, 2002 - year(date::DATE) AS dur FROM f WHERE year(date::DATE) > 1994)
SELECT doi, y::INT AS year, n, CASE WHEN dur > 0 AND n > 0 THEN round(n / dur, 9) END AS ratio, CASE WHEN dur > 0 AND n > 0 THEN (n / dur > 4)::INT WHEN n > 0 THEN 1 ELSE 0 END AS interest FROM v""")
def citation_velocity(spark, d):
    f = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("doi")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("date"), F.count("*").alias("n"))
    return citations.velocity(f, S.year_of("date"), F.col("n"), 2002, 1994, 4.0).select("doi", "year", "n", F.round("ratio", 9).alias("ratio"), "interest")


@query("""
WITH f AS (SELECT 'P' || l_partkey AS doi, strftime(min(l_shipdate), '%Y-%m-%d') AS date, count(*) AS n FROM lineitem GROUP BY 1),
v AS (SELECT *, 2002 - year(date::DATE) AS dur FROM f WHERE year(date::DATE) > 1994)
SELECT doi, date, n FROM v WHERE CASE WHEN dur > 0 THEN n / dur > 4 ELSE true END AND lower(doi) NOT IN (SELECT 'p' || s_suppkey FROM supplier)""")
def velocity_selection(spark, d):
    f = t(spark, d, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("doi")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("date"), F.count("*").alias("n"))
    own = t(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("doi"))
    return citations.select_by_velocity(f, own, ref_year=2002, min_year=1994, min_ratio=4.0)


PAPERS = """
l AS (SELECT l_orderkey, string_agg(DISTINCT '10/p' || l_partkey, ''', ''' ORDER BY '10/p' || l_partkey) AS a, string_agg(DISTINCT '10/s' || l_suppkey, ''', ''' ORDER BY '10/s' || l_suppkey) AS b FROM lineitem GROUP BY 1),
m AS (SELECT DISTINCT '10/p' || (l_orderkey % 3000) AS own, x.o AS other, x.k AS outward FROM lineitem, LATERAL (SELECT unnest(['10/p' || l_partkey, '10/s' || l_suppkey]) AS o, unnest([true, false]) AS k) x)
"""


def papers(spark, d) -> DataFrame:
    """Orders as papers: their parts are newer works, their suppliers older ones; ids wrap, so that orders are among the parts, too."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("10/p"), F.col("l_partkey").cast("string")))).alias("a"), F.array_sort(F.collect_set(F.concat(F.lit("10/s"), F.col("l_suppkey").cast("string")))).alias("b"))
    quoted = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    extra = F.concat(F.lit("{'citing': "), quoted("a"), F.lit(", 'cited': "), quoted("b"), F.lit("}"))
    doi = F.concat(F.lit("10/p"), (F.col("l_orderkey") % 3000).cast("string"))
    return li.select(F.col("l_orderkey").alias("ord"), doi.alias("DOI"), extra.alias("Extra"), (1990 + F.col("l_orderkey") % 30).cast("string").alias("Year"), F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("Label"), F.lit(None).cast("string").alias("Title"), F.lit(None).cast("string").alias("Url"), F.lit("library").alias("origin"))


@query("WITH " + PAPERS + 'SELECT DISTINCT CASE WHEN outward THEN own ELSE other END AS "Source", CASE WHEN outward THEN other ELSE own END AS "Target" FROM m WHERE own <> other')
def graph_edges(spark, d):
    return graph.edges(graph.mentions(papers(spark, d)))


@query("""
WITH e AS (SELECT l_orderkey AS ord, '10/p' || (l_orderkey % 3000) AS own, 1 AS late, '10/p' || l_partkey AS other FROM lineitem UNION ALL SELECT l_orderkey, '10/p' || (l_orderkey % 3000), 0, '10/s' || l_suppkey FROM lineitem),
known AS (SELECT own AS id, min(ord) AS ord FROM e GROUP BY own),
f AS (SELECT other AS id, min(ord) AS ord FROM e WHERE other NOT IN (SELECT id FROM known) GROUP BY 1),
w AS (SELECT f.id, f.ord, min(e.late) AS late FROM f JOIN e ON e.other = f.id AND e.ord = f.ord GROUP BY 1, 2),
n AS (SELECT id, ord, row_number() OVER (ORDER BY ord, 1 - late, id) - 1 AS k FROM w)
SELECT id AS "Id", 'L' || ord AS "Label", 'library' AS origin, CAST(1990 + ord % 30 AS VARCHAR) AS "Year", CAST(NULL AS VARCHAR) AS "Url", '2023' AS "End_Date" FROM known
UNION ALL SELECT id, 'new_' || k, 'new paper', CAST(1990 + ord % 30 AS VARCHAR), 'https://doi.org/' || id, '2023' FROM n""")
def graph_nodes(spark, d):
    p = papers(spark, d)
    return graph.nodes(p, graph.mentions(p)).drop("Title")


@query("""
SELECT DISTINCT '10/p' || (l_orderkey % 3000) AS "Source", '10/p' || l_partkey AS "Target" FROM lineitem WHERE l_orderkey % 3000 <> l_partkey""")
def graph_edges_list(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("10/p"), F.col("l_partkey").cast("string")))).alias("a"))
    p = li.select(F.col("l_orderkey").alias("ord"), F.concat(F.lit("10/p"), (F.col("l_orderkey") % 3000).cast("string")).alias("DOI"), F.concat(F.lit("['"), F.array_join("a", "', '"), F.lit("']")).alias("Extra"))
    return graph.edges(graph.mentions(p, extra_format="list"))


# ---- joins -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_existing(spark, d):
    return library.absent(t(spark, d, "documents").select(F.col("doc_id").alias("url")), t(spark, d, "labels").select(F.col("doc_id").alias("url"))).select(F.col("url").alias("doc_id"))


@query("""
WITH s AS (SELECT DISTINCT lower(p_name) AS k, p_brand FROM part WHERE p_size <= 2), u AS (SELECT k, min(p_brand) AS subject FROM s GROUP BY k HAVING count(*) = 1)
SELECT p_partkey, subject FROM part JOIN u ON lower(p_name) = k""")
def exactly_one_match(spark, d):
    p = t(spark, d, "part")
    return kg.unique_match(p.withColumn("title", F.concat("p_name", F.lit("."))), p.where("p_size <= 2").select(F.col("p_brand").alias("s"), F.upper("p_name").alias("o")), "title").select("p_partkey", "subject")


@query("""
SELECT event_id, coalesce(c_name, s_name) AS value FROM events LEFT JOIN customer ON c_custkey = user_id AND c_mktsegment = 'BUILDING' LEFT JOIN supplier ON s_suppkey = user_id""")
def fallback_join(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("k0"), F.col("user_id").alias("k1"))
    a = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    b = t(spark, d, "supplier")
    return kg.fallback(e, (a.select(F.col("c_custkey").alias("k0"), "c_name"), "k0", "c_name"), (b.select(F.col("s_suppkey").alias("k1"), "s_name"), "k1", "s_name")).select("event_id", "value")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_write_wins(spark, d):
    return dump.last_link(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""
WITH f AS (SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY 1)
SELECT s_suppkey, c_name FROM supplier LEFT JOIN f ON s_nationkey = c_nationkey""")
def first_match(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_nationkey", "nk")
    return match.first_match(t(spark, d, "supplier").withColumnRenamed("s_nationkey", "nk"), c, "nk", "c_custkey", ["c_name"]).select("s_suppkey", "c_name")


@query("""
WITH a AS (SELECT s_suppkey, right(regexp_replace(s_name, '[^0-9]', '', 'g'), 5) AS k FROM supplier), b AS (SELECT c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 5) AS k FROM customer)
SELECT s_suppkey, c_custkey FROM a, b WHERE damerau_levenshtein(a.k, b.k) < 2""")
def fuzzy_title(spark, d):
    digits = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(5))
    return match.fuzzy_pairs(t(spark, d, "supplier").select("s_suppkey", digits("s_name").alias("k")), t(spark, d, "customer").select("c_custkey", digits("c_name").alias("k")), "s_suppkey", "k", "c_custkey", "k")


@query("""
WITH a AS (SELECT s_suppkey, regexp_replace(s_name, '[^0-9]', '', 'g') AS k FROM supplier), b AS (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS k FROM customer)
SELECT s_suppkey, c_custkey FROM a, b WHERE damerau_levenshtein(a.k, b.k) < 2""")
def fuzzy_title_whole(spark, d):
    """fuzzy_title over all digits."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return match.fuzzy_pairs(t(spark, d, "supplier").select("s_suppkey", digits("s_name").alias("k")), t(spark, d, "customer").select("c_custkey", digits("c_name").alias("k")), "s_suppkey", "k", "c_custkey", "k")


@query("""
WITH i AS (SELECT s_suppkey AS key, right(s_name, 3) AS title FROM supplier), c AS (SELECT s_suppkey AS key, rank, lpad(CAST((s_suppkey + off) % 1000 AS VARCHAR), 3, '0') AS title, 'd' || rank AS doi FROM supplier, (SELECT unnest([1, 2, 3]) AS rank, unnest([11, 1, 0]) AS off)),
m AS (SELECT i.key, min(rank) AS rank FROM i JOIN c ON c.key = i.key AND rank <= 2 AND damerau_levenshtein(i.title, c.title) < 2 GROUP BY 1)
SELECT i.key, coalesce('d' || rank, 'not found') AS "DOI" FROM i LEFT JOIN m USING (key)""")
def doi_repair(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.right("s_name", F.lit(3)).alias("title"), F.lit(None).cast("string").alias("DOI"))
    offs = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(o).alias("off")) for r, o in ((1, 11), (2, 1), (3, 0))]))
    c = s.select("key", offs.alias("x")).select("key", "x.rank", F.lpad(((F.col("key") + F.col("x.off")) % 1000).cast("string"), 3, "0").alias("title"), F.concat(F.lit("d"), F.col("x.rank").cast("string")).alias("DOI"))
    return match.repair_dois(s, c).select("key", "DOI")


# ---- tags ------------------------------------------------------------------------------------------------------

TAGS = "e AS (SELECT event_id, user_id, event_type || ':' || json_extract_string(props, '$.k') AS tag, 'type:' || event_type AS auto FROM events)"


def tagged(spark, d) -> DataFrame:
    e = t(spark, d, "events")
    return e.select("event_id", "user_id", F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("tag"), F.concat(F.lit("type:"), F.col("event_type")).alias("auto"))


@query("WITH " + TAGS + " SELECT tag, count(*) AS nb FROM (SELECT tag FROM e UNION ALL SELECT auto FROM e) GROUP BY tag")
def tag_frequency(spark, d):
    e = tagged(spark, d).select(F.concat("tag", F.lit(";")).alias("manual"), "auto")
    return tags.frequency(tags.exploded(e, "manual", "auto"))


@query("WITH " + TAGS + ", f AS (SELECT tag, count(*) AS nb FROM e GROUP BY tag) SELECT count(*) FILTER (nb > 1) AS over_1, count(*) FILTER (nb > 10) AS over_10, count(*) FILTER (nb > 100) AS over_100 FROM f")
def tag_thresholds(spark, d):
    return tags.thresholds(tags.frequency(tagged(spark, d)), (1, 10, 100))


@query("WITH " + TAGS + " SELECT upper(trim(string_split(tag, ':')[1])) AS level1, count(*)::BIGINT AS nb FROM e GROUP BY 1")
def tag_rollup(spark, d):
    return tags.roll_up(tags.frequency(tagged(spark, d)))


@query("WITH " + TAGS + " SELECT upper(tag) AS tag, upper(string_split(tag, ':')[1]) AS key, upper(string_split(tag, ':')[2]) AS value, count(*) AS nb FROM e GROUP BY 1, 2, 3")
def tag_key_values(spark, d):
    return tags.key_values(tagged(spark, d).withColumn("tag", F.concat(F.lit(" "), F.col("tag"), F.lit(" "))))


@query("""
WITH e AS (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS v FROM events)
SELECT user_id, string_agg(v, ',' ORDER BY v) FILTER (event_type = 'click') AS click, string_agg(v, ',' ORDER BY v) FILTER (event_type = 'error') AS error, string_agg(v, ',' ORDER BY v) FILTER (event_type = 'view') AS view FROM e WHERE event_type IN ('click', 'error', 'view') OR true GROUP BY 1""")
def tag_pivot(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("v"))
    return tags.pivoted(e, "user_id", "event_type", "v", ["click", "error", "view"])


@query("""
SELECT p_partkey, 'TYPE:' || string_agg(upper(w[1]) || lower(w[2:]), '' ORDER BY i) AS tag FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY 1""")
def tag_normalize(spark, d):
    return t(spark, d, "part").select("p_partkey", S.tag_value("TYPE", "p_name").alias("tag"))


@query("""
WITH e AS (SELECT user_id, event_type AS tag FROM events),
n AS (SELECT user_id, tag AS old, CASE tag WHEN 'click' THEN 'ACT:click' WHEN 'view' THEN 'view' WHEN 'error' THEN NULL WHEN 'signup' THEN 'STEP:first' ELSE tag END AS new FROM e)
SELECT user_id, coalesce(string_agg(DISTINCT new, ';' ORDER BY new), '') AS tags, coalesce(string_agg(DISTINCT new, ';' ORDER BY new), '') <> string_agg(DISTINCT old, ';' ORDER BY old) AS changed FROM n GROUP BY 1""")
def tag_replace(spark, d):
    rules = spark.createDataFrame([("click", "PWC:ACT:click", None, None, None), ("view", None, "x", "x", None), ("error", None, None, "x", None), ("signup", None, "", None, "first")], "tag string, replace_by string, keep string, delete string, STEP1 string")
    out = tags.replace_tags(t(spark, d, "events").select("user_id", F.col("event_type").alias("tag")), rules, "user_id", ["STEP1"])
    return out.select("user_id", F.array_join("tags", ";").alias("tags"), "changed")


@query("""
WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type || ':' || CASE WHEN value > 15 THEN '?' ELSE 'x' END))) AS l FROM events GROUP BY 1),
h AS (SELECT user_id, list_distinct(list_transform(list_filter(l, lambda x: string_split(x, ':')[1] IN ('click', 'view') AND NOT contains(x, '?')), lambda x: string_split(x, ':')[1] || ':X')) AS held FROM e)
SELECT user_id, array_to_string(list_concat(list_sort(held), list_transform(list_filter(['click', 'view', 'lang'], lambda r: NOT list_contains(list_transform(held, lambda h: string_split(h, ':')[1]), r)), lambda r: r || ':?')), ';') AS tags FROM h""")
def tag_fill(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat("event_type", F.lit(":"), F.when(F.col("value") > 15, "?").otherwise("x")))).alias("l"))
    return e.select("user_id", F.array_join(tags.fill_required(F.col("l"), ["click", "view", "lang"]), ";").alias("tags"))


@query("""
WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type || ':' || CASE WHEN value > 15 THEN '?' ELSE '1' END))) AS l FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_concat(list_filter(l, lambda x: x <> 'error:?'), list_transform(list_filter(['click', 'extra'], lambda r: NOT list_contains(list_transform(l, lambda h: string_split(h, ':')[1]), r)), lambda r: r || ':?')), ';') AS tags FROM e""")
def tag_policy(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat("event_type", F.lit(":"), F.when(F.col("value") > 15, "?").otherwise("1")))).alias("l"))
    return e.select("user_id", F.array_join(tags.apply_policy(F.col("l"), ["click"], ["extra"], ["error"]), ";").alias("tags"))


@query("""
WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS l FROM events WHERE value < 8 GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN list_contains(l, 'NEG') OR user_id NOT IN (SELECT s_suppkey FROM supplier) THEN l ELSE list_append(l, 'NEG') END, ';') AS tags FROM e""")
def tag_listed(spark, d):
    e = t(spark, d, "events").where("value < 8").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return tags.tag_listed(e, t(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "l", "NEG").select("user_id", F.array_join("l", ";").alias("tags"))


@query("""
WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS l FROM events GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN list_contains(l, 'NEG') OR user_id NOT IN (SELECT s_suppkey FROM supplier) THEN l ELSE list_append(l, 'NEG') END, ';') AS tags FROM e""")
def tag_listed_all(spark, d):
    """tag_listed over all events."""
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return tags.tag_listed(e, t(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "l", "NEG").select("user_id", F.array_join("l", ";").alias("tags"))


@query("SELECT n.n_name AS name, r.r_name AS parent_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey UNION ALL SELECT r_name, NULL FROM region")
def collection_hierarchy(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parentCollection"))
    r = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parentCollection"))
    return tags.children(n.unionByName(r)).select("name", "parent_name")


@query("SELECT DISTINCT event_type AS prefix FROM events")
def tag_prefixes(spark, d):
    return tags.prefixes(tagged(spark, d))


@query("WITH " + TAGS + " SELECT tag, count(*) AS nb FROM e WHERE contains(upper(tag), 'SIGN') GROUP BY tag")
def tag_prefix_filter(spark, d):
    return tags.frequency(tagged(spark, d).where(filters.prefixed("tag", "SIGN")))


# ---- dump and knowledge graph -----------------------------------------------------------------------------------


@query("""
SELECT year(o_orderdate)::INT AS year, count(*) AS total, count(*) FILTER (contains(o_orderpriority, 'LOW')) AS preprint, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS code,
 count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS benchmarked FROM orders GROUP BY 1""")
def year_stats(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "paper_url")
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("paper_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.contains("o_orderpriority", F.lit("LOW")), "arxiv").otherwise("x").alias("url_abs"))
    return dump.yearly(dump.flagged(p, li.where("l_quantity > 40"), li.where("l_returnflag = 'R'"), li.where("false")))


@query("""
WITH f AS (SELECT o_orderkey, contains(o_orderpriority, 'LOW') AS pre, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS code, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS bench, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0) AS ds FROM orders)
SELECT o_orderkey, CASE WHEN code THEN 'STATUT:have code' ELSE 'STATUT:donthave code' END || ';' || CASE WHEN bench THEN 'STATUT:is benchmarked' ELSE 'STATUT:not benchmarked' END AS tags FROM f WHERE (NOT pre OR code OR bench) AND NOT ds""")
def push_gate(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "paper_url")
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("paper_url"), F.when(F.contains("o_orderpriority", F.lit("LOW")), "arxiv").otherwise("x").alias("url_abs"))
    out = dump.to_push(dump.flagged(p, li.where("l_quantity > 40"), li.where("l_returnflag = 'R'"), li.where("l_tax = 0")))
    return out.select(F.col("paper_url").alias("o_orderkey"), F.array_join(dump.status_tags(F.col("has_code"), F.col("is_benchmarked")), ";").alias("tags"))


@query("""
SELECT DISTINCT 'order' || l_orderkey AS task, 'part' || l_partkey AS dataset, l_suppkey AS paper FROM lineitem UNION SELECT DISTINCT 'order' || l_orderkey, 'sub' || l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 3""")
def nested_subtask_union(spark, d):
    li = t(spark, d, "lineitem")
    row = F.struct(F.col("l_suppkey").cast("string").alias("paper_url"), F.lit("m").alias("model_name"), F.lit("{}").alias("metrics"))
    ds = lambda name: F.struct(F.concat(F.lit(name), F.col("l_partkey").cast("string")).alias("dataset"), F.struct(F.array(row).alias("rows")).alias("sota"))
    nested = li.groupBy(F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("task")).agg(F.collect_list(ds("part")).alias("datasets"), F.collect_list(F.when(F.col("l_linenumber") > 3, F.struct(F.array(ds("sub")).alias("datasets")))).alias("subtasks"))
    return dump.evaluation_rows(nested).select("task", "dataset", F.col("paper_url").cast("long").alias("paper")).distinct()


@query("""
WITH p AS (SELECT p_partkey, lpad(CAST(1000 + p_partkey % 9000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS id, p_type AS task FROM part),
e AS (SELECT DISTINCT p_type AS task, lpad(CAST(1000 + l_partkey % 9000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS id, l_suppkey FROM lineitem JOIN part ON p_partkey = l_suppkey)
SELECT p_partkey AS paper, p.task, 'm' || l_suppkey AS model_name FROM p JOIN e ON p.task = e.task AND p.id = e.id""")
def substring_sota_join(spark, d):
    ident = lambda c: F.concat(F.lpad((1000 + F.col(c) % 9000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col(c).cast("string"), 5, "0"))
    part = t(spark, d, "part")
    p = part.select(F.col("p_partkey").alias("paper_url"), ident("p_partkey").alias("arxiv_id"), F.array("p_type").alias("tasks"))
    li = t(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_suppkey"))
    e = li.select(F.col("p_type").alias("task"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model_name"), F.lit("d").alias("dataset"), F.concat(F.lit("https://x.org/abs/"), ident("l_partkey")).alias("paper_url")).distinct()
    return dump.sota_papers(p, e).select(F.col("paper_url").alias("paper"), "task", "model_name")


@query("SELECT p_brand AS task, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS datasets FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#2', 'brand#17') GROUP BY 1")
def datasets_per_task(spark, d):
    return dump.datasets_by_task(t(spark, d, "part").select("p_type", F.array("p_brand").alias("tasks")), "p_type", "tasks", ["BRAND#1", "brand#2", "Brand#17"])


@query("SELECT event_type AS task, count(*) AS nb FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events")
def dataset_tasks(spark, d):
    return dump.task_counts(t(spark, d, "events").select(F.array("event_type", F.lit("all")).alias("tasks")), "tasks")


@query("""
SELECT user_id AS paper_url, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS "shortTitle" FROM events GROUP BY 1""")
def model_names(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("paper_url"), F.col("event_type").alias("model_name"), F.lit("d").alias("dataset"), F.col("props").alias("metrics_json"))
    return dump.results_by_paper(e).select("paper_url", "shortTitle")


@query("""
SELECT c_custkey::VARCHAR AS s, r_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def kg_two_hop(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.lit("inNation").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("o"))
    n = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("inRegion").alias("p"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("o"))
    r = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("name").alias("p"), F.col("r_name").alias("o"))
    return kg.path(c.unionByName(n).unionByName(r), "inNation", "inRegion", "name").select(F.substring("s", 2, 20).alias("s"), "o")


# ---- agreement --------------------------------------------------------------------------------------------------

RATED = "r AS (SELECT user_id % 3 AS dim, user_id AS url, event_type AS category, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 12 GROUP BY 1, 2, 3)"


def rated(spark, d) -> DataFrame:
    """A user's first twelve events as twelve raters' categories of one subject."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t(spark, d, "events").withColumn("k", k).where("k <= 12").select((F.col("user_id") % 3).alias("dim"), F.col("user_id").alias("url"), F.col("event_type").alias("category"))
    return agreement.contingency(e, ["dim"])


@query("WITH " + RATED + """,
s AS (SELECT dim, url, sum(n) AS m, sum(n * n) AS sq FROM r GROUP BY 1, 2),
a AS (SELECT dim, count(*) AS n_subjects, max(m)::BIGINT AS n_raters, min(m) AS m0, avg((sq - m) / (m * (m - 1))) AS p FROM s GROUP BY 1),
c AS (SELECT dim, sum(c * c) / (sum(c) * sum(c)) AS pe FROM (SELECT dim, category, sum(n)::DOUBLE AS c FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT dim, n_subjects, n_raters, CASE WHEN m0 = n_raters AND pe < 1 THEN round((p - pe) / (1 - pe), 9) END AS kappa FROM a JOIN c USING (dim)""")
def fleiss_kappa(spark, d):
    return agreement.fleiss(rated(spark, d), ["dim"]).select("dim", "n_subjects", "n_raters", F.round("kappa", 9).alias("kappa"))


@query("""
WITH e AS (SELECT user_id AS url, hour(ts) AS annotator, list_sort(list_distinct(list('TYPE:' || event_type))) AS l FROM events GROUP BY 1, 2),
g AS (SELECT url, annotator, coalesce(array_to_string(l, ';'), 'TYPE:?') AS category FROM (SELECT DISTINCT url FROM e) CROSS JOIN (SELECT unnest(range(24)) AS annotator) LEFT JOIN e USING (url, annotator)),
r AS (SELECT url % 3 AS dim, url, category, count(*) AS n FROM g GROUP BY 1, 2, 3),
s AS (SELECT dim, url, sum(n) AS m, sum(n * n) AS sq FROM r GROUP BY 1, 2),
a AS (SELECT dim, count(*) AS n_subjects, max(m)::BIGINT AS n_raters, min(m) AS m0, avg((sq - m) / (m * (m - 1))) AS p FROM s GROUP BY 1),
c AS (SELECT dim, sum(c * c) / (sum(c) * sum(c)) AS pe FROM (SELECT dim, category, sum(n)::DOUBLE AS c FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT dim, n_subjects, n_raters, CASE WHEN m0 = n_raters AND pe < 1 THEN round((p - pe) / (1 - pe), 9) END AS kappa FROM a JOIN c USING (dim)""")
def fleiss_kappa_all(spark, d):
    """Kappa over all events: the 24 hours are raters, who give a user all types of that hour; one without events gives TYPE:?."""
    e = t(spark, d, "events").select(F.lit("x").alias("doc_type"), F.col("user_id").alias("url"), F.hour("ts").alias("annotator"), F.lit("TYPE").alias("dim"), F.concat(F.lit("TYPE:"), "event_type").alias("tag"))
    cats = e.groupBy("doc_type", "url", "annotator", "dim").agg(F.array_join(F.array_sort(F.collect_set("tag")), ";").alias("category"))
    raters = e.select("doc_type", "url").distinct().withColumn("annotator", F.explode(F.sequence(F.lit(0), F.lit(23))))
    whole = agreement.dense(cats, raters, e.select("doc_type", "dim").distinct())
    rows = agreement.contingency(whole.select((F.col("url") % 3).alias("k"), "url", "category"), ["k"])
    return agreement.fleiss(rows, ["k"]).select(F.col("k").alias("dim"), "n_subjects", "n_raters", F.round("kappa", 9).alias("kappa"))


@query("""
WITH p AS (SELECT source, quality AS a, toxic AS b FROM documents JOIN labels USING (doc_id)),
n AS (SELECT source, count(*) AS n, avg((a = b)::INT) AS po, (sum(a)::DOUBLE * sum(b) + sum(1 - a)::DOUBLE * sum(1 - b)) / (count(*)::DOUBLE * count(*)) AS pe FROM p GROUP BY 1)
SELECT source, n, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 9) END AS kappa,
 CASE WHEN pe >= 1 THEN NULL WHEN (po - pe) / (1 - pe) < 0 THEN 'Poor' WHEN (po - pe) / (1 - pe) <= 0.2 THEN 'Slight' WHEN (po - pe) / (1 - pe) <= 0.4 THEN 'Fair' WHEN (po - pe) / (1 - pe) <= 0.6 THEN 'Moderate' WHEN (po - pe) / (1 - pe) < 0.8 THEN 'Substantial' ELSE 'Almost perfect' END AS band FROM n""")
def cohen_kappa(spark, d):
    p = docs(spark, d).select("doc_id", "source").join(t(spark, d, "labels"), "doc_id").select("source", F.col("quality").alias("a"), F.col("toxic").alias("b"))
    k = agreement.cohen(p, ["source"])
    return k.select("source", "n", F.round("kappa", 9).alias("kappa"), S.kappa_band("kappa").alias("band"))


@query("""
WITH w AS (SELECT DISTINCT conv_id, turn, 'W:' || unnest(string_split(lower(text), ' ')) AS tag FROM conversations WHERE text IS NOT NULL),
a AS (SELECT conv_id, tag FROM w WHERE turn = 0), b AS (SELECT conv_id, turn, tag FROM w WHERE turn > 0)
SELECT b.conv_id, b.turn, count(a.tag) AS n_same, count(*) FILTER (a.tag IS NULL) AS n_new FROM b LEFT JOIN a ON a.conv_id = b.conv_id AND a.tag = b.tag WHERE b.conv_id IN (SELECT conv_id FROM a) GROUP BY 1, 2""")
def annotation_diff(spark, d):
    c = t(spark, d, "conversations").where("text is not null").select(F.lit("x").alias("doc_type"), F.col("conv_id").alias("url"), F.when(F.col("turn") == 0, "init").otherwise(F.col("turn").cast("string")).alias("annotator"), F.explode(F.split(F.lower("text"), " ")).alias("w"))
    sets = c.groupBy("doc_type", "url", "annotator").agg(F.collect_set(F.concat(F.lit("W:"), F.col("w"))).alias("tags"))
    first = sets.where("annotator = 'init'").select("url", F.col("tags").alias("base"))
    got = sets.where("annotator <> 'init'").join(first, "url").withColumn("x", agreement.compare(F.col("base"), F.col("tags"), clean=False))
    return got.select(F.col("url").alias("conv_id"), F.col("annotator").cast("long").alias("turn"), F.size("x.same").cast("long").alias("n_same"), F.size(F.array_union("x.added", "x.updated")).cast("long").alias("n_new"))


@query("""
SELECT 'lang' AS level, lang AS member, sum(n_chars)::BIGINT AS total, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang UNION ALL SELECT 'source', source, sum(n_chars)::BIGINT, count(*), round(avg(n_chars), 6) FROM documents GROUP BY source""")
def agreement_rollup(spark, d):
    return agreement.roll_up(docs(spark, d), ["lang", "source"], "n_chars").withColumn("mean", F.round("mean", 6))


@query("""
WITH c AS (SELECT DISTINCT user_id AS url, event_type AS dim, hour(ts) % 4 AS annotator, round(value) % 3 AS v FROM events),
g AS (SELECT url, dim, annotator, string_agg(CAST(v::INT AS VARCHAR), ';' ORDER BY v) AS category FROM c GROUP BY 1, 2, 3)
SELECT x.annotator::BIGINT AS annotator1, y.annotator::BIGINT AS annotator2, count(*) AS n, count(*) FILTER (x.category = y.category) AS n_equal FROM g x JOIN g y ON x.url = y.url AND x.dim = y.dim AND x.annotator < y.annotator GROUP BY 1, 2""")
def annotator_pairs(spark, d):
    e = t(spark, d, "events").select(F.lit("x").alias("doc_type"), F.col("user_id").alias("url"), F.col("event_type").alias("dim"), (F.hour("ts") % 4).cast("long").alias("annotator"), (F.round("value") % 3).cast("int").cast("string").alias("v"))
    g = e.groupBy("doc_type", "url", "dim", "annotator").agg(F.array_join(F.array_sort(F.collect_set("v")), ";").alias("category"))
    return agreement.annotator_pairs(g).groupBy("annotator1", "annotator2").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


# ---- text, people, strings ---------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s''-]+', '|', 'g'), '\\s+', ' ', 'g'), '\\b(the|of|and|in|to|is|a|that)\\b', '|', 'g') AS s FROM benchmark),
p AS (SELECT item_id, trim(unnest(string_split(s, '|'))) AS term FROM n),
c AS (SELECT item_id, term, count(*) AS times FROM p WHERE term <> '' GROUP BY 1, 2),
w AS (SELECT item_id, term, times, unnest(string_split(term, ' ')) AS word, len(string_split(term, ' ')) AS l FROM c),
s AS (SELECT item_id, word, sum(times * l)::DOUBLE / sum(times) AS s FROM w GROUP BY 1, 2)
SELECT item_id, term, round(sum(s), 6) AS score FROM w JOIN s USING (item_id, word) GROUP BY 1, 2""")
def rake_terms(spark, d):
    stop = ["the", "of", "and", "in", "to", "is", "a", "that"]
    return text.rake(t(spark, d, "benchmark"), "item_id", "text", stop).withColumn("score", F.round("score", 6))


@query("SELECT lower(event_type) AS term, count(*) AS nb, round(count(*) / sum(value), 9) AS inv_mean_score FROM events GROUP BY 1")
def global_term_scores(spark, d):
    return text.global_terms(t(spark, d, "events").select(F.lower("event_type").alias("term"), F.col("value").alias("score"))).withColumn("inv_mean_score", F.round("inv_mean_score", 9))


@query("SELECT user_id, event_id AS term, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 50")
def top_terms(spark, d):
    return text.top_terms(t(spark, d, "events").select("user_id", F.col("event_id").alias("term"), F.col("value").alias("score")), "user_id", 50).withColumn("rank", F.col("rank").cast("long"))


@query()
def textrank_terms(spark, d):
    return text.top_terms(text.textrank(t(spark, d, "benchmark"), "item_id", "text", rounds=100), "item_id", None)


@query()
def yake_terms(spark, d):
    return text.yake(t(spark, d, "benchmark"), "item_id", "text", 50)


@query("""
SELECT source AS collection, '**** *coll_' || source || ' *year_' || coalesce(CAST(2000 + doc_id % 20 AS VARCHAR), 'NA') || ' *label_' || lang || chr(10) || coalesce(text, '') AS value FROM documents""")
def corpus_export(spark, d):
    return text.corpus(docs(spark, d), F.col("source"), (2000 + F.col("doc_id") % 20), F.col("lang"), F.col("text"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def page_extract(spark, d):
    part = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t(spark, d, "pages").select("page_id", part("<title>([^<]*)</title>").alias("title"), part('<html lang="([a-z]+)"').alias("lang"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS orcid, CAST(year(ts) AS VARCHAR) AS start, event_type AS role, 'educ' AS type FROM events WHERE event_type = 'signup'
UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(year(ts) AS VARCHAR), event_type, 'work' FROM events WHERE event_type <> 'signup' AND event_id % 3 <> 0""")
def lifepath(spark, d):
    e = t(spark, d, "events")
    aff = F.struct(F.when(F.col("event_id") % 3 != 0, "dpt").alias("department-name"), F.col("event_type").alias("role-title"), F.struct(F.struct(F.year("ts").cast("string").alias("value")).alias("year")).alias("start-date"))
    person = e.groupBy(F.col("user_id").cast("string").alias("orcid")).agg(F.collect_list(F.when(F.col("event_type") == "signup", aff)).alias("a"), F.collect_list(F.when(F.col("event_type") != "signup", aff)).alias("b"))
    body = F.struct(F.struct(F.col("a").alias("education-summary")).alias("educations"), F.struct(F.col("b").alias("employment-summary")).alias("employments"))
    raw = person.select(F.to_json(F.create_map("orcid", body)).alias("value"))
    return people.life_paths(people.people(raw)).select("orcid", "start", "role", "type")


@query("SELECT CAST(p_partkey AS VARCHAR) AS orcid, unnest([lower(p_name), lower(p_brand)]) AS kwd FROM part")
def person_keywords(spark, d):
    p = t(spark, d, "part")
    kwd = F.struct(F.array(F.struct(F.concat("p_name", F.lit(" , "), "p_brand", F.lit(",")).alias("content"))).alias("keyword"))
    raw = p.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(kwd.alias("kwd")))).alias("value"))
    return people.keywords(people.people(raw))


@query("""
SELECT page_id, replace(url, 'https://', '') AS bare, replace(url, 'example.com', 'example.org') AS moved, nullif(lower(regexp_replace(url, '[^A-Za-z0-9]+', '', 'g')), '') AS squashed, regexp_replace(lower(url || '.'), '\\.$', '') AS key FROM pages""")
def url_strings(spark, d):
    return t(spark, d, "pages").select("page_id", S.swap_namespace("url", "https://", "").alias("bare"), S.swap_namespace("url", "example.com", "example.org").alias("moved"), S.squash("url").alias("squashed"), S.title_key(F.concat("url", F.lit("."))).alias("key"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y')::INT AS year, 'https://doi.org/' || o_orderkey AS url, o_orderkey || '-' || o_custkey AS pages, replace(o_orderstatus || '.0', '.0', '') AS plain FROM orders")
def record_strings(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), S.doi_url(F.col("o_orderkey").cast("string")).alias("url"), S.page_range("o_orderkey", "o_custkey").alias("pages"), S.year_text(F.concat("o_orderstatus", F.lit(".0"))).alias("plain"))


@query("SELECT c_custkey, string_split(c_name, '#')[1] || '_' || CAST(1990 + c_nationkey AS VARCHAR) AS label FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment || '_' || CAST(1990 + c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 1")
def graph_labels(spark, d):
    c = t(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    return c.select("c_custkey", S.graph_label(F.when(even, F.concat(F.substring_index("c_name", "#", 1), F.lit(", v2"))), F.concat(F.lit(", "), F.col("c_mktsegment"), F.lit(" X; Y")), F.concat((1990 + F.col("c_nationkey")).cast("string"), F.lit(".0"))).alias("label"))


@query("""
SELECT c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'journalArticle' ELSE 'book' END AS "itemType", 'u' || c_custkey AS url FROM customer WHERE 'u' || c_custkey NOT IN (SELECT 'u' || s_suppkey FROM supplier) AND c_custkey % 5 <> 0""")
def push_payloads(spark, d):
    c = t(spark, d, "customer")
    none = F.lit(None).cast("string")
    rec = c.select(F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 5 == 0, none).when(F.col("c_custkey") % 2 == 0, "bookSection").otherwise("book").alias("itemType"), none.alias("url"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("DOI"), F.lit("A;B").alias("authors"))
    return library.absent(library.templates(rec), t(spark, d, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"))).select("title", "itemType", "url")


@query("""
SELECT o_orderkey AS key, 1::BIGINT AS version, o_custkey % 2 = 1 AS conflict FROM orders WHERE o_orderstatus <> 'F'""")
def versioned_patches(spark, d):
    o = t(spark, d, "orders")
    lib = o.select(F.col("o_orderkey").alias("key"), (1 + F.col("o_custkey") % 2).alias("version"), F.lit("F").alias("status"))
    new = o.select(F.col("o_orderkey").alias("key"), F.lit(1).cast("long").alias("version"), F.col("o_orderstatus").alias("status"))
    return library.patches(new, lib).select("key", "version", "conflict")
