"""Golden rows of the normalisers, deduplication, graphs and agreement."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import strings as S
from lectern.operators import agreement, citations, compose, dedup, filters, graph, kg, library, match, tags, text
from lectern.plans.aggregate import aggregate
from lectern.schema import COLUMNS, norm_missing
from lectern.sources import normalize as N


def records(spark, api, *rows):
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.parse_json("v").alias("r"))
    return N.normalize(df, api).collect()


def one(spark, col, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(col(F.col("x"))).collect()]


def test_semantic_scholar(spark):
    a, b, c, d = records(
        spark, "semanticscholar",
        {"title": "T", "publicationTypes": ["JournalArticle", "Book"], "journal": {"name": "J", "pages": "1-9", "volume": "2"}, "authors": [{"name": "A"}, {"name": ""}, {"name": "B"}]},
        {"title": "T", "publicationTypes": ["Review"], "journal": {"name": "J"}},
        {"title": "", "venue": "", "abstract": None},
        {"title": "T", "publicationTypes": ["JournalArticle"], "venue": {"type": "conference", "name": "V"}},
    )
    assert (a.itemType, a.pages, a.authors, a.volume) == ("bookSection", "1-9", "A;B", "2")
    assert (b.itemType, b.journalAbbreviation) == ("journalArticle", "J")
    assert (c.itemType, c.title, c.abstract, c.serie) == ("Manuscript", None, None, None)
    assert (d.itemType, d.conferenceName) == ("conferencePaper", "V")


def test_dblp_authors_are_one_or_many(spark):
    a, b, c = records(spark, "DBLP", {"info": {"authors": {"author": {"text": "A"}}}}, {"info": {"authors": {"author": [{"text": "A"}, {"text": "B"}]}, "type": "Conference and Workshop Papers", "venue": "X"}}, {"info": {"title": "t"}})
    assert [a.authors, b.authors, c.authors] == ["A", "A;B", None] and (b.itemType, b.conferenceName) == ("conferencePaper", "X")


def test_other_sources(spark):
    (o, p) = records(spark, "OpenAlex", {"type": "article", "biblio": {"first_page": "3", "last_page": None}, "open_access": {"is_oa": True}}, {"type": "article", "host_venue": {"type": "conference", "display_name": "C", "publisher": "P"}})
    assert (o.pages, o.itemType, o.rights) == (None, "journalArticle", "True") and (p.itemType, p.conferenceName, p.publisher) == ("conferencePaper", "C", "P")
    (i,) = records(spark, "Istex", {"genre": ["a", "b"], "doi": ["a", "b"], "host": {"pages": {"first": "1", "last": "2"}}})
    assert (i.itemType, i.DOI, i.pages) == (None, "a;b", "1-2")
    (e,) = records(spark, "IEEE", {"publication_date": "", "publication_year": "2021", "authors": {"authors": [{"full_name": "F"}]}, "doi": ""})
    assert (e.date, e.authors, e.DOI) == ("2021", "F", None)
    (s,) = records(spark, "Springer", {"contentType": "ConferencePaper Article", "creators": [{"creator": "A"}, {"creator": "B"}]})
    assert (s.itemType, s.authors) == ("conferencePaper", "A;B")
    (h,) = records(spark, "HAL", {"docType_s": "COMM", "submittedDateY_i": 2020, "title_s": ["a", "b"]})
    assert (h.itemType, h.date, h.title, h.authors) == ("conferencePaper", "2020", "a", None)
    (x,) = records(spark, "Arxiv", {"authors": ["A"], "id": "i"})
    assert (x.itemType, x.rights) == ("Manuscript", "True")
    (v,) = records(spark, "Elsevier", {"prism:doi": "10/x", "source-id": "9", "subtypeDescription": "Book Chapter"})
    assert (v.DOI, v.archiveID, v.itemType) == ("10/x", "9", "bookSection")
    (w,) = records(spark, "PaperWithCode", {"url_abs": "http://arxiv.org/1", "title": "t"})
    assert w.itemType == "preprint"
    with pytest.raises(ValueError):
        records(spark, "GoogleScholar", {})


GOLD = [(1, "DBLP", "10/x", "T1", None, "1-2"), (2, "OpenAlex", "10/x", "T1", "Abs", None), (3, "Arxiv", None, "T1", "Abs-long", None), (4, "HAL", None, "T2", None, None)]
COLS = ["archive", "DOI", "title", "abstract", "pages"]


def test_dedup_golden(spark):
    df = spark.createDataFrame(GOLD, "ord int, archive string, DOI string, title string, abstract string, pages string")
    got = dedup.deduplicate(df, COLS, "ord")
    assert {tuple(r[c] for c in COLS) for r in got.collect()} == {("HAL", None, "T2", None, None), ("Arxiv;DBLP*;OpenAlex*", "10/x", "T1", "Abs", "1-2")}
    again = dedup.deduplicate(got, COLS, "ord")
    assert {tuple(r[c] for c in COLS) for r in again.collect()} == {tuple(r[c] for c in COLS) for r in got.collect()}
    same = spark.createDataFrame([(1, "DBLP", "d", "x", None, None), (2, "DBLP", "d", "y", None, "1")], df.schema)
    assert [(r.archive, r.title, r.pages) for r in dedup.dedup_pass(same, "DOI", COLS, "ord").collect()] == [("DBLP*;DBLP*", "y", "1")]


def test_dedup_does_not_depend_on_row_order(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ABC"), rng.choice(["d1", "d2", None]), rng.choice(["t1", "t2", "t3"]), rng.choice([None, "a"]), rng.choice([None, "p"])) for k in range(60)]
    schema = "ord int, archive string, DOI string, title string, abstract string, pages string"
    seen = set()
    for _ in range(3):
        rng.shuffle(rows)
        seen.add(frozenset(tuple(r[c] for c in COLS) for r in dedup.deduplicate(spark.createDataFrame(rows, schema).repartition(3), COLS, "ord").collect()))
    assert len(seen) == 1


def test_missing(spark):
    assert one(spark, norm_missing, "", " NA", "nan", "None", "not found", "x", None) == [None] * 5 + ["x", None]
    assert one(spark, lambda c: norm_missing(c, strict=True), "", "NA") == ["", None]


def test_strings(spark):
    words = ["knowledge-graph bert2vec it's", "éa ÉB", "a1b c", "", "x\ty"]
    assert one(spark, S.title_case, *words) == [w.title() for w in words]
    assert one(spark, lambda c: S.tag_value("PTM", c), "big bird") == ["PTM:BigBird"]
    pairs = [("abcd", "abdc", True), ("abcd", "abxd", True), ("abcd", "badc", False), ("abc", "abc", True), ("a", "", True), ("ab", "ba", True), ("", "", True), ("abc", "abcde", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean").select(S.within_one_edit("a", "b").alias("g"), "w")
    assert all(r.g == r.w for r in df.collect())
    labels = spark.createDataFrame([("REBEL, v2", "S, A", "2021.0"), (None, "Smith, Ann; Lee, Bo", "2021.0"), ("", ", Ann Lee", "2021.0")], "s string, a string, y string").select(S.graph_label("s", "a", "y")).collect()
    assert [r[0] for r in labels] == ["REBEL_2021", "Smith_2021", "Ann_2021"]
    assert one(spark, S.clean_tag, "LANG:NSP", "NB: 10^3 x", "A: b", "plain") == ["LANG:?", "NB:10^3", "A:b", "plain"]
    assert one(spark, S.kappa_band, -0.1, 0.0, 0.2, 0.4, 0.6, 0.79, 0.8, None, kind="double") == ["Poor", "Slight", "Slight", "Fair", "Moderate", "Substantial", "Almost perfect", None]
    assert one(spark, S.any_year, "2020-05-01", "May 1998", "x") == [2020, 1998, None]
    assert one(spark, S.repair_authors, ", A B", "A") == ["A B", "A"] and one(spark, S.bare_doi, "https://doi.org/10/x") == ["10/x"]
    assert one(spark, S.squash, "A-b 1!", "--") == ["ab1", None] and one(spark, S.url_quote, "a b&c") == ["a%20b%26c"]


def test_filters(spark):
    df = spark.createDataFrame([("A RAG system", None), (None, "llm here"), ("none", "none")], "title string, abstract string")
    assert filters.keyword_filter(df, ["rag", "LLM"]).count() == 2 and filters.keyword_filter(df, ["zz"], compat=True).count() == 3
    v = spark.createDataFrame([('{"p": ["a", "b"]}',), ('"c"',)], "j string").select(filters.abstract_text(F.parse_json("j")).alias("t"))
    assert [r.t for r in v.collect()] == ["a b", "c"]
    assert one(spark, filters.valid_doi, "10/x", "NA", "x", None) == [True, False, False, False]
    assert one(spark, filters.finished, ["DONE"], ["x"], None, kind="array<string>") == [True, False, False]
    assert one(spark, filters.is_power, "NB:10^2", "NB:5") == [True, False]


def test_compose(spark):
    q = compose.query_matrix(spark, [["RAG", "LLM"], ["KG"]], [2023, 2024], ["DBLP", "Arxiv"])
    assert [(r.id_collect, r.keyword, r.year) for r in q.where("api = 'DBLP'").orderBy("id_collect").collect()] == [(0, ["RAG", "KG"], 2023), (1, ["RAG", "KG"], 2024), (2, ["LLM", "KG"], 2023), (3, ["LLM", "KG"], 2024)]
    assert compose.keyword_groups([["a", "b"], []]) == [["a"], ["b"]] and compose.keyword_groups([[], ["a"]]) == [] == compose.keyword_groups([["a"], ["b"], ["c"]])
    s = compose.initial_state(q)
    assert compose.pending(s).count() == 8
    pages = spark.createDataFrame([("DBLP", 0, 1, 3, 2, 2), ("DBLP", 0, 2, 3, 1, 2), ("DBLP", 1, 1, 9, 2, 2)], "api string, id_collect int, page int, total long, n int, max_by_page int")
    after = {(r.api, r.id_collect): r for r in compose.advance(s, pages).collect()}
    assert [(after["DBLP", k].state, after["DBLP", k].last_page, after["DBLP", k].coll_art) for k in (0, 1, 2)] == [(1, 2, 3), (0, 1, 2), (-1, 0, 0)]


def test_graph_golden(spark):
    p = spark.createDataFrame([(1, "10/p", "{'citing': ['10/b','10/c'], 'cited': ['10/a']}", "2020", "P"), (2, "10/b", None, "2021", "B"), (3, None, "{'citing': ['10/z'], 'cited': []}", "2021", "Z"), (4, "10/q", "it's broken", "2022", "Q")], "ord int, DOI string, Extra string, Year string, Label string").withColumns({"Title": F.lit("t"), "Url": F.lit(None).cast("string"), "origin": F.lit("lib")})
    n, e = graph.build(p)
    assert {(r.Source, r.Target) for r in e.collect()} == {("10/p", "10/b"), ("10/p", "10/c"), ("10/a", "10/p")}
    got = {r.Id: (r.Label, r.origin, r.Year) for r in n.collect()}
    assert got == {"10/p": ("P", "lib", "2020"), "10/b": ("B", "lib", "2021"), "10/q": ("Q", "lib", "2022"), "10/c": ("new_0", "new paper", "2020"), "10/a": ("new_1", "new paper", "2020"), "10/z": ("new_2", "new paper", "2021")}


def test_velocity(spark):
    df = spark.createDataFrame([("2018-01", 9, "A"), ("2022-01", 2, "B"), ("2022-01", 3, "C"), ("2024-01", 1, "D"), ("2024-01", 0, "E")], "date string, n int, doi string")
    got = {r.doi: r.interest for r in citations.velocity(df, S.year_of("date"), F.col("n")).collect()}
    assert got == {"B": 0, "C": 1, "D": 1, "E": 0}
    assert [r.doi for r in citations.select_by_velocity(df, spark.createDataFrame([("c",)], "doi string")).collect()] == ["D"]


def test_tag_rules(spark):
    df = spark.createDataFrame([(["A:1", "C:?", "C:2"],)], "t array<string>")
    assert df.select(tags.apply_policy(F.col("t"), ["A"], ["B"], ["C"])).first()[0] == ["A:1", "C:2", "B:?"]
    assert df.select(tags.fill_required(F.col("t"), ["C", "D"])).first()[0] == ["C:2", "D:?"]
    assert df.select(tags.add_missing(F.col("t"), "A:1"), tags.add_missing(F.col("t"), "N")).first()[:] == (["A:1", "C:?", "C:2"], ["A:1", "C:?", "C:2", "N"])


def test_annotation_difference(spark):
    df = spark.createDataFrame([(["LANG:?", "TASK:RE", "PTM:BERT"], ["LANG:EN", "TASK:RE", "DATASET:NYT"])], "a array<string>, b array<string>")
    d = df.select(agreement.compare(F.col("a"), F.col("b")).alias("d")).first().d
    assert (d.same, d.updated, d.deleted, d.added) == (["TASK:RE"], ["LANG:EN"], ["PTM:BERT"], ["DATASET:NYT"])


def test_fleiss_published_example(spark):
    rows = ["0 0 0 0 14", "0 2 6 4 2", "0 0 3 5 6", "0 3 9 2 0", "2 2 8 1 1", "7 7 0 0 0", "3 2 6 3 0", "2 5 3 2 2", "6 5 2 1 0", "0 2 2 3 7"]
    data = [("x", i, c, int(n)) for i, r in enumerate(rows) for c, n in enumerate(r.split()) if int(n)]
    k = agreement.fleiss(spark.createDataFrame(data, "dim string, url int, category int, n int"), ["dim"]).first()
    assert round(k.kappa, 3) == 0.210 and (k.n_subjects, k.n_raters) == (10, 14)
    ragged = spark.createDataFrame([("x", 1, 0, 2), ("x", 2, 0, 3)], "dim string, url int, category int, n int")
    assert agreement.fleiss(ragged, ["dim"]).first().kappa is None


def test_cohen_and_codes(spark):
    pairs = spark.createDataFrame([("k", 1, 1), ("k", 0, 0), ("k", 1, 0), ("k", 0, 0), ("z", 1, 1)], "g string, a int, b int")
    got = {r.g: r.kappa for r in agreement.cohen(pairs, ["g"]).collect()}
    assert got["z"] is None and round(got["k"], 6) == 0.5
    cats = spark.createDataFrame([("t", "u", "a", "D", "x"), ("t", "u", "b", "D", "y"), ("t", "u", "a", "E", "y"), ("t", "u", "b", "E", "y")], "doc_type string, url string, annotator string, dim string, category string")
    assert {(r.dim, r.annotator): r.code for r in agreement.ordinal_codes(cats).collect()} == {("D", "a"): 0, ("D", "b"): 1, ("E", "a"): 0, ("E", "b"): 0}
    assert agreement.annotator_pairs(cats).count() == 2
    grid = agreement.dense(cats.where("dim = 'D'"), cats.select("doc_type", "url", "annotator").distinct(), cats.select("doc_type", "dim").distinct())
    assert {r.category for r in grid.where("dim = 'E'").collect()} == {"E:?"}
    done = spark.createDataFrame([("t", "u", "a", "DONE"), ("t", "u", "b", "x"), ("t", "v", "a", "DONE"), ("t", "v", "init", "x")], "doc_type string, url string, annotator string, tag string")
    assert [r.url for r in agreement.all_finished(done).collect()] == ["v"]


def test_fuzzy_neighbourhood_misses_nothing(spark):
    rng = random.Random(4)
    left = [(k, "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))) for k in range(60)]
    right = [(k, "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))) for k in range(60)]
    import duckdb

    con = duckdb.connect()
    want = {(a, b) for a, x in left for b, y in right if con.execute("select damerau_levenshtein(?, ?)", [x, y]).fetchone()[0] < 2}
    got = match.fuzzy_pairs(spark.createDataFrame(left, "l_id int, k string"), spark.createDataFrame(right, "r_id int, k string"), "l_id", "k", "r_id", "k")
    assert {(r.l_id, r.r_id) for r in got.collect()} == want


def test_kg(spark):
    t = [("p1", "dcterms:title", "My Paper."), ("p1", "lpwc:hasMethod", "m1"), ("p1", "lpwc:hasMethod", "m2"), ("m1", "foaf:name", "graph net"), ("m2", "foaf:name", "bert"), ("p1", "lpwc:hasModel", "x"), ("x", "foaf:name", "BigNet"), ("p1", "lpwc:hasRepository", "r"), ("r", "fabio:hasURL", "http://r"), ("p2", "dcterms:title", "Twin"), ("p3", "dcterms:title", "twin")]
    items = spark.createDataFrame([("k", "my paper", ["TASK:Old"], "", None), ("l", "twin", [], "", None)], "key string, title string, tags array<string>, shortTitle string, archiveLocation string")
    got = kg.enrich_items(items, spark.createDataFrame(t, "s string, p string, o string"), {"ARCHI": ("lpwc:hasMethod", "foaf:name")}, ("lpwc:hasModel", "foaf:name"), ("lpwc:hasRepository", "fabio:hasURL"), ["BERT"], ("p", "q"), min_bindings=1).collect()
    assert [(r.key, r.tags, r.shortTitle, r.archive, r.archiveLocation) for r in got] == [("k", ["TASK:Old", "ARCHI:GraphNet", "PTM:Bert"], "BigNet", "q1", "http://r")]


def test_library(spark):
    rec = spark.createDataFrame([("T", "bookSection", None, "10/x", "A; B"), ("U", None, "u", None, None), ("V", "book", "v", None, None)], "title string, itemType string, url string, DOI string, authors string")
    items = library.templates(rec, "C").collect()
    assert [(r.title, r.itemType, r.url, [c.firstName for c in r.creators]) for r in items] == [("T", "journalArticle", "10/x", ["A", "B"]), ("V", "book", "v", [])]
    assert json.loads(library.payloads(library.templates(rec)).first().payload)["title"] == "T"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "x")], "key string, version int, title string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 1, "y"), ("c", 1, "x")], "key string, version int, title string")
    assert {(r.key, r.conflict, r.payload) for r in library.patches(new, old).collect()} == {("a", False, '{"title":"y"}'), ("b", True, '{"title":"y"}')}
    made = []
    assert library.find_or_create(spark.createDataFrame([("k", "n")], "key string, name string"), "n", made.append) == "k" and not made


def test_terms(spark):
    df = spark.createDataFrame([(1, "Deep learning of graphs. Deep learning for text, graphs!")], "d int, t string")
    got = {r.term: r.score for r in text.rake(df, "d", "t", ["of", "for"]).collect()}
    assert got == {"deep learning": 4.0, "graphs": 1.0, "text": 1.0}
    assert text.yake(df, "d", "t").count() > 0 and text.textrank(df, "d", "t", rounds=3).count() > 0
    assert text.yake(spark.createDataFrame([(1, None), (2, "")], df.schema), "d", "t").count() == 0


def test_aggregate_flow(spark):
    rows = [("DBLP", 0, 1, 0, {"info": {"title": "Graph RAG", "doi": "10/1"}, "@id": "a"}), ("DBLP", 0, 1, 1, {"info": {"title": "Other"}}), ("Arxiv", 0, 1, 0, {"title": "Graph RAG", "doi": "10/1", "abstract": "on rag"})]
    df = spark.createDataFrame([(a, i, p, n, json.dumps(r)) for a, i, p, n, r in rows], "api string, id_collect int, page long, pos int, v string").withColumn("r", F.parse_json("v")).drop("v")
    cites = spark.createDataFrame([("10/2", "10/1"), ("10/1", "10/0")], "citing string, cited string")
    (r,) = aggregate(df, ["DBLP", "Arxiv"], ["rag"], cites).collect()
    assert (r.title, r.abstract, r.archive, r.nb_cited, r.nb_citation) == ("Graph RAG", "on rag", "DBLP;Arxiv*", 1, 1) and set(COLUMNS) < set(r.asDict())
