"""Paging, files, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import sinks
from lectern.operators import compose
from lectern.sources import api, envelopes, files, registry
from lectern.streaming import landing


def test_compiled_queries():
    c = lambda n: registry.source(n).compile(["a b", "c"], 2020)
    assert "a%20b%7Cc" in c("semanticscholar") and "year=2020" in c("semanticscholar")
    assert "%28a%20b%20AND%20c%29" in c("IEEE") and "TITLE-ABS(a b AND c)" in c("Elsevier") and "q=a+b+c year:2020:" in c("DBLP")
    assert 'ti:"a b"+OR+abs:"a b"' in c("arxiv") and "abstract.search:c,title.search:c" in c("OpenAlex") and '"a b" AND "c"' in c("Springer") and "as_yhi=2021" in c("GoogleScholar") and "submittedDateY_i:[2020]" in c("HAL") and "title:(a b AND c)" in c("istex")
    assert registry.source("OpenAlex").offset(3) == 3 and registry.source("DBLP").offset(3) == 2000
    assert registry.compile_groups("IEEE", [["a", "b"], ["c"]]) == "(a OR b) AND (c)" and registry.compile_groups("SemanticScholar", [["a", "b"], ["c"]]) == '("a"|"b")+("c")'
    with pytest.raises(ValueError):
        registry.source("nope")


def test_paging():
    spec = registry.SourceSpec("x", 2, 1000, lambda k, y: "q&o={}")
    data = list(range(5))
    fetch = lambda u, n: {"total": 5, "results": data[int(u.split("=")[1]) :][:2]}
    got = list(api.pages(spec, "q&o={}", fetch))
    assert [(p["page"], p["n"]) for p in got] == [(1, 2), (2, 2), (3, 1)]
    assert [p["page"] for p in api.pages(spec, "q&o={}", fetch, last_page=2)] == [3]

    def broken(u, n):
        raise OSError

    assert list(api.pages(spec, "q", broken)) == []
    assert [len(p) for p in api.until_empty(lambda s: list(range(s, min(s + 100, 150))))] == [100, 50]
    waits = []
    now = [0.0]
    limit = api.RateLimit(10, lambda: now[0], waits.append)
    for _ in range(3):
        limit.wait()
    assert [round(w, 3) for w in waits] == [0.1, 0.2]


def test_collect(spark):
    q = compose.initial_state(compose.query_matrix(spark, [["k"]], [2020], ["DBLP", "Arxiv"]))

    def fetch(name, url, page):
        return {"total": 1, "results": [{"name": name, "url": url}]}

    got = {r.api: json.loads(r.results)[0] for r in api.collect(q, fetch).collect()}
    assert set(got) == {"DBLP", "Arxiv"} and "year:2020" in got["DBLP"]["url"]


def test_collect_of_two_endpoints(spark):
    """Springer's pages come from both endpoints."""
    q = compose.initial_state(compose.query_matrix(spark, [["k"]], [2020], ["Springer"]))
    got = api.collect(q, lambda name, url, page: {"total": 1, "results": [{"url": url}]}).collect()
    assert {(r.endpoint, json.loads(r.results)[0]["url"].split("?")[0], r.page) for r in got} == {("meta", "meta", 1), ("openaccess", "openaccess", 1)}


def test_envelopes_of_odd_bodies(spark):
    rows = [("DBLP", 0, 1, None), ("IEEE", 0, 1, "no json"), ("Arxiv", 0, 1, "<feed"), ("HAL", 0, 1, '{"response":{"numFound":"x"}}'), ("other", 0, 1, "{}"), (None, 0, 1, "{}"), ("Arxiv", 1, 1, "<feed><totalResults>3</totalResults></feed>")]
    got = envelopes.page_envelopes(spark.createDataFrame(rows, "api string, id_collect int, page long, body string"))
    assert sorted((r.id_collect, r.total, r.n) for r in got.collect()) == [(0, 0, 0)] * 6 + [(1, 3, 0)]
    assert envelopes.page_envelopes(spark.createDataFrame([], "api string, id_collect int, page long, body string")).count() == 0


def test_requested_fields_and_orders():
    c = lambda n: registry.source(n).compile(["a"], 2020)
    assert "&fields=title,abstract," in c("SemanticScholar") and "fl=title_s,abstract_s," in c("HAL") and "sort_field=article_number" in c("IEEE") and "sortBy=relevance" in c("Arxiv")


def test_delivery_and_sources_at_once(spark, tmp_path):
    from lectern.operators import library

    where = str(tmp_path)

    def send(rows):
        for r in rows:
            open(f"{where}/{r.k}", "w").close()

    library.deliver(spark.range(3).withColumnRenamed("id", "k"), send)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1", "2"]
    dealt = compose.by_source(spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "api string, id_collect int"), 4).withColumn("p", F.spark_partition_id())
    assert dealt.groupBy("api").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0


def test_data_source(spark):
    api.register(spark, "lectern_pages", "api string, n int", [{"api": "a"}, {"api": "b"}], lambda s: iter([(s["api"], 1), (s["api"], 2)]))
    df = spark.read.format("lectern_pages").load()
    assert df.count() == 4 and df.rdd.getNumPartitions() == 2


def land(path, name, k, page, results, total=3):
    at = path / name / str(k)
    at.mkdir(parents=True, exist_ok=True)
    (at / f"page_{page}").write_text(json.dumps({"date_search": "d", "id_collect": k, "page": page, "total": 0, "total_nb": total, "results": results}))


def test_landing_and_stream(spark, tmp_path):
    zone = tmp_path / "zone"
    land(zone, "DBLP", 0, 1, [{"@id": "1", "info": {"title": "A", "doi": "10/1"}}, {"@id": "2", "info": {"title": "B"}}])
    land(zone, "DBLP", 1, 1, [{"@id": "3", "info": {"title": "C"}}])
    pages = files.landing_pages(spark, str(zone))
    assert {(r.api, r.id_collect, r.page, r.total) for r in pages.collect()} == {("DBLP", 0, 1, 3), ("DBLP", 1, 1, 3)}
    state = spark.createDataFrame([("DBLP", 0)], "api string, id_collect int")
    assert files.raw_records(pages, state).count() == 2 and files.raw_records(pages).count() == 3
    run = lambda: landing.merge_stream(spark, str(zone), "DBLP", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    land(zone, "DBLP", 1, 2, [{"@id": "4", "info": {"title": "A2", "doi": "10/1", "year": "2020"}}])
    run()
    got = {(r.title, r.date, r.archive) for r in landing.read_current(spark, str(tmp_path / "t")).collect()}
    assert landing.current(spark, str(tmp_path / "t")) == 1 and landing.current(spark, str(tmp_path / "u")) is None
    land(zone, "DBLP", 1, 3, [])
    run()
    assert landing.current(spark, str(tmp_path / "t")) == 2 and {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")} == {"v=1", "v=2"}
    assert ("B", None, "DBLP") in got and ("C", None, "DBLP") in got and len(got) == 3
    q = landing.progress(landing.pages_stream(spark, str(zone))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id_collect, r.last_page, r.coll_art) for r in spark.table("progress").collect()} == {("0", 1, 2), ("1", 3, 2)}


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Item Type;Title\nbook;"a\nb;""c"""\n')
    assert files.csv_export(spark, str(tmp_path / "x.csv")).first().asDict() == {"Item_Type": "book", "Title": 'a\nb;"c"'}
    (tmp_path / "o.csv").write_text("orcid;name\n|1|;|a;b|\n")
    assert files.orcid_ids(spark, str(tmp_path / "o.csv")).first().name == "a;b"
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.dump(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>T</title><summary>S</summary><author><name>A</name></author><author><name>B</name></author><link href="h" title="pdf"/><category term="cs"/></entry></feed>')
    e = files.atom_entries(spark, str(tmp_path / "a.xml")).first()
    assert (e.id, e.abstract, e.authors, e.pdf, e.categories) == ("i", "S", ["A", "B"], "h", ["cs"])
    (tmp_path / "t.nt").write_text('<s> <p> "a \\"b"@en .\n# no\n<s> <q> <o> .\n')
    assert {(r.s, r.p) for r in files.triples(spark, str(tmp_path / "t.nt")).collect()} == {("s", "p"), ("s", "q")}
    (tmp_path / "c.yml").write_text("keywords: [[a]]\nDBLP:\n  api_key: x\n")
    (tmp_path / "sub").mkdir()
    assert files.load_config("c.yml", start=tmp_path / "sub") == {"keywords": [["a"]], "dblp": {"api_key": "x"}}
    with pytest.raises(FileNotFoundError):
        files.load_config("missing-file.yml", start=tmp_path)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a;b", None), ('q"', "x")], "title string, DOI string")
    sinks.write_records(df, str(tmp_path / "r"))
    assert {(r.title, r.DOI) for r in files.csv_export(spark, str(tmp_path / "r")).collect()} == {("a;b", "NA"), ('q"', "x")}
    sinks.write_records(df, str(tmp_path / "i"), index_by=["title"])
    assert {(r["index"], r.title) for r in files.csv_export(spark, str(tmp_path / "i")).collect()} == {("0", "a;b"), ("1", 'q"')}
    sinks.write_graph(df, df, str(tmp_path / "g"))
    assert files.csv_export(spark, str(tmp_path / "g" / "nodes"), "\t").count() == 2
    sinks.write_corpus(spark.createDataFrame([("c", "**** *coll_c\ntext")], "collection string, value string"), str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k" / "collection=c")).count() == 2
    sinks.write_wide(spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "url string, k string, v int"), "url", "k", ["a", "b"], "v", str(tmp_path / "w"))
    assert files.csv_export(spark, str(tmp_path / "w"), ",").first().asDict() == {"url": "u", "a": "1", "b": "2"}
    pages = spark.createDataFrame([("DBLP", 0, 1)], "api string, id_collect int, page int")
    sinks.write_pages(pages, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).where(F.col("api") == "DBLP").count() == 1
    sinks.write_state(pages, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1
