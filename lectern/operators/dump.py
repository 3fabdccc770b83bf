"""Analytics over a knowledge dump of papers, tasks, datasets, evaluations and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import year_of
from ..schema import BENCHMARKED, HAVE_CODE, NO_CODE, NOT_BENCHMARKED
from .filters import in_focus, is_preprint


def method_tags(methods: Column, tasks: Column) -> Column:
    """Pwc_method:x and Pwc_task:x."""
    none = F.array().cast("array<string>")
    return F.concat(F.transform(F.coalesce(methods, none), lambda m: F.concat(F.lit("Pwc_method:"), m)), F.transform(F.coalesce(tasks, none), lambda t: F.concat(F.lit("Pwc_task:"), t)))


def status_tags(code: Column, benchmarked: Column) -> Column:
    """What a paper has, as tags."""
    return F.array(F.when(code, HAVE_CODE).otherwise(NO_CODE), F.when(benchmarked, BENCHMARKED).otherwise(NOT_BENCHMARKED))


def task_counts(df: DataFrame, tasks: str) -> DataFrame:
    """How often each task occurs."""
    return df.select(F.explode(tasks).alias("task")).groupBy("task").agg(F.count("*").alias("nb"))


# What is kept of a dataset of the dump.
DATASET_FIELDS = ["name", "full_name", "homepage", "description", "paper", "introduced_date", "warning", "modalities", "languages", "variants", "num_papers"]


def focused_datasets(datasets: DataFrame, focus: list[str]) -> DataFrame:
    """(url, kept fields, tasks, paper_url) of the datasets with a task in focus, tasks being those (P19). Of the kept fields, those that the frame has."""
    mine = F.transform(F.filter("tasks", lambda t: in_focus(t["task"], focus)), lambda t: t["task"])
    kept = [c for c in DATASET_FIELDS if c in datasets.columns]
    return datasets.select("url", *kept, mine.alias("tasks"), F.col("paper.url").alias("paper_url")).where(F.size("tasks") > 0)


def datasets_by_task(df: DataFrame, name: str, tasks: str, focus: list[str]) -> DataFrame:
    """(task, datasets) of the tasks in focus."""
    rows = df.select(name, F.explode(tasks).alias("task")).where(in_focus("task", focus))
    return rows.groupBy("task").agg(F.array_join(F.array_sort(F.collect_set(name)), ";").alias("datasets"))


def evaluation_rows(tables: DataFrame) -> DataFrame:
    """(task, dataset, paper_url, model_name, metrics) of tables with nested datasets, and of those of their subtasks."""
    own = tables.select("task", F.explode("datasets").alias("d"))
    sub = tables.select("task", F.explode("subtasks").alias("t")).select("task", F.explode("t.datasets").alias("d"))
    rows = own.unionByName(sub).select("task", F.col("d.dataset").alias("dataset"), F.explode("d.sota.rows").alias("r"))
    return rows.select("task", "dataset", "r.paper_url", "r.model_name", "r.metrics").distinct()


def sota_papers(papers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Papers with the evaluations of one of their tasks whose address has their arXiv id (J8). The id is cut out of the address, so
    both conditions are equalities."""
    p = papers.where(F.col("arxiv_id").isNotNull()).select("paper_url", "arxiv_id", F.explode("tasks").alias("task"))
    e = evaluations.select(F.col("task").alias("_task"), "model_name", "dataset", F.regexp_extract("paper_url", r"(\d{4}\.\d{4,5})", 1).alias("_id"))
    return p.join(e, (p["task"] == e["_task"]) & (p["arxiv_id"] == e["_id"])).select("paper_url", "task", "dataset", "model_name")


def flagged(papers: DataFrame, links: DataFrame, evaluations: DataFrame, datasets: DataFrame, key: str = "paper_url") -> DataFrame:
    """Papers with has_code, is_benchmarked and is_dataset (J9-J11): each by one join with distinct keys."""
    for frame, name in ((links, "has_code"), (evaluations, "is_benchmarked"), (datasets, "is_dataset")):
        keys = frame.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn(name, F.lit(True))
        papers = papers.join(keys, papers[key] == keys["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(False)))
    return papers


def to_push(papers: DataFrame) -> DataFrame:
    """No preprint, or with code, or benchmarked, and no dataset paper."""
    return papers.where((~is_preprint("url_abs") | F.col("has_code") | F.col("is_benchmarked")) & ~F.col("is_dataset"))


def last_link(links: DataFrame, key: str = "paper_url", value: str = "repo_url", order: str = "ord") -> DataFrame:
    """The last address of each paper."""
    return links.groupBy(key).agg(F.max_by(value, order).alias(value))


def yearly(papers: DataFrame, date: str = "date", url: str = "url_abs") -> DataFrame:
    """Total, preprints, with code, benchmarked by year, ascending."""
    return papers.groupBy(year_of(date).alias("year")).agg(F.count("*").alias("total"), F.count_if(is_preprint(url)).alias("preprint"), F.count_if("has_code").alias("code"), F.count_if("is_benchmarked").alias("benchmarked")).orderBy("year")


def usage(papers: DataFrame) -> DataFrame:
    """Uses of each method."""
    return papers.select(F.explode("methods").alias("method")).groupBy("method").agg(F.count("*").alias("nb"))


def results_by_paper(evaluations: DataFrame, key: str = "paper_url") -> DataFrame:
    """(paper, shortTitle, callNumber): distinct model names, and the results as JSON {dataset: {metric: value}}."""
    by = evaluations.groupBy(key).agg(F.array_sort(F.collect_set("model_name")).alias("_m"), F.array_sort(F.collect_list(F.struct("dataset", "metrics_json"))).alias("_r"))
    return by.select(key, F.array_join("_m", ", ").alias("shortTitle"), F.to_json("_r").alias("callNumber"))


def fill_links(items: DataFrame, by_url: DataFrame, by_title: DataFrame) -> DataFrame:
    """Items with shortTitle, archiveLocation and callNumber filled where they are empty: by their archive's address, else by their title (J14,
    G14). by_url: (url, ...), by_title: (title, ...), each with the three columns and one row a key."""
    names = ["shortTitle", "archiveLocation", "callNumber"]
    a = by_url.select(F.col("url").alias("_u"), *[F.col(n).alias(f"_a_{n}") for n in names])
    b = by_title.select(F.col("title").alias("_t"), *[F.col(n).alias(f"_b_{n}") for n in names])
    out = items.join(a, items["archive"] == a["_u"], "left").join(b, items["title"] == b["_t"], "left")
    filled = {n: F.coalesce(F.nullif(items[n], F.lit("")), F.col(f"_a_{n}"), F.col(f"_b_{n}")) for n in names}
    return out.select(*[filled[c].alias(c) if c in filled else items[c] for c in items.columns])
