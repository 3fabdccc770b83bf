"""Scans of files: the landing zone of pages, CSV exports, dumps, identifiers, configuration."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "date_search string, id_collect int, page long, total long, total_nb long, results array<variant>"
TRIPLES = "s string, p string, o string"


def landing_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files <path>/<api>/<id_collect>/page_<n>: (api, id_collect, page, total, results)."""
    df = spark.read.schema(ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select(F.element_at(parts, -3).alias("api"), F.element_at(parts, -2).cast("int").alias("id_collect"), F.coalesce("page", F.regexp_extract(F.element_at(parts, -1), r"(\d+)$", 1).cast("long")).alias("page"), F.coalesce("total_nb", "total").alias("total"), "results")


def raw_records(pages: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(api, id_collect, page, pos, r): one row a record; of queries in the state only, if it is given."""
    if state is not None:
        pages = pages.join(state.select("api", "id_collect"), ["api", "id_collect"], "left_semi")
    return pages.select("api", "id_collect", "page", F.posexplode("results").alias("pos", "r"))


def csv_export(spark: SparkSession, path: str, sep: str = ";", schema: str | None = None) -> DataFrame:
    """A quoted CSV, TSV or ;-separated export with line breaks inside quotes; spaces of column names become _."""
    reader = spark.read.options(sep=sep, header=True, multiLine=True, quote='"', escape='"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def orcid_ids(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers, ;-separated and quoted by |."""
    return spark.read.options(sep=";", quote="|", header=True).csv(path)


def dump(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON array a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom XML with the fields that the Arxiv normaliser reads."""
    schema = "id string, updated string, published string, title string, summary string, author array<struct<name:string>>, doi string, journal_ref string, link array<struct<_href:string,_title:string>>, category array<struct<_term:string>>"
    e = spark.read.format("xml").options(rowTag="entry", ignoreNamespace=True).schema(schema).load(path)
    pdf = F.element_at(F.filter("link", lambda x: x["_title"] == "pdf"), 1)["_href"]
    return e.select("id", "updated", "published", "title", F.col("summary").alias("abstract"), "doi", pdf.alias("pdf"), F.col("journal_ref").alias("journal"), F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples as (s, p, o), literals without their type or language."""
    t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    m = [F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$", k) for k in (1, 2, 3)]

    def bare(c):
        return F.when(c.startswith("<"), F.regexp_replace(c, "^<|>$", "")).otherwise(F.regexp_replace(c, r'^"|"(\^\^\S+|@[\w-]+)?$', ""))

    return t.select(*(bare(c).alias(n) for c, n in zip(m, "spo", strict=True)))


def load_config(*names: str, start: str | Path = ".") -> dict:
    """YAML files, looked for in `start` and the directories above it, merged; section names in small letters."""
    import yaml

    out: dict = {}
    for name in names:
        here = Path(start).resolve()
        found = next((d / name for d in (here, *here.parents) if (d / name).is_file()), None)
        if found is None:
            raise FileNotFoundError(name)
        loaded = yaml.safe_load(found.read_text()) or {}
        out |= {(k.lower() if isinstance(v, dict) else k): v for k, v in loaded.items()}
    return out
