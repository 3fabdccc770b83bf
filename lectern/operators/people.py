"""Author life paths and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import keyword_list

AFFILIATION = "struct<`department-name`:string,`role-title`:string,`start-date`:struct<year:struct<value:string>>,`end-date`:struct<year:struct<value:string>>,organization:struct<name:string,address:struct<city:string,country:string>>>"
PERSON = f"map<string,struct<kwd:struct<keyword:array<struct<content:string>>>,educations:struct<`education-summary`:array<{AFFILIATION}>>,employments:struct<`employment-summary`:array<{AFFILIATION}>>>>"


def people(raw: DataFrame, column: str = "value") -> DataFrame:
    """(orcid, person) of JSON maps from identifier to record."""
    return raw.select(F.explode(F.from_json(column, PERSON)).alias("orcid", "person"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """(orcid, person) of the answers (orcid, resource, body) of a person's sub-resources, keywords, employments, educations and address (S23). A resource
    that is missing or no JSON is NULL; of repeated answers the largest counts."""
    kinds = {"keywords": ("kwd", "struct<keyword:array<struct<content:string>>>"), "educations": ("educations", f"struct<`education-summary`:array<{AFFILIATION}>>"), "employments": ("employments", f"struct<`employment-summary`:array<{AFFILIATION}>>"), "address": ("address", "struct<address:array<struct<country:struct<value:string>>>>")}
    rows = parts.where(F.col("orcid").isNotNull()).groupBy("orcid").agg(*[F.max(F.when(F.col("resource") == r, F.col("body"))).alias(r) for r in kinds])
    return rows.select("orcid", F.struct(*[F.from_json(r, kind).alias(name) for r, (name, kind) in kinds.items()]).alias("person"))


def keywords(persons: DataFrame) -> DataFrame:
    """(orcid, kwd): one row a keyword, split at commas, trimmed, small letters."""
    rows = persons.select("orcid", F.explode("person.kwd.keyword.content").alias("k"))
    return rows.select("orcid", F.explode(keyword_list("k")).alias("kwd")).where("kwd <> ''")


def life_paths(persons: DataFrame, compat: bool = True) -> DataFrame:
    """(orcid, start, end, role, org, city, country, dpt, type): education and work. compat: work only where it names a department."""

    def rows(column: str, kind: str) -> DataFrame:
        e = persons.select("orcid", F.explode(column).alias("e"))
        return e.select("orcid", F.col("e.`start-date`.year.value").alias("start"), F.col("e.`end-date`.year.value").alias("end"), F.col("e.`role-title`").alias("role"), F.col("e.organization.name").alias("org"), F.col("e.organization.address.city").alias("city"), F.col("e.organization.address.country").alias("country"), F.col("e.`department-name`").alias("dpt"), F.lit(kind).alias("type"))

    work = rows("person.employments.`employment-summary`", "work")
    return rows("person.educations.`education-summary`", "educ").unionByName(work.where("dpt is not null") if compat else work)
