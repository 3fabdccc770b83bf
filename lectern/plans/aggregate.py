"""The three flows: collect, aggregate, graph, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.citations import enrich
from ..operators.dedup import deduplicate
from ..operators.filters import keyword_filter
from ..operators.graph import build
from ..schema import COLUMNS
from ..sources.normalize import normalize_all


def aggregate(records: DataFrame, apis: list[str], keywords: list[str] | None = None, citations: DataFrame | None = None) -> DataFrame:
    """Raw records of a landing zone to the aggregated table: normalise, union, filter by keyword, resolve by DOI and then title, add
    citations."""
    out = normalize_all(records, apis)
    if keywords:
        out = keyword_filter(out, keywords)
    rank = F.array_position(F.array(*[F.lit(a.lower()) for a in apis]), F.lower("api"))
    out = out.withColumn("ord", F.struct(rank.alias("source"), F.col("id_collect"), F.col("page"), F.col("pos"))).select(*COLUMNS, "ord")
    out = deduplicate(out, COLUMNS, "ord").select(*COLUMNS)
    return out if citations is None else enrich(out, citations)


def citation_graph(papers: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a library export."""
    return build(papers, **options)
