"""Query composition, collection state and pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keyword_groups(keywords: list[list[str]]) -> list[list[str]]:
    """Two lists give all pairs, one (or an empty second) single words, anything else nothing."""
    first, second = (keywords[0] if keywords else []), (keywords[1] if len(keywords) > 1 else [])
    if len(keywords) == 2 and first and second:
        return [[a, b] for a in first for b in second]
    if first and (len(keywords) == 1 or (len(keywords) == 2 and not second)):
        return [[a] for a in first]
    return []


def query_matrix(spark: SparkSession, keywords: list[list[str]], years: list[int], apis: list[str]) -> DataFrame:
    """(api, id_collect, keyword, year): every group, year and source; ids count within a source, keyword first, then year (C1, C2). The
    lists are a configuration's, so the product is made where they are."""
    rows = [(a, k * len(years) + j, g, y) for a in apis for k, g in enumerate(keyword_groups(keywords)) for j, y in enumerate(years)]
    return spark.createDataFrame(rows, "api string, id_collect int, keyword array<string>, year int")


def product(*frames: DataFrame) -> DataFrame:
    """The same for lists that are tables; each is broadcast to the next, so all but the first must be configuration-sized."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def number_queries(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """id_collect: the ordinal within the source."""
    return df.withColumn("id_collect", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def initial_state(queries: DataFrame) -> DataFrame:
    """Nothing fetched yet."""
    return queries.withColumns({"state": F.lit(-1), "last_page": F.lit(0), "total_art": F.lit(0).cast("long"), "coll_art": F.lit(0).cast("long"), "update_date": F.lit(None).cast("string")})


def api_states(state: DataFrame, api: str = "api", column: str = "state") -> DataFrame:
    """1 where all queries of the source are done, else 0 (C4)."""
    return state.groupBy(api).agg(F.when(F.bool_and(F.coalesce(F.col(column) == 1, F.lit(False))), 1).otherwise(0).alias("api_state"))


def rolled_up(state: DataFrame, api: str = "api", column: str = "state") -> DataFrame:
    """The state with its source's and the whole collection's (C4)."""
    apis = api_states(state, api, column)
    whole = apis.agg(F.min("api_state").alias("global_state"))
    return state.join(apis, api).crossJoin(F.broadcast(whole))  # one row


def pending(state: DataFrame, api: str = "api", column: str = "state") -> DataFrame:
    """Queries still to be run: not done, of a source and a collection that are not done."""
    return rolled_up(state, api, column).where(f"api_state <> 1 and global_state <> 1 and coalesce({column}, -1) <> 1")


def advance(state: DataFrame, pages: DataFrame, page_size: str = "max_by_page") -> DataFrame:
    """The state after pages (api, id_collect, page, total, n, max_by_page) have been fetched. last_page is the last page that is
    complete, so a resumed run starts behind it; a short page ends a query (C4, S2)."""
    done = pages.groupBy("api", "id_collect").agg(F.max("page").alias("p"), F.max("total").alias("t"), F.sum("n").alias("c"), F.bool_or(F.col("n") < F.col(page_size)).alias("short"))
    joined = state.join(done, ["api", "id_collect"], "left")
    return joined.select("api", "id_collect", "keyword", "year", F.when(F.col("p").isNull(), F.col("state")).when(F.col("short"), 1).otherwise(0).alias("state"), F.coalesce("p", "last_page").alias("last_page"), F.coalesce("t", "total_art").alias("total_art"), (F.col("coll_art") + F.coalesce("c", F.lit(0))).alias("coll_art"))


def by_source(queries: DataFrame, sources: int) -> DataFrame:
    """One partition for each source, so that a source's rate limit holds for all its queries."""
    return queries.repartition(sources, "api").sortWithinPartitions("api", "id_collect")


def register(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of (api, keyword, year): known ones keep theirs, others follow the largest, in order."""
    keys = ["api", "keyword", "year"]
    joined = new.join(old.select(*keys, "id_collect"), keys, "left")
    top = old.groupBy("api").agg(F.max("id_collect").alias("top"))
    order = Window.partitionBy("api", F.col("id_collect").isNull()).orderBy("keyword", "year")
    joined = joined.join(top, "api", "left").withColumn("n", F.row_number().over(order))
    return joined.select(*keys, F.coalesce("id_collect", F.coalesce("top", F.lit(-1)) + F.col("n")).alias("id_collect"))
