"""Writers (K1-K10). "NA" stands for NULL only here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_na(df: DataFrame) -> DataFrame:
    return df.na.fill("NA")


def write_pages(df: DataFrame, path: str) -> None:
    """Page envelopes, a directory for each source and query (K1)."""
    df.write.mode("append").partitionBy("api", "id_collect").json(path)


def write_state(df: DataFrame, path: str) -> None:
    """The collection's state (K2)."""
    df.write.mode("overwrite").json(path)


def with_index(df: DataFrame, by: list[str], name: str = "index") -> DataFrame:
    """A first column of row numbers from 0 in the order of `by`, which must be unique, without bringing all rows into one task: the rows are sorted over
    range partitions, and each gets its place in its partition and the number of rows in those before, which is one row a partition. The
    ranges come from a sample, so both uses must see the same ones: the sorted rows are persisted (spark.catalog.clearCache() frees them), and a lost part is
    made anew within the same ranges."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).persist()
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(before, "_part").select((F.col("_before") + F.col("_at")).alias(name), *df.columns)


def write_records(df: DataFrame, path: str, index_by: list[str] | None = None) -> None:
    """;-separated and quoted, with a header, NA for missing (K3); with an index column if there is an order for it."""
    df = df if index_by is None else with_index(df, index_by)
    with_na(df).write.mode("overwrite").options(sep=";", header=True, quoteAll=True, escape='"').csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as TSV, edges as CSV, as graph tools read them (K4)."""
    nodes.write.mode("overwrite").options(sep="\t", header=True).csv(f"{path}/nodes")
    edges.write.mode("overwrite").options(header=True).csv(f"{path}/edges")


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Counts, terms, recaps, agreement and life-path tables."""
    df.write.mode("overwrite").options(sep=sep, header=True).csv(path)


def write_wide(df: DataFrame, row: str, column: str, columns: list[str], value: str, path: str) -> None:
    """One row a subject, one column a name."""
    write_table(df.groupBy(row).pivot(column, columns).agg(F.first(value)), path)


def write_corpus(df: DataFrame, path: str) -> None:
    """Text, a directory a collection (K8)."""
    df.write.mode("overwrite").partitionBy("collection").text(path)
