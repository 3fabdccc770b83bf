"""Vectors that take part in searches and joins, and their classes of equal vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, h1, h2): rows with an id and a vector that is neither null nor zero, without null or non-finite components, and as long as
    most of the table's vectors are (of equally frequent lengths, the smaller). h1 and h2: two hashes of the vector."""
    x = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    most = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    x = x.where(F.size("v") == (most.n if most else -1))
    return x.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of valid() rows: the members (id, h1, h2, v), a repeated row once, and the classes of equal vectors (rep: smallest id, n: members, v,
    h1, h2)."""
    members = rows.groupBy("h1", "h2", "id").agg(F.any_value("v").alias("v"))
    return members, members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
