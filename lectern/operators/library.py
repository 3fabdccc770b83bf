"""Reference libraries: payloads, insert-if-absent, versioned updates."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import pushable

# The columns that every item template has.
COMMON = ["title", "date", "url", "DOI", "pages", "volume", "issue", "language", "rights", "series", "publisher", "archive"]


def creators(authors: Column) -> Column:
    """A list of authors from ;-joined names."""
    names = F.filter(F.split(F.coalesce(authors, F.lit("")), ";"), lambda n: F.trim(n) != "")
    return F.transform(names, lambda n: F.struct(F.lit("author").alias("creatorType"), F.trim(n).alias("firstName"), F.lit("").alias("lastName")))


def templates(records: DataFrame, collection: str | None = None) -> DataFrame:
    """Items to push (P15, P16): the common columns, the abstract, the archive's id, authors; book sections become journal articles; the DOI
    stands in for a missing address. Every item is made of its own row alone."""
    kind = F.when(F.col("itemType") == "bookSection", "journalArticle").otherwise(F.col("itemType"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
    url = F.coalesce(F.col("url"), F.col("DOI"))
    cols = [kind.alias("itemType"), *[(url if c == "url" else blank(c)).alias(c) for c in COMMON], blank("abstract").alias("abstractNote"), blank("archiveID").alias("archiveLocation"), creators(F.col("authors")).alias("creators")]
    if collection is not None:
        cols.append(F.array(F.lit(collection)).alias("collections"))
    return records.select(*cols).where(pushable())


def absent(items: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """Items whose key the library has not."""
    return items.join(existing.select(F.col(key).alias("_k")).distinct(), items[key] == F.col("_k"), "left_anti")


def payloads(items: DataFrame) -> DataFrame:
    """One JSON body an item."""
    return items.select(F.to_json(F.struct(*items.columns)).alias("payload"))


def patches(changes: DataFrame, library: DataFrame, key: str = "key") -> DataFrame:
    """(key, version, payload, conflict): what to send for items that differ from the library, under the version that was read;
    conflict where the library has another version by now (K12)."""
    fields = [c for c in changes.columns if c not in (key, "version")]
    now = library.select(F.col(key).alias("_k"), F.col("version").alias("_version"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = changes.join(now, changes[key] == now["_k"])
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    body = F.to_json(F.struct(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).alias(c) for c in fields]))
    return joined.where(differs).select(key, "version", body.alias("payload"), (F.col("version") != F.col("_version")).alias("conflict"))


def deliver(df: DataFrame, send: Callable[[Iterable], None]) -> None:
    """Hands each partition's rows to a function that sends them; a retried task sends again, so it must be idempotent."""
    df.foreachPartition(send)


def find_or_create(collections: DataFrame, name: str, create: Callable[[str], str]) -> str:
    """The key of a collection, made if there is none."""
    row = collections.where(F.col("name") == name).select("key").orderBy("key").first()
    return row.key if row else create(name)
