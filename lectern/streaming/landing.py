"""Incremental collection as a stream: new pages are normalised and merged, and progress is the checkpoint's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import deduplicate
from ..schema import COLUMNS
from ..sources.files import ENVELOPE
from ..sources.normalize import normalize


def pages_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Page files as they come, at most so many at a time."""
    return spark.readStream.schema(ENVELOPE).options(multiLine=True, recursiveFileLookup=True, maxFilesPerTrigger=per_trigger).json(path).withColumn("_file", F.col("_metadata.file_path"))


def progress(pages: DataFrame) -> DataFrame:
    """Running (api, id_collect, last_page, total, coll_art) of the pages."""
    parts = F.split("_file", "/")
    return pages.groupBy(F.element_at(parts, -3).alias("api"), F.element_at(parts, -2).alias("id_collect")).agg(F.max("page").alias("last_page"), F.max(F.coalesce("total_nb", "total")).alias("total"), F.sum(F.size("results")).alias("coll_art"))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def current(spark: SparkSession, target: str) -> int | None:
    """The number of the version that target/CURRENT names: the last complete one."""
    at = _path(spark, f"{target}/CURRENT")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(spark.read.text(f"{target}/CURRENT").first().value) if fs.exists(at) else None


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """The table that merge_stream() keeps at `target`."""
    number = current(spark, target)
    if number is None:
        raise ValueError(f"{target} has no complete version yet")
    return spark.read.parquet(f"{target}/v={number}")


def merge_stream(spark: SparkSession, source: str, api: str, target: str, checkpoint: str):
    """Starts a query that merges new records of one source into the table at `target`, entity-resolved with what is there, and ends when all
    that is there now has been read. A batch writes a new version of the table beside the old one, then names it in target/CURRENT, and then
    removes versions older than the one before, which a reader may still be reading. A batch that is run again starts from the version before it, so it
    gives the same."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = normalize(batch.select(F.explode("results").alias("r")), api)
        fs = _path(spark, target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(k for k in range(number) if fs.exists(_path(spark, f"{target}/v={k}/_SUCCESS")))
        old = spark.read.parquet(f"{target}/v={done[-1]}") if done else None
        both = rows.withColumn("ord", F.lit(1)) if old is None else old.withColumn("ord", F.lit(0)).unionByName(rows.withColumn("ord", F.lit(1)))
        both = both.withColumn("ord", F.concat_ws("|", F.col("ord"), F.coalesce("archive", F.lit("")), F.coalesce("archiveID", F.lit("")), F.coalesce("title", F.lit(""))))
        deduplicate(both, COLUMNS, "ord").select(*COLUMNS).write.mode("overwrite").parquet(f"{target}/v={number}")
        written = fs.create(_path(spark, f"{target}/CURRENT.new"), True)
        written.writeBytes(str(number))
        written.close()
        fs.delete(_path(spark, f"{target}/CURRENT"), False)
        fs.rename(_path(spark, f"{target}/CURRENT.new"), _path(spark, f"{target}/CURRENT"))
        for k in done[:-1]:
            fs.delete(_path(spark, f"{target}/v={k}"), True)

    return pages_stream(spark, source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
