"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes any table with the columns doc_id and text, and perhaps others, whatever their names; an empty table gives an empty one. What each does with
null ids and texts, empty texts and repeated rows is in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, packing, shingle_join, suffix_dedup, toxicity
from lectern.llm.common import Tables
from lectern.llm.registry import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table labels, rejects (score 0.5 or more) go. A null text is scored as an empty one; rows with
    null ids are scored, too, but not learned from; repeated rows stay or go together; without labels of both classes all
    rows stay, or, if all labels say toxic, none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.where(toxicity.score(model) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of three lines or more are cut from the texts, by id and, in a document, by place. Rows with null ids or texts stay as they are;
    repeated rows (id and text) are one document and are cut alike; a text that is all copies becomes empty, and its row stays."""
    return line_dedup.dedup_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.75) the document with the smallest id stays.
    Texts without words, null texts and null ids are in no group and stay; repeated rows (one id) stay or go together."""
    groups = shingle_join.near_groups(docs).select(F.col("doc_id").alias("_id"), "component_id")
    later = groups.where("component_id <> _id").select("_id").distinct().hint("merge")
    return docs.join(later, docs["doc_id"] == later["_id"], "left_anti")


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that are covered by a string of 100 bytes that also starts earlier are cut from the texts, and with them what is left of a character that a cut
    splits. Null ids and texts stay as they are; repeated rows (id and text) are one document and are cut alike; rows whose
    text becomes empty stay."""
    return suffix_dedup.dedup_bytes(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed: a row a piece. A null text counts as empty and is its end token alone; a null id stays null; repeated rows are documents
    of their own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("shingle_join", keep_one_of_each_group),
    ("suffix_dedup", drop_repeated_bytes),
    ("packing", pack),
]

#: A learned classifier and a tokenizer are no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again; the last one's rows."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = tables.put(name, stage(spark, docs, sf_dir))
        tables.drop(*(n for n, _ in STAGES if n != name))
        docs = after
    return docs
