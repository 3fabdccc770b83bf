"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_join, line_dedup, nearest, packing, pieces, shingle_join, suffix_dedup, token_counts, toxicity, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_groups(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digest(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_bytes", "n_tokens", "ids_crc32", "round_trip")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"), min_words=line_dedup.MIN_WORDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_token_counts, op3_shingle_join, op4_nearest, op5_suffix_dedup, op6_pieces, op7_warc_revisits, op8_toxicity, op9_embedding_join, op10_line_dedup, op10_passage_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_revisits": warc.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
