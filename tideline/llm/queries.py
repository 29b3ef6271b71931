"""The thin opN_<name> queries over the corpus tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import licenses, media, mixing, neighbours, ngrams, order, quality, simhash, substrings
from tideline.llm.common import fold_of, fresh_path, table


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by a model of six in seven of them."""
    return ngrams.score(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and accepted license templates of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in an archive of the shared folder, read back by byte ranges."""
    path = fresh_path(spark, "archives")
    media.write_archives(table(spark, sf_dir, "documents"), path)
    return media.media_features(media.read_archives(spark, path))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public 50k ranks and decoded again."""
    import public_tokenizers

    from tideline.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of documents with smaller ids."""
    return substrings.removed(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of positives and unlabelled texts."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of token ids of all documents, as stored in the shards in training order."""
    import public_tokenizers

    return order.training_order(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_order": op5_order,
    "op6_mixing": op6_mixing,
    "op7_ngrams": op7_ngrams,
    "op8_licenses": op8_licenses,
    "op9_media": op9_media,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op3_substrings": substrings.SQL, "op6_mixing": mixing.SQL}
