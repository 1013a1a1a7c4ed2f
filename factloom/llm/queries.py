"""The queries of this package: (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import jpeg, langid, mixing, packing, quality, sharding, simhash, sketch, sql, tokenstore, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to WARC archives in the shared scratch folder and reads them back."""
    where = scratch.path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), where)
    return warc.page_records(spark, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document from bit-sliced n-gram filters."""
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document and names its near-duplicate component."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; FACTLOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("FACTLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into a content-addressed store and reads them back from it."""
    where = scratch.path(spark, "tokenstore")
    tokenstore.write_store(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), where)
    return tokenstore.verified(spark, where)


def op5_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches every document, its edited text and the next document."""
    return sketch.edited_documents(_table(spark, sf_dir, "documents"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as a baseline JPEG in the shared scratch folder and reads dimensions, thumbnail and digests back."""
    found = jpeg.features(jpeg.store(_table(spark, sf_dir, "documents"), scratch.path(spark, "media")))
    feature = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":"), "thumbnail_hash", F.lit(":"), "thumbnails_sha1")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 1024."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by how well good and bad dictionaries compress it."""
    return quality.predict_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to target weights; a source's taken words are its target rounded."""
    return mixing.mix(_table(spark, sf_dir, "documents"), mixing.words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaves all documents into 24 shards of equal row counts."""
    placed = sharding.interleave(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_langid": op2_langid,
        "op3_simhash": op3_simhash,
        "op4_tokenstore": op4_tokenstore,
        "op5_sketch": op5_sketch,
        "op6_jpeg": op6_jpeg,
        "op7_packing": op7_packing,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": sql.OP1, "op9_mixing": sql.OP9, "op10_sharding": sql.OP10}
