"""Proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within each source by a seeded hash and numbered; a row's
fractional rank is (number + 1/2) / (rows of its source). Sorted by fractional
rank, every stretch of rows holds the sources in the proportions of the whole,
so equal cuts are shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import nulls_last, positions
from factloom.scratch import materialise

SHARDS = 24
SEED = "shard"


def interleave(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row.

    ``size`` is the text's UTF-8 bytes plus 8 (null text: 8). Shards differ by
    one row at most; ``slot`` runs from 0 in each. Null sources are one source.
    Rows are ordered by hash of the id, then id and text checksum; rows equal
    in all of these are interchangeable. Other columns are not read. An empty
    table gives no rows, and fewer rows than shards leave shards empty.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")
    )
    rows = materialise(rows, "shard-rows")
    tie = ["key", "doc_id", "text_crc32"]
    ranked, total = positions(rows, [*nulls_last("source"), *map(F.col, tie)], "shard-ranked")
    ranked = materialise(ranked, "shard-numbered")
    strata = materialise(ranked.groupBy("source").agg(F.count("*").alias("n"), F.min("position").alias("start")).withColumnRenamed("source", "stratum"), "shard-strata")
    spread = ranked.join(strata, F.col("source").eqNullSafe(F.col("stratum"))).withColumn("fraction", (2 * (F.col("position") - F.col("start")) + 1) / (2 * F.col("n")))
    spread = materialise(spread.select("doc_id", "source", "size", "text_crc32", "key", "fraction"), "shard-fractions")
    placed, _ = positions(spread, [F.col("fraction"), *nulls_last("source"), *map(F.col, tie)], "shard-placed")
    if not total:
        return placed.select("doc_id", "source", "size", "text_crc32", F.lit(0).alias("shard"), F.col("position").alias("slot"))
    # Row p of n goes to shard floor(p k / n), whose first row is ceil(shard n / k).
    shard = F.expr(f"(position * {shards}L) div {total}L")
    first = F.expr(f"((shard * {total}L) + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"))
