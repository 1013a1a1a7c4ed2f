"""A training corpus from raw documents: good, in a known language, without near copies, mixed and packed.

Every stage takes a table with doc_id, text, lang and source, of which any may
be null, and further columns of any name; all but the last return the same
columns, rows as they were. An empty table gives an empty table. Rows that
repeat are rows of their own. Each stage learns and counts over what the one
before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import langid, mixing, neardup, packing, quality
from factloom.llm.langid import bucket
from factloom.llm.queries import tokenizer_path
from factloom.scratch import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.7 or more.

    Null and empty texts go. Without a usable label, or with labels of 1 alone,
    every other text stays; with labels of 0 alone, none does. Rows that repeat
    are judged alike.
    """
    model = quality.learn_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams the filter of some language explains.

    Null and letterless texts go; where no row states a language, every text
    does. Rows that repeat are judged alike.
    """
    model = langid.learn(docs.where(bucket(docs["doc_id"], 5) != 0))
    return langid.keep_identified(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8 or more): that with the smallest id.

    Texts without a word are one group. Null ids count as largest; among rows
    that share the id, that with the least hash of its text stays, and of rows
    that repeat wholly one.
    """
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null sources are one source, which comes last; texts without a word have no
    size and are never taken. Ties in the random key are ordered by id, size and place.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and copies with their places in sequences of 1024 tokens.

    Null text is empty and gives the end id alone; copies of a document are
    packed each for itself. Further columns are not read.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("language identification", keep_identified),
    ("simhash near-dedup", keep_one_of_each),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The stages learn models and encode tokens, which SQL cannot express; tests/llm hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
