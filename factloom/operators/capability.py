"""Capability findings from fact rows of parsed sources (facts: columns are counted from 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators.literals import judged
from factloom.plans import vocab


def _rows(facts: DataFrame, ord_: int, capability: Column, evidence: Column, origin: str) -> DataFrame:
    kept = facts.withColumn("_c", capability).where("_c is not null")
    return kept.select(F.lit(ord_).alias("detector"), F.col("_c").alias("capability"), "file", "line", (F.col("col0") + 1).alias("col"), evidence.alias("evidence"), F.lit(origin).alias("origin"), "fn")


def detect(use_paths: DataFrame, unsafe_sites: DataFrame, extern_blocks: DataFrame, attributes: DataFrame, string_literals: DataFrame) -> DataFrame:
    """detector, capability, file, line, col, evidence, origin, fn: the five detectors in their order."""
    attribute = S.one_of(vocab.ATTRIBUTE_CAPABILITIES.items(), F.col("name"))
    literal = judged(string_literals)
    return (
        _rows(use_paths, 0, S.rust_capability(F.col("path")), F.col("path"), "import")
        .unionByName(_rows(unsafe_sites, 1, F.lit("unsafe_code"), F.col("text"), "code_site"))
        .unionByName(_rows(extern_blocks, 2, F.lit("ffi"), F.col("text"), "code_site"))
        .unionByName(_rows(attributes, 3, attribute, F.concat(F.lit("#["), F.col("name"), F.lit("]")), "attribute"))
        .unionByName(_rows(literal, 4, F.col("capability"), F.col("evidence"), "string_literal"))
    )


def symbol_profiles(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """file, fn, name and the findings of each function that has any, in order of place."""
    held = findings.where("fn is not null").groupBy("file", "fn").agg(F.sort_array(F.collect_list(F.struct("line", "col", "capability", "evidence"))).alias("findings"))
    return held.join(functions.select("file", "fn", "name"), ["file", "fn"])


def annotate_reachable(findings: DataFrame, functions: DataFrame, reachable: DataFrame) -> DataFrame:
    """findings with ``reachable``: whether the function that starts last at or ahead of the line is reachable; null without one.

    The lookup joins on the file and keeps the latest start, so a file's
    functions meet only that file's findings.
    """
    marked = functions.join(reachable.withColumn("hit", F.lit(True)), ["file", "name"], "left").select(F.col("file").alias("_f"), F.col("line").alias("start"), F.coalesce("hit", F.lit(False)).alias("hit"))
    keyed = findings.withColumn("_id", F.monotonically_increasing_id()).drop("reachable")
    joined = keyed.join(marked, (F.col("file") == F.col("_f")) & (F.col("start") <= F.col("line")), "left")
    return joined.groupBy(*keyed.columns).agg(F.max_by("hit", "start").alias("reachable")).drop("_id")


def enclosing_units(locations: DataFrame, declarations: DataFrame) -> DataFrame:
    """locations with kind, name, start, end of the smallest declaration that holds them; the first offered wins ties."""
    keyed = locations.withColumn("_id", F.monotonically_increasing_id())
    d = declarations.withColumnsRenamed({"file": "_f", "ord": "_o"})
    joined = keyed.join(d, (F.col("file") == F.col("_f")) & F.col("at").between(F.col("start"), F.col("end") - 1), "left")
    best = joined.groupBy(*keyed.columns).agg(F.min_by(F.struct("kind", "name", "start", "end"), F.struct(F.col("end") - F.col("start"), "_o")).alias("unit"))
    return best.select(*locations.columns, "unit.*")
