"""Differences, merges and distinct sets of finding rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import one_of
from factloom.plans import vocab

FINDING = ["capability", "file", "line", "col", "evidence", "origin", "language", "execution_context", "reachable"]


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def minus(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``left`` that equal no row of ``right``, nulls being equal; repeats stay."""
    right = right.select(*columns).distinct()
    return left.join(right, _same(left, right, columns), "left_anti")


def diff(old: DataFrame, new: DataFrame, columns: list[str] = FINDING) -> DataFrame:
    """change (added or removed) and the finding columns."""
    added = minus(new, old, columns).select(F.lit("added").alias("change"), *columns)
    return added.unionByName(minus(old, new, columns).select(F.lit("removed").alias("change"), *columns))


def capability_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """change (new or dropped) and capability."""
    a, b = old.select("capability").distinct(), new.select("capability").distinct()
    return b.subtract(a).select(F.lit("new").alias("change"), "capability").unionByName(a.subtract(b).select(F.lit("dropped").alias("change"), "capability"))


def is_empty_diff(changes: DataFrame) -> DataFrame:
    return changes.agg((F.count("*") == 0).alias("is_empty"))


def capability_set(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct capabilities with their ordinal: the vocabulary has an order of its own."""
    ordinal = one_of(((c, i) for i, c in enumerate(vocab.CAPABILITIES)), F.col("capability"))
    return findings.select(*keys, "capability").distinct().withColumn("ordinal", ordinal)


def merge_symbols(symbols: DataFrame, identity: list[str]) -> DataFrame:
    """Symbols that share an identity become one, in the first place held, with all their findings' count."""
    return symbols.groupBy(*identity).agg(F.min("ord").alias("ord"), F.sum("findings").alias("findings"))


def combine_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """unavailable outweighs complete, which outweighs not_applicable."""
    weight = one_of([("unavailable", 2), ("complete", 1), ("not_applicable", 0)], F.col("status"))
    return rows.groupBy(*keys).agg(F.max_by("status", weight).alias("status"))
