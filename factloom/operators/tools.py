"""Read-only query tools over an index of findings, verdicts and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import vocab


def scope_filter(rows: DataFrame, scope: str) -> DataFrame:
    """``workspace``, a crate's name, or a path (which holds a slash)."""
    if scope == "workspace":
        return rows
    return rows.where(F.col("file") == scope) if "/" in scope else rows.where(F.col("crate") == scope)


def query_capabilities(findings: DataFrame, scope: str = "workspace", capability: str | None = None, context: str | None = None) -> DataFrame:
    """A null context never equals a filter."""
    rows = scope_filter(findings, scope)
    if capability is not None:
        rows = rows.where(F.col("capability") == capability)
    if context is not None:
        rows = rows.where(F.col("execution_context") == context)
    return rows


def query_gate_verdicts(verdicts: DataFrame, scope: str = "workspace") -> DataFrame:
    if "/" in scope:
        raise ValueError("verdicts are of crates, not of files")
    return scope_filter(verdicts, scope)


def query_violations(violations: DataFrame, check: str | None = None, category: str | None = None) -> DataFrame:
    rows = violations
    if check is not None:
        rows = rows.where(F.col("code") == check)
    if category is not None:
        rows = rows.where(F.col("code").isin([c for c, _, kind, _ in vocab.CHECKS if kind == category]))
    return rows


def parse_capability_pattern(pattern: str) -> list[str]:
    wanted = [p.strip() for p in pattern.split("+")]
    if unknown := [p for p in wanted if p not in vocab.CAPABILITIES]:
        raise ValueError(f"unknown capability {unknown[0]!r}")
    return wanted


def search_by_capability(findings: DataFrame, pattern: str, language: str | None = None) -> DataFrame:
    """All findings (of the language) of the crates that have every capability of ``a+b``. Division, in one pass and a semi-join."""
    wanted = parse_capability_pattern(pattern)
    if language is not None:
        if language not in vocab.LANGUAGES or language == "rust":
            raise ValueError("findings of Rust carry no language" if language == "rust" else f"unknown language {language!r}")
        findings = findings.where(F.col("language") == language)
    held = findings.groupBy("crate").agg(*[F.bool_or(F.col("capability") == c).alias(f"_{i}") for i, c in enumerate(wanted)])
    for i in range(len(wanted)):
        held = held.where(F.col(f"_{i}"))
    return findings.join(held.select("crate"), "crate", "left_semi")


def audit_crates(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each crate: files, findings, capabilities and verdicts by severity."""
    a = findings.groupBy("crate").agg(F.count_distinct("file").alias("files"), F.count("*").alias("findings"), F.count_distinct("capability").alias("capabilities"))
    b = verdicts.groupBy("crate").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("deny", "warn", "info")])
    return a.join(b, "crate", "left").fillna(0, ["deny", "warn", "info"])


def structural_duplicates(fingerprints: DataFrame, least_facts: int = 3) -> DataFrame:
    """skeleton, members, exact_groups and largest_exact of skeletons that two functions or more share."""
    exact = fingerprints.where(F.col("fact_count") >= least_facts).groupBy("skeleton", "exact").agg(F.count("*").alias("n"))
    groups = exact.groupBy("skeleton").agg(F.sum("n").alias("members"), F.count_if(F.col("n") >= 2).alias("exact_groups"), F.max("n").alias("largest_exact"))
    return groups.where("members >= 2")


def explain_finding(spark, code: str) -> DataFrame:
    return checks(spark).where(F.col("code") == code)


def checks(spark) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(vocab.CHECKS)], "ord int, code string, description string, category string, generated boolean")


#: Tool name -> function of DataFrames and parameters.
REGISTRY = {f.__name__: f for f in (query_capabilities, query_gate_verdicts, query_violations, search_by_capability, audit_crates, explain_finding, structural_duplicates)}


def dispatch(name: str, *frames, **params) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"no tool is named {name!r}")
    return REGISTRY[name](*frames, **params)
