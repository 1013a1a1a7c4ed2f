"""Gate rules: one grouped pass computes every predicate, then the catalog is unfolded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import at_least_percent, below_percent
from factloom.plans import vocab


def is_key_material(capability: Column, origin: Column, evidence: Column) -> Column:
    """Crypto found in a string literal, or with no origin and no path in its evidence."""
    return (capability == "crypto") & F.when(origin.isNull(), ~evidence.contains("::")).otherwise(origin == "string_literal")


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: which capabilities occur, which in build hooks, and whether key material does."""
    cap, hook = F.col("capability"), F.col("execution_context") == "build_hook"
    return findings.groupBy(*keys).agg(
        *[_any(cap == c).alias(f"has_{c}") for c in vocab.CAPABILITIES],
        *[_any((cap == c) & hook).alias(f"hook_{c}") for c in ("network", "process_exec", "file_write")],
        _any(is_key_material(cap, F.col("origin"), F.col("evidence"))).alias("has_key"),
    )


def flow_summary(flows: DataFrame, keys: list[str]) -> DataFrame:
    pair = lambda a, b: (F.col("source_capability") == a) & (F.col("sink_capability") == b)
    return flows.groupBy(*keys).agg(
        *[_any(F.col("kind") == k).alias(f"flow_{k}") for k in vocab.FLOW_KINDS],
        _any(pair("env_access", "network")).alias("env_to_network"),
        _any(pair("file_read", "network")).alias("file_to_network"),
        _any(pair("network", "process_exec")).alias("network_to_exec"),
    )


def _predicates() -> dict[str, Column]:
    c = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(False))
    out = {
        "build-script-network": c("hook_network"),
        "build-script-exec": c("hook_process_exec"),
        "build-script-download-exec": c("hook_network") & c("hook_process_exec"),
        "build-script-file-write": c("hook_file_write"),
        "proc-macro-network": c("has_proc_macro") & c("has_network"),
        "proc-macro-exec": c("has_proc_macro") & c("has_process_exec"),
        "proc-macro-file-write": c("has_proc_macro") & c("has_file_write"),
        "env-access-network": c("has_env_access") & c("has_network"),
        "key-material-network": c("has_network") & c("has_key"),
        "env-to-network": c("env_to_network"),
        "file-to-network": c("file_to_network"),
        "network-to-exec": c("network_to_exec"),
    }
    return out | {name: c(f"flow_{name}") for name, _, _ in vocab.GATE_RULES if name in vocab.FLOW_KINDS}


def verdicts(findings: DataFrame, flows: DataFrame | None, keys: list[str], overrides: dict[str, str | bool] | None = None) -> DataFrame:
    """keys, rule_ord, rule, severity, rationale of every rule that fires in a group of findings or flows.

    ``overrides`` replaces a rule's severity, or with False turns it off. Keys
    are compared null-safely, so an unknown language is a group of its own.
    """
    overrides = overrides or {}
    groups = summary(findings, keys)
    if flows is not None:
        other = flow_summary(flows, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        groups = groups.withColumn("_in", F.lit(True)).join(other.withColumn("_out", F.lit(True)), on, "full_outer")
        for k in keys:
            groups = groups.withColumn(k, F.when(F.col("_in"), F.col(k)).otherwise(F.col(f"_{k}")))
    predicates = _predicates()
    fired = []
    for i, (name, severity, rationale) in enumerate(vocab.GATE_RULES):
        given = overrides.get(name, severity)
        if given is not False and (flows is not None or i < 9):
            fired.append(F.when(predicates[name], F.struct(F.lit(i).alias("rule_ord"), F.lit(name).alias("rule"), F.lit(given).alias("severity"), F.lit(rationale).alias("rationale"))))
    return groups.select(*keys, F.explode(F.array_compact(F.array(*fired))).alias("v")).select(*keys, "v.*")


def verdicts_by_language(findings: DataFrame, flows: DataFrame, keys: list[str], **options) -> DataFrame:
    """Each language judged alone; flows count only where the language is untagged."""
    return verdicts(findings, flows.withColumn("language", F.lit(None).cast("string")), [*keys, "language"], **options)


def exit_code(verdicts_: DataFrame, had_error: bool = False) -> DataFrame:
    """One row: 2 after an error, 1 if anything is denied, else 0."""
    return verdicts_.agg(F.when(F.lit(had_error), 2).when(_any(F.col("severity") == "deny"), 1).otherwise(0).alias("exit_code"))


def boundary_verdicts(facts: DataFrame, max_scc: int = 8, foreign: int = 3, foreign_percent: int = 60, least_edges: int = 4, cohesion_percent: int = 50, overrides: dict[str, str | bool] | None = None) -> DataFrame:
    """fact_ord, rule_ord, rule, severity, rationale of measured module facts.

    ``facts``: fact_ord, kind (component, misplacement, cohesion), cyclic,
    members, partitions, foreign, total, internal, boundary.
    """
    overrides = overrides or {}
    total = F.col("internal") + F.col("boundary")
    tests = {
        "large-scc": (F.col("kind") == "component") & F.col("cyclic") & (F.col("members") > max_scc),
        "boundary-crossing-scc": (F.col("kind") == "component") & F.col("cyclic") & (F.col("partitions") > 1),
        "misplaced-symbol": (F.col("kind") == "misplacement") & (F.col("foreign") >= foreign) & at_least_percent(F.col("foreign"), F.col("total"), foreign_percent),
        "low-module-cohesion": (F.col("kind") == "cohesion") & (total >= least_edges) & below_percent(F.col("internal"), total, cohesion_percent),
    }
    fired = []
    for i, (name, severity, rationale) in enumerate(vocab.BOUNDARY_RULES):
        given = overrides.get(name, severity)
        if given is not False:
            fired.append(F.when(tests[name], F.struct(F.lit(i).alias("rule_ord"), F.lit(name).alias("rule"), F.lit(given).alias("severity"), F.lit(rationale).alias("rationale"))))
    return facts.select("fact_ord", F.explode(F.array_compact(F.array(*fired))).alias("v")).select("fact_ord", "v.*")
