"""All checks over the facts of Rust sources, in their fixed order, and the checks of whole crates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import capability, rust, style

COLUMNS = ["ord", "code", "file", "line", "col", "detail"]


def style_checks(facts: DataFrame, files: DataFrame, config: style.Config) -> DataFrame:
    """ord, code, file, line, col, detail of every check of single files. ``facts`` is read often: write it to scratch first.

    ``ord`` is the place of the check in the order that reports follow.
    """
    t = lambda tag: rust.table(facts, tag)
    functions = t("function").withColumns({"params": F.size("params"), "forwarder": F.col("is_forwarder"), "gates": F.col("features")})
    flow = t("control_flow").withColumn("has_else", F.coalesce("has_else", F.lit(False)))
    owners = functions.select("file", "fn", F.col("line").alias("_line"), F.col("col").alias("_col"), F.col("has_arithmetic").alias("arithmetic"))
    bindings = t("binding")
    named = bindings.join(owners, ["file", "fn"]).withColumns({"line": F.col("_line"), "col": F.col("_col")})
    calls = t("method_call").withColumn("callee", F.col("name"))
    named_items = t("definition").where("kind <> 'module'")
    parts = [
        style.max_depth(flow, config),
        style.branching(flow, config),
        style.forbidden(t("attribute"), "forbidden-attribute", config),
        style.forbidden(t("type_ref"), "forbidden-type", config),
        style.forbidden(calls, "forbidden-call", config),
        style.forbidden(t("macro"), "forbidden-macro", config),
        style.unsafe_blocks(t("unsafe_site")),
        style.inline_tests(t("module")),
        style.let_underscore(bindings),
        style.dispatch(t("type_ref")),
        style.clone_in_loop(calls, bindings),
        style.naming(named, config),
        style.params(functions, config),
        style.long_bodies(functions, config),
        style.method_counts(functions, config),
        style.module_roots(named_items),
        style.large_files(files.where(F.col("path").endswith(".rs")), config).select(F.lit("large-source-file").alias("code"), "file", F.lit(1).alias("line"), F.lit(1).alias("col"), F.col("lines").cast("string").alias("detail")),
        style.mixed_concerns(t("type_def").select("file", "name"), rust.type_edges(facts)).select(F.lit("mixed-concerns").alias("code"), "file", F.lit(1).alias("line"), F.lit(1).alias("col"), F.col("groups").cast("string").alias("detail")),
    ]
    rows = [p.select(F.lit(i).alias("ord"), "code", "file", "line", "col", F.col("detail").cast("string").alias("detail")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows).where(~F.col("code").isin(sorted(config.disabled)) if config.disabled else F.lit(True))


def gate_prefixes(facts: DataFrame) -> DataFrame:
    """prefix and predicates: what a file below the prefix inherits from the ``mod name;`` that declares it under a condition.

    ``mod x;`` in ``a/mod.rs``, ``a/lib.rs`` or ``a/main.rs`` is ``a/x.rs`` and all below ``a/x``; in ``a/b.rs`` it is ``a/b/x.rs``.
    """
    m = rust.table(facts, "module").where("not inline and size(predicates) > 0")
    own = F.regexp_replace("file", "/?[^/]*$", "")
    base = F.when(F.col("file").rlike("(^|/)(mod|lib|main)\\.rs$"), own).otherwise(F.regexp_replace("file", "\\.rs$", ""))
    prefix = F.concat_ws("/", F.when(base != "", base), "name")
    return m.select(prefix.alias("prefix"), F.explode("predicates").alias("predicate")).groupBy("prefix").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))


def inherited_gates(files: DataFrame, facts: DataFrame) -> DataFrame:
    """file and inherited (sorted conditions) of every file: an equality join on the ancestors of its path."""
    parts = F.split(F.regexp_replace("path", "\\.rs$", ""), "/")
    above = files.select(F.col("path").alias("file"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"))
    joined = above.join(gate_prefixes(facts), "prefix", "left")
    return joined.groupBy("file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("predicates", F.array().cast("array<string>")))))).alias("inherited"))


def project_checks(facts: DataFrame, files: DataFrame, config: style.Config) -> DataFrame:
    """crate, code, type and detail of what only a whole crate shows: scattered impls and too many methods.

    A method's build alternative is the conjunction of its own conditions and
    those that its file inherits; types defined twice in a crate are left out.
    """
    gates = inherited_gates(files, facts)
    methods = rust.table(facts, "function").where("method_of is not null and not is_forwarder").join(gates, "file", "left")
    every = F.array_sort(F.array_distinct(F.concat("predicates", F.coalesce("inherited", F.array().cast("array<string>")))))
    crate = rust.crate_key(F.col("file"))
    impls = methods.select(crate.alias("crate"), "file", F.col("method_of").alias("type"), F.lit(1).cast("bigint").alias("methods"), F.nullif(F.array_join(every, " & "), F.lit("")).alias("gate"))
    defined = rust.table(facts, "type_def").select(crate.alias("crate"), F.col("name").alias("type"))
    found = style.type_footprint(impls, config, defined)
    codes = F.array_compact(F.array(F.when(F.col("scattered"), F.struct(F.lit("scattered-inherent-impl").alias("code"), F.col("files").cast("string").alias("detail"))), F.when(F.col("large"), F.struct(F.lit("high-method-count").alias("code"), F.col("methods").cast("string").alias("detail")))))
    return found.select("crate", "type", F.explode(codes).alias("hit")).select("crate", "hit.code", "type", "hit.detail")


def rust_findings(facts: DataFrame) -> DataFrame:
    """Capability findings of Rust sources: the five detectors over extracted facts."""
    return capability.detect(*rust.capability_facts(facts))
