"""Style checks as filters and grouped filters over fact tables.

Every check returns code, file, line, col (counted from 1), detail. Facts count
columns from 0 in ``col``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as S


@dataclass
class Config:
    """Limits and rules of the checks. Defaults as the checks have them; 0 turns a file tier off."""

    max_depth: int = 3
    else_chain: int = 3
    max_params: int = 5
    max_body: int = 120
    file_warn: int = 500
    file_deny: int = 1000
    max_methods: int = 40
    generic_ratio: float = 0.3
    generic_count: int = 2
    generic_names: list[str] = field(default_factory=list)
    forbidden: dict[str, list[str]] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)


def _violations(rows: DataFrame, code, detail: Column | None = None) -> DataFrame:
    code = code if isinstance(code, Column) else F.lit(code)
    detail = detail if detail is not None else F.lit(None)
    return rows.select(code.alias("code"), "file", "line", (F.col("col") + 1).alias("col"), detail.cast("string").alias("detail"))


def max_depth(control_flow: DataFrame, config: Config) -> DataFrame:
    return _violations(control_flow.where((F.col("kind") != "closure") & (F.col("depth") > config.max_depth)), "max-depth", F.col("depth"))


def branching(control_flow: DataFrame, config: Config) -> DataFrame:
    """nested-if, if-in-match, else-chain, forbidden-else, nested-match, match-in-if: one ``if`` may give several."""
    kind, parent = F.col("kind"), F.col("parent_branch")
    cases = {
        "nested-if": (kind == "if") & (parent == "if"),
        "if-in-match": (kind == "if") & (parent == "match"),
        "else-chain": (kind == "if") & (F.col("chain_len") >= config.else_chain),
        "forbidden-else": (kind == "if") & F.col("has_else"),
        "nested-match": (kind == "match") & (parent == "match"),
        "match-in-if": (kind == "match") & (parent == "if"),
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in cases.items() if code not in config.disabled]))
    return _violations(control_flow.withColumn("_code", F.explode(codes)), F.col("_code"))


def forbidden(facts: DataFrame, check: str, config: Config) -> DataFrame:
    """The first configured pattern that the text matches; patterns are few and become one expression."""
    found = S.first_match([(S.wildcard(F.col("text"), p), F.lit(p)) for p in config.forbidden.get(check, [])])
    return _violations(facts.withColumn("_p", found.cast("string")).where("_p is not null"), check, F.col("_p"))


def unsafe_blocks(sites: DataFrame) -> DataFrame:
    return _violations(sites.where("kind = 'block'"), "forbidden-unsafe")


def inline_tests(modules: DataFrame) -> DataFrame:
    return _violations(modules.where("is_cfg_test"), "inline-tests", F.col("name"))


def let_underscore(bindings: DataFrame) -> DataFrame:
    return _violations(bindings.where("is_wildcard and has_init and not init_is_write_macro"), "let-underscore-result")


def dispatch(type_refs: DataFrame) -> DataFrame:
    """One code for a reference: that of its position if it is dynamic there, else vec-box-dyn; default-hasher besides."""
    place = S.one_of([("return", "dyn-return"), ("param", "dyn-param"), ("field", "dyn-field")], F.col("context"))
    code = F.coalesce(F.when(F.col("involves_dyn"), place), F.when(F.col("is_vec_box_dyn"), F.lit("vec-box-dyn")))
    both = F.array_compact(F.array(code, F.when(F.col("is_default_hasher"), F.lit("default-hasher"))))
    return _violations(type_refs.withColumn("_code", F.explode(both)), F.col("_code"), F.col("text"))


def clone_in_loop(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """Clones inside a loop whose receiver is no counted reference of the same function."""
    counted = bindings.where("is_refcounted").select("file", "fn", F.col("name").alias("receiver")).distinct()
    rows = calls.where("callee = 'clone' and loop_depth > 0")
    return _violations(rows.join(counted, ["file", "fn", "receiver"], "left_anti"), "clone-in-loop", F.col("receiver"))


def naming(bindings: DataFrame, config: Config) -> DataFrame:
    """Functions with many generic names: enough of them, and more than the ratio of all that are not underscored."""
    named = bindings.where(~F.col("name").startswith("_"))
    generic = F.coalesce(S.is_generic_name(F.col("name"), F.col("loop_depth"), F.col("arithmetic"), config.generic_names), F.lit(False))
    sums = named.groupBy("file", "fn", "line", "col").agg(F.count("*").alias("n"), F.count_if(generic).alias("generic"))
    return _violations(sums.where((F.col("generic") >= config.generic_count) & (F.col("generic") / F.col("n") > config.generic_ratio)), "generic-naming", F.concat_ws("/", "generic", "n"))


def params(functions: DataFrame, config: Config) -> DataFrame:
    return _violations(functions.where(F.col("params") > config.max_params), "high-param-count", F.col("params"))


def long_bodies(functions: DataFrame, config: Config) -> DataFrame:
    return _violations(functions.where(F.col("body_lines") > config.max_body), "long-function-body", F.col("body_lines"))


def method_counts(functions: DataFrame, config: Config) -> DataFrame:
    """Types with many methods in a file, forwarders aside, at the first method."""
    sums = functions.where("method_of is not null and not forwarder").groupBy("file", "method_of").agg(F.count("*").alias("n"), F.min(F.struct("line", "col")).alias("at"))
    return _violations(sums.where(F.col("n") > config.max_methods).select("file", "method_of", "n", "at.line", "at.col"), "high-method-count", F.concat_ws(":", "method_of", "n"))


def large_files(files: DataFrame, config: Config) -> DataFrame:
    """file, lines, severity of files at or above a tier. Lines end at a newline; a last one without counts."""
    text = F.col("source")
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    tier = F.when(F.lit(config.file_deny > 0) & (F.col("lines") >= config.file_deny), "deny").when(F.lit(config.file_warn > 0) & (F.col("lines") >= config.file_warn), "warn")
    return files.select(F.col("path").alias("file"), n.alias("lines")).withColumn("severity", tier).where("severity is not null")


def module_roots(items: DataFrame) -> DataFrame:
    """Items defined in mod.rs or lib.rs."""
    return _violations(items.where(S.file_name(F.col("file")).isin("mod.rs", "lib.rs")), "module-root-definitions", F.col("name"))


def visibility(policies: DataFrame, items: DataFrame) -> DataFrame:
    """path, name and problem (missing, duplicate, wrong-kind, wrong-visibility) of every policy that its item does not keep."""
    i = items.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("visibility").alias("_v"))
    on = S.path_suffix(F.col("_f"), F.col("path")) & (F.col("name") == F.col("_n"))
    sums = policies.join(i, on, "left").groupBy("path", "name", "kind", "visibility").agg(F.count("_n").alias("n"), F.first("_k").alias("_k"), F.first("_v").alias("_v"))
    problem = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "duplicate").when(F.col("_k") != F.col("kind"), "wrong-kind").when(F.col("_v") != F.col("visibility"), "wrong-visibility")
    return sums.withColumn("problem", problem).where("problem is not null").select("path", "name", "problem")


def ungated_test_api(functions: DataFrame, globs: list[str], feature: str) -> DataFrame:
    named = reduce(lambda a, b: a | b, [S.wildcard(F.col("name"), g) for g in globs], F.lit(False))
    return _violations(functions.where(named & S.under_src(F.col("file")) & ~F.coalesce(F.array_contains("gates", feature), F.lit(False))), "ungated-test-api", F.col("name"))


def mixed_concerns(types: DataFrame, type_edges: DataFrame) -> DataFrame:
    """file and groups of files whose types fall into two connected groups or more."""
    from factloom.operators.graph import connected_components

    key = lambda name: F.concat_ws("\0", "file", name)
    t = types.select("file", key("name").alias("node")).distinct()
    inner = type_edges.select("file", key("src").alias("a"), key("dst").alias("b"))
    inner = inner.join(t.select(F.col("node").alias("a")), "a", "left_semi").join(t.select(F.col("node").alias("b")), "b", "left_semi")
    found = t.join(connected_components(inner), "node", "left").select("file", F.coalesce("component", "node").alias("component"))
    return found.groupBy("file").agg(F.count_distinct("component").alias("groups")).where("groups >= 2")


# ---------------------------------------------------------------- whole projects


def conflicting_roots(files: DataFrame) -> DataFrame:
    """path of every ``x.rs`` that has a sibling directory ``x``."""
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("stem")).distinct()
    return files.where(F.col("path").endswith(".rs")).withColumn("stem", F.regexp_replace("path", "\\.rs$", "")).join(dirs, "stem", "left_semi").select("path")


def flat_family(files: DataFrame, prefix: str, package: str) -> DataFrame:
    """path of modules named with the family's prefix that lie outside its package directory."""
    return files.where(S.file_name(F.col("path")).startswith(prefix) & ~F.col("path").contains(f"/{package}/")).select("path")


def type_footprint(impls: DataFrame, config: Config, defined: DataFrame | None = None) -> DataFrame:
    """crate, type, files and methods of types whose inherent impls are scattered or too large in all.

    ``impls``: crate, file, type, methods, gate (null if always built). The worst
    build is all ungated methods and the largest gate's. Types defined at more
    than one place of a crate are left out.
    """
    if defined is not None:
        many = defined.groupBy("crate", "type").agg(F.count("*").alias("n")).where("n > 1")
        impls = impls.join(many, ["crate", "type"], "left_anti")
    by_gate = impls.groupBy("crate", "type", "gate").agg(F.sum("methods").alias("m"))
    worst = by_gate.groupBy("crate", "type").agg((F.coalesce(F.sum(F.when(F.col("gate").isNull(), F.col("m"))), F.lit(0)) + F.coalesce(F.max(F.when(F.col("gate").isNotNull(), F.col("m"))), F.lit(0))).alias("methods"))
    spread = impls.groupBy("crate", "type").agg(F.count_distinct("file").alias("files"))
    joined = worst.join(spread, ["crate", "type"])
    return joined.where((F.col("files") > 1) | (F.col("methods") > config.max_methods)).select("crate", "type", "files", "methods", (F.col("files") > 1).alias("scattered"), (F.col("methods") > config.max_methods).alias("large"))


def supersede(per_file: DataFrame, whole: DataFrame) -> DataFrame:
    """Per-file method counts whose type the crate-wide count reports already are dropped."""
    return per_file.join(whole.where("large").select(F.col("type").alias("method_of")).distinct(), "method_of", "left_anti")


def feature_reaches(features: DataFrame, seeds: DataFrame, target: str) -> DataFrame:
    """package and feature of the seeds from which the target feature is activated, over (package, feature, needs) rows."""
    from factloom.operators.graph import closure

    key = lambda f: F.concat_ws("/", "package", f)
    steps = features.select(key("feature").alias("a"), key("needs").alias("b"))
    start = seeds.select(key("feature").alias("node"))
    hit = closure(steps, start).where(F.col("node").endswith(f"/{target}")).select("seed").distinct()
    return seeds.join(hit, key("feature") == F.col("seed"), "left_semi")


def override_for(files: DataFrame, overrides: list[tuple[str, dict]]) -> DataFrame:
    """files with ``override``: the longest glob that the path matches, else null."""
    found = S.first_match([(S.glob(F.col("path"), g), F.lit(g)) for g, _ in sorted(overrides, key=lambda o: -len(o[0]))])
    return files.withColumn("override", found.cast("string"))
