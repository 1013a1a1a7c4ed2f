"""The registered queries of the fact operators, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import flows, gate, graph, sets, style, supply, tools
from factloom.plans import vocab
from factloom.scratch import materialise
from factloom.sources import adapters as A
from factloom.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None, **adapters: str):
    """Register a query; ``{name}`` in its SQL stands for an adapter given by keyword."""
    for key, text in adapters.items():
        sql = sql.replace("{" + key + "}", f"({A.sql(text)})") if sql else sql

    def register(f: Query) -> Query:
        _REGISTERED[name] = (f, sql)
        return f

    return register


def queries() -> dict[str, Query]:
    from factloom.plans import planted, projects  # noqa: F401  they register their own

    return {name: f for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}


# ---------------------------------------------------------------- gate

_ANY = "coalesce(bool_or({}), false)"
_KEY = "capability = 'crypto' AND CASE WHEN origin IS NULL THEN NOT contains(evidence, '::') ELSE origin = 'string_literal' END"
_HAS = {c: _ANY.format(f"capability = '{c}'") for c in vocab.CAPABILITIES}
_HOOK = {c: _ANY.format(f"capability = '{c}' AND execution_context = 'build_hook'") for c in ("network", "process_exec", "file_write")}


def _pair(a: str, b: str) -> str:
    return _ANY.format(f"source_capability = '{a}' AND sink_capability = '{b}'")


_FINDING_RULES = {
    "build-script-network": _HOOK["network"],
    "build-script-exec": _HOOK["process_exec"],
    "build-script-download-exec": f"{_HOOK['network']} AND {_HOOK['process_exec']}",
    "build-script-file-write": _HOOK["file_write"],
    "proc-macro-network": f"{_HAS['proc_macro']} AND {_HAS['network']}",
    "proc-macro-exec": f"{_HAS['proc_macro']} AND {_HAS['process_exec']}",
    "proc-macro-file-write": f"{_HAS['proc_macro']} AND {_HAS['file_write']}",
    "env-access-network": f"{_HAS['env_access']} AND {_HAS['network']}",
    "key-material-network": f"{_HAS['network']} AND {_ANY.format(_KEY)}",
}
_FLOW_RULES = {"env-to-network": _pair("env_access", "network"), "file-to-network": _pair("file_read", "network"), "network-to-exec": _pair("network", "process_exec")} | {
    n: _ANY.format(f"kind = '{n}'") for n, _, _ in vocab.GATE_RULES if n in vocab.FLOW_KINDS
}


def _rule_sql(keys: str, rules: dict[str, str], table: str) -> str:
    known = {n: (i, s) for i, (n, s, _) in enumerate(vocab.GATE_RULES)}
    return " UNION ALL ".join(f"SELECT {keys}, {known[n][0]} AS rule_ord, '{n}' AS rule, '{known[n][1]}' AS severity FROM {table} GROUP BY {keys} HAVING {test}" for n, test in rules.items())


def _findings(spark, d):
    return A.frame(spark, d, A.FINDINGS)


def _flows(spark, d):
    return A.frame(spark, d, A.FLOWS)


@query("gate_verdicts", f"WITH f AS ({A.sql(A.FINDINGS)}), w AS ({A.sql(A.FLOWS)}) {_rule_sql('crate', _FINDING_RULES, 'f')} UNION ALL {_rule_sql('crate', _FLOW_RULES, 'w')}")
def gate_verdicts(spark, d):
    """All 24 capability and flow rules for every crate."""
    return gate.verdicts(_findings(spark, d), _flows(spark, d), ["crate"]).drop("rationale")


@query(
    "gate_verdicts_by_language",
    f"WITH f AS ({A.sql(A.FINDINGS)}), w AS (SELECT *, CAST(NULL AS VARCHAR) AS language FROM ({A.sql(A.FLOWS)})) {_rule_sql('crate, language', _FINDING_RULES, 'f')} UNION ALL {_rule_sql('crate, language', _FLOW_RULES, 'w')}",
)
def gate_verdicts_by_language(spark, d):
    return gate.verdicts_by_language(_findings(spark, d), _flows(spark, d), ["crate"]).drop("rationale")


@query("gate_exit_code", "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM {f} f WHERE capability = 'network' AND execution_context = 'build_hook'", f=A.FINDINGS)
def gate_exit_code(spark, d):
    return gate.exit_code(gate.verdicts(_findings(spark, d), None, ["crate"]))


@query("gate_overrides", f"WITH f AS ({A.sql(A.FINDINGS)}) " + _rule_sql("crate", {k: v for k, v in _FINDING_RULES.items() if k != "build-script-exec"}, "f").replace("'env-access-network' AS rule, 'info'", "'env-access-network' AS rule, 'deny'"))
def gate_overrides(spark, d):
    """One rule raised, one turned off."""
    return gate.verdicts(_findings(spark, d), None, ["crate"], {"env-access-network": "deny", "build-script-exec": False}).drop("rationale")


# ---------------------------------------------------------------- sets and tools

_ORDINAL = "CASE capability " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(vocab.CAPABILITIES)) + " END"


@query("capability_sets", f"SELECT DISTINCT crate, capability, {_ORDINAL} AS ordinal FROM {{f}} f", f=A.FINDINGS)
def capability_sets(spark, d):
    return sets.capability_set(_findings(spark, d), ["crate"])


_DIFF = ["crate", "capability", "file", "origin", "language", "execution_context", "reachable"]
_OLD, _NEW = (A.FINDINGS.replace("FROM {events}", f"FROM {{events}} WHERE ts {op} TIMESTAMP '2024-01-15 00:00:00'") for op in ("<", ">="))
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in _DIFF)


@query(
    "profile_diff",
    f"SELECT 'added' AS change, {', '.join(_DIFF)} FROM {{n}} a WHERE NOT EXISTS (SELECT 1 FROM {{o}} b WHERE {_SAME}) UNION ALL SELECT 'removed', {', '.join(_DIFF)} FROM {{o}} a WHERE NOT EXISTS (SELECT 1 FROM {{n}} b WHERE {_SAME})",
    n=_NEW,
    o=_OLD,
)
def profile_diff(spark, d):
    """Rows on one side only, repeats kept, between two spans of time."""
    return sets.diff(A.frame(spark, d, _OLD), A.frame(spark, d, _NEW), _DIFF)


@query("merged_symbols", "SELECT crate, file, min(ord) AS ord, CAST(sum(findings) AS BIGINT) AS findings FROM (SELECT crate, file, line, min(ord) AS ord, count(*) AS findings FROM {f} f GROUP BY crate, file, line) x GROUP BY crate, file", f=A.FINDINGS)
def merged_symbols(spark, d):
    each = _findings(spark, d).groupBy("crate", "file", "line").agg(F.min("ord").alias("ord"), F.count("*").alias("findings"))
    return sets.merge_symbols(each, ["crate", "file"])


_STATUS = "CASE WHEN reachable IS NULL THEN 'unavailable' WHEN reachable THEN 'complete' ELSE 'not_applicable' END"


@query("combined_status", "SELECT crate, file, CASE WHEN bool_or(reachable IS NULL) THEN 'unavailable' WHEN bool_or(reachable) THEN 'complete' ELSE 'not_applicable' END AS status FROM {f} f GROUP BY crate, file", f=A.FINDINGS)
def combined_status(spark, d):
    return sets.combine_status(_findings(spark, d).withColumn("status", F.expr(_STATUS)), ["crate", "file"])


_COLUMNS = "ord, crate, capability, file, line, evidence, origin, language, execution_context"


@query("query_capabilities", f"SELECT {_COLUMNS} FROM {{f}} f WHERE capability = 'network' AND execution_context = 'build_hook'", f=A.FINDINGS)
def query_capabilities(spark, d):
    return tools.query_capabilities(_findings(spark, d), capability="network", context="build_hook").select(*_COLUMNS.split(", "))


@query(
    "search_by_capability",
    f"SELECT {_COLUMNS} FROM {{f}} f WHERE language = 'python' AND crate IN (SELECT crate FROM {{f}} g WHERE language = 'python' AND capability IN ('network', 'proc_macro') GROUP BY crate HAVING count(DISTINCT capability) = 2)",
    f=A.FINDINGS,
)
def search_by_capability(spark, d):
    return tools.search_by_capability(_findings(spark, d), "network + proc_macro", "python").select(*_COLUMNS.split(", "))


@query(
    "audit_crates",
    f"WITH f AS ({A.sql(A.FINDINGS)}), v AS ({_rule_sql('crate', _FINDING_RULES, 'f')}), a AS (SELECT crate, count(DISTINCT file) AS files, count(*) AS findings, count(DISTINCT capability) AS capabilities FROM f GROUP BY crate), b AS (SELECT crate, count(*) FILTER (severity = 'deny') AS deny, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM v GROUP BY crate) SELECT a.*, coalesce(deny, 0) AS deny, coalesce(warn, 0) AS warn, coalesce(info, 0) AS info FROM a LEFT JOIN b USING (crate)",
)
def audit_crates(spark, d):
    f = _findings(spark, d)
    return tools.audit_crates(f, gate.verdicts(f, None, ["crate"]))


@query(
    "structural_duplicates",
    "SELECT skeleton, CAST(sum(n) AS BIGINT) AS members, count(*) FILTER (n >= 2) AS exact_groups, max(n) AS largest_exact FROM (SELECT skeleton, exact, count(*) AS n FROM {p} p WHERE fact_count >= 3 GROUP BY skeleton, exact) x GROUP BY skeleton HAVING sum(n) >= 2",
    p=A.FINGERPRINTS,
)
def structural_duplicates(spark, d):
    return tools.structural_duplicates(A.frame(spark, d, A.FINGERPRINTS))


# ---------------------------------------------------------------- files and text


@query(
    "file_classes",
    "SELECT CASE WHEN path LIKE '%/Makefile' THEN 'manifest' WHEN path LIKE '%.go' THEN 'source_and_manifest' WHEN path LIKE '%.txt' THEN 'unsupported' ELSE 'source' END AS class, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'java_script' WHEN path LIKE '%.ts' THEN 'type_script' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.sh' THEN 'bash' END AS language, count(*) AS files FROM {x} x GROUP BY ALL",
    x=A.FILES,
)
def file_classes(spark, d):
    return files.classified(A.frame(spark, d, A.FILES)).groupBy("class", "language").agg(F.count("*").alias("files"))


@query(
    "large_source_files",
    "SELECT * FROM (SELECT path AS file, len(source) - len(replace(source, chr(10), '')) + CASE WHEN source <> '' AND NOT ends_with(source, chr(10)) THEN 1 ELSE 0 END AS lines, CASE WHEN lines >= 50 THEN 'deny' WHEN lines >= 20 THEN 'warn' END AS severity FROM {x} x) WHERE severity IS NOT NULL",
    x=A.FILES,
)
def large_source_files(spark, d):
    return style.large_files(A.frame(spark, d, A.FILES), style.Config(file_warn=20, file_deny=50))


@query(
    "endpoint_literals",
    r"SELECT page_id, CASE WHEN strlen(url) > 40 THEN concat(substr(url, 1, 16), '…', right(url, 4)) ELSE url END AS evidence FROM pages WHERE strlen(url) >= 8 AND regexp_matches(url, '^(https?|wss?)://')",
)
def endpoint_literals(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.where(S.is_endpoint(F.col("url"))).select("page_id", S.evidence(F.col("url")).alias("evidence"))


@query(
    "source_hashes",
    "SELECT source, sha256(list_reduce(list(unhex(lpad(hex(octet_length(encode(p))), 16, '0')) || encode(p) || unhex(lpad(hex(octet_length(encode(text))), 16, '0')) || encode(text) ORDER BY p), lambda a, b: a || b)) AS source_hash FROM (SELECT source, CAST(doc_id AS VARCHAR) AS p, text FROM documents) x GROUP BY source",
)
def source_hashes(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("crate"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"))
    return files.source_hash(rows, ["crate"]).withColumnRenamed("crate", "source")


@query("violation_annotations", "SELECT concat('::warning file=', file, ',line=', line, ',col=', col + 1, ',title=max-depth::', depth, '%25 of%0Alimit') AS value FROM {s} s WHERE kind <> 'closure' AND depth > 3", s=A.STATEMENTS)
def violation_annotations(spark, d):
    rows = style.max_depth(A.frame(spark, d, A.STATEMENTS), style.Config())
    return sinks.annotations(rows.withColumns({"severity": F.lit("warn"), "message": F.concat("detail", F.lit("% of\nlimit"))}))


# ---------------------------------------------------------------- style

_V = "file, line, col + 1 AS col"


def _statements(spark, d):
    return A.frame(spark, d, A.STATEMENTS)


def _functions(spark, d):
    return A.frame(spark, d, A.FUNCTIONS)


@query("style_max_depth", f"SELECT 'max-depth' AS code, {_V}, CAST(depth AS VARCHAR) AS detail FROM {{s}} s WHERE kind <> 'closure' AND depth > 3", s=A.STATEMENTS)
def style_max_depth(spark, d):
    return style.max_depth(_statements(spark, d), style.Config())


@query(
    "style_branching",
    f"WITH s AS ({A.sql(A.STATEMENTS)}) "
    + " UNION ALL ".join(
        f"SELECT '{code}' AS code, {_V} FROM s WHERE {test}"
        for code, test in {
            "nested-if": "kind = 'if' AND parent_branch = 'if'", "if-in-match": "kind = 'if' AND parent_branch = 'match'", "else-chain": "kind = 'if' AND chain_len >= 3",
            "forbidden-else": "kind = 'if' AND flag", "nested-match": "kind = 'match' AND parent_branch = 'match'", "match-in-if": "kind = 'match' AND parent_branch = 'if'",
        }.items()
    ),
)
def style_branching(spark, d):
    return style.branching(_statements(spark, d).withColumnRenamed("flag", "has_else"), style.Config()).drop("detail")


@query("style_params", f"SELECT 'high-param-count' AS code, {_V}, CAST(params AS VARCHAR) AS detail FROM {{f}} f WHERE params > 5", f=A.FUNCTIONS)
def style_params(spark, d):
    return style.params(_functions(spark, d), style.Config())


@query("style_long_bodies", f"SELECT 'long-function-body' AS code, {_V}, CAST(body_lines AS VARCHAR) AS detail FROM {{f}} f WHERE body_lines > 120", f=A.FUNCTIONS)
def style_long_bodies(spark, d):
    return style.long_bodies(_functions(spark, d), style.Config())


@query(
    "style_method_counts",
    "SELECT 'high-method-count' AS code, file, (min(struct_pack(line := line, col := col))).line AS line, (min(struct_pack(line := line, col := col))).col + 1 AS col, concat(method_of, ':', count(*)) AS detail FROM {f} f WHERE NOT forwarder GROUP BY file, method_of HAVING count(*) > 10",
    f=A.FUNCTIONS,
)
def style_method_counts(spark, d):
    return style.method_counts(_functions(spark, d), style.Config(max_methods=10))


@query(
    "style_forbidden_calls",
    f"SELECT 'forbidden-call' AS code, {_V}, CASE WHEN callee = 'm1' THEN 'm1' ELSE 'm*2' END AS detail FROM {{s}} s WHERE callee = 'm1' OR (starts_with(callee, 'm') AND ends_with(callee, '2'))",
    s=A.STATEMENTS,
)
def style_forbidden_calls(spark, d):
    return style.forbidden(_statements(spark, d).withColumn("text", F.col("callee")), "forbidden-call", style.Config(forbidden={"forbidden-call": ["m1", "m*2"]}))


@query(
    "style_naming",
    "SELECT 'generic-naming' AS code, file, line, 1 AS col, concat(count(*) FILTER (var = 'v0'), '/', count(*)) AS detail FROM {s} s GROUP BY file, fn, line HAVING count(*) FILTER (var = 'v0') >= 2 AND count(*) FILTER (var = 'v0') / count(*) > 0.3",
    s=A.STATEMENTS,
)
def style_naming(spark, d):
    rows = _statements(spark, d).withColumns({"name": F.col("var"), "arithmetic": F.col("flag"), "col": F.lit(0)})
    return style.naming(rows, style.Config(generic_names=["v0"]))


@query(
    "type_footprint",
    "WITH f AS (SELECT concat('n', o_custkey % 25) AS crate, concat('src/', o_orderstatus, '.rs') AS file, concat('T', o_custkey % 50) AS type, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' END AS gate FROM orders), g AS (SELECT crate, type, gate, count(*) AS m FROM f GROUP BY ALL), w AS (SELECT crate, type, coalesce(sum(m) FILTER (gate IS NULL), 0) + coalesce(max(m) FILTER (gate IS NOT NULL), 0) AS methods FROM g GROUP BY ALL), s AS (SELECT crate, type, count(DISTINCT file) AS files FROM f GROUP BY ALL) SELECT crate, type, files, CAST(methods AS BIGINT) AS methods, files > 1 AS scattered, methods > 40 AS large FROM w JOIN s USING (crate, type) WHERE files > 1 OR methods > 40",
)
def type_footprint(spark, d):
    text = "SELECT concat('n', o_custkey % 25) AS crate, concat('src/', o_orderstatus, '.rs') AS file, concat('T', o_custkey % 50) AS type, CAST(1 AS BIGINT) AS methods, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' END AS gate FROM {orders}"
    return style.type_footprint(A.frame(spark, d, text), style.Config())


# ---------------------------------------------------------------- detectors

_KIND = "SELECT '{}' AS kind, file, fn, CAST(stmt AS INT) AS stmt, CAST({} AS INT) AS other_stmt FROM ({}) x"


def _flow(kind: str, other: str, rows: str) -> str:
    return _KIND.format(kind, other, rows)


@query("flow_dead_store", _flow("dead-store", "nx", "SELECT *, lead(access) OVER w AS na, lead(stmt) OVER w AS nx FROM {s} s WHERE access <> 'call' WINDOW w AS (PARTITION BY file, fn, var ORDER BY stmt, access)") + " WHERE access = 'write' AND na = 'write'", s=A.STATEMENTS)
def flow_dead_store(spark, d):
    return flows.dead_stores(_statements(spark, d))


@query("flow_repeated_call", _flow("repeated-call", "first", "SELECT *, min(stmt) OVER (PARTITION BY file, fn, callee, args) AS first, row_number() OVER (PARTITION BY file, fn, callee, args ORDER BY stmt) AS n FROM {s} s") + " WHERE n > 1", s=A.STATEMENTS)
def flow_repeated_call(spark, d):
    return flows.repeated_calls(_statements(spark, d))


@query(
    "flow_taint",
    "WITH s AS (SELECT * FROM {s} s) SELECT 'taint-flow' AS kind, k.file, k.fn, a.stmt AS from_stmt, k.stmt, 'env_access' AS source_capability, 'network' AS sink_capability FROM s a JOIN s k ON a.file = k.file AND a.fn = k.fn AND a.var = k.var WHERE a.access = 'write' AND k.access = 'call'",
    s=A.STATEMENTS,
)
def flow_taint(spark, d):
    s = _statements(spark, d)
    sources = s.where("access = 'write'").withColumn("capability", F.lit("env_access"))
    return flows.taint(sources, s.where("access = 'call'").withColumns({"names": F.array("var"), "capability": F.lit("network")}))


@query("flow_discarded_result", _flow("discarded-result", "NULL", "SELECT * FROM {s} s WHERE flag AND access = 'call'"), s=A.STATEMENTS)
def flow_discarded_result(spark, d):
    return flows.discarded_results(_statements(spark, d).withColumns({"is_expression": F.col("access") == "call", "returns_result": F.col("flag"), "is_assignment": F.lit(False)}))


@query("flow_partial_error_handling", _flow("partial-error-handling", "NULL", "SELECT file, fn, depth AS stmt FROM {s} s GROUP BY file, fn, depth HAVING bool_or(flag) AND bool_or(access = 'read')"), s=A.STATEMENTS)
def flow_partial_error_handling(spark, d):
    return flows.partial_error_handling(_statements(spark, d).withColumns({"stmt": F.col("depth"), "handled": F.col("flag"), "dropped": F.col("access") == "read"}))


@query("flow_swallowed_ok", _flow("swallowed-ok", "NULL", "SELECT * FROM {s} s WHERE callee = 'm0'"), s=A.STATEMENTS)
def flow_swallowed_ok(spark, d):
    return flows.swallowed_ok(_statements(spark, d).withColumns({"ends_in_ok": F.col("callee") == "m0", "is_expression": F.lit(True)}))


@query("flow_immutable_growable", _flow("immutable-growable", "NULL", "SELECT * FROM {s} a WHERE access = 'read' AND NOT EXISTS (SELECT 1 FROM {s} b WHERE a.file = b.file AND a.fn = b.fn AND a.var = b.var AND b.access = 'write')"), s=A.STATEMENTS)
def flow_immutable_growable(spark, d):
    s = _statements(spark, d)
    return flows.immutable_growable(s.withColumn("growable", F.col("access") == "read"), s.withColumn("use", F.when(F.col("access") == "write", "mutated")))


@query("flow_unnecessary_clone", _flow("unnecessary-clone", "NULL", "SELECT * FROM {s} a WHERE access = 'call' AND NOT EXISTS (SELECT 1 FROM {s} b WHERE a.file = b.file AND a.fn = b.fn AND a.var = b.var AND b.stmt > a.stmt)"), s=A.STATEMENTS)
def flow_unnecessary_clone(spark, d):
    s = _statements(spark, d)
    return flows.unnecessary_clones(s.where("access = 'call'"), s)


@query("flow_allocation_in_loop", _flow("allocation-in-loop", "NULL", "SELECT * FROM {s} a WHERE access = 'write' AND EXISTS (SELECT 1 FROM {s} b WHERE a.file = b.file AND a.fn = b.fn AND b.kind IN ('for', 'while', 'loop') AND a.stmt BETWEEN b.stmt AND b.stmt + 2)"), s=A.STATEMENTS)
def flow_allocation_in_loop(spark, d):
    s = _statements(spark, d)
    return flows.allocation_in_loops(s.where("access = 'write'"), s.where("kind in ('for', 'while', 'loop')").withColumns({"start": F.col("stmt"), "end": F.col("stmt") + 2}))


@query("flow_redundant_collect", _flow("redundant-collect", "NULL", "SELECT * FROM {s} a WHERE access = 'write' AND EXISTS (SELECT 1 FROM {s} b WHERE a.file = b.file AND a.fn = b.fn AND a.var = b.var AND b.callee = 'm1' AND b.stmt > a.stmt)"), s=A.STATEMENTS)
def flow_redundant_collect(spark, d):
    s = _statements(spark, d)
    return flows.redundant_collects(s.where("access = 'write'"), s.withColumn("callee", F.when(F.col("callee") == "m1", "iter")))


@query(
    "flow_lock_across_await",
    _flow("lock-across-await", "NULL", "SELECT s.* FROM {s} s JOIN {f} f USING (fn) JOIN (SELECT fn, max(CASE WHEN flag THEN 1073741824 ELSE stmt + 1 END) AS until FROM {s} g WHERE access = 'write' GROUP BY fn) u USING (fn) WHERE f.is_async AND s.access = 'call' AND s.stmt < until AND NOT EXISTS (SELECT 1 FROM {s} l WHERE l.fn = s.fn AND l.stmt = s.stmt AND l.access = 'write')"),
    s=A.STATEMENTS,
    f=A.FUNCTIONS,
)
def flow_lock_across_await(spark, d):
    s = _statements(spark, d)
    guards = s.where("access = 'write'").withColumns({"lock_stmt": F.col("stmt"), "drop_stmt": F.when(~F.col("flag"), F.col("stmt") + 1)})
    return flows.lock_across_await(_functions(spark, d), s.where("access = 'call'"), guards)


@query(
    "flow_inconsistent_lock_order",
    "WITH s AS (SELECT * FROM {s} s), p AS (SELECT DISTINCT x.fn, x.callee AS a, y.callee AS b FROM s x JOIN s y ON x.file = y.file AND x.fn = y.fn WHERE x.stmt < y.stmt AND x.callee <> y.callee) SELECT DISTINCT 'inconsistent-lock-order' AS kind, x.a AS first, x.b AS second FROM p x JOIN p y ON x.a = y.b AND x.b = y.a AND x.fn <> y.fn WHERE x.a < x.b",
    s=A.STATEMENTS,
)
def flow_inconsistent_lock_order(spark, d):
    return flows.inconsistent_lock_order(_statements(spark, d).withColumn("lock", F.col("callee")))


@query("flow_unobserved_spawn", _flow("unobserved-spawn", "NULL", "SELECT * FROM {s} s WHERE callee = 'm3' AND flag"), s=A.STATEMENTS)
def flow_unobserved_spawn(spark, d):
    return flows.unobserved_spawn(_statements(spark, d).withColumns({"is_spawn": F.col("callee") == "m3", "is_expression": F.col("flag")}))


# ---------------------------------------------------------------- graph


def _graph(spark, d):
    nodes, edges = A.frame(spark, d, A.NODES), A.frame(spark, d, A.EDGES)
    return nodes, graph.select_edges(graph.code_relations(edges), certainties=["resolved"])


_OWN = f"WITH n AS ({A.sql(A.NODES)}), e AS (SELECT * FROM ({A.sql(A.EDGES)}) x WHERE kind <> 'depends_on' AND certainty = 'resolved'), o AS (SELECT node, CASE WHEN category = 'container' THEN node ELSE parent END AS owner, category FROM n), h AS (SELECT e.*, a.owner AS so, b.owner AS d_o, a.category AS sc FROM e JOIN o a ON e.src = a.node JOIN o b ON e.dst = b.node)"


_CLOSED = "s AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT node AS seed, node FROM n UNION SELECT r.seed, s.dst FROM r JOIN s ON r.node = s.src), c AS (SELECT a.seed AS node, min(a.node) AS component, count(*) > 1 AS many FROM r a JOIN r b ON a.seed = b.node AND a.node = b.seed GROUP BY a.seed)"
_REACH = f"WITH RECURSIVE n AS ({A.sql(A.NATIONS)}), e AS ({A.sql(A.NATION_EDGES)}), {_CLOSED}"
# The whole graph's closure is quadratic, which SQL bears on a small scale only.
_WHOLE = f"WITH RECURSIVE n AS ({A.sql(A.NODES)}), e AS (SELECT * FROM ({A.sql(A.EDGES)}) x WHERE kind <> 'depends_on' AND certainty = 'resolved'), {_CLOSED}"

@query("graph_degree", f"{_OWN} SELECT node, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing, coalesce(i, 0) + coalesce(o, 0) AS total FROM n LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM e GROUP BY src) USING (node)")
def graph_degree(spark, d):
    return graph.degree(*_graph(spark, d))


@query("graph_partition", f"{_OWN} SELECT node, owner FROM o")
def graph_partition(spark, d):
    return graph.partition(A.frame(spark, d, A.NODES))


@query("graph_labels", f"WITH RECURSIVE n AS ({A.sql(A.NODES)}), t AS (SELECT node, label AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.node, concat(t.path, '::', n.label) FROM n JOIN t ON n.parent = t.node) SELECT node, path FROM t")
def graph_labels(spark, d):
    return graph.qualified_labels(A.frame(spark, d, A.NODES))


@query("graph_cohesion", f"{_OWN} SELECT owner, coalesce(internal, 0) AS internal, coalesce(boundary, 0) AS boundary, CASE WHEN internal + boundary > 0 THEN internal / (internal + boundary) END AS score FROM (SELECT DISTINCT owner FROM o) LEFT JOIN (SELECT so AS owner, count(*) FILTER (so = d_o) AS internal, count(*) FILTER (so <> d_o) AS boundary FROM h GROUP BY so) USING (owner)")
def graph_cohesion(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.cohesion(edges, graph.partition(nodes))


@query("graph_modularity", f"{_OWN}, a AS (SELECT so AS p, count(*) AS ko, count(*) FILTER (so = d_o) AS i FROM h GROUP BY so), b AS (SELECT d_o AS p, count(*) AS ki FROM h GROUP BY d_o) SELECT CAST(sum(coalesce(ko, 0)) AS BIGINT) AS edges, CAST(sum(coalesce(i, 0)) AS BIGINT) AS internal, round(sum(coalesce(i, 0)) / sum(coalesce(ko, 0)) - sum(coalesce(ko, 0) * coalesce(ki, 0)) / (sum(coalesce(ko, 0)) * sum(coalesce(ko, 0))), 12) AS modularity FROM a FULL JOIN b USING (p)")
def graph_modularity(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.modularity(edges, graph.partition(nodes)).withColumn("modularity", F.round("modularity", 12))


_MIS = f"{_OWN}, p AS (SELECT src, so, d_o, count(*) AS c FROM h WHERE sc <> 'container' GROUP BY ALL), t AS (SELECT src, CAST(sum(c) AS BIGINT) AS total FROM p GROUP BY src)"


@query("graph_misplacement", f"{_MIS} SELECT p.src AS symbol, d_o AS foreign_owner, c AS foreign, total FROM p JOIN t USING (src) WHERE so <> d_o")
def graph_misplacement(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.misplacement(nodes, edges, graph.partition(nodes))


@query(
    "gate_boundary",
    f"{_MIS}, f AS (SELECT p.src AS x, d_o AS y, c, total FROM p JOIN t USING (src) WHERE so <> d_o), k AS (SELECT so AS x, count(*) FILTER (so = d_o) AS internal, count(*) AS total FROM h GROUP BY so) SELECT concat('m', x, '/', y) AS fact_ord, 2 AS rule_ord, 'misplaced-symbol' AS rule, 'warn' AS severity FROM f WHERE c >= 3 AND c * 100 >= total * 20 UNION ALL SELECT concat('c', x), 3, 'low-module-cohesion', 'warn' FROM k WHERE total >= 4 AND internal * 100 < total * 50",
)
def gate_boundary(spark, d):
    nodes, edges = _graph(spark, d)
    facts, _ = _boundary_facts(edges, nodes, materialise(graph.partition(nodes), "owners"))
    return gate.boundary_verdicts(facts, foreign_percent=20).drop("rationale")


def _boundary_facts(edges, nodes, owners):
    """The facts of misplacement and cohesion, and their columns as nulls."""
    none = {c: F.lit(None).cast("bigint") for c in ("members", "partitions", "foreign", "total", "internal", "boundary")} | {"cyclic": F.lit(None).cast("boolean")}
    m = graph.misplacement(nodes, edges, owners)
    m = m.select(F.concat(F.lit("m"), "symbol", F.lit("/"), "foreign_owner").alias("fact_ord"), F.lit("misplacement").alias("kind"), "foreign", "total").withColumns({c: v for c, v in none.items() if c not in ("foreign", "total")})
    c = graph.cohesion(edges, owners).select(F.concat(F.lit("c"), "owner").alias("fact_ord"), F.lit("cohesion").alias("kind"), "internal", "boundary").withColumns({k: v for k, v in none.items() if k not in ("internal", "boundary")})
    return m.unionByName(c), none


_OWNERS = "o AS (SELECT node, CASE WHEN category = 'container' THEN node ELSE parent END AS owner, category FROM n), h AS (SELECT e.*, a.owner AS so, b.owner AS d_o, a.category AS sc FROM e JOIN o a ON e.src = a.node JOIN o b ON e.dst = b.node), p AS (SELECT src, so, d_o, count(*) AS c FROM h WHERE sc <> 'container' GROUP BY ALL), u AS (SELECT src, CAST(sum(c) AS BIGINT) AS total FROM p GROUP BY src)"
_COMPONENTS = "q AS (SELECT component, count(*) AS members, count(DISTINCT owner) AS partitions, bool_or(many OR node IN (SELECT src FROM e WHERE src = dst)) AS cyclic FROM c JOIN o USING (node) GROUP BY component)"


def _boundary_whole_sql() -> str:
    return f"{_WHOLE}, {_OWNERS}, {_COMPONENTS} SELECT concat('m', p.src, '/', d_o) AS fact_ord, 2 AS rule_ord, 'misplaced-symbol' AS rule, 'warn' AS severity FROM p JOIN u USING (src) WHERE so <> d_o AND c >= 3 AND c * 100 >= total * 20 UNION ALL SELECT concat('c', x), 3, 'low-module-cohesion', 'warn' FROM (SELECT so AS x, count(*) FILTER (so = d_o) AS internal, count(*) AS total FROM h GROUP BY so) k WHERE total >= 4 AND internal * 100 < total * 50 UNION ALL SELECT concat('s', component), 0, 'large-scc', 'warn' FROM q WHERE cyclic AND members > 8 UNION ALL SELECT concat('s', component), 1, 'boundary-crossing-scc', 'deny' FROM q WHERE cyclic AND partitions > 1"


@query("gate_boundary_whole", _boundary_whole_sql())
def gate_boundary_whole(spark, d):
    """As gate_boundary, with the facts of strong components: all four rules. Components are beyond the SQL of gate_boundary."""
    nodes, edges = _graph(spark, d)
    edges, owners = materialise(edges, "edges"), materialise(graph.partition(nodes), "owners")
    facts, none = _boundary_facts(edges, nodes, owners)
    s = graph.component_facts(materialise(graph.strong_components(nodes, edges), "components"), owners)
    s = s.select(F.concat(F.lit("s"), "component").alias("fact_ord"), F.lit("component").alias("kind"), "members", "partitions", "cyclic").withColumns({k: v for k, v in none.items() if k not in ("members", "partitions", "cyclic")})
    return gate.boundary_verdicts(facts.unionByName(s), foreign_percent=20).drop("rationale")


@query("graph_neighbors", f"{_OWN}, s AS (SELECT DISTINCT src AS a, dst AS b FROM e) SELECT a AS seed, b AS node, 1 AS distance FROM s JOIN n ON a = node WHERE category = 'type' AND a <> b")
def graph_neighbors(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.neighbors(edges, nodes.where("category = 'type'"), 1)


@query("graph_neighbors_two", f"{_OWN}, s AS (SELECT DISTINCT src AS a, dst AS b FROM e), f AS (SELECT node AS seed, b AS node FROM n JOIN s ON a = node WHERE category = 'type' AND b <> node) SELECT seed, node, min(distance) AS distance FROM (SELECT seed, node, 1 AS distance FROM f UNION ALL SELECT seed, b, 2 FROM f JOIN s ON f.node = s.a WHERE b <> seed) x GROUP BY seed, node")
def graph_neighbors_two(spark, d):
    """Types and what lies within two steps of each."""
    nodes, edges = _graph(spark, d)
    return graph.neighbors(edges, nodes.where("category = 'type'"), 2)


@query("graph_path", f"{_OWN}, a AS (SELECT min(src) AS s FROM e), t AS (SELECT min(dst) AS t FROM e WHERE src IN (SELECT dst FROM e JOIN a ON src = s) AND dst <> (SELECT s FROM a) AND dst NOT IN (SELECT dst FROM e JOIN a ON src = s)), x AS (SELECT min(e.id) AS id FROM e, a, t WHERE e.src = s AND EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = t)), y AS (SELECT min(f.id) AS id FROM e f, t WHERE f.dst = t AND f.src = (SELECT dst FROM e JOIN x USING (id))) SELECT 0 AS step, e.id, src, dst FROM e JOIN x USING (id) UNION SELECT 1, e.id, src, dst FROM e JOIN y USING (id), t WHERE dst = t AND src = (SELECT dst FROM e JOIN x USING (id))")
def graph_path(spark, d):
    """The path of least edge ids from the least source to the least node that is two steps from it."""
    _, edges = _graph(spark, d)
    edges = materialise(edges, "edges")
    source = edges.agg(F.min("src")).first()[0]
    start = spark.createDataFrame([(source,)], "node long")
    target = graph.neighbors(edges, start, 2).where("distance = 2").agg(F.min("node")).first()[0]
    return graph.shortest_path(edges, source, target)


@query("graph_subgraph", f"{_OWN}, a AS (SELECT min(src) AS s FROM e), k AS (SELECT s AS node FROM a UNION SELECT dst FROM e JOIN a ON src = s) SELECT id, src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def graph_subgraph(spark, d):
    """The edges among the least source and its neighbours."""
    _, edges = _graph(spark, d)
    edges = materialise(edges, "edges")
    return graph.subgraph(edges, edges.agg(F.min("src")).first()[0], 1)[1].select("id", "src", "dst")


@query("graph_crossings", f"{_WHOLE}, {_OWNERS} SELECT component, count(*) AS members, count(DISTINCT owner) AS partitions FROM c JOIN o USING (node) GROUP BY component HAVING count(DISTINCT owner) > 1")
def graph_crossings(spark, d):
    nodes, edges = _whole(spark, d)
    return graph.divergence(nodes, edges)["crossings"]


@query("graph_subjects", f"{_WHOLE}, {_OWNERS}, {_COMPONENTS} SELECT component, concat('scc::', g.label, '::', m.label, '::', l.label) AS subject, members FROM q JOIN n l ON l.node = component JOIN n m ON l.parent = m.node JOIN n g ON m.parent = g.node WHERE cyclic")
def graph_subjects(spark, d):
    """Cyclic components by the qualified label of their least member."""
    nodes, edges = _whole(spark, d)
    return graph.component_subjects(graph.strong_components(nodes, edges), graph.qualified_labels(nodes))


@query("graph_layout_edges", f"{_OWN} SELECT id, src, dst, kind, certainty, so <> d_o AS crosses FROM h")
def graph_layout_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.layout_edges(edges, graph.partition(nodes))


@query("graph_document", f"{_OWN} SELECT 0 AS part, CAST(0 AS BIGINT) AS id, concat('{{\"version\":1,\"nodes\":', (SELECT count(*) FROM n), ',\"edges\":', (SELECT count(*) FROM e), '}}') AS value UNION ALL SELECT 1, node, concat('{{\"id\":', node, CASE WHEN parent IS NULL THEN '' ELSE concat(',\"parent\":', parent) END, ',\"category\":\"', category, '\",\"label\":\"', label, '\"}}') FROM n UNION ALL SELECT 2, id, concat('{{\"id\":', id, ',\"source\":', src, ',\"target\":', dst, ',\"kind\":\"', kind, '\",\"certainty\":\"', certainty, '\"}}') FROM e")
def graph_document(spark, d):
    """The graph as rows of a JSON document."""
    return graph.to_json(*_graph(spark, d))


@query("graph_layout", f"{_OWN} SELECT n.node, n.parent, o.owner, coalesce(i, 0) AS incoming, coalesce(u, 0) AS outgoing FROM n JOIN o USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY dst) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS u FROM e GROUP BY src) USING (node)")
def graph_layout(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.layout(nodes, edges, graph.partition(nodes))


def _nations(spark, d):
    return materialise(A.frame(spark, d, A.NATIONS), "nations"), materialise(A.frame(spark, d, A.NATION_EDGES), "nation-edges")


_STRONG = "SELECT node, component, many OR node IN (SELECT src FROM e WHERE src = dst) AS cyclic FROM c"
_CONDENSED = "SELECT a.component AS source, b.component AS target, count(*) AS edges, min(id) AS first_edge FROM e JOIN c a ON e.src = a.node JOIN c b ON e.dst = b.node WHERE a.component <> b.component GROUP BY ALL"
# Components are placed one by one: always the least whose predecessors are all placed.
_ORDERED = ", l AS (SELECT DISTINCT a.component AS source, b.component AS target FROM e JOIN c a ON e.src = a.node JOIN c b ON e.dst = b.node WHERE a.component <> b.component), k AS (SELECT component, list(source) FILTER (source IS NOT NULL) AS needs FROM (SELECT DISTINCT component FROM c) x LEFT JOIN l ON component = target GROUP BY component), t AS (SELECT CAST([] AS BIGINT[]) AS placed, 0 AS done UNION ALL SELECT list_append(placed, (SELECT min(component) FROM k WHERE NOT list_contains(placed, component) AND (needs IS NULL OR list_has_all(placed, needs)))), done + 1 FROM t WHERE done < (SELECT count(*) FROM k)), f AS (SELECT placed FROM t ORDER BY done DESC LIMIT 1) SELECT unnest(placed) AS component, CAST(generate_subscripts(placed, 1) - 1 AS INT) AS place FROM f"
# Walks as long as the distance are shortest routes; those through a node are those to it times those from it.
_BETWEEN = ", g AS (SELECT node AS seed, node, 0 AS d FROM n UNION SELECT g.seed, e.dst, d + 1 FROM g JOIN e ON g.node = e.src WHERE d < 25), m AS (SELECT seed, node, min(d) AS d FROM g GROUP BY ALL), w AS (SELECT node AS seed, node, 0 AS d FROM n UNION ALL SELECT w.seed, e.dst, w.d + 1 FROM w JOIN e ON w.node = e.src JOIN m ON m.seed = w.seed AND m.node = e.dst AND m.d = w.d + 1 WHERE e.src <> e.dst), z AS (SELECT seed, node, d, CAST(count(*) AS DOUBLE) AS routes FROM w GROUP BY ALL), b AS (SELECT a.node AS node, sum(a.routes * o.routes / x.routes) AS raw FROM z a JOIN z o ON a.node = o.seed JOIN z x ON x.seed = a.seed AND x.node = o.node AND x.d = a.d + o.d WHERE a.node <> a.seed AND a.node <> o.node AND a.seed <> o.node GROUP BY a.node) SELECT node, round(coalesce(raw, 0), 9) AS raw, round(coalesce(raw, 0) / ((count(*) OVER () - 1) * (count(*) OVER () - 2)), 12) AS score FROM n LEFT JOIN b USING (node)"


@query("graph_closure", f"{_REACH} SELECT seed, node FROM r")
def graph_closure(spark, d):
    nodes, edges = _nations(spark, d)
    return graph.closure(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), nodes)


@query("graph_strong_components", f"{_REACH} {_STRONG}")
def graph_strong_components(spark, d):
    return graph.strong_components(*_nations(spark, d))


@query("graph_condensation", f"{_REACH} {_CONDENSED}")
def graph_condensation(spark, d):
    nodes, edges = _nations(spark, d)
    return graph.condensation(edges, graph.strong_components(nodes, edges))


@query("graph_topological_order", f"{_REACH}{_ORDERED}")
def graph_topological_order(spark, d):
    nodes, edges = _nations(spark, d)
    found = materialise(graph.strong_components(nodes, edges), "components")
    return graph.topological_order(graph.condensation(edges, found), found)


@query("graph_betweenness", f"{_REACH}{_BETWEEN}")
def graph_betweenness(spark, d):
    return graph.betweenness(*_nations(spark, d)).withColumns({"raw": F.round("raw", 9), "score": F.round("score", 12)})


@query("graph_connected_components", f"WITH RECURSIVE e AS ({A.sql(A.NATION_EDGES)}), s AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), r AS (SELECT DISTINCT a AS seed, a AS node FROM s UNION SELECT r.seed, s.b FROM r JOIN s ON r.node = s.a) SELECT seed AS node, min(node) AS component FROM r GROUP BY seed")
def graph_connected_components(spark, d):
    _, edges = _nations(spark, d)
    return graph.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


# The same over the whole graph.


def _whole(spark, d):
    nodes, edges = _graph(spark, d)
    return materialise(nodes, "nodes"), materialise(edges, "edges")


@query("graph_strong_components_whole", f"{_WHOLE} {_STRONG}")
def graph_strong_components_whole(spark, d):
    return graph.strong_components(*_whole(spark, d))


@query("graph_condensation_whole", f"{_WHOLE} {_CONDENSED}")
def graph_condensation_whole(spark, d):
    nodes, edges = _whole(spark, d)
    return graph.condensation(edges, materialise(graph.strong_components(nodes, edges), "components"))


@query("graph_topological_order_whole", f"{_WHOLE}{_ORDERED}")
def graph_topological_order_whole(spark, d):
    nodes, edges = _whole(spark, d)
    found = materialise(graph.strong_components(nodes, edges), "components")
    return graph.topological_order(graph.condensation(edges, found), found)


@query("graph_connected_components_whole", f"WITH RECURSIVE e AS (SELECT * FROM ({A.sql(A.EDGES)}) x WHERE kind <> 'depends_on' AND certainty = 'resolved'), s AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), r AS (SELECT DISTINCT a AS seed, a AS node FROM s UNION SELECT r.seed, s.b FROM r JOIN s ON r.node = s.a) SELECT seed AS node, min(node) AS component FROM r GROUP BY seed")
def graph_connected_components_whole(spark, d):
    _, edges = _whole(spark, d)
    return graph.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


# ---------------------------------------------------------------- supply chain

_ATT = f"WITH p AS ({A.sql(A.ATTESTATIONS)}), t AS (SELECT name, version, CAST(split_part(version, '.', 2) AS INT) * 100 + CAST(split_part(version, '.', 3) AS INT) AS v, md5(string_agg(concat_ws('|', ord, capability, evidence), ';' ORDER BY concat_ws('|', ord, capability, evidence))) AS source_hash, list_sort(list(DISTINCT capability)) AS capabilities, CAST(sum(skipped) AS BIGINT) AS skipped FROM p GROUP BY name, version), b AS (SELECT * FROM t WHERE v < 300)"


def _attested(spark, d):
    rows = materialise(supply.attest(A.frame(spark, d, A.ATTESTATIONS), ["name", "version"]), "attestations")
    minor = F.split("version", "\\.")[1].cast("int")
    return rows, rows.where(minor < 3)


@query("supply_attestations", f"{_ATT} SELECT name, version, source_hash, array_to_string(capabilities, ',') AS capabilities, skipped FROM t")
def supply_attestations(spark, d):
    return _attested(spark, d)[0].withColumn("capabilities", F.concat_ws(",", "capabilities"))


_CMP = f"{_ATT}, c AS (SELECT t.*, arg_max(b.version, b.v) AS pv, arg_max(b.capabilities, b.v) AS pc, arg_max(b.skipped, b.v) AS ps FROM t LEFT JOIN b ON t.name = b.name AND b.v < t.v WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.name = t.name AND x.version = t.version) GROUP BY ALL), r AS (SELECT name, version, 'new-dependency' AS level, array_to_string(capabilities, ',') AS detail FROM c WHERE pv IS NULL UNION ALL SELECT name, version, 'analysis-incomplete', pv FROM c WHERE pv IS NOT NULL AND NOT (skipped = 0 AND ps = 0) UNION ALL SELECT name, version, 'new-capability', unnest(list_filter(capabilities, lambda x: NOT list_contains(pc, x))) FROM c WHERE pv IS NOT NULL AND skipped = 0 AND ps = 0)"


@query("supply_comparison", f"{_CMP} SELECT * FROM r")
def supply_comparison(spark, d):
    return supply.compare(*_attested(spark, d))


@query("supply_status", f"{_CMP} SELECT coalesce(arg_max(level, CASE level WHEN 'new-capability' THEN 2 WHEN 'new-dependency' THEN 1 ELSE 0 END), 'clean') AS status FROM r")
def supply_status(spark, d):
    return supply.overall(supply.compare(*_attested(spark, d)))


@query("supply_stale", f"{_ATT} SELECT name, version FROM t WHERE v >= 300")
def supply_stale(spark, d):
    every, kept = _attested(spark, d)
    return supply.stale(every, kept).select("name", "version")


# ---------------------------------------------------------------- catalogs


@query("check_catalog", "SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}', '{}', {})".format(i, *(str(x).replace("'", "''") for x in row)) for i, row in enumerate(vocab.CHECKS)) + ") t(ord, code, description, category, generated)")
def check_catalog(spark, d):
    return tools.checks(spark)
