"""The fact operators on small fixtures: what SQL cannot say, and the traps of their semantics."""

import itertools
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import capability, flows, gate, graph, literals, resolve, scan, sets, style, supply, tools
from factloom.sources import files, sinks
from factloom.streaming import changes


def values(spark, column, rows, schema="x string"):
    frame = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in frame.select(column).collect()]


# ---------------------------------------------------------------- scalar


def test_wildcards_overlap_once_and_take_first_places(spark):
    cases = [("abc", "abc", True), ("aba", "ab*ba", True), ("abcb", "*a*b", False), ("ab", "*a*b", True), ("xaybz", "x*y*z", True), ("a.clone()", "*.clone()", True), ("ab", "b*", False), ("", "*", True), ("aXbXc", "a*b*c", True), ("aXbXcc", "a*b*c", False)]
    for text, pattern, want in cases:
        assert values(spark, S.wildcard(F.col("x"), pattern), [text]) == [want], (text, pattern)


def test_globs(spark):
    for path, pattern, want in [("src/a/b.rs", "src/**/b.rs", True), ("x/src/b.rs", "src/**/b.rs", True), ("src/a/c.rs", "src/*.rs", False), ("/abs/tests/x.rs", "tests/*.rs", True), ("tests2/x.rs", "tests/*.rs", False)]:
        assert values(spark, S.glob(F.col("x"), pattern), [path]) == [want], (path, pattern)


def test_endpoints_are_judged_loosely(spark):
    cases = {"http://a": True, "wss://xyz": True, "http:/a.bc": False, "1.2.3.4:80": True, "1.2.3.4": False, "256.2.3.4:80": False, "1.2.3.4:99999": False, "12:30:45": True, "1:2:3": False, "fe80::1:2": True, "[fe80::1]:80": True, "a::b::c:d": False, "nothing here": False}
    assert dict(zip(cases, values(spark, S.is_endpoint(F.col("x")), list(cases)), strict=True)) == cases


def test_key_material(spark):
    cases = {"a" * 64: True, "a" * 63: False, "A1" * 48: True, "ab" * 40: True, "zz" * 30: False, "5" + "K" * 50: True, "AKIA" + "A1" * 8: True, "AKIA" + "a1" * 8: False, "sk_live_" + "a" * 24: True, "sk-" + "a" * 23: False, "ghp_" + "a" * 36: True, "ghp_" + "a" * 35: False, "0x" + "f" * 64: True, "ed25519:x": True, "AGE-SECRET-KEY-1": False}
    assert dict(zip(cases, values(spark, S.is_key_material(F.col("x")), list(cases)), strict=True)) == cases
    assert values(spark, S.evidence(F.col("x")), ["é" * 21, "short"]) == ["é" * 16 + "…" + "é" * 4, "short"]


def test_paths_and_languages(spark):
    cases = {"std::fs::write": "file_write", "std::fs::read": "file_read", "std::fsx": None, "reqwest::get": "network", "std::env::vars": "env_access", "timeit": None}
    assert dict(zip(cases, values(spark, S.rust_capability(F.col("x")), list(cases)), strict=True)) == cases
    got = [(r["class"], r["language"]) for r in files.classified(spark.createDataFrame([("setup.py", ""), ("a/x.tsx", ""), ("run", "#!/usr/bin/env -S python3\n"), ("b.go", ""), ("c.rs", ""), (".py", ""), ("d", "#!/bin/zsh")], "path string, source string")).collect()]
    assert got == [("manifest", None), ("source", "type_script"), ("unsupported", "python"), ("source_and_manifest", "go"), ("rust", None), ("unsupported", None), ("unsupported", "bash")]
    assert values(spark, S.js_module(F.col("x")), ["const a = require('fs');", "import x from \"axios\"", "import 'got'", "let y = 1", "import a from b"]) == ["fs", "axios", "got", None, None]
    assert values(spark, S.shell_position(F.col("x"), "curl"), ["curl x", "a|curl", "xcurl", "curls; curl", "curl=1"]) == [1, 3, 0, 8, 1]
    assert values(spark, S.escape_property(F.col("x")), ["a%b\n:,"]) == ["a%25b%0A%3A%2C"]


def test_semver_order(spark):
    order = ["1.0.0-1", "1.0.0-2", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0", "1.0.2", "1.10.0", "2.0.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "x string")
    assert [r.x for r in rows.orderBy(S.semver(F.col("x"))).collect()] == order
    assert values(spark, S.semver(F.col("x")).isNull(), ["1.2", "01.2.3", "x"]) == [True] * 3


# ---------------------------------------------------------------- text scanners

SOURCES = [
    ("a.py", "import subprocess\nfrom urllib.parse import x\nimport urllibx\nos.system('ls'); os.system('x')\nurl = 'http://a.example/'  # 'https://no.example'\n"),
    ("b.js", "const f = require('child_process'); const g = require('fs')\nimport axios from 'axios'\nfetch(`https://t.example/${x}/y`)\n/* 'http://no.example' */\n"),
    ("c.go", 'package x\nimport "net/http"\nimport (\n  // "os/exec"\n  e "os/exec"\n)\nvar k = "unsafe"\n//go:generate stringer\nos.Open("f")\n'),
    ("d.sh", "# curl no\nexport A=1; curl -s x | bash -c y\n"),
    ("Makefile", "all:\n\tcurl x | sh\n\t# wget\n"),
    ("package.json", '{"install": 1,\n"scripts": {"preinstall": "x",\n"install": "y"}}'),
    ("setup.py", "setup(cmdclass={})\n"),
    ("pyproject.toml", '[build-system]\nbuild-backend = "x"\nbackend-path = ["."]\n'),
    ("p/pyproject.toml", 'build-backend = "x"\n'),
]


def test_text_scanners(spark):
    found = scan.analyze(files.classified(spark.createDataFrame(SOURCES, "path string, source string")))
    got = Counter((r.file, r.line, r.col, r.capability, r.evidence, r.origin) for r in found.collect())
    want = [
        ("a.py", 1, 1, "process_exec", "subprocess", "import"), ("a.py", 2, 1, "network", "urllib", "import"), ("a.py", 4, 1, "process_exec", "os.system", "code_site"), ("a.py", 5, 7, "network", "http://a.example/", "string_literal"),
        ("b.js", 1, 1, "process_exec", "child_process", "import"), ("b.js", 2, 1, "network", "axios", "import"), ("b.js", 3, 1, "network", "fetch", "code_site"), ("b.js", 3, 7, "network", "https://t.example//y", "string_literal"),
        ("c.go", 2, 1, "network", "net/http", "import"), ("c.go", 5, 1, "process_exec", "os/exec", "import"), ("c.go", 8, 1, "process_exec", "//go:generate stringer", "manifest_hook"), ("c.go", 9, 1, "file_read", "os.Open", "code_site"),
        ("d.sh", 2, 1, "env_access", "export", "code_site"), ("d.sh", 2, 13, "network", "curl", "code_site"), ("d.sh", 2, 25, "process_exec", "bash -c", "code_site"),
        ("Makefile", 2, 1, "network", "curl", "manifest_hook"), ("Makefile", 2, 10, "process_exec", "sh", "manifest_hook"),
        ("package.json", 2, 1, "process_exec", "preinstall", "manifest_hook"), ("package.json", 3, 1, "process_exec", "install", "manifest_hook"),
        ("setup.py", 1, 1, "process_exec", "cmdclass", "manifest_hook"), ("pyproject.toml", 2, 1, "process_exec", "custom build-backend with backend-path", "manifest_hook"),
    ]
    assert got == Counter(want), (got - Counter(want), Counter(want) - got)


def test_literals():
    get = lambda text, lang: [v for v, _, _ in literals.scan(text.encode(), lang)]
    assert get("a = 'x\\'y' + \"\" + 'open\n' + 'é'", "python") == ["xy", " + "]  # the unclosed one ends at the newline
    assert get("echo a#b 'c' # 'd'", "bash") == ["c"]
    assert get("x := `raw\\n` + \"q\\\"r\" + 'c'", "go") == ["raw\\n", "qr"]
    assert list(literals.scan(b"\n  'ab'", "python")) == [("ab", 2, 3)]


def test_rust_detectors(spark):
    fact = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    place = "file string, line int, col0 int, fn int"
    found = capability.detect(
        fact(f"path string, {place}", ("std::net::TcpStream", "a.rs", 1, 4, None), ("serde", "a.rs", 2, 0, None)), fact(f"text string, {place}", ("unsafe", "a.rs", 3, 0, 1)), fact(f"text string, {place}", ("extern", "a.rs", 4, 0, None)),
        fact(f"name string, {place}", ("link", "a.rs", 5, 0, None), ("test", "a.rs", 6, 0, None)), fact(f"value string, {place}", ("http://" + "a" * 57, "a.rs", 7, 8, 1), ("1" * 64, "a.rs", 8, 0, 1)),
    )
    got = sorted((r.detector, r.capability, r.line, r.col) for r in found.collect())
    assert got == [(0, "network", 1, 5), (1, "unsafe_code", 3, 1), (2, "ffi", 4, 1), (3, "ffi", 5, 1), (4, "crypto", 8, 1), (4, "network", 7, 9)]
    profiles = capability.symbol_profiles(found, spark.createDataFrame([("a.rs", 1, "f")], "file string, fn int, name string")).collect()
    assert len(profiles) == 1 and [x.line for x in profiles[0].findings] == [3, 7, 8]
    marked = capability.annotate_reachable(spark.createDataFrame([("a", 1), ("a", 7), ("a", 30)], "file string, line int"), spark.createDataFrame([("a", "f", 5), ("a", "g", 20)], "file string, name string, line int"), spark.createDataFrame([("a", "g")], "file string, name string"))
    assert {r.line: r.reachable for r in marked.collect()} == {1: None, 7: False, 30: True}
    unit = capability.enclosing_units(spark.createDataFrame([("a", 5), ("a", 50)], "file string, at int"), spark.createDataFrame([("a", 0, "function", "f", 0, 9), ("a", 1, "impl", "g", 4, 6), ("a", 2, "impl", "h", 4, 6)], "file string, ord int, kind string, name string, start int, end int"))
    assert {r.at: r.name for r in unit.collect()} == {5: "g", 50: None}


# ---------------------------------------------------------------- gate, sets, tools

FINDING = "crate string, capability string, file string, line int, col int, evidence string, origin string, language string, execution_context string, reachable boolean"
FLOW = "crate string, kind string, source_capability string, sink_capability string"


def finding(capability, origin=None, evidence="x", language=None, context=None, crate="c", line=1):
    return (crate, capability, "f", line, 1, evidence, origin, language, context, None)


def test_key_material_and_flows_are_judged_where_they_belong(spark):
    rows = lambda *r: spark.createDataFrame(list(r), FINDING)
    rules = lambda f, w=None: sorted(r.rule for r in gate.verdicts(f, w, ["crate"]).collect())
    assert rules(rows(finding("network"), finding("crypto", "string_literal"))) == ["key-material-network"]
    assert rules(rows(finding("network"), finding("crypto", None, "ring::x"))) == []
    assert rules(rows(finding("network"), finding("crypto", "import"))) == []
    flow = spark.createDataFrame([("c", "taint-flow", "env_access", "network"), ("d", "dead-store", None, None)], FLOW)
    assert rules(rows(finding("ffi")), flow) == ["dead-store", "env-to-network"]
    by = gate.verdicts_by_language(rows(finding("network", language="go", context="build_hook"), finding("process_exec", context="build_hook")), flow, ["crate"])
    got = sorted((r.crate, r.language or "", r.rule) for r in by.collect())
    assert got == [("c", "", "build-script-exec"), ("c", "", "env-to-network"), ("c", "go", "build-script-network"), ("d", "", "dead-store")]
    assert gate.exit_code(by).first()[0] == 1 and gate.exit_code(by.limit(0)).first()[0] == 0 and gate.exit_code(by, True).first()[0] == 2


def test_diff_keeps_repeats_and_equates_nulls(spark):
    a, b = finding("network"), finding("crypto")
    frame = lambda *r: spark.createDataFrame(list(r), FINDING)
    got = Counter(r.change + r.capability for r in sets.diff(frame(a), frame(a, b, b)).collect())
    assert got == {"addedcrypto": 2}
    assert sets.is_empty_diff(sets.diff(frame(a, a), frame(a))).first()[0]
    assert [tuple(r) for r in sets.capability_changes(frame(a), frame(b)).orderBy("change").collect()] == [("dropped", "network"), ("new", "crypto")]


def test_tools(spark):
    rows = spark.createDataFrame([finding("network", language="go"), finding("crypto", language="go"), finding("ffi", language="go"), finding("network", crate="d", language="go"), finding("crypto", crate="d")], FINDING)
    assert {r.capability for r in tools.search_by_capability(rows, "network + crypto", "go").collect()} == {"network", "crypto", "ffi"}
    with pytest.raises(ValueError):
        tools.search_by_capability(rows, "network", "rust")
    with pytest.raises(ValueError):
        tools.parse_capability_pattern("network+magic")
    with pytest.raises(ValueError):
        tools.query_gate_verdicts(rows, "src/a.rs")
    assert tools.dispatch("query_capabilities", rows, capability="crypto").count() == 2
    assert tools.explain_finding(spark, "max-depth").first().category == "nesting"


def test_boundary_rules_compare_whole_numbers(spark):
    facts = spark.createDataFrame([(0, "component", True, 9, 1, None, None, None, None), (1, "component", False, 99, 2, None, None, None, None), (2, "misplacement", None, None, None, 3, 5, None, None), (3, "cohesion", None, None, None, None, None, 2, 2), (4, "cohesion", None, None, None, None, None, 1, 3)], "fact_ord int, kind string, cyclic boolean, members int, partitions int, foreign int, total int, internal int, boundary int")
    assert sorted((r.fact_ord, r.rule) for r in gate.boundary_verdicts(facts).collect()) == [(0, "large-scc"), (2, "misplaced-symbol"), (4, "low-module-cohesion")]


# ---------------------------------------------------------------- style


def test_style_fixtures(spark):
    place = "file string, line int, col int"
    c = style.Config(forbidden={"forbidden-macro": ["panic", "print*"]}, generic_names=["tmp"])
    text = spark.createDataFrame([("a", 1, 0, "println"), ("a", 2, 0, "vec")], f"{place}, text string")
    assert [(r.line, r.detail) for r in style.forbidden(text, "forbidden-macro", c).collect()] == [(1, "print*")]
    refs = spark.createDataFrame([("a", 1, 0, "x", True, True, False, "return"), ("a", 2, 0, "x", False, True, True, "local")], f"{place}, text string, involves_dyn boolean, is_vec_box_dyn boolean, is_default_hasher boolean, context string")
    assert sorted((r.line, r.code) for r in style.dispatch(refs).collect()) == [(1, "dyn-return"), (2, "default-hasher"), (2, "vec-box-dyn")]
    calls = spark.createDataFrame([("a", 1, 0, 1, "clone", "x", 1), ("a", 2, 0, 1, "clone", "y", 1), ("a", 3, 0, 1, "clone", "y", 0)], f"{place}, fn int, callee string, receiver string, loop_depth int")
    bound = spark.createDataFrame([("a", 1, "x", True)], "file string, fn int, name string, is_refcounted boolean")
    assert [r.line for r in style.clone_in_loop(calls, bound).collect()] == [2]
    names = spark.createDataFrame([("a", 1, 0, 1, n, d, ar) for n, d, ar in [("i", 0, False), ("x", 0, True), ("tmp", 0, False), ("_", 0, False), ("total", 0, False), ("i", 1, False)]], f"{place}, fn int, name string, loop_depth int, arithmetic boolean")
    assert [r.detail for r in style.naming(names, c).collect()] == ["2/5"]
    items = spark.createDataFrame([("src/a.rs", "f", "fn", "pub"), ("src/a.rs", "g", "fn", "private"), ("src/a.rs", "h", "fn", "pub"), ("src/a.rs", "h", "fn", "pub")], "file string, name string, kind string, visibility string")
    rules = spark.createDataFrame([("a.rs", n, "fn", "pub") for n in "fghk"], "path string, name string, kind string, visibility string")
    assert sorted((r.name, r.problem) for r in style.visibility(rules, items).collect()) == [("g", "wrong-visibility"), ("h", "duplicate"), ("k", "missing")]
    types = spark.createDataFrame([("a", n) for n in "ABCD"] + [("b", "A"), ("b", "B")], "file string, name string")
    links = spark.createDataFrame([("a", "A", "B"), ("a", "C", "D"), ("b", "A", "B"), ("a", "A", "Z")], "file string, src string, dst string")
    assert [(r.file, r.groups) for r in style.mixed_concerns(types, links).collect()] == [("a", 2)]
    tree = spark.createDataFrame([("src/x.rs",), ("src/x/y.rs",), ("src/z.rs",)], "path string")
    assert [r.path for r in style.conflicting_roots(tree).collect()] == ["src/x.rs"]
    impls = spark.createDataFrame([("c", "a", "T", 30, None), ("c", "b", "T", 5, "f"), ("c", "b", "T", 7, "g"), ("c", "a", "U", 3, None), ("c", "a", "W", 1, None), ("c", "b", "W", 1, None)], "crate string, file string, type string, methods int, gate string")
    defined = spark.createDataFrame([("c", "W"), ("c", "W"), ("c", "T")], "crate string, type string")
    assert [(r.type, r.files, r.methods) for r in style.type_footprint(impls, c, defined).collect()] == [("T", 2, 37)]
    features = spark.createDataFrame([("p", "default", "a"), ("p", "a", "dev"), ("p", "b", "a"), ("p", "dev", "b")], "package string, feature string, needs string")
    assert [r.feature for r in style.feature_reaches(features, spark.createDataFrame([("p", "default"), ("q", "default")], "package string, feature string"), "dev").collect()] == ["default"]
    assert {r.path: r.override for r in style.override_for(spark.createDataFrame([("src/a/b.rs",), ("x.rs",)], "path string"), [("src/**", {}), ("src/a/*.rs", {})]).collect()} == {"src/a/b.rs": "src/a/*.rs", "x.rs": None}


def test_detector_fixtures(spark):
    key = "file string, fn int, stmt int"
    loops = flows.lock_across_await(spark.createDataFrame([("a", 1, True), ("a", 2, False)], "file string, fn int, is_async boolean"), spark.createDataFrame([("a", 1, 0), ("a", 1, 2), ("a", 1, 5), ("a", 1, 9), ("a", 2, 3)], key), spark.createDataFrame([("a", 1, 2, 7)], "file string, fn int, lock_stmt int, drop_stmt int"))
    assert sorted(r.stmt for r in loops.collect()) == [0, 5]  # also ahead of the lock; the lock itself and what follows the drop are not
    locks = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 2, 1, "y"), ("b", 2, 2, "x"), ("c", 3, 1, "p"), ("c", 3, 2, "q"), ("c", 3, 3, "p")], f"{key}, lock string")
    assert [(r.first, r.second) for r in flows.inconsistent_lock_order(locks).collect()] == [("x", "y")]
    functions = spark.createDataFrame([("a", "main", False, False), ("a", "f", False, False), ("a", "g", False, False), ("a", "h", True, False)], "file string, name string, is_public boolean, is_test boolean")
    calls = spark.createDataFrame([("a", "main", "f"), ("a", "g", "g")], "file string, caller string, callee string")
    assert sorted(r.name for r in flows.reachable_functions(functions, calls).collect()) == ["f", "h", "main"]


# ---------------------------------------------------------------- graph


def plain_components(n, arcs):
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a, b in arcs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    return {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}, reach


def plain_betweenness(n, arcs):
    """Shares of all shortest routes, each enumerated."""
    raw = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        routes, found = [[s]], {}
        for _ in range(n):
            ends = {}
            for r in routes:
                for a, b in arcs:
                    if a == r[-1] and b not in found and b != s:
                        ends.setdefault(b, []).append([*r, b])
            found |= ends
            routes = [r for v in ends.values() for r in v]
        for rs in found.values():
            for r in rs:
                for v in r[1:-1]:
                    raw[v] += 1 / len(rs)
    return raw


ARCS = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 4), (4, 5), (5, 4), (6, 6), (1, 3), (0, 3)]


def frames(spark, n, arcs):
    return spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame([(i, a, b, "call", "resolved") for i, (a, b) in enumerate(arcs)], "id long, src long, dst long, kind string, certainty string")


def test_graph_against_plain_versions(spark):
    n = 8
    nodes, edges = frames(spark, n, ARCS)
    want, reach = plain_components(n, ARCS)
    found = graph.strong_components(nodes, edges).cache()
    assert {r.node: r.component for r in found.collect()} == want
    assert {r.node for r in found.where("cyclic").collect()} == {0, 1, 2, 4, 5, 6}
    assert Counter((r.seed, r.node) for r in graph.closure(edges.selectExpr("src as a", "dst as b"), nodes).collect()) == Counter((a, b) for a in reach for b in reach[a])
    got = {r.node: r for r in graph.betweenness(nodes, edges).collect()}
    for v, raw in plain_betweenness(n, ARCS).items():
        assert got[v].raw == pytest.approx(raw, abs=1e-12) and got[v].score == pytest.approx(raw / 42, abs=1e-12)
    with pytest.raises(ValueError):
        graph.betweenness(nodes, edges, 10)
    links = graph.condensation(edges, found)
    assert sorted(map(tuple, links.collect())) == [(0, 3, 3, 3), (3, 4, 2, 4)]
    assert [r.component for r in graph.topological_order(links, found).orderBy("place").collect()] == [0, 3, 4, 6, 7]
    assert {r.node: (r.incoming, r.outgoing) for r in graph.degree(nodes, edges).collect()}[6] == (1, 1)
    assert [(r.id, r.src, r.dst) for r in graph.shortest_path(edges, 1, 5).orderBy("step").collect()] == [(9, 1, 3), (4, 3, 4), (6, 4, 5)]
    assert graph.shortest_path(edges, 5, 0).count() == 0
    kept, inner = graph.subgraph(edges, 3, 2)
    assert sorted(r.node for r in kept.collect()) == [3, 4, 5] and inner.count() == 4
    seeds = nodes.where("node = 0")
    assert {(r.node, r.distance) for r in graph.neighbors(edges, seeds, 2).collect()} == {(1, 1), (3, 1), (2, 2), (4, 2)}
    assert {(r.node, r.distance) for r in graph.neighbors(edges, seeds, 1, "both").collect()} == {(1, 1), (3, 1), (2, 1)}
    parts = graph.connected_components(edges.selectExpr("src as a", "dst as b"))
    assert {r.node: r.component for r in parts.collect()} == dict.fromkeys(range(6), 0)


def test_all_digraphs_on_three_nodes_at_once(spark):
    pairs = list(itertools.product(range(3), repeat=2))
    arcs, want = [], {}
    for g in range(512):
        own = [p for i, p in enumerate(pairs) if g >> i & 1]
        arcs += [(3 * g + a, 3 * g + b) for a, b in own]
        want |= {3 * g + a: 3 * g + c for a, c in plain_components(3, own)[0].items()}
    nodes, edges = frames(spark, 3 * 512, arcs)
    assert {r.node: r.component for r in graph.strong_components(nodes, edges).collect()} == want


def test_modularity_and_partition_by_hand(spark):
    nodes = spark.createDataFrame([(1, None, "container", "r"), (2, 1, "container", "m"), (3, 1, "container", "n"), (4, 2, "function", "a"), (5, 2, "type", "b"), (6, 3, "value", "c"), (7, 6, "value", "d")], "node long, parent long, category string, label string")
    owners = graph.partition(nodes)
    assert {r.node: r.owner for r in owners.collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 2, 6: 3, 7: 3}
    assert {r.path for r in graph.qualified_labels(nodes).collect()} >= {"r::n::c::d"}
    _, edges = frames(spark, 0, [(4, 5), (4, 6), (4, 6), (6, 7)])
    row = graph.modularity(edges, owners).first()
    assert (row.edges, row.internal) == (4, 2) and row.modularity == pytest.approx(2 / 4 - (3 * 1 + 1 * 3) / 16)
    assert {r.owner: (r.internal, r.boundary) for r in graph.cohesion(edges, owners).collect()} == {1: (0, 0), 2: (1, 2), 3: (1, 0)}
    assert [tuple(r) for r in graph.misplacement(nodes, edges, owners).collect()] == [(4, 3, 2, 3)]


# ---------------------------------------------------------------- supply chain, resolution


def test_supply_chain(spark):
    schema = "name string, version string, source_hash string, capabilities array<string>, skipped long"
    current = spark.createDataFrame([("a", "1.0.0", "h2", ["network"], 0), ("b", "1.10.0", "h", ["ffi", "network"], 0), ("c", "1.0.0", "h", ["ffi"], 0), ("d", "2.0.0", "h", ["ffi"], None), ("e", "1.0.0", "h", ["ffi"], 0)], schema)
    base = spark.createDataFrame([("a", "1.0.0", "h1", [], 0), ("b", "1.9.0", "h", ["ffi"], 0), ("b", "1.10.0-rc.1", "h", ["network"], 0), ("b", "1.11.0", "h", [], 0), ("d", "1.0.0", "h", [], 0), ("e", "1.0.0", "h", [], 0), ("z", "1.0.0", "h", [], 0)], schema)
    report = supply.compare(current, base)
    assert sorted((r.name, r.level, r.detail) for r in report.collect()) == [("a", "hash-mismatch", "h1 -> h2"), ("b", "new-capability", "ffi"), ("c", "new-dependency", "ffi"), ("d", "analysis-incomplete", "1.0.0")]
    assert supply.overall(report).first()[0] == "hash-mismatch" and supply.overall(report.limit(0)).first()[0] == "clean"
    assert supply.should_fail(report, "hash-mismatch").first()[0] and not supply.should_fail(report, "none").first()[0]
    assert {r.name for r in supply.stale(base, current).collect()} == {"b", "d", "z"}


def test_resolution(spark):
    scopes = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1)], "node long, parent long")
    definitions = spark.createDataFrame([(10, 0, "root"), (11, 1, "f"), (12, 2, "g"), (13, 2, "f")], "def_id long, node long, name string")
    imports = spark.createDataFrame([(1, "h", 2, "g"), (1, None, 2, None), (3, "k", 1, "h")], "node long, name string, target_node long, target_name string")
    bound = resolve.bind_imports(definitions, imports).cache()
    assert {(r.node, r.name, r.def_id) for r in bound.collect()} == {(0, "root", 10), (1, "f", 11), (2, "g", 12), (2, "f", 13), (1, "h", 12), (1, "g", 12), (3, "k", 12)}  # the glob's f is shadowed
    references = spark.createDataFrame([(0, 3, "root"), (1, 3, "f"), (2, 3, "k"), (3, 2, "zzz")], "ref_id long, node long, name string")
    found = resolve.lexical(references, bound, scopes)
    assert {(r.ref_id, r.def_id) for r in found.collect()} == {(0, 10), (1, 11), (2, 12)}
    marked = references.withColumns({"conditional": F.col("ref_id") == 1, "external": F.lit(False), "dynamic": F.lit(False)})
    assert {r.ref_id: (r.certainty, r.gaps) for r in resolve.records(marked, found).collect()} == {0: ("resolved", []), 1: ("possible", ["conditional_compilation"]), 2: ("resolved", []), 3: ("possible", ["missing_definition"])}
    paths = spark.createDataFrame([(0, 3, ["root", "f"]), (1, 3, ["k"])], "ref_id long, node long, segments array<string>")
    inner = spark.createDataFrame([(10, 2)], "def_id long, opens long")
    assert {(r.ref_id, r.def_id) for r in resolve.resolve_paths(paths, bound, scopes, inner).collect()} == {(0, 13), (1, 12)}
    long = spark.createDataFrame([(n, "x", n + 1, "x") for n in range(12)], "node long, name string, target_node long, target_name string")
    with pytest.raises(ValueError):
        resolve.bind_imports(spark.createDataFrame([(1, 12, "x")], "def_id long, node long, name string"), long)
    a = spark.createDataFrame([(["b", "a"], ["b"], [])], "x array<string>, y array<string>, z array<string>")
    assert a.select(resolve.predicate("all", F.col("x"), F.col("y")), resolve.predicate("any", F.col("x"), F.col("z"))).first() == (["a", "b"], [])
    mods = resolve.candidate_modules(spark.createDataFrame([("src", "a"), ("src", "b"), ("src", "c")], "directory string, name string"), spark.createDataFrame([("src/a.rs",), ("src/b.rs",), ("src/b/mod.rs",)], "path string"))
    assert {r.name: (r.path, r.problem) for r in mods.collect()} == {"a": ("src/a.rs", None), "b": (None, "ambiguous"), "c": (None, "missing")}


# ---------------------------------------------------------------- sources, sinks, stream


def test_tree_scan(spark, tmp_path):
    for name, body in {"src/a.py": b"x", "src/b.txt": b"x", ".git/c.py": b"x", "node_modules/d.js": b"x", "cache/CACHEDIR.TAG": b"Signature: 8a477f597d28d172789f06886806bc55", "cache/e.py": b"x", "bad.py": b"\xff\xfe", "tool": b"#!/bin/bash\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    good, bad = files.read_tree(spark, [str(tmp_path)])
    assert sorted(r.path.removeprefix(f"{tmp_path}/") for r in good.collect()) == ["src/a.py", "tool"]
    assert [(r.path.rsplit("/")[-1], r.error) for r in bad.collect()] == [("bad.py", "not UTF-8")]
    rooted = files.owning_root(spark.createDataFrame([("w/a/src/x.rs",), ("w/y.rs",), ("v/z.rs",)], "path string"), spark.createDataFrame([("w",), ("w/a",)], "root string"))
    assert {r.path: r.root for r in rooted.collect()} == {"w/a/src/x.rs": "w/a", "w/y.rs": "w", "v/z.rs": None}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("max-depth", "a,b.rs", 1, 2, "deny", "100%\nx")], "code string, file string, line int, col int, severity string, message string")
    assert sinks.annotations(rows).first()[0] == "::error file=a%2Cb.rs,line=1,col=2,title=max-depth::100%25%0Ax"
    assert [r.value for r in sinks.text_report(rows).collect()] == ["a,b.rs:1:2: max-depth", "Found 1 violation(s)"]
    assert json.loads(sinks.json_rows(rows.withColumn("none", F.lit(None).cast("string"))).first()[0]) == {"code": "max-depth", "file": "a,b.rs", "line": 1, "col": 2, "severity": "deny", "message": "100%\nx"}
    item = {"capability": "network", "file": "f", "line": 1, "col": 2, "evidence": "e"}
    (tmp_path / "p.json").write_text(json.dumps({"findings": [item]}))
    (tmp_path / "q.json").write_text(json.dumps({"spec_version": "0.1.0", "profile": {"findings": [item, item]}}))
    assert sinks.read_profile(spark, str(tmp_path / "p.json")).count() == 1 and sinks.read_profile(spark, str(tmp_path / "q.json")).count() == 2


def test_change_feed(spark, tmp_path):
    feed, where = tmp_path / "feed", str(tmp_path / "index")
    feed.mkdir()
    put = lambda name, rows: (feed / name).write_text("\n".join(json.dumps(dict(zip(("seq", "crate", "path", "op", "source"), r, strict=True))) for r in rows))
    run = lambda: changes.watch(spark, str(feed), where, str(tmp_path / "check")).awaitTermination()
    put("1.json", [(1, "c", "a", "create", "1"), (2, "c", "a", "modify", "2"), (3, "c", "b", "create", "x"), (4, "d", "z", "create", "zz")])
    run()
    put("2.json", [(5, "c", "a", "modify", None), (6, "c", "b", "remove", None), (7, "d", "z", "remove", None)])
    run()
    got = {(r.crate, r.path): (r.source, r.degraded) for r in changes.read_index(spark, where).collect()}
    assert got == {("c", "a"): ("2", "unreadable")}
    put("3.json", [(8, "c", "a", "modify", "3"), (9, "d", "y", "create", "n")])
    run()
    got = {(r.crate, r.path): (r.source, r.degraded) for r in changes.read_index(spark, where).collect()}
    assert got == {("c", "a"): ("3", None), ("d", "y"): ("n", None)}
