"""Rust facts, token scanners, the check runner and the mended loops, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import scratch
from factloom.functions import scalar as S
from factloom.operators import checks, graph, rust, structured, style, supply
from factloom.sources import files, sinks


def rows(source, tag):
    return [(fn, line, col, body) for t, fn, line, col, body in rust.scan(source) if t == tag]


def test_lexer_tells_lifetimes_chars_and_nested_comments():
    t = rust.Tokens("fn f<'a>(x: &'a str) { /* a /* b */ 'c */ let q = '\\''; let r = r##\"a\"#b\"##; 1..2; x.0.1; b'x' }")
    assert [x for k, x in zip(t.kind, t.text, strict=True) if k == "life"] == ["'a", "'a"]
    assert [x for k, x in zip(t.kind, t.text, strict=True) if k in ("char", "str")] == ["'\\''", 'r##"a"#b"##', "b'x'"]
    assert rust.string_value('"a\\n\\u{e9}\\\n   b"') == "a\néb" and rust.string_value('b"x"') is None
    assert t.place(0) == (1, 0) and rust.scan("fn f( {") == [("error", None, 1, 0, {"message": "unmatched { in line 1"})]
    assert rust.scan("") == [] and rust.scan("é // x\n ") == []


def test_control_flow_nests_as_written():
    source = "fn f() { if a { } else if b { match c { _ if d => loop { }, X::Y(z) => while let Some(q) = w { }, } } else { for i in x { |y| y; } } }"
    got = [(b["kind"], b["depth"], b["loop_depth"], b["parent_branch"], b.get("chain_len")) for _, _, _, b in rows(source, "control_flow")]
    assert got == [("if", 1, 0, None, 3), ("if", 2, 0, "if", None), ("match", 3, 0, "if", None), ("loop", 4, 1, "match", None), ("while", 4, 1, "match", None), ("for", 3, 1, "if", None), ("closure", 3, 1, "if", None)]


def test_imports_and_paths():
    source = "use a::{self, b as c, d::{e, *}};\nfn f() { a::b(); a::b(); S { x: m::N }; let y: t::U = v as w::X; match z { p::Q => 1, p::R(_) => 2 } }"
    assert [(b["text"], b["alias"], b["glob"]) for _, _, _, b in rows(source, "reference") if b["origin"] == "import"] == [("a::self", None, False), ("a::b", "c", False), ("a::d::e", None, False), ("a::d", None, True)]
    assert [b["text"] for _, _, _, b in rows(source, "reference") if b["origin"] == "expression_path"] == ["a::b", "a::b", "m::N", "p::Q"]


def test_types_and_gates():
    source = "#[cfg_attr(unix, cfg(a))]\n#[cfg(feature = \"f\")]\nimpl<T: X> Tr<T> for m::S<T> { fn a(&self, v: Vec<Box<dyn A>>, h: HashSet<u8>, k: HashMap<u8, u8, R>) -> Arc<dyn B> { self.i.go::<u8>(1)? } }"
    (impl,) = rows(source, "impl_block")
    assert impl[3]["type"] == "m" and impl[3]["trait"] == "Tr" and impl[3]["predicates"] == ["all(unix, a)", 'feature = "f"']
    flags = {b["text"]: (b["involves_dyn"], b["is_vec_box_dyn"], b["is_default_hasher"]) for _, _, _, b in rows(source, "type_ref")}
    assert flags == {"Arc<dynB>": (True, False, False), "Vec<Box<dynA>>": (False, True, False), "HashSet<u8>": (False, False, True), "HashMap<u8,u8,R>": (False, False, False), "u8": (False, False, False)}
    (fn,) = rows(source, "function")
    assert fn[3]["features"] == ["f"] and fn[3]["method_of"] is None and not fn[3]["is_forwarder"]
    for body, forwards in {"self.a.b(c)": True, "self.a.b(c)?": True, "self.a.b::<T>(c).await?;": True, "self.b(c)": False, "self.a.b(c).d()": False, "x; self.a.b()": False}.items():
        ((_, _, _, b),) = rows(f"impl S {{ fn f(&self) {{ {body} }} }}", "function")
        assert b["is_forwarder"] is forwards, body


def test_fnv_and_fingerprints():
    assert rust.fnv1a(b"") == 0xCBF29CE484222325 and rust.fnv1a(b"foobar") == 0x85944171F73967E8
    of = lambda source: [(b["skeleton"], b["exact"]) for _, _, _, b in rows(source, "fingerprint")]
    (a, b, c) = of("fn f(x: u8) -> u8 { x.a(); if q { } }  fn g(y: u8) -> u8 { z.b(); if r { } }  fn h() { }")
    assert a[0] == b[0] and a[1] != b[1] and c[0] != a[0]


def test_pairs(spark):
    assert [tuple(p) for p in spark.range(1).select(rust.pairs(F.array(*map(F.lit, "abc")))).first()[0]] == [("a", "b"), ("a", "c"), ("b", "c")]


def test_tables_of_empty_and_null_sources(spark):
    held = spark.createDataFrame([("a.rs", None), ("b.rs", ""), ("c.py", "fn x() {}"), ("d.rs", "fn x() {}")], "path string, source string")
    facts = rust.extract(held)
    assert [r.name for r in rust.table(facts, "function").collect()] == ["x"]
    assert rust.extract(held.limit(0)).count() == 0
    assert checks.style_checks(scratch.materialise(facts, "f"), held, style.Config()).count() == 0


def test_gates_of_declaring_modules(spark):
    source = {"k/src/lib.rs": "#[cfg(unix)] mod a;\nmod b;", "k/src/a.rs": "#[cfg(x)] mod c;", "k/src/a/c.rs": "", "k/src/a/d.rs": "", "k/src/b.rs": ""}
    held = spark.createDataFrame(list(source.items()), "path string, source string")
    got = {r.file: r.inherited for r in checks.inherited_gates(held, rust.extract(held)).collect()}
    assert got == {"k/src/lib.rs": [], "k/src/a.rs": ["unix"], "k/src/a/c.rs": ["unix", "x"], "k/src/a/d.rs": ["unix"], "k/src/b.rs": []}


def test_structured_scanners():
    got = lambda text, lang: [(c, line, col, e) for c, line, col, e, _ in structured.scan(text.encode(), lang)]
    assert got("import requests as r\nr.get(x); a.r.get(y)  # r.post(\ns = 'r.put('\n", "python") == [("network", 1, 1, "requests"), ("network", 2, 1, "r.get")]
    assert got("// require('fs')\nx(require('fs'), require(`net`));import {\na} from \"jose\"", "java_script") == [("file_read", 2, 3, "fs"), ("crypto", 2, 34, "jose")]
    assert got('package m\nimport (\n _ "net/http"\n . "os/exec"\n o "os"\n)\nvar x = o.Open("f")', "go") == [("file_read", 7, 9, "os.Open")]
    assert got("A=1 curl x\nbash y; sh -c z\necho 'wget'\nif env; then mv a b; fi\ncurl=1", "bash") == [("network", 1, 1, "curl"), ("process_exec", 2, 9, "bash -c"), ("env_access", 4, 4, "env"), ("file_write", 4, 14, "mv")]
    assert got("x", "rust") == [] and got("", "bash") == []


def test_topological_order_refuses_large_graphs(spark, monkeypatch):
    components = spark.createDataFrame([(i, i) for i in range(5)], "node long, component long")
    links = spark.createDataFrame([(0, 1), (1, 2)], "source long, target long")
    assert graph.topological_order(links, components).count() == 5
    monkeypatch.setattr(graph.admit, "__defaults__", (4, 10))
    with pytest.raises(ValueError, match="ceiling"):
        graph.topological_order(links, components)


def test_facts_of_components_are_validated(spark):
    schema = "component long, members long, partitions long, cyclic boolean"
    graph.validate_component_facts(spark.createDataFrame([(0, 3, 2, True), (5, 1, 1, False)], schema))
    for bad in ([(0, 2, 1, False)], [(0, 1, 2, False)], [(0, 0, 0, False)], [(0, 1, 1, False), (0, 1, 1, False)]):
        with pytest.raises(ValueError):
            graph.validate_component_facts(spark.createDataFrame(bad, schema))


def test_divergence_layout_and_json(spark):
    nodes = spark.createDataFrame([(0, None, "container", "a"), (1, None, "container", "b"), (2, 0, "function", "f"), (3, 1, "function", "g")], "node long, parent long, category string, label string")
    edges = spark.createDataFrame([(0, 2, 3, "call", "resolved"), (1, 3, 2, "call", "resolved"), (2, 2, 2, "call", "possible")], "id long, src long, dst long, kind string, certainty string")
    found = graph.divergence(nodes, edges)
    assert {(r.component, r.members, r.partitions) for r in found["crossings"].collect()} == {(2, 2, 2)}
    assert {(r.symbol, r.foreign, r.total) for r in found["misplacement"].collect()} == {(2, 1, 2), (3, 1, 1)}
    owners = graph.partition(nodes)
    assert {r.id: r.crosses for r in graph.layout_edges(edges, owners).collect()} == {0: True, 1: True, 2: False}
    assert {r.node: r.betweenness for r in graph.layout(nodes, edges, owners, graph.betweenness(nodes, edges)).collect()} == dict.fromkeys(range(4), 0.0)
    named = graph.component_subjects(graph.strong_components(nodes, edges), graph.qualified_labels(nodes)).collect()
    assert [(r.component, r.subject, r.members) for r in named] == [(2, "scc::a::f", 2)]
    parts = [json.loads(r.value) for r in graph.to_json(nodes, edges).orderBy("part", "id").collect()]
    assert parts[0] == {"version": 1, "nodes": 4, "edges": 3} and parts[3] == {"id": 2, "parent": 0, "category": "function", "label": "f"} and parts[5]["source"] == 2


def test_outputs(spark):
    verdicts = spark.createDataFrame([("r", "deny", "a%b"), ("s", "info", "x")], "rule string, severity string, rationale string")
    lines = [r.value for r in sinks.project_gate_annotations(verdicts, "syntactic", ["lib", "bin"]).orderBy("ord", "value").collect()]
    assert lines == ["::notice title=module-boundary::analysis tier: syntactic; targets: lib, bin", "::error title=r::a%25b", "::notice title=s::x"]
    worst = supply.overall(spark.createDataFrame([("new-dependency",), ("hash-mismatch",)], "level string"))
    assert [r.value for r in sinks.ci_outputs(worst, "/r.json").orderBy("ord").collect()] == ["status=hash-mismatch", "report=/r.json"]
    units = spark.createDataFrame([("a.py", "function", "f", 3, 9)], "file string, kind string, name string, start int, end int")
    (got,) = sinks.snippets(units, spark.createDataFrame([("a.py", "é\ndef f(): pass")], "path string, source string")).collect()
    assert json.loads(got.value) == {"version": 1, "location": {"file": "a.py", "line": 2, "start": 3, "end": 9}, "kind": "function", "name": "f", "text": "def f("}


def test_as_of_baseline_is_strictly_older(spark):
    schema = "name string, version string, n int"
    current = spark.createDataFrame([("a", "1.10.0", 1), ("a", "1.2.0", 2), ("a", "0.1.0", 3), ("b", "x2", 4), ("c", "1.0.0", 5), ("a", "1.10.0+z", 6)], schema)
    base = spark.createDataFrame([("a", "1.2.0", 10), ("a", "1.9.0", 11), ("a", "1.10.0", 12), ("b", "x1", 13), ("b", "1.0.0", 14)], schema)
    assert {r.n: r.prior_n for r in supply.prior_baseline(current, base).collect()} == {1: 11, 2: None, 3: None, 4: 13, 5: None, 6: 11}


def test_source_hash_streams_a_group(spark):
    import hashlib

    held = [("c1", "b", "2"), ("c1", "a", None), ("c2", "x", "é" * 10_000), (None, "p", "q")]
    got = {r.crate: r.source_hash for r in files.source_hash(spark.createDataFrame(held, "crate string, path string, source string"), ["crate"]).collect()}
    part = lambda x: len(x.encode()).to_bytes(8, "big") + x.encode()
    want = {c: hashlib.sha256(b"".join(part(p) + part(s or "") for cc, p, s in sorted(held, key=lambda r: r[1]) if cc == c)).hexdigest() for c in ("c1", "c2", None)}
    assert got == want
    plan = files.source_hash(spark.createDataFrame(held, "crate string, path string, source string"), ["crate"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_tree_leaves_large_files_unread(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}", "src/big.rs": b"x" * 100, "bad.py": b"\xff\xfe", "tagged/CACHEDIR.TAG": b"x", "tagged/in/b.rs": b"x", ".dot/c.rs": b"x", "n.txt": b"x", "run": b"#!/bin/sh\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    kept, quarantine = files.read_tree(spark, [str(tmp_path)], 50)
    short = lambda p: p.split(f"{tmp_path}/")[1]
    assert {short(r.path) for r in kept.collect()} == {"src/a.rs", "run"}
    assert {(short(r.path), r.error) for r in quarantine.collect()} == {("src/big.rs", "above the size ceiling"), ("bad.py", "not UTF-8")}


def test_scratch_grows_and_forgets(spark):
    grown = scratch.Grown(spark.range(3).toDF("n"), "grown-test")
    assert grown.add(spark.range(3, 5).toDF("n")).count() == 2 and grown.rows.count() == 5 and len(grown.paths) == 2
    held = scratch.materialise(spark.range(2), "gone")
    scratch.discard(held)
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        spark.read.parquet(held._scratch).count()


def test_entry_names_only_the_missing_subpackage(tmp_path):
    """A broken import inside the training-data operators is an error; only their absence is not."""
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).resolve().parent.parent
    (tmp_path / "factloom").mkdir()
    (tmp_path / "__spark_entry__.py").write_text((home / "__spark_entry__.py").read_text())
    for part in ("__init__.py", "scratch.py", "ship.py", "functions", "operators", "plans", "sources", "streaming"):
        (tmp_path / "factloom" / part).symlink_to(home / "factloom" / part)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert int(run().stdout) > 60
    (tmp_path / "corpus_pipeline.py").write_text("import factloom.no_such_module\n")
    assert run().returncode != 0


def test_matching_functions_are_null_safe(spark):
    frame = spark.createDataFrame([(None,)], "x string")
    assert frame.select(S.wildcard(F.col("x"), "a*b*c")).first()[0] is False
    assert rust.scan("mod a { mod b { fn f() {} } }")[0][4]["inline"] is True


def test_reports_are_read_and_built_within_limits(spark, tmp_path):
    from factloom.sources import reports

    whole = {"units": [{"unit": "u"}], "files": [{"unit": "u", "path": "a.rs", "lines": 3}], "definitions": [{"def_id": i, "unit": "u", "path": "a.rs", "kind": "function", "name": "f", "line": i, "col": 0, "end_line": i, "end_col": 1, "parent": None} for i in range(2)], "references": [], "resolutions": []}
    (tmp_path / "r.json").write_text(json.dumps(whole))
    held = reports.read_report(spark, str(tmp_path / "r.json"))
    assert held["definitions"].count() == 2 and reports.problems(held).count() == 0
    with pytest.raises(ValueError, match="2 definitions"):
        reports.read_report(spark, str(tmp_path / "r.json"), reports.LIMITS | {"definitions": 1})
    b = reports.Builder(reports.LIMITS | {"definitions": 3})
    b.append("definitions", held["definitions"])
    with pytest.raises(ValueError, match="4 definitions"):
        b.append("definitions", held["definitions"])
    b = reports.Builder()
    b.append("definitions", held["definitions"])
    refs = spark.createDataFrame([(1, "u", "a.rs", "call", 0, 0, 0, 1, 1)], "ref_id long, unit string, path string, kind string, line int, col int, end_line int, end_col int, owner long")
    b.append("references", refs)
    records = spark.createDataFrame([(1, 0, "resolved")], "ref_id long, def_id long, certainty string")
    b.append("resolutions", records)
    assert b.tables()["resolutions"].count() == 1
    for bad in (records.withColumn("def_id", F.lit(9)), records.withColumn("ref_id", F.lit(9))):
        with pytest.raises(ValueError, match="does not hold"):
            b.append("resolutions", bad)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    from factloom.streaming import changes

    where = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "c", "c/a.py", "create", "import socket\n"), (2, "d", "d/b.sh", "create", "curl x\n")], changes.CHANGE)
    for _ in range(2):
        changes.reindex(spark, where, rows)
    got = {r.crate: (r.files, r.findings, r.capabilities) for r in changes.read_crates(spark, where).collect()}
    assert got == {"c": (1, 1, ["network"]), "d": (1, 1, ["network"])}
    changes.reindex(spark, where, spark.createDataFrame([(3, "c", "c/a.py", "remove", None)], changes.CHANGE))
    assert [r.crate for r in changes.read_crates(spark, where).collect()] == ["d"]


def test_items_of_an_owner(spark):
    from factloom.operators import resolve

    refs = spark.createDataFrame([(1, 7, "N"), (2, 7, "zz"), (3, 8, "N")], "ref_id long, owner_def long, name string")
    held = spark.createDataFrame([(20, 7, "N"), (21, 7, "N"), (22, None, "N")], "def_id long, owner long, name string")
    assert {(r.ref_id, r.def_id) for r in resolve.associated_items(refs, held).collect()} == {(1, 20), (1, 21)}


def test_prefix_joins_have_equalities(spark):
    """No nested loop in the plans of packages, members, targets, the tree scan's owners and the as-of baselines."""
    from factloom.sources import manifests

    tree = spark.createDataFrame([("w/Cargo.toml", '[workspace]\nmembers = ["a"]\n'), ("w/a/Cargo.toml", '[package]\nname = "a"\n'), ("w/a/src/lib.rs", "")], "path string, source string")
    held = scratch.materialise(manifests.parse(tree), "plan-test")
    for frame in (manifests.packages(held), manifests.members(held), manifests.targets(held, tree), files.owning_root(tree, tree.selectExpr("path AS root")), supply.prior_baseline(*[spark.createDataFrame([("a", "1.0.0")], "name string, version string")] * 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r.root for r in manifests.members(held).collect()] == ["w"]
    with pytest.raises(ValueError, match="more than 1"):
        manifests.parse(tree, 1)
