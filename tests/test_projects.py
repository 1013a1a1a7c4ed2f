"""Manifests, configuration, graph assembly, declarations and reuse on small fixtures."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import assemble, declarations, graph
from factloom.operators.cache import CachedGraph, FrameCache, reuse
from factloom.sources import config, manifests

TREE = [
    ("Cargo.toml", '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old"]\n[workspace.package]\nversion = "1.2.3"\n[workspace.dependencies]\nshared = { path = "crates/b", package = "bee" }\n'),
    ("crates/a/Cargo.toml", '[package]\nname = "a"\nversion.workspace = true\nedition = "2021"\n[dependencies]\nshared = { workspace = true, optional = true }\nserde = "1"\n[target."cfg(unix)".dependencies]\nnix = "0.1"\n[dev-dependencies]\nc = { path = "../c" }\n[features]\ndefault = ["x"]\nx = []\n[[bin]]\nname = "tool"\npath = "src/tool.rs"\n'),
    ("crates/b/Cargo.toml", '[package]\nname = "bee"\nversion = "0.1.0"\nedition = "2018"\n'),
    ("crates/c/Cargo.toml", '[package]\nname = "c"\n'),
    ("crates/old/Cargo.toml", '[package]\nname = "old"\n'),
    ("broken/Cargo.toml", "[package\n"),
    *[(p, "") for p in ("crates/a/src/lib.rs", "crates/a/src/main.rs", "crates/a/src/tool.rs", "crates/a/src/bin/extra.rs", "crates/a/tests/t.rs", "crates/a/build.rs", "crates/b/src/lib.rs")],
]


def test_manifests(spark):
    files = spark.createDataFrame(TREE, "path string, source string")
    rows = manifests.parse(files).cache()
    assert rows.where("kind = 'error'").count() == 1
    assert {(r.name, r.version, r.edition) for r in manifests.packages(rows).collect()} == {("a", "1.2.3", "2021"), ("bee", "0.1.0", "2018"), ("c", None, None), ("old", None, None)}
    assert {r.directory for r in manifests.members(rows).collect()} == {"crates/a", "crates/b", "crates/c"}
    got = {(r.name, r.package, r.kind, r.condition, r.feature, r.target_path) for r in manifests.dependencies(rows).collect()}
    assert got == {("shared", "bee", "normal", None, "shared", "crates/b"), ("serde", "serde", "normal", None, None, None), ("nix", "nix", "normal", "cfg:cfg(unix)", None, None), ("c", "c", "development", None, None, "crates/c")}
    assert {(r.package, r.feature, r.needs) for r in manifests.features(rows).collect()} == {("a", "default", "x")}
    got = {(r.directory, r.kind, r.name, r.path) for r in manifests.targets(rows, files).collect()}
    at = "crates/a"
    assert got == {(at, "bin", "tool", f"{at}/src/tool.rs"), (at, "lib", "a", f"{at}/src/lib.rs"), (at, "bin", "a", f"{at}/src/main.rs"), (at, "bin", "extra", f"{at}/src/bin/extra.rs"), (at, "test", "t", f"{at}/tests/t.rs"), (at, "build", "build-script", f"{at}/build.rs"), ("crates/b", "lib", "bee", "crates/b/src/lib.rs")}
    assert manifests.revision(files).first().manifests == 6


def test_unit_selection_and_module_closure(spark):
    edges = spark.createDataFrame([("a", "b", "unix"), ("b", "c", None), ("a", "d", "win"), ("d", "c", "x"), ("c", "a", None), ("a", "e", "unix"), ("a", "e", None)], "source string, target string, condition string")
    got = {r.directory: r.conditions for r in manifests.select_units(spark.createDataFrame([("a",)], "directory string"), edges).collect()}
    assert got == {"a": [], "b": ["unix"], "c": ["unix", "win&x"], "d": ["win"], "e": []}
    files = spark.createDataFrame([(p,) for p in ("src/lib.rs", "src/m.rs", "src/m/n.rs", "src/two.rs", "src/two/mod.rs")], "path string")
    declared = spark.createDataFrame([("src/lib.rs", "m"), ("src/m.rs", "n"), ("src/lib.rs", "two"), ("src/lib.rs", "gone")], "path string, name string")
    found, problems = manifests.module_closure(spark.createDataFrame([("u", "src/lib.rs")], "unit string, path string"), declared, files)
    assert {(r.module, r.path) for r in found.collect()} == {("crate", "src/lib.rs"), ("crate::m", "src/m.rs"), ("crate::m::n", "src/m/n.rs")}
    assert {(r.name, r.problem) for r in problems.collect()} == {("two", "ambiguous"), ("gone", "missing")}


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "user"))
    assert config.find(tmp_path) is None
    (tmp_path / ".factloom.toml").write_text('[check]\nmax_depth = 5\n[gate]\ndead-store = false\nenv-access-network = "deny"\nffi = true\n')
    table = config.load(config.find(tmp_path))
    base = config.check_config(table["check"])
    assert base.max_depth == 5 and base.max_params == 5
    assert config.gate_overrides(table["gate"]) == {"dead-store": False, "env-access-network": "deny"}
    overrides = [("tests/**", {"enabled": False}), ("src/**", {"max_params": 9})]
    assert config.for_path(base, overrides, "tests/**") is None and config.for_path(base, overrides, "src/**").max_params == 9 and config.for_path(base, overrides, None) is base
    for bad in ({"nope": 1},):
        with pytest.raises(ValueError):
            config.check_config(bad)
    with pytest.raises(ValueError):
        config.gate_overrides({"x": "loud"})


def test_assembly(spark):
    frame = spark.createDataFrame
    nodes, edges = assemble.build(
        frame([("b",), ("a",)], "unit string"), frame([("a", "a.rs"), ("b", "b.rs")], "unit string, path string"),
        frame([(7, "a", "a.rs", "module", "m", 0, None), (8, "a", "a.rs", "function", "f", 5, 7), (9, "b", "b.rs", "struct", "S", 1, None)], "def_id long, unit string, path string, kind string, name string, start int, parent long"),
        frame([(1, "call", 8), (2, "type", 8)], "ref_id long, kind string, owner long"), frame([(1, 8, "resolved"), (2, 9, "possible")], "ref_id long, def_id long, certainty string"), frame([("a", "b")], "source string, target string"),
    )
    got = {r.node: (r.parent, r.category, r.label) for r in nodes.collect()}
    assert got == {0: (None, "container", "a"), 1: (None, "container", "b"), 2: (0, "file", "a.rs"), 3: (1, "file", "b.rs"), 4: (2, "container", "m"), 5: (4, "function", "f"), 6: (3, "type", "S")}
    assert sorted((r.id, r.src, r.dst, r.kind, r.certainty) for r in edges.collect()) == [(0, 0, 1, "depends_on", "resolved"), (1, 5, 5, "call", "resolved"), (2, 5, 6, "reference", "possible")]
    assemble.validate(nodes, edges)
    for bad in ([(0, 1), (1, 0)], [(0, None), (2, 0)]):
        with pytest.raises(ValueError):
            assemble.validate(frame(bad, "node long, parent long"), frame([], "src long, dst long"))


def test_declarations(spark):
    py = b"class A:\n    def f(self,\n          x):\n        return '}'\n\n    async def g(self): pass\n\ndef h():\n    pass\nx = 1\n"
    assert [(k, n, py[a:b].splitlines()[0], py[a:b].splitlines()[-1]) for k, n, a, b in declarations.scan(py, "python")] == [
        ("class", "A", b"class A:", b"    async def g(self): pass"), ("method", "f", b"def f(self,", b"        return '}'"), ("method", "g", b"async def g(self): pass", b"async def g(self): pass"), ("function", "h", b"def h():", b"    pass")]
    go = b'package x\n// func no() {\nfunc f() { s := "}" }\nfunc (t *T) m(a int) {\n}\ntype T struct {\n}\n'
    assert [(k, n) for k, n, _, _ in declarations.scan(go, "go")] == [("function", "f"), ("method", "m"), ("struct", "T")]
    assert [(k, n) for k, n, _, _ in declarations.scan(b"function a() { }\nconst b = async (x) => { }\nclass C { }", "java_script")] == [("function", "a"), ("function", "b"), ("class", "C")]
    assert [n for _, n, _, _ in declarations.scan(b"f() {\n echo '}'\n}\nfunction g {\n}\n", "bash")] == ["f", "g"]
    files = spark.createDataFrame([("a.py", py.decode(), "python")], "path string, source string, language string")
    found = spark.createDataFrame([("a.py", 4, 9), ("a.py", 9, 5), ("a.py", 10, 1)], "file string, line int, col int")
    assert {r.line: r.symbol for r in declarations.attributed(found, files).collect()} == {4: "f", 9: "h", 10: None}


def test_reuse_and_cache(spark):
    made = []
    derive = lambda rows: (made.append([r.path for r in rows.collect()]), rows.select("path", F.length("source").alias("n")))[1]
    files = lambda *r: spark.createDataFrame(list(r), "path string, source string")
    nothing = spark.createDataFrame([], "path string, n int, claim string")
    first = reuse(files(("a", "1"), ("b", "22")), nothing, derive).cache()
    second = reuse(files(("a", "1"), ("b", "333")), first, derive)
    assert {(r.path, r.n) for r in second.collect()} == {("a", 1), ("b", 3)} and sorted(made[1]) == ["b"]
    cache = FrameCache(1)
    for key in "aab":
        cache.get(key, lambda: spark.range(1))
    assert cache.stats == {"hit": 1, "miss": 2, "evict": 1}
    cache.clear()
    held = CachedGraph(spark.createDataFrame([(0,), (1,)], "node long"), spark.createDataFrame([(0, 0, 1, "call", "resolved")], "id long, src long, dst long, kind string, certainty string"))
    for _ in range(2):
        assert {r.node: r.total for r in held.ask("degree", kinds=("call",)).collect()} == {0: 1, 1: 1}
    assert held.cache.stats["hit"] >= 1 and graph.SYMBOLS
