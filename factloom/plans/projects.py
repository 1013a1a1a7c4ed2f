"""Queries over a planted project, one copy for each nation: manifests, modules, resolution, index upkeep and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import scratch
from factloom.functions import scalar as S
from factloom.operators import capability, declarations, flows, gate, resolve, sets, style, supply, tools
from factloom.operators.cache import reuse
from factloom.plans import vocab
from factloom.plans.planted import values
from factloom.plans.queries import _NEW, _OLD, _findings, _functions, _statements, query
from factloom.scratch import materialise
from factloom.sources import adapters as A
from factloom.sources import files as trees
from factloom.sources import manifests, reports, sinks
from factloom.streaming import changes


def copies(spark, d, rows: list[tuple], schema: str) -> DataFrame:
    """k (``k`` and the nation's number), n and the rows, for each nation."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("n"))
    return nations.crossJoin(spark.createDataFrame(rows, schema)).withColumn("k", F.concat(F.lit("k"), F.col("n").cast("string")))


def copies_sql(select: str, rows: list[tuple], columns: str) -> str:
    return f"SELECT {select} FROM (SELECT n_nationkey AS n, concat('k', n_nationkey) AS k FROM nation) x, {values(rows, columns)}"


def below(column: str):
    """A path below the nation's folder."""
    return F.concat_ws("/", "k", F.when(F.col(column) != "", F.col(column)))


TREE = [
    ("Cargo.toml", '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old"]\n[workspace.package]\nversion = "1.2.3"\n[workspace.dependencies]\nshared = { path = "crates/b", package = "bee" }\n'),
    ("crates/a/Cargo.toml", '[package]\nname = "a"\nversion.workspace = true\nedition = "2021"\n[dependencies]\nshared = { workspace = true, optional = true }\nserde = "1"\n[target."cfg(unix)".dependencies]\nnix = "0.1"\n[dev-dependencies]\nc = { path = "../c" }\n[features]\ndefault = ["x"]\nx = ["deep"]\ndeep = []\n[[bin]]\nname = "tool"\npath = "src/tool.rs"\n'),
    ("crates/b/Cargo.toml", '[package]\nname = "bee"\nversion = "0.1.0"\nedition = "2018"\n'),
    ("crates/c/Cargo.toml", '[package]\nname = "c"\n'),
    ("crates/old/Cargo.toml", '[package]\nname = "old"\n'),
    ("broken/Cargo.toml", "[package\n"),
    *[(p, "") for p in ("crates/a/src/lib.rs", "crates/a/src/main.rs", "crates/a/src/tool.rs", "crates/a/src/bin/extra.rs", "crates/a/tests/t.rs", "crates/a/build.rs", "crates/b/src/lib.rs")],
]


def _tree(spark, d) -> DataFrame:
    return materialise(copies(spark, d, TREE, "inner string, source string").select(below("inner").alias("path"), "source"), "planted-tree")


def _manifests(spark, d) -> DataFrame:
    return materialise(manifests.parse(_tree(spark, d)), "planted-manifests")


_AT = "concat(k, '/', directory) AS directory"


@query("project_packages", copies_sql(f"{_AT}, name, version, edition", [("crates/a", "a", "1.2.3", "2021"), ("crates/b", "bee", "0.1.0", "2018"), ("crates/c", "c", None, None), ("crates/old", "old", None, None)], "directory, name, version, edition"))
def project_packages(spark, d):
    """Packages with what they inherit from their workspace."""
    return manifests.packages(_manifests(spark, d)).select("directory", "name", "version", "edition")


@query("project_members", copies_sql(f"k AS root, {_AT}", [("crates/a",), ("crates/b",), ("crates/c",)], "directory"))
def project_members(spark, d):
    return manifests.members(_manifests(spark, d))


@query("project_dependencies", copies_sql("concat(k, '/crates/a/Cargo.toml') AS path, name, package, kind, condition, feature, CASE WHEN target IS NOT NULL THEN concat(k, '/', target) END AS target_path", [("shared", "bee", "normal", None, "shared", "crates/b"), ("serde", "serde", "normal", None, None, None), ("nix", "nix", "normal", "cfg:cfg(unix)", None, None), ("c", "c", "development", None, None, "crates/c")], "name, package, kind, condition, feature, target"))
def project_dependencies(spark, d):
    return manifests.dependencies(_manifests(spark, d))


@query("project_targets", copies_sql(f"{_AT}, kind, name, concat(k, '/', path) AS path", [("crates/a", "bin", "tool", "crates/a/src/tool.rs"), ("crates/a", "lib", "a", "crates/a/src/lib.rs"), ("crates/a", "bin", "a", "crates/a/src/main.rs"), ("crates/a", "bin", "extra", "crates/a/src/bin/extra.rs"), ("crates/a", "test", "t", "crates/a/tests/t.rs"), ("crates/a", "build", "build-script", "crates/a/build.rs"), ("crates/b", "lib", "bee", "crates/b/src/lib.rs")], "directory, kind, name, path"))
def project_targets(spark, d):
    rows = _manifests(spark, d)
    return manifests.targets(rows, _tree(spark, d))


@query("project_features", copies_sql("'a' AS package, feature, needs", [("default", "x"), ("x", "deep")], "feature, needs"))
def project_features(spark, d):
    return manifests.features(_manifests(spark, d))


@query("project_feature_reach", copies_sql("concat(k, '-a') AS package, feature", [("default",), ("x",)], "feature"))
def project_feature_reach(spark, d):
    """Which of a package's features turn one on that is not for them."""
    edges = copies(spark, d, [("default", "x"), ("x", "deep"), ("other", "none")], "feature string, needs string").select(F.concat("k", F.lit("-a")).alias("package"), "feature", "needs")
    return style.feature_reaches(edges, edges.select("package", "feature").distinct(), "deep")


@query("project_errors", copies_sql("concat(k, '/broken/Cargo.toml') AS path, kind", [("error",)], "kind"))
def project_errors(spark, d):
    """A manifest that does not parse is a row, not an end."""
    return _manifests(spark, d).where("kind = 'error'").select("path", "kind")


@query("project_units", copies_sql("concat(k, '/', unit) AS directory, conditions", [("a", ""), ("b", "unix"), ("c", "unix,win&x"), ("d", "win"), ("e", "")], "unit, conditions"))
def project_units(spark, d):
    """Units that a root reaches, each under the alternatives of all ways to it; cycles end."""
    edges = copies(spark, d, [("a", "b", "unix"), ("b", "c", None), ("a", "d", "win"), ("d", "c", "x"), ("c", "a", None), ("a", "e", "unix"), ("a", "e", None)], "source string, target string, condition string")
    edges = edges.select(below("source").alias("source"), below("target").alias("target"), "condition")
    roots = copies(spark, d, [("a",)], "unit string").select(below("unit").alias("directory"))
    return manifests.select_units(roots, edges).select("directory", F.concat_ws(",", "conditions").alias("conditions"))


@query("project_modules", copies_sql("concat(k, '/', path) AS path, module, problem", [("src/lib.rs", "crate", None), ("src/m.rs", "crate::m", None), ("src/m/n.rs", "crate::m::n", None), ("src/lib.rs", "two", "ambiguous"), ("src/lib.rs", "gone", "missing")], "path, module, problem"))
def project_modules(spark, d):
    """Files by module path from each root, and declarations without a file of their own."""
    files = copies(spark, d, [(p,) for p in ("src/lib.rs", "src/m.rs", "src/m/n.rs", "src/two.rs", "src/two/mod.rs")], "inner string").select(below("inner").alias("path"))
    declared = copies(spark, d, [("src/lib.rs", "m"), ("src/m.rs", "n"), ("src/lib.rs", "two"), ("src/lib.rs", "gone")], "inner string, name string").select(below("inner").alias("path"), "name")
    roots = copies(spark, d, [("src/lib.rs",)], "inner string").select(F.col("k").alias("unit"), below("inner").alias("path"))
    found, problems = manifests.module_closure(roots, declared, files)
    return found.select("path", "module", F.lit(None).cast("string").alias("problem")).unionByName(problems.select("path", F.col("name").alias("module"), "problem"))


@query("project_layout", copies_sql("concat(k, '/', path) AS path, problem", [("src/x.rs", "conflicting-module-root"), ("src/io_read.rs", "flat-module-family")], "path, problem"))
def project_layout(spark, d):
    """``x.rs`` beside ``x/``, and a member of a family outside its folder."""
    files = copies(spark, d, [(p,) for p in ("src/x.rs", "src/x/y.rs", "src/z.rs", "src/io_read.rs", "src/io/io_write.rs")], "inner string").select(below("inner").alias("path"))
    a = style.conflicting_roots(files).select("path", F.lit("conflicting-module-root").alias("problem"))
    return a.unionByName(style.flat_family(files, "io_", "io").select("path", F.lit("flat-module-family").alias("problem")))


@query("project_policies", copies_sql("concat(k, '/a.rs') AS path, name, problem", [("g", "wrong-visibility"), ("h", "duplicate"), ("q", "missing")], "name, problem"))
def project_policies(spark, d):
    """Items that do not keep the visibility that is asked of them."""
    items = copies(spark, d, [("f", "fn", "pub"), ("g", "fn", "private"), ("h", "fn", "pub"), ("h", "fn", "pub")], "name string, kind string, visibility string")
    items = items.select(F.concat(F.lit("src/"), "k", F.lit("/a.rs")).alias("file"), "name", "kind", "visibility")
    rules = copies(spark, d, [(n, "fn", "pub") for n in "fghq"], "name string, kind string, visibility string").select(F.concat("k", F.lit("/a.rs")).alias("path"), "name", "kind", "visibility")
    return style.visibility(rules, items)


@query("project_overrides", "SELECT path, CASE WHEN path LIKE 'docs/%/%.py' THEN 'docs/*/*.py' WHEN path LIKE 'docs/%' THEN 'docs/**' END AS override FROM {f} f", f=A.FILES)
def project_overrides(spark, d):
    """The longest glob of the configuration that each file matches."""
    return style.override_for(A.frame(spark, d, A.FILES).select("path"), [("docs/**", {}), ("docs/*/*.py", {})])


@query("project_owners", "SELECT path, CASE WHEN path LIKE 'docs/%' THEN regexp_extract(path, '^docs/[^/]*', 0) WHEN path LIKE 'turns/%' THEN 'turns' END AS root FROM {f} f", f=A.FILES)
def project_owners(spark, d):
    """The nearest root above each file: an equality join on its ancestors."""
    files = A.frame(spark, d, A.FILES).select("path")
    roots = files.where(F.col("path").startswith("docs/")).select(F.regexp_extract("path", "^docs/[^/]*", 0).alias("root")).distinct()
    return trees.owning_root(files, roots.unionByName(spark.createDataFrame([("docs",), ("turns",)], "root string")))


@query("project_revision", "SELECT 6 * count(*) AS manifests FROM nation")
def project_revision(spark, d):
    return manifests.revision(_tree(spark, d)).select("manifests")


# ---------------------------------------------------------------- resolution


def _numbers(spark, d, rows, schema, *columns) -> DataFrame:
    """Rows whose number columns lie in a range of the nation's own."""
    out = copies(spark, d, rows, schema)
    return out.withColumns({c: F.col(c) + F.col("n") * 100 for c in columns}).drop("k", "n")


def _bindings(spark, d) -> DataFrame:
    definitions = _numbers(spark, d, [(1, "a", 10), (2, "b", 11), (3, "c", 12), (3, "b", 13)], "node long, name string, def_id long", "node", "def_id")
    imports = _numbers(spark, d, [(1, "x", 2, "b"), (4, None, 3, None), (4, "b", 2, "b"), (5, "y", 1, "x"), (5, None, 4, None)], "node long, name string, target_node long, target_name string", "node", "target_node")
    return materialise(resolve.bind_imports(definitions, imports), "planted-bindings")


@query("resolve_bindings", copies_sql("node + n * 100 AS node, name, def_id + n * 100 AS def_id, \"glob\"", [(1, "a", 10, False), (2, "b", 11, False), (3, "c", 12, False), (3, "b", 13, False), (1, "x", 11, False), (4, "c", 12, True), (4, "b", 11, False), (5, "y", 11, False), (5, "c", 12, True), (5, "b", 11, True), (5, "b", 13, True)], 'node, name, def_id, "glob"'))
def resolve_bindings(spark, d):
    """What every scope binds, imports of imports and globs included; direct members shadow those of globs."""
    return _bindings(spark, d).select("node", "name", "def_id", "glob").distinct()


@query("resolve_paths", copies_sql("ref_id + n * 100 AS ref_id, def_id + n * 100 AS def_id", [(1, 11), (2, 10), (3, 12), (4, 13)], "ref_id, def_id"))
def resolve_paths(spark, d):
    """Paths segment by segment: the first in the nearest scope that has it, the others inside what the last gave."""
    scopes = _numbers(spark, d, [(1, None), (2, 1), (3, 1), (6, 2)], "node long, parent long", "node", "parent")
    paths = copies(spark, d, [(1, 6, ["b"]), (2, 6, ["a"]), (3, 6, ["m", "c"]), (4, 1, ["m", "b"]), (5, 1, ["m", "zz"]), (6, 1, ["nope"])], "ref_id long, node long, segments array<string>")
    paths = paths.withColumns({c: F.col(c) + F.col("n") * 100 for c in ("ref_id", "node")}).select("ref_id", "node", "segments")
    more = _numbers(spark, d, [(1, "m", 20)], "node long, name string, def_id long", "node", "def_id")
    bound = _bindings(spark, d).where("name in ('a', 'b', 'c')").select("node", "name", "def_id").unionByName(more)
    inner = _numbers(spark, d, [(20, 3)], "def_id long, opens long", "def_id", "opens")
    return resolve.resolve_paths(paths, bound, scopes, inner)


@query("resolve_records", copies_sql("ref_id + n * 100 AS ref_id, candidates, certainty, gaps", [(1, 1, "resolved", ""), (2, 2, "possible", "ambiguous"), (3, 1, "possible", "conditional_compilation"), (4, 0, "possible", "missing_definition"), (5, 0, "possible", "external_definition"), (6, 0, "possible", "dynamic_dispatch")], "ref_id, candidates, certainty, gaps"))
def resolve_records(spark, d):
    """Certainty and gaps of references by their candidates."""
    refs = _numbers(spark, d, [(1, False, False, False), (2, False, False, False), (3, True, False, False), (4, False, False, False), (5, False, True, False), (6, False, False, True)], "ref_id long, conditional boolean, external boolean, dynamic boolean", "ref_id")
    found = _numbers(spark, d, [(1, 7), (2, 7), (2, 8), (2, 8), (3, 9)], "ref_id long, def_id long", "ref_id")
    return resolve.records(refs, found).select("ref_id", "candidates", "certainty", F.concat_ws(",", "gaps").alias("gaps"))


@query("resolve_methods", copies_sql("ref_id + n * 100 AS ref_id, def_id, dynamic", [(1, 1, False), (1, 2, False), (2, None, True), (3, None, True), (4, 3, False)], "ref_id, def_id, dynamic"))
def resolve_methods(spark, d):
    """Methods by receiver type, and items by owner."""
    definitions = spark.createDataFrame([(1, "T", "method", "go"), (2, "T", "method", "go"), (3, "U", "method", "go"), (4, "T", "constant", "N")], "def_id long, owner string, kind string, name string")
    calls = _numbers(spark, d, [(1, "T", "go"), (2, None, "go"), (3, "T", "N"), (4, "U", "go")], "ref_id long, receiver string, name string", "ref_id")
    return resolve.methods(calls, definitions)


@query("resolve_units", copies_sql("concat(k, unit) AS unit, name, CASE WHEN outside THEN target ELSE concat(k, target) END AS target", [("u", "my_crate", "u", False), ("u", "re_named", "v", True), ("v", "v", "v", False)], "unit, name, target, outside"))
def resolve_units(spark, d):
    """What each unit calls the units that it may name."""
    units = copies(spark, d, [("u", "my-crate"), ("v", "v")], "unit string, package string").select(F.concat("k", "unit").alias("unit"), "package")
    needs = copies(spark, d, [("u", "re-named", "v")], "unit string, name string, target string").select(F.concat("k", "unit").alias("unit"), "name", "target")
    return resolve.unit_names(needs, units)


REPORT = {
    "units": [("u",)], "files": [("u", "a.rs", 9)],
    "definitions": [(1, "u", "a.rs", "function", "f", 0, 0, 3, 1, None), (2, "u", "a.rs", "function", "g", 4, 0, 9, 1, None), (3, "u", "b.rs", "struct", "S", 0, 0, 0, 1, 1), (3, "u", "a.rs", "struct", "S", 5, 2, 5, 1, None)],
    "references": [(1, "u", "a.rs", "call", 1, 0, 1, 4, 1), (2, "u", "a.rs", "call", 2, 0, 2, 4, 1)],
    "resolutions": [(1, 1, "resolved"), (1, 2, "resolved"), (2, 9, "possible"), (7, 1, "possible")],
}
_REPORT = {"units": "unit string", "files": "unit string, path string, lines int", "definitions": "def_id long, unit string, path string, kind string, name string, line int, col int, end_line int, end_col int, parent long", "references": "ref_id long, unit string, path string, kind string, line int, col int, end_line int, end_col int, owner long", "resolutions": "ref_id long, def_id long, certainty string"}
_WRONG = [("definition-stated-twice", 3), ("record-without-reference", 7), ("unknown-definition", 2), ("resolved-more-than-once", 1), ("definition-outside-its-file", 2), ("definition-outside-its-file", 3), ("definition-outside-its-file", 3), ("parent-of-another-file", 3)]


@query("report_problems", f"SELECT kind, CAST(id AS BIGINT) AS id FROM {values(_WRONG, 'kind, id')}")
def report_problems(spark, d):
    """A report written as JSON, read back within its limits and held against itself."""
    where = scratch.path(spark, "report")
    frames = {k: spark.createDataFrame(rows, _REPORT[k]) for k, rows in REPORT.items()}
    whole = None
    for k, f in frames.items():
        one = f.agg(F.collect_list(F.struct(*f.columns)).alias(k))
        whole = one if whole is None else whole.crossJoin(one)
    whole.write.json(where)
    return reports.problems(reports.read_report(spark, where))


# ---------------------------------------------------------------- places, snippets, declarations

# source, line, col0, byte offset (null: no such place)
PLACES = [("ab\ncd", 1, 0, 0), ("ab\ncd", 2, 1, 4), ("é\nüx", 2, 1, 5), ("é\nüx", 1, 1, 2), ("ab", 1, 2, 2), ("ab", 1, 3, None), ("ab", 2, 0, None), ("", 1, 0, 0), ("a\n\nb", 2, 0, 2), ("a\n", 2, 0, 2)]


@query("place_offsets", f"SELECT CAST(p_partkey AS BIGINT) AS id, CAST(byte AS INT) AS byte, CASE WHEN byte IS NOT NULL THEN line END AS line, CASE WHEN byte IS NOT NULL THEN col0 END AS col0 FROM part JOIN {values([(k, *r) for k, r in enumerate(PLACES)], 'k, source, line, col0, byte')} ON p_partkey % {len(PLACES)} = k")
def place_offsets(spark, d):
    """Line and column to byte offset and back."""
    from factloom.plans.planted import dealt

    p = dealt(spark, d, "part", "p_partkey", [(k, *r[:3]) for k, r in enumerate(PLACES)], "k int, source string, line int, col0 int", len(PLACES))
    p = p.withColumn("byte", S.byte_offset(F.col("source"), F.col("line"), F.col("col0")))
    back = S.place_of(F.col("source"), F.col("byte"))
    return p.select("id", "byte", back["line"].alias("line"), back["col0"].alias("col0"))


# path, root, confined; qualified path, sink; method, mutation; type, copied
SMALL = [
    ("r/a/../b.rs", "r", True, "std::net::TcpStream::connect", "network", "push_str", True, "u8", True),
    ("r/../b.rs", "r", False, "a::process::net::run", "network", "len", False, "String", False),
    ("../r/b.rs", "r", False, "std::process::Command::new", "process_exec", "sort_by_key", True, "usize", True),
    ("r", "r", True, "net", None, "Push", False, "char", True),
    ("rr/b", "r", False, "a::b::net", None, "clear", True, "str", False),
    ("./r/./x", "r", True, "", None, "", False, "", False),
]


@query("small_judgements", f"SELECT CAST(p_partkey AS BIGINT) AS id, confined, sink, mutates, copied FROM part JOIN {values([(k, *r) for k, r in enumerate(SMALL)], 'k, path, root, confined, callee, sink, method, mutates, type, copied')} ON p_partkey % {len(SMALL)} = k")
def small_judgements(spark, d):
    """Confinement of paths, sinks by module, mutating methods and copied types."""
    from factloom.plans.planted import dealt

    given = [(k, r[0], r[1], r[3], r[5], r[7]) for k, r in enumerate(SMALL)]
    p = dealt(spark, d, "part", "p_partkey", given, "k int, path string, root string, callee string, method string, type string", len(SMALL))
    c = F.col
    return p.select("id", S.confined(c("path"), c("root")).alias("confined"), S.sink_capability(c("callee")).alias("sink"), S.is_mutation(c("method")).alias("mutates"), S.is_copy_type(c("type")).alias("copied"))


DECLARED = [
    ("a.py", "python", "class A:\n    def f(self):\n        return 1\n\ndef h():\n    pass\n", [("class", "A", 0, 42), ("method", "f", 13, 42), ("function", "h", 44, 61)]),
    ("b.go", "go", "func f() { s := \"}\" }\nfunc (t *T) m() {\n}\n", [("function", "f", 0, 21), ("method", "m", 22, 41)]),
    ("c.js", "java_script", "function a() { }\nclass C { }\n", [("function", "a", 0, 16), ("class", "C", 17, 28)]),
    ("d.sh", "bash", "f() {\n echo '}'\n}\n", [("function", "f", 0, 17)]),
    ("e.rs", "rust", "struct S { a: u8 }\nfn g() { }\n", [("struct", "S", 0, 18), ("function", "g", 19, 29)]),
]


def _declared(spark, d) -> DataFrame:
    return copies(spark, d, [r[:3] for r in DECLARED], "inner string, language string, source string").select(below("inner").alias("path"), "language", "source")


@query("declarations_found", copies_sql("concat(k, '/', \"inner\") AS file, kind, name, CAST(\"start\" AS INT) AS start, CAST(\"end\" AS INT) AS end", [(r[0], *x) for r in DECLARED for x in r[3]], '"inner", kind, name, "start", "end"'))
def declarations_found(spark, d):
    """Declarations of five languages with their byte ranges."""
    return declarations.declarations(_declared(spark, d)).select("file", "kind", "name", "start", "end")


@query("declarations_attributed", copies_sql("concat(k, '/', \"inner\") AS file, line, symbol", [("a.py", 3, "f"), ("a.py", 4, None), ("a.py", 6, "h"), ("b.go", 1, "f"), ("d.sh", 2, "f"), ("e.rs", 1, None), ("e.rs", 2, "g")], '"inner", line, symbol'))
def declarations_attributed(spark, d):
    """Findings by the callable that holds them."""
    found = copies(spark, d, [("a.py", 3), ("a.py", 4), ("a.py", 6), ("b.go", 1), ("d.sh", 2), ("e.rs", 1), ("e.rs", 2)], "inner string, line int").select(below("inner").alias("file"), "line", F.lit(1).alias("col"))
    return declarations.attributed(found, _declared(spark, d)).select("file", "line", "symbol")


@query("snippet_envelopes", copies_sql("concat(k, '/', \"inner\") AS file, kind, name, concat('{\"version\":1,\"location\":{\"file\":\"', k, '/', \"inner\", '\",\"line\":', line, ',\"start\":', \"start\", ',\"end\":', \"end\", '},\"kind\":\"', kind, '\",\"name\":\"', name, '\",\"text\":\"', text, '\"}') AS value", [("e.rs", "struct", "S", 1, 0, 18, "struct S { a: u8 }"), ("e.rs", "function", "g", 2, 19, 29, "fn g() { }")], '"inner", kind, name, line, "start", "end", text'))
def snippet_envelopes(spark, d):
    """Units of the Rust sources as JSON."""
    files = _declared(spark, d).where("language = 'rust'")
    return sinks.snippets(declarations.declarations(files), files).select("file", "kind", "name", "value")


@query("reachable_functions", copies_sql("concat(k, '/a.rs') AS file, name", [("main",), ("f",), ("h",)], "name"))
def reachable_functions(spark, d):
    """Functions that an entry point reaches; one that only calls itself is none."""
    fns = copies(spark, d, [("main", False, False), ("f", False, False), ("g", False, False), ("h", True, False)], "name string, is_public boolean, is_test boolean").withColumn("file", F.concat("k", F.lit("/a.rs")))
    calls = copies(spark, d, [("main", "f"), ("g", "g")], "caller string, callee string").withColumn("file", F.concat("k", F.lit("/a.rs")))
    return flows.reachable_functions(fns, calls)


@query("reachable_findings", copies_sql("concat(k, '/a.rs') AS file, line, reachable", [(1, None), (7, False), (30, True)], "line, reachable"))
def reachable_findings(spark, d):
    """Findings by whether the function that starts last ahead of them is reachable."""
    at = lambda rows, schema: copies(spark, d, rows, schema).withColumn("file", F.concat("k", F.lit("/a.rs"))).drop("k", "n")
    found = at([(1, None), (7, None), (30, None)], "line int, reachable boolean")
    return capability.annotate_reachable(found, at([("f", 5), ("g", 20)], "name string, line int"), at([("g",)], "name string"))


# ---------------------------------------------------------------- index upkeep

FIRST = [(1, "a.py", "create", "import socket\n"), (2, "build.rs", "create", "fn main() { std::net::TcpStream::connect(\"x\"); std::process::Command::new(\"y\"); }\n"), (3, "b.sh", "create", "curl x\n"), (4, "c.py", "create", "x = 1\n")]
SECOND = [(5, "a.py", "modify", "import hashlib\n"), (6, "b.sh", "remove", None), (7, "c.py", "modify", None), (8, "d.js", "create", "fetch(x)\n")]


@query("index_crates", copies_sql("k AS crate, 4 AS files, 1 AS degraded, findings, capabilities, verdicts", [(4, "crypto,network,process_exec", "build-script-download-exec,build-script-exec,build-script-network")], "findings, capabilities, verdicts"))
def index_crates(spark, d):
    """Two batches of changes to an index, and what follows for each crate: findings, capabilities and verdicts are redone."""
    where = scratch.path(spark, "index")
    for batch in (FIRST, SECOND):
        rows = copies(spark, d, batch, "seq long, inner string, op string, source string")
        changes.reindex(spark, where, rows.select("seq", F.col("k").alias("crate"), below("inner").alias("path"), "op", "source"))
    return changes.read_crates(spark, where).select("crate", "files", "degraded", "findings", F.concat_ws(",", "capabilities").alias("capabilities"), F.concat_ws(",", "verdicts").alias("verdicts"))


@query("index_files", copies_sql("concat(k, '/', \"inner\") AS path, source, degraded", [("a.py", "import hashlib\n", None), ("build.rs", FIRST[1][3], None), ("c.py", "x = 1\n", "unreadable"), ("d.js", "fetch(x)\n", None)], '"inner", source, degraded'))
def index_files(spark, d):
    """The files of the index after both batches: one that cannot be read keeps its last source, marked."""
    held = spark.createDataFrame([], changes.INDEX)
    for batch in (FIRST, SECOND):
        rows = copies(spark, d, batch, "seq long, inner string, op string, source string").select("seq", F.col("k").alias("crate"), below("inner").alias("path"), "op", "source")
        held = materialise(changes.apply(held, rows), "index-state")
    return held.select("path", "source", "degraded")


@query("index_reuse", "SELECT concat(source, '/', doc_id) AS path, CAST(strlen(text) AS INT) AS n FROM documents")
def index_reuse(spark, d):
    """Projections of the files that have not changed are taken over; the others are made anew."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"), "doc_id")
    derive = lambda rows: rows.select("path", F.octet_length("source").alias("n"))
    nothing = spark.createDataFrame([], "path string, n int, claim string")
    before = materialise(reuse(docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("source"))).drop("doc_id"), nothing, derive), "projections")
    return reuse(docs.drop("doc_id"), before, derive).select("path", "n")


# ---------------------------------------------------------------- tools, sets and outputs


@query("tool_violations", "SELECT 'match-in-if' AS code, file, line, col + 1 AS col FROM {s} s WHERE kind = 'match' AND parent_branch = 'if'", s=A.STATEMENTS)
def tool_violations(spark, d):
    """Violations of one check, through the registry of tools."""
    rows = style.branching(_statements(spark, d).withColumnRenamed("flag", "has_else"), style.Config())
    return tools.dispatch("query_violations", rows, check="match-in-if", category="nesting").drop("detail")


@query("tool_verdicts", "SELECT crate, 'proc-macro-network' AS rule, 'deny' AS severity FROM {f} f WHERE crate = 'crate1' GROUP BY crate HAVING bool_or(capability = 'proc_macro') AND bool_or(capability = 'network')", f=A.FINDINGS)
def tool_verdicts(spark, d):
    """Verdicts of one crate."""
    v = gate.verdicts(_findings(spark, d), None, ["crate"])
    return tools.query_gate_verdicts(v, "crate1").where("rule = 'proc-macro-network'").select("crate", "rule", "severity")


@query("tool_explain", "SELECT 'max-depth' AS code, 'Excessive nesting depth' AS description, 'nesting' AS category, false AS generated")
def tool_explain(spark, d):
    return tools.explain_finding(spark, "max-depth").drop("ord")


@query("capability_changes", "SELECT 'new' AS change, capability FROM (SELECT DISTINCT capability FROM {n} a WHERE capability <> 'crypto') x WHERE capability NOT IN (SELECT capability FROM {o} b WHERE capability <> 'network') UNION ALL SELECT 'dropped', capability FROM (SELECT DISTINCT capability FROM {o} c WHERE capability <> 'network') y WHERE capability NOT IN (SELECT capability FROM {n} e WHERE capability <> 'crypto')", n=_NEW, o=_OLD)
def capability_changes(spark, d):
    """Capabilities that one side has alone; the sides are cut so that each has one."""
    return sets.capability_changes(A.frame(spark, d, _OLD).where("capability <> 'network'"), A.frame(spark, d, _NEW).where("capability <> 'crypto'"))


@query("diff_is_empty", "SELECT true AS is_empty")
def diff_is_empty(spark, d):
    """A profile differs in nothing from itself, repeats and nulls included."""
    f = _findings(spark, d)
    return sets.is_empty_diff(sets.diff(f, f, ["crate", *sets.FINDING]))


@query("method_test_api", "SELECT 'ungated-test-api' AS code, file, line, col + 1 AS col, name AS detail FROM {f} f WHERE name LIKE 'f%7'", f=A.FUNCTIONS)
def method_test_api(spark, d):
    """Functions by a name pattern under ``src`` that no feature gates."""
    return style.ungated_test_api(_functions(spark, d).withColumn("gates", F.array().cast("array<string>")), ["f*7"], "test")


_DEEP = "SELECT concat(file, ':', line, ':', col + 1, ': max-depth') AS value FROM {s} s WHERE kind <> 'closure' AND depth > 3"


@query("output_text", f"{_DEEP} UNION ALL SELECT concat('Found ', count(*), ' violation(s)') FROM {{s}} t WHERE kind <> 'closure' AND depth > 3", s=A.STATEMENTS)
def output_text(spark, d):
    """The text report, its count included."""
    return sinks.text_report(style.max_depth(_statements(spark, d), style.Config()))


@query("output_json", "SELECT concat('{{\"code\":\"max-depth\",\"file\":\"', file, '\",\"line\":', line, ',\"col\":', col + 1, ',\"detail\":\"', depth, '\"}}') AS value FROM {s} s WHERE kind <> 'closure' AND depth > 3".replace("{{", "{").replace("}}", "}"), s=A.STATEMENTS)
def output_json(spark, d):
    return sinks.json_rows(style.max_depth(_statements(spark, d), style.Config()))


@query("output_gate", f"SELECT 0 AS ord, '::notice title=module-boundary::analysis tier: syntactic; targets: lib' AS value UNION ALL SELECT 1, '::error title=build-script-network::{dict((n, r) for n, _, r in vocab.GATE_RULES)['build-script-network']}' FROM {{f}} f WHERE capability = 'network' AND execution_context = 'build_hook' GROUP BY crate", f=A.FINDINGS)
def output_gate(spark, d):
    """The notice of a project's gate, and a workflow command for each verdict of one rule."""
    v = gate.verdicts(_findings(spark, d), None, ["crate"]).where("rule = 'build-script-network'")
    return sinks.project_gate_annotations(v, "syntactic", ["lib"])


@query("output_ci", "SELECT 0 AS ord, 'status=new-capability' AS value UNION ALL SELECT 1, 'report=/r.json'")
def output_ci(spark, d):
    rows = spark.createDataFrame([("new-dependency",), ("new-capability",), ("analysis-incomplete",)], "level string")
    return sinks.ci_outputs(supply.overall(rows), "/r.json")


@query("supply_prior", "SELECT name, version, CASE WHEN v > 0 THEN concat('1.', (v - 1) // 7, '.', (v - 1) % 7) END AS prior_version FROM (SELECT DISTINCT p_brand AS name, concat('1.', CAST((p_size - p_size % 7) / 7 AS INT), '.', p_size % 7) AS version, p_size AS v FROM part WHERE p_size % 2 = 0) x WHERE 1 = 0 UNION ALL SELECT a.name, a.version, max(b.version) FILTER (b.v = m) FROM (SELECT a.*, (SELECT max(v) FROM (SELECT DISTINCT p_brand AS name, p_size AS v FROM part WHERE p_size % 3 = 0) c WHERE c.name = a.name AND c.v < a.v) AS m FROM (SELECT DISTINCT p_brand AS name, concat('1.', CAST((p_size - p_size % 7) / 7 AS INT), '.', p_size % 7) AS version, p_size AS v FROM part) a) a LEFT JOIN (SELECT DISTINCT p_brand AS name, concat('1.', CAST((p_size - p_size % 7) / 7 AS INT), '.', p_size % 7) AS version, p_size AS v FROM part WHERE p_size % 3 = 0) b ON a.name = b.name AND a.m = b.v GROUP BY a.name, a.version")
def supply_prior(spark, d):
    """The newest strictly older baseline of every attested version."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("name"), F.expr("concat('1.', CAST((p_size - p_size % 7) / 7 AS INT), '.', p_size % 7)").alias("version"), "p_size").distinct()
    return supply.prior_baseline(p.select("name", "version"), p.where("p_size % 3 = 0").select("name", "version"))


@query("supply_fails", "SELECT true AS fail")
def supply_fails(spark, d):
    rows = spark.createDataFrame([("new-dependency",), ("new-capability",)], "level string")
    return supply.should_fail(rows, "new-dependency")


@query("supply_build_hooks", copies_sql("concat(k, '/', \"inner\") AS path, build_hook", [("build.rs", True), ("src/a.rs", False)], '"inner", build_hook'))
def supply_build_hooks(spark, d):
    """Sources that only build scripts reach."""
    rows = copies(spark, d, [("build.rs", True), ("src/a.rs", True), ("src/a.rs", False), ("build.rs", True)], "inner string, is_build boolean").select(below("inner").alias("path"), "is_build")
    return supply.build_hook_sources(rows)
