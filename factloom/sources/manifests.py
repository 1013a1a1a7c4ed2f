"""Cargo manifests as tables: packages, targets, dependencies and features.

Manifests are parsed where they lie (``mapInArrow`` over path and source); the
rest is joins: inheritance from the workspace, member globs, target discovery,
selection of dependencies to a fixpoint.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.scratch import materialise
from factloom.ship import ship

#: Manifests of one project that are loaded.
CEILING = 4096
_TABLES = {"dependencies": "normal", "dev-dependencies": "development", "build-dependencies": "build"}


def _rows(path: str, source: str) -> list[tuple]:
    """(path, kind, name, json) rows of a manifest; a broken one gives one row of kind error."""
    try:
        m = tomllib.loads(source)
    except tomllib.TOMLDecodeError as e:
        return [(path, "error", None, json.dumps({"message": str(e)}))]
    out = []
    package, workspace = m.get("package"), m.get("workspace")
    inherited = lambda v: isinstance(v, dict) and v.get("workspace") is True
    if package is not None:
        plain = {k: None if inherited(package.get(k)) else package.get(k) for k in ("version", "edition", "rust-version")}
        plain["inherits"] = [k for k in ("version", "edition", "rust-version") if inherited(package.get(k))]
        plain["build"] = package.get("build")
        plain["autobins"] = package.get("autobins", True)
        out.append((path, "package", package.get("name"), json.dumps(plain)))
        for kind in ("lib", "bin", "example", "test", "bench"):
            given = m.get(kind, [])
            for t in [given] if isinstance(given, dict) else given:
                out.append((path, "target", t.get("name"), json.dumps({"kind": kind, "path": t.get("path")})))
        for name, needs in m.get("features", {}).items():
            out.append((path, "feature", name, json.dumps({"needs": needs})))
        conditional = [(f"cfg:{cfg}", t) for cfg, t in m.get("target", {}).items()]
        for condition, tables in [(None, m), *conditional]:
            for table, kind in _TABLES.items():
                for name, spec in tables.get(table, {}).items():
                    spec = spec if isinstance(spec, dict) else {"version": spec}
                    out.append((path, "dependency", name, json.dumps({"kind": kind, "condition": condition, "package": spec.get("package"), "path": spec.get("path"), "optional": bool(spec.get("optional")), "inherits": spec.get("workspace") is True})))
    if workspace is not None:
        out.append((path, "workspace", None, json.dumps({"members": workspace.get("members", []), "exclude": workspace.get("exclude", [])})))
        for k, v in workspace.get("package", {}).items():
            out.append((path, "shared", k, json.dumps({"value": v if isinstance(v, str) else json.dumps(v)})))
        for name, spec in workspace.get("dependencies", {}).items():
            spec = spec if isinstance(spec, dict) else {"version": spec}
            out.append((path, "shared-dependency", name, json.dumps({"package": spec.get("package"), "path": spec.get("path")})))
    return out


def parse(files: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """path, kind, name, body (JSON) rows of all Cargo.toml files among (path, source); more of them than the ceiling are refused."""
    import pyarrow as pa

    ship(files.sparkSession)
    if (n := files.where(S.file_name(F.col("path")) == "Cargo.toml").count()) > ceiling:
        raise ValueError(f"the project has {n} manifests, more than {ceiling}")

    def run(batches):
        for b in batches:
            out = [r for p, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in _rows(p, s or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["path", "kind", "name", "body"])

    rows = files.where(S.file_name(F.col("path")) == "Cargo.toml").select("path", "source")
    return rows.mapInArrow(run, "path string, kind string, name string, body string")


def _of(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("path", "name", F.from_json("body", schema).alias("b")).select("path", "name", "b.*")


def directory(path) -> F.Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def with_ancestors(rows: DataFrame, path, name: str) -> DataFrame:
    """A row for each folder that a path lies in or is, the root (an empty path) included: what joins on prefixes by equality."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.withColumn(name, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), up))))


def packages(rows: DataFrame) -> DataFrame:
    """path, directory, name, version, edition, rust_version: what a package leaves to its workspace comes from the nearest one above."""
    own = _of(rows, "package", "version string, edition string, `rust-version` string, inherits array<string>, build string, autobins boolean").withColumn("directory", directory(F.col("path")))
    shared = rows.where("kind = 'shared'").select(directory(F.col("path")).alias("_root"), F.col("name").alias("_key"), F.get_json_object("body", "$.value").alias("_value"))
    held = shared.groupBy("_root").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("_shared"))
    up = with_ancestors(own, F.col("directory"), "_up")
    joined = up.join(held, F.col("_up") == F.col("_root"), "left").groupBy(*own.columns).agg(F.max_by("_shared", F.length("_root")).alias("_s"))
    pick = lambda c: F.when(F.array_contains("inherits", c), F.col("_s")[c]).otherwise(F.col(f"`{c}`"))
    return joined.select("path", "directory", "name", pick("version").alias("version"), pick("edition").alias("edition"), pick("rust-version").alias("rust_version"), "build", "autobins")


def dependencies(rows: DataFrame) -> DataFrame:
    """path, name, package, kind, condition, feature, target_path: one row for each declared edge.

    An optional dependency is behind the feature of its name; one that is
    inherited takes package and path from the workspace.
    """
    raw = rows.where("kind = 'dependency'").select("path", "name", F.from_json("body", "kind string, condition string, package string, path string, optional boolean, inherits boolean").alias("b"))
    d = raw.select("path", "name", F.col("b.kind").alias("kind"), F.col("b.condition").alias("condition"), F.col("b.package").alias("own_package"), F.col("b.path").alias("own_path"), F.col("b.optional").alias("optional"), F.col("b.inherits").alias("inherits"))
    shared = rows.where("kind = 'shared-dependency'").select(F.col("name").alias("_n"), directory(F.col("path")).alias("_root"), F.get_json_object("body", "$.package").alias("_package"), F.get_json_object("body", "$.path").alias("_path"))
    joined = d.join(shared, (F.col("name") == F.col("_n")) & F.col("inherits") & ((F.col("_root") == "") | F.col("path").startswith(F.concat("_root", F.lit("/")))), "left")
    own = lambda a, base: F.when(a.isNotNull(), F.concat_ws("/", F.when(base != "", base), a))
    target = F.coalesce(own(F.col("own_path"), directory(F.col("path"))), own(F.col("_path"), F.col("_root")))
    return joined.select("path", "name", F.coalesce("own_package", "_package", "name").alias("package"), "kind", "condition", F.when(F.col("optional"), F.col("name")).alias("feature"), normal(target).alias("target_path"))


def normal(path) -> F.Column:
    """A relative path with ``.`` and ``..`` resolved."""
    step = lambda held, part: F.when(part.isin("", "."), held).when((part == "..") & (F.size(held) > 0), F.slice(held, 1, F.size(held) - 1)).otherwise(F.concat(held, F.array(part)))
    return F.when(path.isNotNull(), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def features(rows: DataFrame) -> DataFrame:
    """package, feature, needs of every feature edge inside a package."""
    names = rows.where("kind = 'package'").select("path", F.col("name").alias("package"))
    return _of(rows, "feature", "needs array<string>").join(names, "path").select("package", F.col("name").alias("feature"), F.explode("needs").alias("needs"))


def members(rows: DataFrame) -> DataFrame:
    """root and directory of the members of each workspace: packages that a member glob matches and no exclude covers."""
    w = _of(rows, "workspace", "members array<string>, exclude array<string>").withColumn("root", directory(F.col("path")))
    p = rows.where("kind = 'package'").select(directory(F.col("path")).alias("directory")).distinct()
    inner = F.when(F.col("root") == "", F.col("directory")).when(F.col("directory").startswith(F.concat("root", F.lit("/"))), F.substr("directory", F.length("root") + 2))
    joined = with_ancestors(p, F.col("directory"), "root").join(w, "root").withColumn("inner", inner)
    segments = lambda g: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(g, "([.+(){}|^$\\[\\]\\\\])", "\\\\$1"), "\\*", "[^/]*"), F.lit("$"))
    hit = F.exists("members", lambda g: F.rlike(F.col("inner"), segments(g))) | (F.col("directory") == F.col("root"))
    out = F.exists("exclude", lambda g: (F.col("inner") == g) | F.col("inner").startswith(F.concat(g, F.lit("/"))))
    return joined.where(hit & ~F.coalesce(out, F.lit(False))).select("root", "directory").distinct()


def targets(rows: DataFrame, files: DataFrame) -> DataFrame:
    """directory, kind, name, path of the targets of each package: declared ones, and those that lie where targets lie."""
    p = packages(rows).select("directory", F.col("name").alias("package"), "build", "autobins")
    said = rows.where("kind = 'target'").select(directory(F.col("path")).alias("directory"), "name", F.get_json_object("body", "$.kind").alias("kind"), F.get_json_object("body", "$.path").alias("given"))
    full = lambda c: F.concat_ws("/", F.when(F.col("directory") != "", F.col("directory")), c)
    folder = S.one_of([("lib", "src/lib.rs"), ("bin", "src/bin/"), ("example", "examples/"), ("test", "tests/"), ("bench", "benches/")], F.col("kind"))
    usual = F.when(F.col("kind") == "lib", F.lit("src/lib.rs")).otherwise(F.concat(folder, F.col("name"), F.lit(".rs")))
    declared = said.join(p, "directory").select("directory", "kind", F.coalesce("name", "package").alias("name"), full(F.coalesce("given", usual)).alias("path"))
    at = with_ancestors(files.select("path").distinct(), directory(F.col("path")), "directory").join(p, "directory")
    inner = F.when(F.col("directory") == "", F.col("path")).otherwise(F.substr("path", F.length("directory") + 2))
    at = at.withColumn("inner", inner)
    stem = F.regexp_extract("inner", "([^/]+)\\.rs$", 1)
    found = at.select(
        "directory",
        F.when(F.col("inner") == "src/lib.rs", "lib").when((F.col("inner") == "src/main.rs") & F.col("autobins"), "bin").when(F.col("inner").rlike("^src/bin/[^/]+\\.rs$") & F.col("autobins"), "bin")
        .when(F.col("inner").rlike("^examples/[^/]+\\.rs$"), "example").when(F.col("inner").rlike("^tests/[^/]+\\.rs$"), "test").when(F.col("inner").rlike("^benches/[^/]+\\.rs$"), "bench")
        .when(F.col("inner") == F.coalesce("build", F.lit("build.rs")), "build").alias("kind"),
        F.when(F.col("inner").isin("src/lib.rs", "src/main.rs"), F.col("package")).when(F.col("inner") == F.coalesce("build", F.lit("build.rs")), F.lit("build-script")).otherwise(stem).alias("name"),
        "path",
    ).where("kind is not null")
    return declared.unionByName(found.join(declared.select("directory", "kind", "name"), ["directory", "kind", "name"], "left_anti").join(declared.select("directory", "path"), ["directory", "path"], "left_anti"))


def select_units(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """directory and conditions of every package that the roots (directory) reach over dependency edges (source, target, condition).

    A package is as widely active as any way to it: conditions are a set of
    alternatives, and the empty condition, ``always``, absorbs all others.
    """
    always = F.lit("")
    seen = materialise(roots.select("directory", always.alias("condition")).distinct(), "units")
    front = seen
    steps = materialise(edges.select(F.col("source").alias("directory"), "target", F.coalesce("condition", always).alias("step")), "unit-edges")
    while True:
        met = front.join(steps, "directory").select(F.col("target").alias("directory"), F.concat_ws("&", F.array_sort(F.array_distinct(F.filter(F.concat(F.split("condition", "&"), F.array("step")), lambda c: c != "")))).alias("condition")).distinct()
        # What a package that is always active would add is known already.
        whole = seen.where(F.col("condition") == always).select("directory")
        front = materialise(met.join(whole, "directory", "left_anti").join(seen, ["directory", "condition"], "left_anti"), "unit-front")
        if front.isEmpty():
            break
        seen = materialise(seen.unionByName(front), "units")
    sums = seen.groupBy("directory").agg(F.bool_or(F.col("condition") == always).alias("always"), F.array_sort(F.collect_set("condition")).alias("conditions"))
    return sums.select("directory", F.when(F.col("always"), F.array().cast("array<string>")).otherwise(F.col("conditions")).alias("conditions"))


def revision(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over the paths and contents of all manifests, in order."""
    rows = files.where(S.file_name(F.col("path")) == "Cargo.toml").select("path", F.sha2(F.col("source"), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat(x["path"], F.lit("\0"), x["h"])), "\n"), 256).alias("revision"), F.count("*").alias("manifests"))


def module_closure(roots: DataFrame, declared: DataFrame, files: DataFrame, depth: int = 256) -> tuple[DataFrame, DataFrame]:
    """(instances, problems): unit, module, path of all files that the roots (unit, path) declare by ``mod``, level by level.

    ``declared``: path, name. A file may belong to several units and modules;
    a declaration without a file, or with two, is a problem (path, name, problem).
    """
    from factloom.operators.resolve import candidate_modules

    stem = S.file_name(F.col("path")).isin("mod.rs", "lib.rs", "main.rs")
    inside = declared.withColumn("directory", F.when(stem, directory(F.col("path"))).otherwise(F.regexp_replace("path", "\\.rs$", "")))
    held = materialise(candidate_modules(inside.select("directory", "name").distinct(), files).join(inside.withColumnRenamed("path", "from"), ["directory", "name"]), "module-files")
    now = materialise(roots.select("unit", F.lit("crate").alias("module"), "path"), "modules")
    every, level = now, 0
    while True:
        level += 1
        now = materialise(now.join(held.where("problem is null").select(F.col("from").alias("path"), "name", F.col("path").alias("to")), "path").select("unit", F.concat_ws("::", "module", "name").alias("module"), F.col("to").alias("path")), "modules")
        if now.isEmpty():
            return every, held.where("problem is not null").select(F.col("from").alias("path"), "name", "problem")
        if level > depth:
            raise ValueError("modules are nested too deeply")
        every = materialise(every.unionByName(now), "modules")
