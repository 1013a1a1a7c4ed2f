"""Text scanners: capability findings from the lines of sources and manifests.

A file becomes lines once; every rule is then a filter on lines, joined by
``unionByName``. Columns: those of a finding, and ``ord`` within a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.plans import vocab
from factloom.scratch import materialise

COLUMNS = ["capability", "file", "line", "col", "evidence", "origin", "language", "execution_context", "reachable"]


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text: as split at newlines, a carriage return before one dropped, no last empty line."""
    split = F.split(F.coalesce("source", F.lit("")), "\n")
    rows = files.select(*[c for c in files.columns if c != "source"], F.posexplode(F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)).alias("at", "text"))
    return rows.withColumn("line", F.col("at") + 1).withColumn("text", F.regexp_replace("text", "\r$", "")).drop("at")


def _hits(rows: DataFrame, cases: list[tuple[Column, str, str]]) -> DataFrame:
    """One row for each case (column in the line or null, capability, evidence) that a line has.

    The pattern table is part of the expression: places are found by case, and what a case means is looked up by its number.
    """
    places = F.transform(F.array(*[at.cast("int") for at, _, _ in cases]), lambda at, i: F.struct(i.alias("case"), at.alias("col")))
    found = rows.select("path", "line", F.explode(F.filter(places, lambda x: x["col"].isNotNull())).alias("_x"))
    of = lambda k: F.get(F.array(*[F.lit(c[k]) for c in cases]), F.col("_x.case"))
    return found.select("path", "line", F.struct(of(1).alias("capability"), F.col("_x.col").alias("col"), of(2).alias("evidence")).alias("hit"))


def _finding(rows: DataFrame, origin: str, language, context=None) -> DataFrame:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return rows.select(
        F.col("hit.capability"), F.col("path").alias("file"), F.col("line").cast("int").alias("line"), F.col("hit.col").cast("int").alias("col"), F.col("hit.evidence"),
        text(origin).alias("origin"), text(language).alias("language"), text(context).alias("execution_context"), F.lit(None).cast("boolean").alias("reachable"),
    )


def _hit(capability, column, evidence) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(capability).alias("capability"), lit(column).cast("int").alias("col"), lit(evidence).alias("evidence"))


def _first_module(name: Column, language: str) -> Column:
    """The first known module (m) that a name is or lies under, with its capability (c); null if none."""
    known = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c).alias("c")) for m, c in vocab.IMPORTS[language]])
    return F.get(F.filter(known, lambda x: (name == x["m"]) | name.startswith(F.concat(x["m"], F.lit("/")))), F.lit(0))


def call_sites(rows: DataFrame, language: str, tag: str | None = None) -> DataFrame:
    """The first place of each pattern in each line."""
    cases = [(F.when(F.col("text").contains(p), F.octet_length(F.substring_index("text", p, 1)) + 1), c, e) for p, c, e in vocab.CALLS[language]]
    return _finding(_hits(rows, cases), "code_site", tag or language)


def python(rows: DataFrame) -> DataFrame:
    """Imports (a line may match several modules), then calls. ``rows`` as ``lines`` gives them, here and below."""
    cases = [(F.when(S.python_import(F.col("text"), m), 1), c, m) for m, c in vocab.IMPORTS["python"]]
    return _finding(_hits(rows, cases), "import", "python").unionByName(call_sites(rows, "python"))


def java_script(rows: DataFrame, tag: str = "java_script") -> DataFrame:
    """Imports (the first matching module only), then calls."""
    rows = rows.withColumn("module", S.js_module(F.col("text")))
    imports = rows.withColumn("found", _first_module(F.col("module"), "java_script")).where("found is not null").withColumn("hit", _hit(F.col("found.c"), 1, F.col("found.m")))
    return _finding(imports, "import", tag).unionByName(call_sites(rows, "java_script", tag))


def go(rows: DataFrame) -> DataFrame:
    """Imports, alone or in a block, then calls; repeats of a place and capability count once."""
    rows = rows.withColumn("trimmed", S.strip(F.col("text")))
    opens = F.col("trimmed").rlike("^import\\s*\\(")
    closes = F.col("trimmed").startswith(")")
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # The last line ahead that could open or close a block says whether this one is inside: an import line opens only outside, a closing line closes only inside.
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order)
    rows = rows.withColumn("inside", F.coalesce(state, F.lit(False)))
    spec = F.when(F.col("inside"), F.when(~closes & (F.col("trimmed") != "") & ~F.col("trimmed").startswith("//"), F.col("trimmed"))).when(F.col("trimmed").startswith("import") & ~opens, F.substr("trimmed", F.lit(7)))
    rows = rows.withColumn("package", S.go_package(spec))
    imports = rows.withColumn("found", _first_module(F.col("package"), "go")).where("found is not null")
    imports = _finding(imports.withColumn("hit", _hit(F.col("found.c"), 1, F.col("package"))), "import", "go")
    return imports.unionByName(call_sites(rows, "go").dropDuplicates(["file", "line", "col", "capability"]))


SHELL = [(c, cap) for group, cap in ((vocab.SHELL_NETWORK, "network"), (vocab.SHELL_WRITE, "file_write"), (vocab.SHELL_EXEC, "process_exec"), (vocab.SHELL_ENV, "env_access"), (vocab.SHELL_CRYPTO, "crypto")) for c in group]
RECIPES = [*((c, "network") for c in vocab.SHELL_NETWORK), *((c, "process_exec") for c in vocab.SHELL_EXEC), *((c, "process_exec") for c in vocab.HOOK_INTERPRETERS)]


def _commands(rows: DataFrame, patterns) -> DataFrame:
    return _hits(rows, [(F.nullif(S.shell_position(F.col("text"), c), F.lit(0)), cap, c) for c, cap in patterns])


def bash(rows: DataFrame) -> DataFrame:
    """Commands at word borders of lines that are neither empty nor comments."""
    rows = rows.withColumn("text", S.strip(F.col("text"))).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    return _finding(_commands(rows, SHELL), "code_site", "bash")


def manifests(rows: DataFrame) -> DataFrame:
    """Hooks of package.json, setup.py, pyproject.toml, make and just files, and generator directives of Go sources."""
    name = S.file_name(F.col("path"))
    rows = rows.withColumns({"name": name, "trimmed": S.strip(F.col("text"))})
    quoted = F.col("text").contains('"scripts"')
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    npm = rows.where("name = 'package.json'").withColumn("open", F.max(quoted).over(order)).withColumn("first", F.sum(quoted.cast("int")).over(order)).where("open")
    # On the line of the first "scripts" key, only what follows the key counts.
    rest = F.when(quoted & (F.col("first") == 1), F.expr("substr(text, locate('\"scripts\"', text))")).otherwise(F.col("text"))
    npm = _hits(npm.withColumn("text", rest), [(F.when(F.col("text").contains(f'"{h}"'), 1), "process_exec", h) for h in vocab.NPM_HOOKS])
    setup = rows.where("name = 'setup.py' and contains(text, 'cmdclass')").withColumn("hit", _hit("process_exec", 1, "cmdclass"))
    project = rows.where("name = 'pyproject.toml'")
    local = project.where(F.col("trimmed").startswith("backend-path")).select("path").distinct()
    backend = project.where(F.col("trimmed").startswith("build-backend")).join(local, "path", "left_semi").withColumn("hit", _hit("process_exec", 1, "custom build-backend with backend-path"))
    generate = rows.where((S.extension(F.col("path")) == "go") & F.col("trimmed").startswith("//go:generate ")).withColumn("hit", _hit("process_exec", 1, F.col("trimmed")))
    make = rows.where(F.col("name").isin("Makefile", "makefile", "GNUmakefile", "justfile", "Justfile"))
    make = make.where(F.col("text").startswith("\t") | (F.col("text").startswith("    ") & ~F.col("trimmed").endswith(":"))).where((F.col("trimmed") != "") & ~F.col("trimmed").startswith("#"))
    parts = [
        _finding(npm, "manifest_hook", None, "install_hook"),
        _finding(setup, "manifest_hook", "python", "build_hook"),
        _finding(backend, "manifest_hook", "python", "build_hook"),
        _finding(generate, "manifest_hook", "go", "generator"),
        _finding(_commands(make.withColumn("text", F.col("trimmed")), RECIPES), "manifest_hook", "bash", "build_hook"),
    ]
    return reduce(DataFrame.unionByName, parts)


def analyze(files: DataFrame, structured: bool = False) -> DataFrame:
    """All findings of files with path, source and language (see ``sources.files.classified``).

    Sources are split to lines once, and the lines of files that any scanner
    reads are written to scratch; every scanner reads that table. With
    ``structured``, imports, calls through aliases and shell commands come from
    ``operators.structured`` in place of the line scanners' imports and commands.
    """
    from factloom.operators import structured as tokens
    from factloom.operators.literals import literal_findings

    wanted = F.col("language").isNotNull() | S.file_class(F.col("path")).isin("manifest", "source_and_manifest")
    rows = materialise(lines(files.where(wanted).select("path", "language", "source")), "lines")
    of = lambda name: rows.where(F.col("language") == name)
    if structured:
        parts = [tokens.findings(files), *[call_sites(of(n), "java_script" if n == "type_script" else n, n) for n in ("python", "java_script", "type_script")]]
        parts.append(call_sites(of("go"), "go").dropDuplicates(["file", "line", "col", "capability"]))
        found = reduce(DataFrame.unionByName, parts).dropDuplicates(["file", "line", "col", "capability", "evidence", "origin"])
        parts = [found]
    else:
        parts = [python(of("python")), java_script(of("java_script")), java_script(of("type_script"), "type_script"), go(of("go")), bash(of("bash"))]
    return reduce(DataFrame.unionByName, [*parts, manifests(rows), literal_findings(files)])
