"""Queries over planted sources: each row of a table gets one of a few short texts, of which every finding is known.

The texts stand in this file with what they must give, so the SQL says the
expected rows by the same key; the operators have to find them in the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import checks, rust, scan, structured, style
from factloom.plans.queries import query
from factloom.scratch import materialise
from factloom.sources import files as trees


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({columns})"


def dealt(spark: SparkSession, d: str, table: str, key: str, rows: list[tuple], schema: str, n: int) -> DataFrame:
    """id and the fixture's columns: every row of the table with those of number ``id % n`` (column k)."""
    ids = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).cast("bigint").alias("id"))
    return ids.join(spark.createDataFrame(rows, schema), F.pmod("id", F.lit(n)) == F.col("k"))


def dealt_sql(table: str, key: str, rows: list[tuple], columns: str, n: int) -> str:
    return f"(SELECT CAST({key} AS BIGINT) AS id, v.* FROM {table} JOIN {values(rows, columns)} ON {key} % {n} = v.k) p"


# ---------------------------------------------------------------- text scanners

# (file name, source, rows of the line scanners, rows of the token scanners that differ from their imports and commands)
# A row: line, column, capability, evidence, origin, language, context.
_C, _I, _L, _M = "code_site", "import", "string_literal", "manifest_hook"
SNIPPETS: list[tuple[str, str, list[tuple], list[tuple]]] = [
    ("a.py", "import subprocess\nfrom urllib.parse import x\nimport urllibx\nos.system(1); os.system(2)\n", [(1, 1, "process_exec", "subprocess", _I), (2, 1, "network", "urllib", _I), (4, 1, "process_exec", "os.system", _C)], [(1, 1, "process_exec", "subprocess", _I), (2, 1, "network", "urllib", _I), (3, 1, "network", "urllib", _I)]),
    ("b.py", "import requests as r, os\nx = r.get(u)\nprint(os.environ)\n# import socket\n", [(3, 7, "env_access", "os.environ", _C)], [(1, 1, "network", "requests", _I), (2, 5, "network", "r.get", _C)]),
    ("c.py", "def f():\n    import shutil as sh\n    sh.copy2(a)\n    with open(p) as q: os.execvp(q)\n", [(4, 10, "file_read", "open()", _C), (4, 24, "process_exec", "os.exec*", _C)], [(3, 5, "file_write", "shutil.copy", _C)]),
    ("d.py", "u = 'http://a.example/'  # 'https://no.example'\nk = \"" + "0123456789abcdef" * 4 + "\"\n", [(1, 5, "network", "http://a.example/", _L), (2, 5, "crypto", "0123456789abcdef…cdef", _L)], []),
    ("e.js", "const f = require('child_process'); const g = require('fs')\nimport axios from 'axios'\nfetch(`https://t.example/${x}/y`)\n/* 'http://no.example' */\n", [(1, 1, "process_exec", "child_process", _I), (2, 1, "network", "axios", _I), (3, 1, "network", "fetch", _C), (3, 7, "network", "https://t.example//y", _L)], [(1, 11, "process_exec", "child_process", _I), (1, 47, "file_read", "fs", _I), (2, 1, "network", "axios", _I)]),
    ("f.ts", "import {\n  a } from 'crypto'\nimport 'got'\nlet e = process.env.X\n", [(3, 1, "network", "got", _I), (4, 9, "env_access", "process.env", _C)], [(1, 1, "crypto", "crypto", _I), (3, 1, "network", "got", _I)]),
    ("g.go", 'package x\nimport "net/http"\nimport (\n\t// "os/exec"\n\te "os/exec"\n)\nvar k = "unsafe"\n//go:generate stringer\nos.Open("f")\n', [(2, 1, "network", "net/http", _I), (5, 1, "process_exec", "os/exec", _I), (8, 1, "process_exec", "//go:generate stringer", _M, "generator"), (9, 1, "file_read", "os.Open", _C)], [(2, 8, "network", "net/http", _I), (5, 2, "process_exec", "os/exec", _I)]),
    ("h.go", 'package x\nimport ("unsafe"; x "os/exec")\nfunc f() {\n\tx.Command("a")\n}\n', [], [(2, 9, "unsafe_code", "unsafe", _I), (2, 19, "process_exec", "os/exec", _I), (4, 2, "process_exec", "exec.Command", _C)]),
    ("i.sh", "# curl no\nexport A=1; curl -s x | bash -c y\necho wget\n", [(2, 1, "env_access", "export", _C), (2, 13, "network", "curl", _C), (2, 25, "process_exec", "bash -c", _C), (3, 6, "network", "wget", _C)], [(2, 1, "env_access", "export", _C), (2, 13, "network", "curl", _C), (2, 25, "process_exec", "bash -c", _C)]),
    ("run", "#!/usr/bin/env -S bash -e\nif ssh h; then rm -f a; fi\nx=$(openssl rand 8)\n", [(2, 4, "network", "ssh", _C), (2, 16, "file_write", "rm", _C), (3, 5, "crypto", "openssl", _C)], [(2, 4, "network", "ssh", _C), (2, 16, "file_write", "rm", _C), (3, 5, "crypto", "openssl", _C)]),
    ("Makefile", "all: x\n\tcurl x | sh\n\t# wget\nV = curl\n", [(2, 1, "network", "curl", _M, "build_hook"), (2, 10, "process_exec", "sh", _M, "build_hook")], []),
    ("package.json", '{"install": 1,\n"scripts": {"preinstall": "x",\n"install": "y"}}', [(2, 1, "process_exec", "preinstall", _M, "install_hook"), (3, 1, "process_exec", "install", _M, "install_hook")], []),
    ("setup.py", "from setuptools import setup\nsetup(cmdclass={})\n", [(2, 1, "process_exec", "cmdclass", _M, "build_hook")], []),
    ("pyproject.toml", '[build-system]\nbuild-backend = "x"\nbackend-path = ["."]\n', [(2, 1, "process_exec", "custom build-backend with backend-path", _M, "build_hook")], []),
    ("q/pyproject.toml", 'build-backend = "x"\n', [], []),
    ("notes.txt", "import socket\ncurl x\n", [], []),
]
_TAGS = {"py": "python", "js": "java_script", "ts": "type_script", "go": "go", "sh": "bash", "run": "bash"}
_MANIFEST_TAGS = {"Makefile": "bash", "setup.py": "python", "pyproject.toml": "python", "package.json": None}


def _expected(which: int) -> list[tuple]:
    out = []
    for k, (name, _, *rows) in enumerate(SNIPPETS):
        tag = _MANIFEST_TAGS.get(name.split("/")[-1], _TAGS.get(name.rpartition(".")[2]))
        out += [(k, name, *r, tag, None) if len(r) == 5 else (k, name, *r[:5], tag, r[5]) for r in rows[which]]
    return out


def _snippets(spark, d) -> DataFrame:
    rows = [(k, name, text) for k, (name, text, *_) in enumerate(SNIPPETS)]
    p = dealt(spark, d, "events", "event_id", rows, "k int, name string, source string", len(SNIPPETS))
    ahead = F.when(F.col("name") == "run", F.lit(0)).otherwise(F.pmod("id", F.lit(3)))  # empty lines ahead, but of a first line that must stay one
    files = p.select(F.concat(F.lit("e/"), F.col("id").cast("string"), F.lit("/"), "name").alias("path"), F.concat(F.repeat(F.lit("\n"), ahead.cast("int")), "source").alias("source"))
    return trees.classified(files)


_FOUND = "file, line, col, capability, evidence, origin, language, execution_context"


def _scan_sql(rows: list[tuple]) -> str:
    return f"SELECT concat('e/', id, '/', name) AS file, line + CASE WHEN name = 'run' THEN 0 ELSE id % 3 END AS line, col, capability, evidence, origin, language, execution_context FROM {dealt_sql('events', 'event_id', rows, 'k, name, line, col, capability, evidence, origin, language, execution_context', len(SNIPPETS))}"


@query("scan_text", _scan_sql(_expected(0)))
def scan_text(spark, d):
    """All line scanners, manifests and literals over one source for each event."""
    return scan.analyze(_snippets(spark, d)).select(*_FOUND.split(", "))


@query("scan_structured", _scan_sql(_expected(1)))
def scan_structured(spark, d):
    """Imports, calls through aliases and shell commands by tokens."""
    return structured.findings(_snippets(spark, d)).select(*_FOUND.split(", "))


# ---------------------------------------------------------------- scalar functions

_HEX, _B58 = "0123456789abcdef", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
# value, endpoint, ipv4, ipv6, pem, hex, base58, prefixed, credential, evidence (null: the value)
LITERALS = [
    ("http://a", True, False, False, False, False, False, False, False, None),
    ("wss://xyz", True, False, False, False, False, False, False, False, None),
    ("http:/a.bc", False, False, False, False, False, False, False, False, None),
    ("1.2.3.4:80", True, True, False, False, False, False, False, False, None),
    ("1.2.3.4", False, False, False, False, False, False, False, False, None),
    ("256.2.3.4:80", False, False, False, False, False, False, False, False, None),
    ("1.2.3.4:99999", False, False, False, False, False, False, False, False, None),
    ("12:30:45", True, False, True, False, False, False, False, False, None),
    ("fe80::1:2", True, False, True, False, False, False, False, False, None),
    ("[fe80::1]:80", True, False, True, False, False, False, False, False, None),
    ("a::b::c:d", False, False, False, False, False, False, False, False, None),
    ("-----BEGIN RSA KEY-----", False, False, False, True, False, False, False, False, None),
    (_HEX * 4, False, False, False, False, True, False, False, False, "0123456789abcdef…cdef"),
    (_HEX * 6, False, False, False, False, True, False, False, False, "0123456789abcdef…cdef"),
    (_HEX * 4 + "0", False, False, False, False, False, False, False, False, "0123456789abcdef…def0"),
    ("5" + _B58[:50], False, False, False, False, False, True, False, False, "5123456789ABCDEF…opqr"),
    (_B58 + _B58[:10], False, False, False, False, False, True, False, False, "123456789ABCDEFG…789A"),
    ("AGE-SECRET-KEY-1X", False, False, False, False, False, False, True, False, None),
    ("ed25519:x", False, False, False, False, False, False, True, False, None),
    ("0x" + _HEX * 4, False, False, False, False, False, False, True, False, "0x0123456789abcd…cdef"),
    ("AKIA" + "A1" * 8, False, False, False, False, False, False, False, True, None),
    ("AKIA" + "a1" * 8, False, False, False, False, False, False, False, False, None),
    ("ghp_" + "a" * 36, False, False, False, False, False, False, False, True, None),
    ("sk_live_" + "a" * 24, False, False, False, False, False, False, False, True, None),
    ("sk-" + "a" * 23, False, False, False, False, False, False, False, False, None),
    ("plain", False, False, False, False, False, False, False, False, None),
]
_JUDGED = {"endpoint": S.is_endpoint, "ipv4": S.is_ipv4, "ipv6": S.is_ipv6, "pem": S.is_pem, "hex": S.is_hex_key, "base58": S.is_base58_key, "prefixed": S.is_prefixed_key, "credential": S.is_credential}


@query("literal_judgements", f"SELECT id, {', '.join(_JUDGED)}, coalesce(evidence, value) AS evidence FROM {dealt_sql('customer', 'c_custkey', [(k, *r) for k, r in enumerate(LITERALS)], 'k, value, ' + ', '.join(_JUDGED) + ', evidence', len(LITERALS))}")
def literal_judgements(spark, d):
    """What each judge says of a literal, and the evidence that is shown."""
    p = dealt(spark, d, "customer", "c_custkey", [(k, r[0]) for k, r in enumerate(LITERALS)], "k int, value string", len(LITERALS))
    return p.select("id", *[f(F.col("value")).alias(n) for n, f in _JUDGED.items()], S.evidence(F.col("value")).alias("evidence"))


# path, source, class, language, grammar, skipped, below src, version by stem
PATHS = [
    ("src/a.rs", "", "rust", None, "rust", False, True, "a"),
    ("x/setup.py", "", "manifest", None, "python", False, False, "setup"),
    ("a/x.tsx", "", "source", "type_script", "tsx", False, False, "x"),
    ("a/y.mjs", "", "source", "java_script", "java_script", False, False, "y"),
    ("run", "#!/usr/bin/env -S python3\n", "unsupported", "python", "python", False, False, ""),
    ("bin/d", "#!/bin/zsh", "unsupported", "bash", "bash", False, False, ""),
    ("c/b.go", "", "source_and_manifest", "go", "go", False, False, "b"),
    (".git/hooks/a.py", "", "source", "python", "python", True, False, "a"),
    ("x/node_modules/y/i.js", "", "source", "java_script", "java_script", True, False, "i"),
    ("cargo/serde/1.0.2.json", "", "unsupported", None, None, False, False, "1.0.2"),
    ("lib/srcs/a.sh", "", "source", "bash", "bash", False, False, "a"),
    ("w/src/deep/m.ts", "", "source", "type_script", "type_script", False, True, "m"),
    (".py", "", "unsupported", None, None, False, False, ""),
]


@query("path_judgements", f"SELECT id, path, class, language, grammar, skipped, below_src, version FROM {dealt_sql('supplier', 's_suppkey', [(k, *r) for k, r in enumerate(PATHS)], 'k, path, source, class, language, grammar, skipped, below_src, version', len(PATHS))}")
def path_judgements(spark, d):
    """File class, language, grammar and what else a path and a first line say."""
    p = dealt(spark, d, "supplier", "s_suppkey", [(k, *r[:2]) for k, r in enumerate(PATHS)], "k int, path string, source string", len(PATHS))
    path, source = F.col("path"), F.col("source")
    return p.select("id", "path", S.file_class(path).alias("class"), S.language(path, source).alias("language"), S.syntax_language(path, source).alias("grammar"), S.is_skipped_dir(path).alias("skipped"), S.under_src(path).alias("below_src"), S.version_from_path(path).alias("version"))


# a qualified path and its capability, a module name and whether it lies under net, a line and what imports it holds, a command line
RULES = [
    ("std::fs::write", "file_write", "net/http", True, "import socket", True, "curl x", 1, "require('fs')", "fs", 'x "net/http"', "net/http"),
    ("std::fs::read", "file_read", "net", True, "from socket import y", True, "a|curl", 3, "import x from \"axios\"", "axios", '"os/exec"', "os/exec"),
    ("std::fsx", None, "netx", False, "import sockets", False, "xcurl", 0, "import 'got'", "got", "fmt", None),
    ("reqwest::get", "network", "net/", True, "from socket.a import b", True, "curls; curl", 8, "let y = 1", None, '""', ""),
    ("std::env::vars", "env_access", "", False, "import os, socket", False, "curl=1", 1, "import a from b", None, "", None),
    ("tokio::fs::rename", "file_write", "Net", False, "  import socket.x", True, "(curl)", 2, "const {a} = require(\"jose\")", "jose", '_ "a/b"', "a/b"),
    ("timeit", None, "n", False, "# import socket", False, "curl", 1, "require(x)", None, '"C"', "C"),
    ("time::now", "system_time", "net.x", False, "from socketx import a", False, "a=curl", 0, "import {a} from 'fs/promises'", "fs/promises", "import", None),
]
_RULES = "k, path, capability, module, under_net, line, imports, command, place, script, package, spec, go_package"


@query("rule_judgements", f"SELECT id, capability, under_net, imports, place, package, go_package FROM {dealt_sql('part', 'p_partkey', [(k, *r) for k, r in enumerate(RULES)], _RULES, len(RULES))}")
def rule_judgements(spark, d):
    """Capabilities of paths, module borders, import lines and shell word borders."""
    given = [(k, *r[0::2]) for k, r in enumerate(RULES)]
    p = dealt(spark, d, "part", "p_partkey", given, "k int, path string, module string, line string, command string, script string, spec string", len(RULES))
    return p.select(
        "id", S.rust_capability(F.col("path")).cast("string").alias("capability"), S.matches_module(F.col("module"), "net").alias("under_net"), S.python_import(F.col("line"), "socket").alias("imports"),
        S.shell_position(F.col("command"), "curl").alias("place"), S.js_module(F.col("script")).alias("package"), S.go_package(F.col("spec")).alias("go_package"),
    )


# text and whether it matches a*b*c, a path and whether src/**/b.rs matches it, a suffix rule, a name and whether it is generic outside loops
PATTERNS = [
    ("aXbXc", True, "src/a/b.rs", True, "x/a.rs", True, "i", True, "1.0.0-1", 0), ("aXbXcc", False, "x/src/b.rs", True, "xa.rs", False, "x", True, "1.0.0-alpha", 1), ("abc", True, "src/a/c.rs", False, "a.rs", True, "total", False, "1.0.0-alpha.1", 2),
    ("acb", False, "src/b.rs", True, "x/a.rs/y", False, "tmp", True, "1.0.0", 3), ("", False, "srcs/b.rs", False, "", False, "n", True, "1.0.2", 4), ("a b c", True, "src/x/y/b.rs", True, "y/x/a.rs", True, "nn", False, "1.10.0", 5),
]
_PATTERNS = "k, text, wild, path, globbed, suffix, has_suffix, name, generic, version, place"


@query("pattern_judgements", f"SELECT id, wild, globbed, has_suffix, generic, place FROM {dealt_sql('part', 'p_partkey', [(k, *r) for k, r in enumerate(PATTERNS)], _PATTERNS, len(PATTERNS))}")
def pattern_judgements(spark, d):
    """Wildcards, globs, suffixes, generic names and the order of semantic versions."""
    given = [(k, *r[0::2]) for k, r in enumerate(PATTERNS)]
    p = dealt(spark, d, "part", "p_partkey", given, "k int, text string, path string, suffix string, name string, version string", len(PATTERNS))
    order = F.array(*[S.semver(F.lit(r[8])) for r in PATTERNS])
    return p.select(
        "id", S.wildcard(F.col("text"), "a*b*c").alias("wild"), S.glob(F.col("path"), "src/**/b.rs").alias("globbed"), S.path_suffix(F.col("suffix"), F.lit("a.rs")).alias("has_suffix"),
        S.is_generic_name(F.col("name"), F.lit(0), F.lit(False), ["tmp"]).alias("generic"), F.size(F.filter(order, lambda v: v < S.semver(F.col("version")))).alias("place"),
    )


# ---------------------------------------------------------------- Rust sources

RUST = [
    (
        "use std::{fs, net::{TcpStream as T, *}};\n#[cfg(feature = \"x\")]\npub(crate) mod inner {\n    #[derive(Debug)]\n    pub struct S<T> { a: Vec<Box<dyn Fn()>>, b: HashMap<String, T> }\n    impl<T> S<T> {\n        pub fn go(&self, n: usize, (p, q): (u8, u8)) -> Result<(), Box<dyn Error>> {\n            let _ = self.a.len();\n"
        "            for i in 0..n {\n                if i > 2 { match i { Foo::Bar => fs::read(\"http://h.example\")?, _ => loop { x.clone(); } } }\n                else if a { b() } else { while t { c(|z| z.d::<u8>()) } }\n            }\n            unsafe { println!(\"x\") };\n            Ok(())\n        }\n        fn fwd(&self) -> u8 { self.inner.call(1)?.await }\n    }\n}\n"
    ),
    "mod tests;\n#[cfg(test)]\nmod t {}\npub trait Shape: Sized {\n    const N: u8 = 1;\n    fn area(&self, scale: f64) -> f64;\n    fn twice(&self) -> f64 { self.area(1.0) * 2.0 }\n}\nenum E { A(u8), B { c: Rc<str> }, C = 3 }\nunion U { a: u32 }\ntype Alias = Vec<E>;\nstatic mut G: u8 = 0;\nunsafe impl Send for U {}\nextern \"C\" { fn c(); }\n",
    "#![allow(dead_code)]\nasync fn main() {\n    let x: Arc<String> = Arc::new(String::new());\n    let r#type = 'a';\n    /* fn no() { /* nested */ } */\n    let s = r#\"fn also_no() {}\"#;\n    std::env::var(\"HOME\").ok();\n    std::env::var(s);\n    let f = |v: u8| if v > 1 { 2 } else { 3 };\n    match x { y if y.is_empty() => {}, _ => panic!(\"no\") }\n}\npub(super) unsafe fn raw(p: *const u8) {}\n",
    "fn broken() {\n",
]
# tag, function, line, column, then what is known of the row as one text
_RUST_ROWS: list[list[tuple]] = [
    [
        ("control_flow", 0, 9, 12, "for 1 1 -"), ("control_flow", 0, 10, 16, "if 2 1 - 3"), ("control_flow", 0, 10, 27, "match 3 1 if"), ("control_flow", 0, 10, 85, "loop 4 2 match"), ("control_flow", 0, 11, 21, "if 3 1 if -"), ("control_flow", 0, 11, 41, "while 4 2 if"), ("control_flow", 0, 11, 53, "closure 4 2 if"),
        ("function", 0, 7, 15, "go 2 9 S public true false x"), ("function", 1, 16, 11, "fwd 0 1 S private true true x"),
        ("import", None, 1, 0, "std::fs"), ("import", None, 1, 0, "std::net::TcpStream as T"), ("import", None, 1, 0, "std::net::*"),
        ("expression_path", 0, 10, 37, "Foo::Bar"), ("expression_path", 0, 10, 49, "fs::read"),
        ("method_call", 0, 8, 26, "len - 0"), ("method_call", 0, 10, 93, "clone x 2"), ("method_call", 0, 11, 58, "d z 2"), ("method_call", 1, 16, 40, "call - 0"),
        ("type_def", None, 5, 15, "struct S public Vec Box HashMap String T"), ("impl_block", None, 6, 12, "S - usize u8 u8 Result Box u8"),
        ("module", None, 3, 11, "inner false true feature = \"x\""), ("attribute", None, 2, 0, "cfg cfg(feature=\"x\")"), ("attribute", None, 4, 4, "derive derive(Debug)"), ("macro", 0, 13, 21, "println!"),
        ("string_literal", 0, 10, 58, "http://h.example"), ("unsafe_site", 0, 13, 12, "block"),
        ("type_ref", None, 5, 25, "field Vec<Box<dynFn()>> vec"), ("type_ref", None, 5, 48, "field HashMap<String,T> hasher"), ("type_ref", 0, 7, 56, "return Result<(),Box<dynError>>"), ("type_ref", 0, 7, 28, "param usize"), ("type_ref", 0, 7, 43, "param (u8,u8)"), ("type_ref", 0, 11, 63, "body u8"), ("type_ref", 1, 16, 25, "return u8"),
        ("binding", 0, 7, 25, "n 0 false false"), ("binding", 0, 7, 36, "p 0 false false"), ("binding", 0, 7, 39, "q 0 false false"), ("binding", 0, 8, 16, "_ 0 false true"), ("binding", 0, 9, 16, "i 1 false false"),
        ("definition", None, 3, 15, "module inner -"), ("definition", None, 5, 15, "struct S -"), ("definition", None, 7, 15, "method go S"), ("definition", None, 16, 11, "method fwd S"),
    ],
    [
        ("module", None, 1, 0, "tests false false "), ("module", None, 3, 0, "t true true test"), ("attribute", None, 2, 0, "cfg cfg(test)"),
        ("type_def", None, 4, 10, "trait Shape public f64 f64 f64"), ("function", 0, 6, 7, "area 1 0 - private true false "), ("function", 1, 7, 7, "twice 0 1 - private true false "), ("method_call", 1, 7, 33, "area self 0"),
        ("type_def", None, 9, 5, "enum E private u8 Rc str"), ("type_def", None, 10, 6, "union U private u32"), ("type_alias", None, 11, 5, "Alias Vec E"),
        ("unsafe_site", None, 13, 0, "impl"), ("impl_block", None, 13, 21, "U Send Send"), ("extern_block", None, 14, 0, "extern block"),
        ("type_ref", None, 5, 13, "body u8"), ("type_ref", 0, 6, 34, "return f64"), ("type_ref", 0, 6, 26, "param f64"), ("type_ref", 1, 7, 23, "return f64"), ("type_ref", None, 9, 11, "field u8"), ("type_ref", None, 9, 23, "field Rc<str>"), ("type_ref", None, 10, 13, "field u32"), ("type_ref", None, 11, 13, "body Vec<E>"), ("type_ref", None, 11, 17, "body E"), ("type_ref", None, 12, 14, "body u8"),
        ("binding", 0, 6, 19, "scale 0 false false"),
        ("definition", None, 1, 4, "module tests -"), ("definition", None, 3, 4, "module t -"), ("definition", None, 4, 10, "trait Shape -"), ("definition", None, 5, 10, "constant N Shape"), ("definition", None, 6, 7, "method area Shape"), ("definition", None, 7, 7, "method twice Shape"), ("definition", None, 9, 5, "enum E -"), ("definition", None, 10, 6, "union U -"), ("definition", None, 11, 5, "type_alias Alias -"), ("definition", None, 12, 11, "static G -"),
    ],
    [
        ("attribute", None, 1, 0, "allow allow(dead_code)"), ("function", 0, 2, 9, "main 0 10 - private false false "), ("function", 1, 12, 21, "raw 1 1 - super false false "),
        ("expression_path", 0, 3, 25, "Arc::new"), ("expression_path", 0, 3, 34, "String::new"), ("expression_path", 0, 7, 4, "std::env::var"), ("expression_path", 0, 8, 4, "std::env::var"),
        ("string_literal", 0, 6, 12, "fn also_no() {}"), ("string_literal", 0, 7, 18, "HOME"), ("method_call", 0, 7, 25, "ok - 0"), ("method_call", 0, 10, 20, "is_empty y 0"), ("macro", 0, 10, 44, "panic!"),
        ("control_flow", 0, 9, 12, "closure 0 0 -"), ("control_flow", 0, 9, 20, "if 1 0 - 2"), ("control_flow", 0, 10, 4, "match 1 0 -"), ("unsafe_site", 1, 12, 11, "fn"),
        ("type_ref", 0, 3, 11, "body Arc<String>"), ("type_ref", 0, 3, 15, "body String"), ("type_ref", 1, 12, 28, "param *constu8"),
        ("binding", 0, 3, 8, "x 0 true false"), ("binding", 0, 4, 8, "r#type 0 false false"), ("binding", 0, 6, 8, "s 0 false false"), ("binding", 0, 9, 8, "f 0 false false"), ("binding", 1, 12, 25, "p 0 false false"),
        ("definition", None, 2, 9, "function main -"), ("definition", None, 12, 21, "function raw -"),
    ],
    [("error", None, 1, 0, "unmatched { in line 1")],
]


def _rust_files(spark, d) -> DataFrame:
    p = dealt(spark, d, "customer", "c_custkey", list(enumerate(RUST)), "k int, source string", len(RUST))
    return p.select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("/src/lib.rs")).alias("path"), "source")


def _facts(spark, d) -> DataFrame:
    return materialise(rust.extract(_rust_files(spark, d)), "rust-facts")


def _rust_sql(select: str, rows: list[tuple], columns: str, where: str = "") -> str:
    return f"SELECT {select} FROM {dealt_sql('customer', 'c_custkey', rows, columns, len(RUST))}{where}"


_FILE = "concat('c', id, '/src/lib.rs') AS file"
_SAID = {
    "control_flow": "concat_ws(' ', kind, depth, loop_depth, coalesce(parent_branch, '-'), CASE WHEN has_else THEN coalesce(CAST(chain_len AS STRING), '-') END)",
    "function": "concat_ws(' ', name, size(params), body_lines, coalesce(method_of, '-'), visibility, is_associated, is_forwarder, concat_ws(',', features))",
    "method_call": "concat_ws(' ', name, coalesce(receiver, '-'), loop_depth)",
    "type_def": "concat_ws(' ', kind, name, visibility, concat_ws(' ', edges))",
    "type_alias": "concat_ws(' ', name, concat_ws(' ', edges))",
    "impl_block": "concat_ws(' ', type, coalesce(trait, '-'), concat_ws(' ', edges))",
    "module": "concat_ws(' ', name, is_cfg_test, inline, concat_ws(',', predicates))",
    "attribute": "concat_ws(' ', name, text)",
    "macro": "text",
    "string_literal": "value",
    "unsafe_site": "kind",
    "extern_block": "text",
    "type_ref": "concat_ws(' ', context, text, CASE WHEN involves_dyn THEN 'dyn' END, CASE WHEN is_vec_box_dyn THEN 'vec' END, CASE WHEN is_default_hasher THEN 'hasher' END)",
    "binding": "concat_ws(' ', name, loop_depth, is_refcounted, is_wildcard)",
    "definition": "concat_ws(' ', kind, name, coalesce(owner, '-'))",
    "error": "message",
}
_SQL_ROWS = [(k, *r) for k, rows in enumerate(_RUST_ROWS) for r in rows]


@query("rust_facts", _rust_sql(f"{_FILE}, tag, CAST(fn AS INT) AS fn, line, col, said", _SQL_ROWS, "k, tag, fn, line, col, said"))
def rust_facts(spark, d):
    """Every fact of one Rust source for each customer: functions, control flow, types, imports, sites and the rest."""
    facts = _facts(spark, d)
    parts = [rust.table(facts, tag).select("file", F.lit(tag).alias("tag"), "fn", "line", "col", F.expr(said).alias("said")) for tag, said in _SAID.items()]
    refs = rust.table(facts, "reference").where("origin in ('import', 'expression_path')")
    refs = refs.select("file", F.col("origin").alias("tag"), "fn", "line", "col", F.expr("concat(text, CASE WHEN glob THEN '::*' ELSE '' END, coalesce(concat(' as ', alias), ''))").alias("said"))
    for p in parts:
        refs = refs.unionByName(p)
    return refs


# skeleton bytes (parameters, whether a value is returned, tags of control flow, numbers of calls, bindings and types) by function
_SHAPES = [(0, "go", 2, 1, [2, 0, 1, 4, 0, 3, 5], 3, 5, 4), (0, "fwd", 0, 1, [], 1, 0, 1), (1, "area", 1, 1, [], 0, 1, 2), (1, "twice", 0, 1, [], 1, 0, 1), (2, "main", 0, 0, [5, 0, 1], 2, 4, 2), (2, "raw", 1, 0, [], 0, 1, 1)]


def _bytes(params, returned, flows, calls, bound, types) -> str:
    return "".join(n.to_bytes(8, "little").hex() if wide else f"{n:02x}" for n, wide in [(params, True), (returned, False), *((f, False) for f in flows), (calls, True), (bound, True), (types, True)])


_FNV_SQL = "lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(regexp_extract_all(bytes, '..'), lambda x: CAST(CAST('0x' || x AS INT) AS UHUGEINT))), lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT)), 16, '0'))"


@query("rust_fingerprints", _rust_sql(f"{_FILE}, name, {_FNV_SQL} AS skeleton, facts AS fact_count", [(k, name, _bytes(*shape), len(shape[2]) + sum(shape[3:])) for k, name, *shape in _SHAPES], "k, name, bytes, facts"))
def rust_fingerprints(spark, d):
    """Skeleton hashes of functions; SQL folds the same bytes by the 64-bit FNV-1a rule."""
    return rust.table(_facts(spark, d), "fingerprint").select("file", "name", "skeleton", "fact_count")


_FOUND_RUST = [(0, 0, "file_read", 1, 1, "std::fs"), (0, 0, "network", 1, 1, "std::net::TcpStream"), (0, 0, "network", 1, 1, "std::net"), (0, 1, "unsafe_code", 13, 13, "unsafe block"), (0, 4, "network", 10, 59, "http://h.example"), (1, 1, "unsafe_code", 13, 1, "unsafe impl"), (1, 2, "ffi", 14, 1, "extern block"), (2, 0, "env_access", 7, 5, "std::env::var"), (2, 1, "unsafe_code", 12, 12, "unsafe fn")]


@query("rust_findings", _rust_sql(f"{_FILE}, detector, capability, line, col, evidence", _FOUND_RUST, "k, detector, capability, line, col, evidence"))
def rust_findings(spark, d):
    """The five detectors over extracted facts."""
    return checks.rust_findings(_facts(spark, d)).select("file", "detector", "capability", "line", "col", "evidence")


_VIOLATIONS = [
    (0, "max-depth", 10, 86, "4"), (0, "max-depth", 11, 42, "4"), (0, "match-in-if", 10, 28, None), (0, "nested-if", 11, 22, None), (0, "else-chain", 10, 17, None), (0, "forbidden-else", 10, 17, None), (0, "forbidden-else", 11, 22, None),
    (0, "forbidden-call", 8, 27, ".len()"), (0, "forbidden-macro", 13, 22, "print*!"), (0, "forbidden-attribute", 4, 5, "derive(*)"), (0, "forbidden-unsafe", 13, 13, None), (0, "vec-box-dyn", 5, 26, "Vec<Box<dynFn()>>"), (0, "default-hasher", 5, 49, "HashMap<String,T>"), (0, "clone-in-loop", 10, 94, "x"), (0, "let-underscore-result", 8, 17, None), (0, "forbidden-type", 5, 49, "HashMap<*>"),
    (0, "module-root-definitions", 5, 16, "S"), (0, "module-root-definitions", 7, 16, "go"), (0, "module-root-definitions", 16, 12, "fwd"), (0, "generic-naming", 7, 16, "3/4"),
    (1, "inline-tests", 3, 1, "t"), *[(1, "module-root-definitions", line, col, name) for line, col, name in ((4, 11, "Shape"), (5, 11, "N"), (6, 8, "area"), (7, 8, "twice"), (9, 6, "E"), (10, 7, "U"), (11, 6, "Alias"), (12, 12, "G"))], (1, "mixed-concerns", 1, 1, "3"),
    (2, "forbidden-else", 9, 21, None), (2, "generic-naming", 2, 10, "3/4"), (2, "module-root-definitions", 2, 10, "main"), (2, "module-root-definitions", 12, 22, "raw"),
]


@query("rust_checks", _rust_sql(f"{_FILE}, code, line, col, detail", _VIOLATIONS, "k, code, line, col, detail"))
def rust_checks(spark, d):
    """All checks of single files, in their order, over extracted facts."""
    config = style.Config(forbidden={"forbidden-call": [".len()"], "forbidden-macro": ["print*!"], "forbidden-attribute": ["derive(*)"], "forbidden-type": ["HashMap<*>"]})
    return checks.style_checks(_facts(spark, d), _rust_files(spark, d), config).select("file", "code", "line", "col", "detail")


CRATE = [
    ("src/lib.rs", "#[cfg(unix)]\nmod a;\nmod b;\npub struct T;\npub struct D;\nimpl T { fn x(&self) {} fn y(&self) {} }\n"),
    ("src/a.rs", "impl T { fn p(&self) {} fn q(&self) {} fn r(&self) {} }\npub struct D;\n"),
    ("src/b.rs", "#[cfg(windows)]\nimpl T { fn s(&self) {} }\nimpl T { #[cfg(unix)] fn u(&self) {} }\nimpl D { fn d(&self) {} }\nimpl Other { fn o(&self) { self.i.go() } }\n"),
]


@query("rust_project", f"SELECT concat('k', n_nationkey) AS crate, code, type, detail FROM nation, {values([('scattered-inherent-impl', 'T', '3'), ('high-method-count', 'T', '6')], 'code, type, detail')}")
def rust_project(spark, d):
    """Scattered impls and the worst build of a type: methods of a and of b under unix count together, that under windows does not."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("crate"))
    files = nations.crossJoin(spark.createDataFrame(CRATE, "inner string, source string")).select(F.concat_ws("/", "crate", "inner").alias("path"), "source")
    facts = materialise(rust.extract(files), "rust-facts")
    return checks.project_checks(facts, files, style.Config(max_methods=5))
