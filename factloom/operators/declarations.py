"""Declarations of sources without a parser: kind, name and byte range of each callable and type.

Python ends a declaration where indentation falls back, the brace languages
where their braces balance outside literals and comments. Rows feed
``capability.enclosing_units``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.ship import ship

_PYTHON = re.compile(rb"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)
_BRACED = {
    "java_script": [("function", rb"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("), ("class", rb"class\s+([A-Za-z_$][\w$]*)"), ("function", rb"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*(?=\{)")],
    "go": [("method", rb"func\s*\([^)]*\)\s*([A-Za-z_]\w*)\s*\("), ("function", rb"func\s+([A-Za-z_]\w*)\s*[(\[]"), ("struct", rb"type\s+([A-Za-z_]\w*)\s+struct")],
    "bash": [("function", rb"(?:function\s+)([A-Za-z_][\w-]*)\s*(?:\(\))?\s*(?=\{)"), ("function", rb"([A-Za-z_][\w-]*)\s*\(\)\s*(?=\{)")],
    "rust": [("function", rb"fn\s+([A-Za-z_]\w*)"), ("struct", rb"struct\s+([A-Za-z_]\w*)"), ("enum", rb"enum\s+([A-Za-z_]\w*)"), ("union", rb"union\s+([A-Za-z_]\w*)\s*\{"), ("trait", rb"trait\s+([A-Za-z_]\w*)"), ("impl", rb"impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>,&'\s]+?\s+for\s+)?([A-Za-z_][\w:]*)")],
}
_BRACED["type_script"] = [*_BRACED["java_script"], ("trait", rb"interface\s+([A-Za-z_$][\w$]*)"), ("enum", rb"enum\s+([A-Za-z_$][\w$]*)")]
_RULES = {lang: [(kind, re.compile(rb"(?:^|(?<=[\s;{}(]))" + rx)) for kind, rx in rules] for lang, rules in _BRACED.items()}
_IDLE = {
    "bash": re.compile(rb"(?:(?<=\s)|\A)#[^\n]*|\"(?:\\[\s\S]|[^\"\\])*\"|'[^']*'"),
    "rust": re.compile(rb"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"),
}
_C_LIKE = re.compile(rb"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`")


def scan(source: bytes, language: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) of each declaration, in order of start."""
    if language == "python":
        return _python(source)
    if language not in _RULES:
        return []
    # What lies in literals and comments counts as blank, newlines apart.
    plain = _IDLE.get(language, _C_LIKE).sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), source)
    ends, open_ = {}, []
    for m in re.finditer(rb"[{}]", plain):
        if m[0] == b"{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
    out = {}
    for kind, rx in _RULES[language]:
        for m in rx.finditer(plain):
            body = re.compile(rb"[{;]").search(plain, m.end())
            if body and body[0] == b"{" and body.start() in ends:
                out.setdefault(m.start(), (kind, m[1].decode("utf-8", "replace"), m.start(), ends[body.start()]))
    return [out[k] for k in sorted(out)]


def _python(source: bytes) -> list[tuple[str, str, int, int]]:
    out, types = [], []
    for m in _PYTHON.finditer(source):
        indent = len(m[1].expandtabs())
        end = len(source)
        at = source.find(b"\n", m.end()) + 1 or end
        depth = source.count(b"(", m.start(), at) - source.count(b")", m.start(), at)
        while at < end:
            stop = source.find(b"\n", at) + 1 or end
            line = source[at:stop]
            if depth <= 0 and line.strip() and not line.lstrip().startswith(b"#") and len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= indent:
                end = at
                break
            if depth > 0:
                depth += line.count(b"(") - line.count(b")")
            at = stop
        types = [(i, e) for i, e in types if e > m.start()]
        kind = "class" if m[2] == b"class" else "method" if types and types[-1][0] < indent else "function"
        if kind == "class":
            types.append((indent, end))
        out.append((kind, m[3].decode(), m.start() + len(m[1]), len(source[:end].rstrip()) or end))
    return out


def declarations(files: DataFrame) -> DataFrame:
    """file, ord, kind, name, start, end of every file with path, source and language."""
    import pyarrow as pa

    ship(files.sparkSession)
    rows = files.select("path", "language", F.coalesce(F.col("source").cast("binary"), F.lit(b"")).alias("source"))

    def run(batches):
        for b in batches:
            out = [(p, i, *d) for p, lang, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, d in enumerate(scan(s, lang))]
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "ord", "kind", "name", "start", "end"])

    return rows.mapInArrow(run, "file string, ord int, kind string, name string, start int, end int")


def attributed(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with ``symbol``: the function or method whose range holds the finding's place, null outside of any.

    The place of a line and column is the bytes of the lines ahead of it, so the
    join is on the file and the smallest range that holds the place.
    """
    from pyspark.sql import Window

    from factloom.operators.capability import enclosing_units
    from factloom.operators.scan import lines

    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines(files.select("path", "source")).select(F.col("path").alias("file"), "line", F.coalesce(F.sum(F.octet_length("text") + 1).over(ahead), F.lit(0)).alias("_start"))
    placed = findings.join(starts, ["file", "line"], "left").withColumn("at", F.col("_start") + F.col("col") - 1).drop("_start")
    callables = declarations(files).where(F.col("kind").isin("function", "method"))
    return enclosing_units(placed, callables).withColumnRenamed("name", "symbol").drop("at", "kind", "start", "end")
