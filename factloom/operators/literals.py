"""String literals of sources without a parser.

A lexer is state over bytes, which columns cannot hold, so it runs as
``mapInArrow`` over (path, source, language); what it returns is judged in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.ship import ship

_BODY = {q: rb"(?:\\[\s\S]|[^" + q + rb"\\\n])*" for q in (b"'", b'"')}
_QUOTED = b"|".join(q + _BODY[q] + q for q in (b"'", b'"')) + b"|" + b"|".join(q + _BODY[q] for q in (b"'", b'"'))
# Each lexer is one alternation: comments, then literals, then anything else.
_LEXERS = {
    "python": re.compile(rb"(?P<skip>#[^\n]*)|(?P<lit>" + _QUOTED + rb")"),
    "bash": re.compile(rb"(?P<skip>(?:(?<=[ \t\n;|&(])|\A)#[^\n]*)|(?P<lit>" + _QUOTED + rb")"),
    "java_script": re.compile(rb"(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<lit>" + _QUOTED + rb"|`(?:\\[\s\S]|[^`\\])*`?)"),
    "go": re.compile(rb"(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\[\s\S]|[^'\\\n])*'?)|(?P<lit>\"" + _BODY[b'"'] + rb'"?|`[^`]*`?)'),
}
_LEXERS["type_script"] = _LEXERS["java_script"]


def scan(source: bytes, language: str) -> Iterator[tuple[str, int, int]]:
    """(value, line, column) of each closed, non-empty literal.

    Escape pairs are dropped from the value, a newline ends a quoted literal
    unclosed, and each byte becomes one character. The fixed parts of a template
    around its interpolations are one value.
    """
    lexer = _LEXERS.get(language)
    if lexer is None:
        return
    line, line_start, seen = 1, 0, 0
    for m in lexer.finditer(source):
        if m["lit"] is None:
            continue
        line += source.count(b"\n", seen, m.start())
        line_start = source.rfind(b"\n", 0, m.start()) + 1
        seen = m.start()
        text, quote = m["lit"], m["lit"][:1]
        if len(text) < 3 or text[-1:] != quote:
            continue
        body = text[1:-1]
        if quote != b"`" or language != "go":
            body = re.sub(rb"\\[\s\S]", b"", body)
        if quote == b"`" and language != "go":
            body = re.sub(rb"\$\{[^}]*\}", b"", body)
        if body:
            yield body.decode("latin-1"), line, m.start() - line_start + 1


def literals(files: DataFrame) -> DataFrame:
    """path, language, value, line, col of the literals of every file of a language that has a lexer."""
    ship(files.sparkSession)
    import pyarrow as pa

    rows = files.where(F.col("language").isin(list(_LEXERS))).select("path", "language", F.coalesce(F.col("source").cast("binary"), F.lit(b"")).alias("source"))

    def run(batches):
        for b in batches:
            out = [(p, lang, *hit) for p, lang, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for hit in scan(s, lang)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["path", "language", "value", "line", "col"])

    return rows.mapInArrow(run, "path string, language string, value string, line int, col int")


def judged(rows: DataFrame) -> DataFrame:
    """capability and evidence of each literal: the first of endpoint and PEM header, and key material besides."""
    value = F.col("value")
    first = F.when(S.is_endpoint(value), F.struct(F.lit("network").alias("capability"), value.alias("evidence"))).when(S.is_pem(value), F.struct(F.lit("crypto").alias("capability"), value.alias("evidence")))
    key = F.when(S.is_key_material(value), F.struct(F.lit("crypto").alias("capability"), S.evidence(value).alias("evidence")))
    return rows.withColumn("_hit", F.explode(F.array_compact(F.array(first, key)))).select("*", "_hit.*").drop("_hit")


def literal_findings(files: DataFrame) -> DataFrame:
    found = judged(literals(files))
    return found.select(
        "capability", F.col("path").alias("file"), "line", "col", "evidence", F.lit("string_literal").alias("origin"), "language", F.lit(None).cast("string").alias("execution_context"), F.lit(None).cast("boolean").alias("reachable")
    )
