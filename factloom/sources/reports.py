"""Resolution reports: read within limits, held against their snapshot, and put together under a ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.scratch import materialise

#: Rows of each kind that a report may hold.
LIMITS = {"units": 4096, "files": 65_536, "definitions": 1_000_000, "references": 1_000_000, "resolutions": 1_000_000}
_SPAN = "line int, col int, end_line int, end_col int"
SCHEMA = f"""units array<struct<unit: string>>, files array<struct<unit: string, path: string, lines: int>>,
  definitions array<struct<def_id: bigint, unit: string, path: string, kind: string, name: string, {_SPAN.replace(' int', ': int')}, parent: bigint>>,
  references array<struct<ref_id: bigint, unit: string, path: string, kind: string, {_SPAN.replace(' int', ': int')}, owner: bigint>>,
  resolutions array<struct<ref_id: bigint, def_id: bigint, certainty: string>>"""


def read_report(spark: SparkSession, path: str, limits: dict[str, int] = LIMITS) -> dict[str, DataFrame]:
    """The tables of the JSON reports at ``path`` (one object a line), counted before anything is made of them."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return tables(rows, limits)


def tables(rows: DataFrame, limits: dict[str, int] = LIMITS) -> dict[str, DataFrame]:
    """One frame for each kind of row; a kind with more rows than its limit is refused."""
    held = rows.agg(*[F.sum(F.coalesce(F.size(k), F.lit(0))).alias(k) for k in limits]).first()
    for kind, most in limits.items():
        if (held[kind] or 0) > most:
            raise ValueError(f"the report holds {held[kind]} {kind}, more than {most}")
    return {k: rows.select(F.explode(k).alias("r")).select("r.*") for k in limits}


def problems(report: dict[str, DataFrame]) -> DataFrame:
    """kind and id of everything in which a report contradicts itself or its files.

    A reference has one record for each definition and one at least where it is
    resolved; ids are unique and known; spans do not end before they begin, nor
    lie beyond their file; a parent is a definition of the same file.
    """
    d, r, s = report["definitions"], report["references"], report["resolutions"]
    said = lambda rows, kind, column: rows.select(F.lit(kind).alias("kind"), F.col(column).cast("bigint").alias("id"))
    twice = lambda rows, column: rows.groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1")
    files = report["files"].select("unit", "path", F.col("lines").alias("_lines"))
    outside = F.col("_lines").isNull() | (F.col("end_line") >= F.col("_lines")) | (F.struct("end_line", "end_col") < F.struct("line", "col"))
    own = d.select(F.col("def_id").alias("_p"), F.col("unit").alias("_u"), F.col("path").alias("_f"))
    orphans = d.where("parent is not null").join(own, F.col("parent") == F.col("_p"), "left").where("_p is null or _u <> unit or _f <> path or parent = def_id")
    return (
        said(twice(d, "def_id"), "definition-stated-twice", "def_id")
        .unionByName(said(twice(r, "ref_id"), "reference-stated-twice", "ref_id"))
        .unionByName(said(s.groupBy("ref_id", "def_id").agg(F.count("*").alias("n")).where("n > 1"), "record-stated-twice", "ref_id"))
        .unionByName(said(s.join(r.select("ref_id"), "ref_id", "left_anti"), "record-without-reference", "ref_id"))
        .unionByName(said(s.where("def_id is not null").join(d.select("def_id"), "def_id", "left_anti"), "unknown-definition", "ref_id"))
        .unionByName(said(s.where("certainty = 'resolved'").groupBy("ref_id").agg(F.count("*").alias("n")).where("n > 1"), "resolved-more-than-once", "ref_id"))
        .unionByName(said(d.join(files, ["unit", "path"], "left").where(outside), "definition-outside-its-file", "def_id"))
        .unionByName(said(r.join(files, ["unit", "path"], "left").where(outside), "reference-outside-its-file", "ref_id"))
        .unionByName(said(orphans, "parent-of-another-file", "def_id"))
    )


class Builder:
    """A report in the making: rows are appended kind by kind; a kind beyond its ceiling, and ids that were never appended, are refused."""

    _KNOWN = {"references": [("owner", "definitions", "def_id")], "resolutions": [("ref_id", "references", "ref_id"), ("def_id", "definitions", "def_id")]}

    def __init__(self, limits: dict[str, int] = LIMITS):
        self.limits, self.held, self.counts = limits, {}, dict.fromkeys(limits, 0)

    def append(self, kind: str, rows: DataFrame) -> None:
        rows = materialise(rows, f"report-{kind}")
        self.counts[kind] += rows.count()
        if self.counts[kind] > self.limits[kind]:
            raise ValueError(f"the report would hold {self.counts[kind]} {kind}, more than {self.limits[kind]}")
        for column, other, key in self._KNOWN.get(kind, []):
            known = self.held.get(other)
            named = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(key))
            if not (named if known is None else named.join(known.select(key), key, "left_anti")).isEmpty():
                raise ValueError(f"{kind} name {other} that the report does not hold")
        self.held[kind] = rows if kind not in self.held else self.held[kind].unionByName(rows)

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.held)
