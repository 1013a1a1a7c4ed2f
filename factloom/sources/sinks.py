"""Output forms: JSON rows, text reports, workflow annotations, attestations and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalar import escape_message, escape_property

#: Version of the attestation format that is written.
SPEC_VERSION = "0.1.0"
FINDING = "capability string, file string, line int, col int, evidence string, origin string, language string, execution_context string, reachable boolean"
ATTESTATION = f"spec_version string, source_hash string, crate_name string, crate_version string, analysis_tier string, timestamp bigint, profile struct<findings:array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"


def json_rows(rows: DataFrame) -> DataFrame:
    """value: each row as JSON, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def profile_json(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and value: the findings of each group as one JSON object."""
    cols = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*cols))).alias("findings"))).alias("value"))


def text_report(violations: DataFrame) -> DataFrame:
    """value: a line for each violation, and the count at the end."""
    rows = violations.select(F.lit(0).alias("_s"), F.format_string("%s:%d:%d: %s", "file", "line", "col", "code").alias("value"))
    foot = violations.agg(F.lit(1).alias("_s"), F.format_string("Found %d violation(s)", F.count("*")).alias("value"))
    return rows.unionByName(foot).orderBy("_s", "value").select("value")


def annotations(violations: DataFrame) -> DataFrame:
    """value: a workflow command for each violation (severity deny is an error, else a warning)."""
    command = F.when(F.col("severity") == "deny", "error").otherwise("warning")
    return violations.select(F.concat(F.lit("::"), command, F.lit(" file="), escape_property(F.col("file")), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("col").cast("string"), F.lit(",title="), escape_property(F.col("code")), F.lit("::"), escape_message(F.col("message"))).alias("value"))


def verdict_annotations(verdicts: DataFrame) -> DataFrame:
    command = F.when(F.col("severity") == "deny", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    return verdicts.select(F.concat(F.lit("::"), command, F.lit(" title="), escape_property(F.col("rule")), F.lit("::"), escape_message(F.col("rationale"))).alias("value"))


def project_gate_annotations(verdicts: DataFrame, tier: str, targets: list[str]) -> DataFrame:
    """value: a notice of what was judged, and at which tier, then a workflow command for each verdict; ``ord`` is the order."""
    spark = verdicts.sparkSession
    said = f"analysis tier: {tier}; targets: {', '.join(targets) if targets else 'none'}"
    notice = spark.createDataFrame([(0, said)], "ord int, said string").select("ord", F.concat(F.lit("::notice title=module-boundary::"), escape_message(F.col("said"))).alias("value"))
    return notice.unionByName(verdict_annotations(verdicts).select(F.lit(1).alias("ord"), "value"))


def ci_outputs(status: DataFrame, report_path: str) -> DataFrame:
    """ord and value: ``name=value`` lines for a workflow's output file, the overall status (a one-row frame) and where the report lies."""
    return status.select(F.posexplode(F.array(F.concat(F.lit("status="), F.col("status")), F.lit(f"report={report_path}"))).alias("ord", "value"))


def snippets(units: DataFrame, sources: DataFrame) -> DataFrame:
    """file, kind, name and value: the text of each unit (start and end in bytes) with its place, as a JSON envelope."""
    body = F.decode(F.substring(F.col("source").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    joined = units.join(sources.select(F.col("path").alias("file"), "source"), "file").withColumn("text", body)
    first = F.octet_length("source") >= 0
    line = F.size(F.split(F.decode(F.substring(F.col("source").cast("binary"), F.lit(1), F.col("start")), "ISO-8859-1"), "\n"))
    envelope = F.struct(F.lit(1).alias("version"), F.struct("file", line.alias("line"), "start", "end").alias("location"), "kind", "name", "text")
    return joined.where(first).select("file", "kind", "name", "start", F.to_json(envelope).alias("value"))


def write_attestations(attestations: DataFrame, where: str) -> None:
    """One folder for each name and version, rewritten alone."""
    attestations.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "version").json(where)


def read_baselines(spark: SparkSession, where: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(where)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a profile, or of an attestation (which states its format's version)."""
    rows = spark.read.schema(ATTESTATION).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    held = F.when(F.col("spec_version").isNotNull(), F.col("profile.findings")).otherwise(F.col("findings"))
    return rows.select(F.explode(held).alias("f")).select("f.*")
