"""An index that follows a feed of file changes.

Changes (seq, path, op, source) are applied in the order of seq: the last one of
a path wins. The index lies by crate; a batch rewrites only the crates that it
touches, so that a repeated batch after a failure gives the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGE = "seq long, crate string, path string, op string, source string"
INDEX = "path string, source string, degraded string, crate string"


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path; a rename leaves what its create or remove says."""
    order = Window.partitionBy("crate", "path").orderBy(F.col("seq").desc())
    return changes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply(index: DataFrame, changes: DataFrame, error=None) -> DataFrame:
    """The index after the changes: removed paths go, written ones are replaced.

    A source that is null or for which ``error(source)`` (a Column, null if
    fine) is not null keeps the old row, marked as degraded until the next success.
    """
    last = last_changes(changes)
    bad = F.when(F.col("source").isNull(), F.lit("unreadable")) if error is None else F.coalesce(F.when(F.col("source").isNull(), F.lit("unreadable")), error(F.col("source")))
    last = last.withColumn("problem", F.when(F.col("op") != "remove", bad)).withColumnsRenamed({"source": "new_source"})
    joined = index.join(last.select("crate", "path", "op", "new_source", "problem"), ["crate", "path"], "full_outer").where("op is null or op <> 'remove'")
    failed = F.col("problem").isNotNull()
    return joined.select(
        "path",
        F.when(F.col("op").isNull() | failed, F.col("source")).otherwise(F.col("new_source")).alias("source"),
        F.when(failed, F.col("problem")).when(F.col("op").isNull(), F.col("degraded")).alias("degraded"),
        "crate",
    ).where("source is not null or degraded is not null")


def upsert(spark: SparkSession, where: str, changes: DataFrame, error=None) -> None:
    """Apply a batch to the Parquet index at ``where``: only the touched crates are read and rewritten."""
    from factloom.scratch import materialise

    changes = materialise(changes.select(*[c.split()[0] for c in CHANGE.split(", ")]), "changes")
    try:
        held = spark.read.schema(INDEX).parquet(where)
    except Exception as e:  # no index as yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], INDEX)
    touched = changes.select("crate").distinct()
    after = materialise(apply(held.join(touched, "crate", "left_semi").select(*[c.split()[0] for c in INDEX.split(", ")]), changes, error), "index-after")
    # A crate with no file left still has its partition rewritten, by a row that readers drop.
    emptied = touched.join(after.select("crate").distinct(), "crate", "left_anti").select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("degraded"), "crate")
    after.unionByName(emptied).repartition("crate").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crate").parquet(where)


def read_index(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(where).where("path is not null")


def crate_rows(index: DataFrame) -> DataFrame:
    """crate, files, degraded, findings, capabilities and verdicts of each crate of an index: all that follows from its files."""
    from factloom.operators import checks, gate, rust, scan
    from factloom.scratch import materialise
    from factloom.sources.files import classified

    columns = ["file", "line", "capability", "evidence", "origin", "language", "execution_context"]
    files = materialise(index.where("path is not null"), "index-files")
    text = scan.analyze(classified(files.select("path", F.coalesce("source", F.lit("")).alias("source")))).select(*columns)
    code = checks.rust_findings(materialise(rust.extract(files), "index-facts"))
    hook = F.when(F.col("file").rlike("(^|/)build\\.rs$"), F.lit("build_hook"))
    code = code.select("file", "line", "capability", "evidence", "origin", F.lit(None).cast("string").alias("language"), hook.alias("execution_context"))
    found = text.unionByName(code).join(files.select(F.col("path").alias("file"), "crate"), "file")
    found = materialise(found, "index-findings")
    sums = files.groupBy("crate").agg(F.count("*").alias("files"), F.count("degraded").alias("degraded"))
    held = found.groupBy("crate").agg(F.count("*").alias("findings"), F.array_sort(F.collect_set("capability")).alias("capabilities"))
    rules = gate.verdicts(found, None, ["crate"]).groupBy("crate").agg(F.array_sort(F.collect_set("rule")).alias("verdicts"))
    none = F.array().cast("array<string>")
    out = sums.join(held, "crate", "left").join(rules, "crate", "left")
    return out.select("crate", "files", "degraded", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"), F.coalesce("capabilities", none).alias("capabilities"), F.coalesce("verdicts", none).alias("verdicts"))


def reindex(spark: SparkSession, where: str, changes: DataFrame, error=None) -> None:
    """Apply a batch of changes, and redo what follows from the files of the crates that it touched.

    The rows by crate lie beside the index, at ``where`` and ``-crates``; a crate without files keeps none.
    """
    from factloom.scratch import materialise

    changes = materialise(changes, "changes")
    upsert(spark, where, changes, error)
    touched = changes.select("crate").distinct()
    after = materialise(crate_rows(read_index(spark, where).join(touched, "crate", "left_semi")), "crate-rows")
    emptied = touched.join(after.select("crate"), "crate", "left_anti").select("crate", F.lit(None).cast("bigint").alias("files"))
    rows = after.unionByName(emptied, allowMissingColumns=True).select("files", "degraded", "findings", "capabilities", "verdicts", "crate")
    rows.repartition("crate").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crate").parquet(f"{where}-crates")


def read_crates(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("files bigint, degraded bigint, findings bigint, capabilities array<string>, verdicts array<string>, crate string").parquet(f"{where}-crates").where("files is not null")


def watch(spark: SparkSession, feed: str, where: str, checkpoint: str, error=None):
    """Follow a folder of JSON changes; returns the started query."""
    stream = spark.readStream.schema(CHANGE).json(feed)
    return stream.writeStream.foreachBatch(lambda batch, _: reindex(batch.sparkSession, where, batch, error)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
