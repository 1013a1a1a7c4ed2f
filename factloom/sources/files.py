"""Source trees as rows: path, source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.plans import vocab
from factloom.scratch import materialise
from factloom.ship import ship

#: Ceilings of a snapshot: files, bytes of a file, bytes of all.
MAX_FILES, MAX_BYTES, MAX_TOTAL = 65_536, 8 << 20, 512 << 20


def read_tree(spark: SparkSession, roots: list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, quarantine): path and source of every analysable file below the roots, and path and error of the rest.

    Dot-directories, node_modules and directories that hold CACHEDIR.TAG are
    left out; Spark lists no empty files. A file above the ceiling or not in UTF-8 is quarantined, never lost.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    # The length is known without reading the file, so what is above the ceiling is never read.
    raw = raw.select(F.regexp_replace("path", "^file:", "").alias("path"), "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content")).dropDuplicates(["path"])
    raw = raw.where(~S.is_skipped_dir(F.col("path")))
    tagged = raw.where(S.file_name(F.col("path")) == "CACHEDIR.TAG").select(F.regexp_replace("path", "/[^/]*$", "").alias("_up")).distinct()
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    below = raw.select("path", F.explode(up).alias("_up")).join(tagged, "_up", "left_semi").select("path").distinct()
    raw = raw.join(below, "path", "left_anti")
    raw = raw.where((S.file_class(F.col("path")) != "unsupported") | S.shebang_language(F.decode(F.substring("content", 1, 200), "ISO-8859-1")).isNotNull())
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(F.col("length") > max_bytes, "above the size ceiling").when(text.isNull(), "not UTF-8")
    marked = materialise(raw.select("path", text.alias("source"), error.alias("error")), "tree")
    return marked.where("error is null").select("path", "source"), marked.where("error is not null").select("path", "error")


def from_text(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(name, text)], "path string, source string")


def classified(files: DataFrame) -> DataFrame:
    """files with class and language."""
    return files.withColumns({"class": S.file_class(F.col("path")), "language": S.language(F.col("path"), F.col("source"))})


def check_ceilings(files: DataFrame) -> None:
    n, total = files.agg(F.count("*"), F.sum(F.octet_length("source"))).first()
    if n > MAX_FILES or (total or 0) > MAX_TOTAL:
        raise ValueError("the snapshot is above its ceiling")


def owning_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files with root: the longest root (a column ``root``) that is an ancestor. An equi-join on the ancestors of each path."""
    parts = F.split("path", "/")
    up = files.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    best = up.join(roots.select("root").distinct(), F.col("_up") == F.col("root")).groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(best, "path", "left")


def source_hash(files: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over paths and sources in path order, each behind its length as eight bytes.

    The digest of a group is sequential by definition: a task goes through the
    group's files in order and holds one batch of them, whatever the group's size.
    Null sources are empty; files of equal path are ordered by their digest.
    """
    import pyarrow as pa

    ship(files.sparkSession)
    rows = files.select(*keys, "path", F.coalesce(F.col("source").cast("binary"), F.lit(b"")).alias("source"))
    kept = rows.select(*keys, F.lit("").alias("source_hash")).schema
    order = [*keys, "path"]
    sorted_rows = rows.withColumn("_tie", F.sha2("source", 256)).repartition(*keys).sortWithinPartitions(*order, "_tie").drop("_tie")

    def digest(batches):
        import hashlib

        now, state = None, None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for r in zip(*columns, strict=True):
                if r[: len(keys)] != now:
                    if state:
                        yield row(now, state)
                    now, state = r[: len(keys)], hashlib.sha256()
                for part in (r[-2].encode(), r[-1]):
                    state.update(len(part).to_bytes(8, "big"))
                    state.update(part)
        if state:
            yield row(now, state)

    schema = rows.select(*keys).schema

    def row(now, state):
        from pyspark.sql.pandas.types import to_arrow_type

        arrays = [pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(now, schema, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([state.hexdigest()])], names=[*keys, "source_hash"])

    return sorted_rows.mapInArrow(digest, kept)


def manifest_files(files: DataFrame) -> DataFrame:
    return files.where(S.file_name(F.col("path")).isin(vocab.MANIFESTS))
