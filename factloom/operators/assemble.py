"""A code graph from a resolution report: nodes, containment and edges with dense ids.

Ids follow the order containers, files, definitions, then unit, place and name.
They come from range-partitioned row numbers (a count for each partition at the
driver), so no single task orders all nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import one_of
from factloom.scratch import materialise

#: References by what they become.
REFERENCE_KINDS = {"module": "import", "import": "import", "call": "call", "type": "reference", "implementation": "implementation"}
CATEGORIES = {"module": "container", "function": "function", "method": "function", "struct": "type", "enum": "type", "union": "type", "trait": "type", "type_alias": "type", "constant": "value", "static": "value"}


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with dense long ids from 0 in ``order``, which must leave no ties."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ids")
    counts = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    offset = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts or [0]]), F.shiftright("_m", 33).cast("int"))
    return placed.withColumn(name, offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def build(units: DataFrame, files: DataFrame, definitions: DataFrame, references: DataFrame, resolutions: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in the shapes of ``operators.graph``.

    units: unit; files: unit, path; definitions: def_id, unit, path, kind, name,
    start, parent (def_id, null under the file); references: ref_id, kind,
    owner (def_id); resolutions: ref_id, def_id, certainty; dependencies: source, target (units).
    """
    rank = lambda i: F.lit(i).alias("pass")
    none = lambda t: F.lit(None).cast(t)
    a = units.select(rank(0), "unit", none("string").alias("path"), none("long").alias("start"), none("long").alias("def_id"), F.lit("container").alias("category"), F.col("unit").alias("label"), none("long").alias("up"))
    b = files.select(rank(1), "unit", "path", none("long"), none("long"), F.lit("file"), F.col("path"), none("long"))
    c = definitions.select(rank(2), "unit", "path", F.col("start").cast("long"), "def_id", one_of(CATEGORIES.items(), F.col("kind")), F.col("name"), F.col("parent").cast("long"))
    rows = materialise(numbered(a.union(b).union(c), [F.col("pass"), F.col("unit"), F.col("path"), F.col("start"), F.col("def_id")], "node"), "nodes")
    of_def = rows.where("pass = 2").select(F.col("def_id").alias("_d"), F.col("node").alias("_dn"))
    of_file = rows.where("pass = 1").select(F.col("unit").alias("_fu"), F.col("path").alias("_fp"), F.col("node").alias("_fn"))
    of_unit = rows.where("pass = 0").select(F.col("unit").alias("_u"), F.col("node").alias("_un"))
    up = rows.join(of_def, rows["up"] == F.col("_d"), "left").join(of_file, (rows["unit"] == F.col("_fu")) & (rows["path"] == F.col("_fp")) & (F.col("pass") == 2), "left").join(of_unit, (rows["unit"] == F.col("_u")) & (F.col("pass") == 1), "left")
    nodes = up.select("node", F.coalesce("_dn", "_fn", "_un").alias("parent"), "category", "label")
    to = of_def.select(F.col("_d").alias("_td"), F.col("_dn").alias("dst"))
    found = references.join(resolutions, "ref_id").join(of_def, F.col("owner") == F.col("_d")).join(to, F.col("def_id") == F.col("_td"))
    calls = found.select(F.lit(1).alias("pass"), F.col("ref_id").alias("origin"), F.col("_dn").alias("src"), "dst", one_of(REFERENCE_KINDS.items(), F.col("kind")).alias("kind"), "certainty")
    ends = of_unit.select(F.col("_u").alias("_tu"), F.col("_un").alias("dst"))
    uses = dependencies.join(of_unit, F.col("source") == F.col("_u")).join(ends, F.col("target") == F.col("_tu")).select(F.lit(0), none("long"), F.col("_un"), "dst", F.lit("depends_on"), F.lit("resolved"))
    edges = numbered(uses.union(calls).toDF("pass", "origin", "src", "dst", "kind", "certainty"), [F.col("pass"), F.col("origin"), F.col("src"), F.col("dst")], "id")
    return nodes, edges.select("id", "src", "dst", "kind", "certainty", "origin")


def validate(nodes: DataFrame, edges: DataFrame) -> None:
    """Ids are dense, ends exist, and containment is a forest; else ValueError."""
    n, top, distinct = nodes.agg(F.count("*"), F.max("node"), F.count_distinct("node")).first()
    if n and (top != n - 1 or distinct != n):
        raise ValueError("node ids are not dense")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(nodes.where("parent is not null").select("parent"))
    if not ends.join(nodes.select("node"), "node", "left_anti").isEmpty():
        raise ValueError("an edge or parent names no node")
    up = materialise(nodes.where("parent is not null").select("node", "parent"), "forest")
    while True:  # leaves fall off until nothing is left, or nothing falls
        inner = materialise(up.join(up.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"), "forest")
        before, after = up.count(), inner.count()
        if not after:
            return
        if after == before:
            raise ValueError("containment has a cycle")
        up = inner
