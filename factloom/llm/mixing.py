"""Mixing sources to target weights by hash-random keys and exact cuts.

Every row gets a random key from its id; rows are range-sorted by source and
key, distributed prefix sums of the sizes say where each row lies in its
source, and a source is cut where its budget ends. A source whose budget
exceeds its size is taken again from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import nulls_last, positions, prefix_sums, spare
from factloom.llm.rows import finder, with_places
from factloom.scratch import materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix as a share of all sizes; a source's largest target as a multiple of its size.
SHARE, REPEATS = 1.5, 2
SEED = "mix"
WORD = "[^ \\t-\\r]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, target for a table of (source, source_size), one row each.

    Targets are weight times one level, held to ``repeats`` times the source's
    size; the level is raised until the targets sum to ``share`` of all sizes.
    Each round is one aggregate over the sources; nothing else is collected.
    """
    placed, _ = positions(sizes, nulls_last("source"), "mix-sources")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("position", F.lit(len(weights))).cast("int"))
    table = materialise(placed.select("source", "source_size", weight.alias("weight")), "mix-weights")
    total, weighed = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return table.withColumn("target", F.lit(0.0))
    budget, level = share * total, share * total / weighed
    while True:
        full = F.col("source_size") * repeats <= F.col("weight") * F.lit(level)
        held, free = table.agg(F.sum(F.when(full, F.col("source_size") * repeats).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        risen = (budget - held) / free if free else level
        if not free or risen <= level:
            break
        level = risen
    return table.withColumn("target", F.when(full, (F.col("source_size") * repeats).cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row, and the ``carried`` columns.

    A source's budget is its target, rounded to whole words (a half goes up).
    ``taken`` is what the mix takes of a row's size, repeats counted: all of it
    in each full epoch of its source, and in the last, partial epoch what lies
    ahead of the cut, so a source's taken words are exactly its budget. The
    document at the cut is the only one taken in part. ``copies`` counts whole
    documents: every epoch, and the last if at least half the document lies ahead of the cut.

    Null sources are one source and come last; documents of size 0 are never
    taken. Ties in the key are ordered by id and size; rows equal in these are
    interchangeable in size, and each has its own place. Other columns are not
    read; an empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *[F.col(c) for c in carried]), "mix-rows")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    aims = materialise(targets(sizes, weights, share, repeats), "mix-targets")
    starts = prefix_sums(aims, nulls_last("source"), "source_size", "mix-starts").withColumnRenamed("before", "source_start")
    starts = materialise(starts.withColumnRenamed("source", "aim"), "mix-aims")
    placed = prefix_sums(rows, [*nulls_last("source"), F.col("key"), F.col("doc_id"), F.col("size"), *[F.col(c) for c in carried]], "size", "mix-sorted")
    # Both sides are fresh exchanges, so Spark may split a hot source; a small table of sources is broadcast by its size on disk.
    joined = materialise(placed, "mix-placed").join(starts, F.col("source").eqNullSafe(F.col("aim")))
    joined = joined.withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("ahead", F.col("before") - F.col("source_start"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("bigint")
    joined = joined.withColumn("epochs", epochs)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("ahead"))).cast("bigint")
    joined = joined.withColumn("part", part)
    copies = F.col("epochs") + F.when((F.col("size") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"), (F.col("epochs") * F.col("size") + F.col("part")).cast("bigint").alias("taken"), *carried)


def mixed_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``copies`` says, all columns as they were.

    Documents are never cut, so a source's words come within half a document of
    its budget. Every row is counted by its own place, rows that repeat too.
    """
    rows, file, at = with_places(docs)
    taken = mix(rows, words(F.col(text_col)), id_col, source_col, carried=(file, at), **options).where("copies > 0")
    find = finder(taken, file, at, ["copies"], "mix-taken")
    hit, copy = spare(rows, "_mix_hit"), spare(rows, "_mix_copy")
    kept = rows.withColumn(hit, find(F.col(file), F.col(at))).where(F.col(f"{hit}.found"))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{hit}.copies")))).drop(file, at, hit, copy)
