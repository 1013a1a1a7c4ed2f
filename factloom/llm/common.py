"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.scratch import materialise
from factloom.ship import ship

#: Rows in an Arrow batch. Texts may be very long, so batches are short.
ARROW_ROWS = 256

_LOCAL = (1 << 33) - 1


def short_batches(spark: SparkSession) -> None:
    """Make ready for Python on the executors: they get this package, and at most ARROW_ROWS rows cross at once."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` and so on that no column of ``df`` has, whatever its case."""
    held = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(held) + 2))) if n.lower() not in held)


def nulls_last(name: str) -> list[Column]:
    return [F.col(name).isNull(), F.col(name)]


def utf8(name: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def literal_longs(values: list[int]) -> Column:
    """An array of longs that stands in the plan as one literal, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def by_partition(totals: dict[int, int], pid: Column) -> Column:
    """Look a partition's value up in a literal array: its size is the number of partitions."""
    return F.get(literal_longs([totals.get(i, 0) for i in range(max(totals, default=0) + 1)]), pid.cast("int"))


def positions(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Number the rows from 0 in ``order``: adds long ``position``; also returns the row count.

    Rows are range-partitioned and sorted, written once to scratch, and only one
    count for each partition comes to the driver. No single task sees all rows.
    Rows that ``order`` leaves tied are numbered in any order.
    """
    spark = df.sparkSession
    placed = materialise(
        df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()),
        name,
    )
    pid = F.shiftright("_mid", 33)
    counts = {r["pid"]: r["n"] for r in placed.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    where = by_partition(starts, pid) + F.col("_mid").bitwiseAND(F.lit(_LOCAL))
    return placed.withColumn("position", where).drop("_mid"), total


def prefix_sums(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add long ``before``: the sum of ``value`` over all rows ahead in ``order``.

    Only one sum for each range partition comes to the driver; the sums within a
    partition are a window over that partition's rows.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    placed = materialise(
        df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()),
        name,
    )
    pid = F.shiftright("_mid", 33)
    sums = {r["pid"]: r["n"] or 0 for r in placed.groupBy(pid.alias("pid")).agg(F.sum(value).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sums):
        starts[p] = total
        total += sums[p]
    window = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_pid", pid)
    within = F.sum(F.coalesce(F.col(value), F.lit(0))).over(window) - F.coalesce(F.col(value), F.lit(0))
    return placed.withColumn("before", by_partition(starts, F.col("_pid")) + within).drop("_mid", "_pid")


def filter_texts(docs: DataFrame, text: Column, keeps: Callable[[object, object], bool], model: object) -> DataFrame:
    """The rows for whose text ``keeps(model, text)`` is true, all columns as they were. The model is broadcast."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(text.alias(spare(docs, "_filter_text")), *[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            keep = pa.array([keeps(held, t) for t in b.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]).filter(keep)

    return rows.mapInArrow(run, docs.schema)
