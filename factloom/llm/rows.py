"""Rows by their place in the files that they are read from.

A decision about a row (keep it, take it twice, it revisits another) is found
on narrow rows: keys, hashes, sizes. To bring it to the wide row, the decision
is written to scratch by the row's place, file and number within the file, and
the tasks that scan the wide rows read the entries of the stretch of the file
that they are at. So neither texts are shuffled nor a table is broadcast,
whatever the size of either side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import short_batches, shuffle_partitions, spare
from factloom.scratch import materialise, path

#: Rows of a file, as a power of two, whose entries a task holds at once.
STRETCH_BITS = 18


def filesystem(uri: str):
    """The pyarrow file system of a path that Spark wrote to, and the path within it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _is_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of files, each at most once: a scan below nothing but projections and filters."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.children().isEmpty() and node.nodeName().startswith("LogicalRelation") and "parquet" in node.toString().lower()


def with_places(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: a hash of the file of each row, and its number there.

    No two rows share both (files by 64-bit hash of their path). Rows that do
    not come straight from Parquet files are written to scratch first.
    """
    if not _is_scan(docs):
        docs = materialise(docs, "rows")
    file, at = spare(docs, "_row_file"), spare(docs, "_row_at")
    place = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].cast("bigint").alias(at)), file, at


def finder(table: DataFrame, file: str, at: str, values: list[str], name: str, bits: int = STRETCH_BITS) -> Callable[[Column, Column], Column]:
    """Writes ``table``, at most one row for each place, and returns what finds its long ``values`` by place.

    The result is a struct: ``found``, and the values (null where there are none).
    """
    spark = table.sparkSession
    short_batches(spark)
    where, parts = path(spark, name), shuffle_partitions(spark)
    part = lambda file, at: F.pmod(F.xxhash64(file, F.shiftright(at, bits)), F.lit(parts)).cast("int")
    entries = table.select(part(F.col(file), F.col(at)).alias("part"), F.col(file).alias("file"), F.col(at).alias("at"), *[F.col(v).cast("bigint").alias(v) for v in values])
    entries.repartition(parts, "part").sortWithinPartitions("part", "file", "at").write.partitionBy("part").parquet(where)
    kind = pa.struct([("found", pa.bool_()), *((v, pa.int64()) for v in values)])

    @F.arrow_udf("struct<" + ", ".join(["found: boolean", *(f"{v}: bigint" for v in values)]) + ">")
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        key, held = None, None
        for file, at, part in batches:
            f, a, p = (x.to_numpy(zero_copy_only=False) for x in (file, at, part))
            hit, out = np.zeros(len(f), dtype=bool), [np.zeros(len(f), dtype=np.int64) for _ in values]
            edge = np.flatnonzero((f[1:] != f[:-1]) | (a[1:] >> bits != a[:-1] >> bits)) + 1
            for begin, end in zip([0, *edge], [*edge, len(f)], strict=True):
                if begin == end:
                    continue
                here = (int(f[begin]), int(a[begin]) >> bits)
                if here != key:
                    key, held = here, _entries(f"{where}/part={int(p[begin])}", *here, values, bits)
                places, columns = held
                i = np.searchsorted(places, a[begin:end])
                ok = (i < len(places)) & (places[np.minimum(i, max(0, len(places) - 1))] == a[begin:end]) if len(places) else np.zeros(end - begin, bool)
                hit[begin:end] = ok
                for o, c in zip(out, columns, strict=True):
                    o[begin:end][ok] = c[i[ok]]
            yield pa.StructArray.from_arrays([pa.array(hit), *(pa.array(o, mask=~hit) for o in out)], fields=list(kind))

    find = find.asNondeterministic()  # so that a filter on the result and its use above share one call
    return lambda file, at: find(file, at, part(file, at))


def _entries(folder: str, file: int, stretch: int, values: list[str], bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and values of one stretch of a file, in order of place."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, at = filesystem(folder)
    found = [x.path for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.File and x.base_name[:1] not in "_."]
    if not found:
        return np.empty(0, np.int64), [np.empty(0, np.int64) for _ in values]
    wanted = (ds.field("file") == file) & (ds.field("at") >= stretch << bits) & (ds.field("at") < (stretch + 1) << bits)
    table = ds.dataset(found, filesystem=store, format="parquet").to_table(columns=["at", *values], filter=wanted, use_threads=False).sort_by("at")
    return table.column("at").to_numpy(), [table.column(v).to_numpy() for v in values]
