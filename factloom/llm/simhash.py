"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into ``blocks`` blocks. Two fingerprints that differ in at
most d bits agree on at least ``blocks - d`` of them, so each fingerprint is
filed once under every choice of that many blocks, and only fingerprints filed
together are compared. Equal fingerprints are one from the start, so a group
of copies, however large, is one entry.

Within a file, members are searched as a graph: a member is compared only with
those not yet reached, and one link for each newly reached member is returned.
The links within a file are thus a spanning forest of all links there, never
all pairs, and connect exactly what all pairs would. A file larger than CHUNK
is dealt out as pairs of chunks to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import short_batches, spare, utf8
from factloom.llm.rows import finder, with_places
from factloom.scratch import materialise

SHINGLE, BITS, DISTANCE = 4, 64, 4
#: Members of one file that one task compares; more are dealt out as pairs of chunks.
CHUNK = 1024
#: Fingerprints in a file, if they were random, from which more blocks are cut.
CROWD = 4


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text given as UTF-8; 0 for a text without a word.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D;
    every shingle of ``shingle`` words (the whole sequence, if shorter) counts
    each time it occurs; a bit is 1 where over half of the XXH64 values have it.
    """
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long), body (XXH64 of the text) and the ``carried`` columns of every row; null text is empty."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("body"), *[F.col(c) for c in carried])
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("fp", LongType()), *rows.schema[2:]]))


# ---------------------------------------------------------------- blocks


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask of each choice of ``blocks - distance`` blocks of a 64-bit word."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    each = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(each[i] for i in pick) for pick in combinations(range(blocks), blocks - distance)]


def blocks_for(distinct: int, distance: int = DISTANCE) -> int:
    """The fewest blocks that leave a file of random fingerprints under CROWD members; every choice finds all pairs."""
    blocks = distance + 1
    while distinct / 2 ** (BITS * (blocks - distance) / blocks) > CROWD and comb(blocks + 1, distance) <= 500:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the graph of pairs at most ``distance`` bits apart."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            a = stack.pop()
            near = np.bitwise_count(fp[rest] ^ fp[a]) <= distance
            if near.any():
                found = rest[near].tolist()
                out.extend((a, b) for b in found)
                stack.extend(found)
                rest = rest[~near]
    return out


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Links between distinct fingerprints (column fp, long): a, b. They connect exactly what all close pairs connect.

    ``fps`` holds each fingerprint once and is read more than once. Whatever a
    file's size, no task holds more than two chunks of it.
    """
    spark = fps.sparkSession
    short_batches(spark)
    masks = block_masks(blocks or blocks_for(fps.count(), distance), distance)
    filed = fps.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("choice", "mask"))
    filed = filed.select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    large = materialise(filed.groupBy("choice", "bits").agg(F.count("*").alias("members")).where(F.col("members") > CHUNK), "simhash-large")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    dealt = (
        filed.join(large, ["choice", "bits"], "left")
        .withColumn("parts", F.coalesce(F.ceil(F.col("members") / CHUNK), F.lit(1)).cast("bigint"))
        .withColumn("own", own)
        .select("fp", "choice", "bits", "own", other.alias("other"))
        .select("fp", F.xxhash64("choice", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("file"), "choice", "bits", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys = ["choice", "bits", "one", "two"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by file; each file is searched once its last row is in."""
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)]))
            if sum(map(len, held)) < 50_000:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
            if not len(last):
                held = [rows]
                continue
            done, held = rows[: last[-1] + 1], [rows[last[-1] + 1 :]]
            yield from found(done)
        if held:
            yield from found(np.concatenate(held))

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.concatenate(([0], np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1, [len(rows)]))
        size = np.diff(edge)
        fp = rows[:, 4].view(np.uint64) if rows.flags.f_contiguous else np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        two = edge[:-1][size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance] if len(two) else two
        a, b = [fp[two]], [fp[two + 1]]
        for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            part = fp[at : at + n]
            if pairs := spanning_links(part, distance):
                p = np.array(pairs)
                a.append(part[p[:, 0]])
                b.append(part[p[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], schema=schema)

    sorted_rows = dealt.repartition("file").sortWithinPartitions(*keys).select("choice", "bits", "one", "two", "fp")
    return sorted_rows.mapInArrow(search, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """The connected components of edges (a, b), as node and root (the smallest node reachable).

    Large-star and small-star rounds, each one written to shared scratch; a hub
    is joined on its smallest neighbour, so no node's neighbours are gathered.
    Self-loops are ignored; repeated edges count once.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    while True:
        # Large-star: every larger neighbour of a node goes to the node's smallest neighbour, itself included.
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)


def _members(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle: int, carried: tuple[str, ...] = ()) -> DataFrame:
    marks = materialise(fingerprints(docs, id_col, text_col, shingle, carried), "simhash-fp")
    classes = materialise(marks.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    found = components(links(classes.select("fp"), distance))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    names = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    named = materialise(rooted.join(names, "root").select("fp", "root", "component_id"), "simhash-named")
    return marks.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of every row.

    Rows with equal fingerprints, and rows of linked fingerprints, are one
    component. Null and wordless texts have fingerprint 0, which is linked like
    any other. Null ids count as larger than any other id. Repeated rows stay.
    Other columns are not read; an empty table gives no rows.
    """
    found = _members(docs, id_col, text_col, distance, shingle)
    return found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component, all columns as they were: that with the smallest id.

    Null ids count as largest; among rows with that id, the one with the least
    hash of its text stays, and of wholly repeated rows one.
    """
    rows, file, at = with_places(docs)
    return keep_least(rows, _members(rows, id_col, text_col, distance, shingle, (file, at)), file, at)


def keep_least(rows: DataFrame, found: DataFrame, file: str, at: str) -> DataFrame:
    """The row with the smallest id of each root, given the id, body, root and place of every row. Texts are not dealt out."""
    least = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body", file, at)).alias("first"))
    find = finder(least.select(F.col(f"first.{file}"), F.col(f"first.{at}")), file, at, [], "simhash-stay")
    stays = spare(rows, "_stays")
    return rows.withColumn(stays, find(F.col(file), F.col(at))).where(F.col(f"{stays}.found")).drop(file, at, stays)
