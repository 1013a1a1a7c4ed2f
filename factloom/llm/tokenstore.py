"""A content-addressed store of token ids.

A rolling hash over the ids cuts every document into chunks at places that
depend on the ids alone, so documents that share a passage share its chunks.
The store is a folder with

* ``chunks``: each distinct chunk once, by its SHA-256: digest, count and the
  zstandard-compressed little-endian 32-bit ids;
* ``recipes``: the documents in ascending doc_id order: ordinal, doc_id, start,
  n_tokens, the digests and lengths of its chunks and the root of the Merkle
  tree over the digests;
* ``manifest``: number of documents and ids, and the Merkle root over the roots
  of all documents in order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import prefix_sums, short_batches
from factloom.llm.tokens import encoder
from factloom.scratch import materialise

END_ID = 2
#: Ids that the rolling hash sees; a chunk's least, usual and most ids.
WINDOW, LEAST, USUAL, MOST = 16, 64, 512, 4096
#: Digests that a task remembers so as to send each chunk only once.
REMEMBERED = 200_000
LEVEL = 1

_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- chunks


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a document's ids; the last is their number. No ids give no chunk."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    h ^= h >> np.uint64(29)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    rolling = (total[WINDOW:] - total[:-WINDOW]) * _STEP  # of the WINDOW ids that end at each place
    marks = np.flatnonzero(rolling >> np.uint64(40) < np.uint64((1 << 24) // (USUAL - LEAST))) + WINDOW
    out, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        stop = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        out.append(stop)
        at = stop
    if at < n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary SHA-256 tree over the leaves; leaves and inner nodes are told apart; an odd node moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """One row for each document (its recipe) and one for each chunk that its task has not sent lately."""
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [("kind", pa.string()), ("key", pa.binary()), ("n_tokens", pa.int64()), ("data", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, compress = encoder(tokenizer).encode_all, zstandard.ZstdCompressor(level=LEVEL).compress
        sent: set[bytes] = set()
        for b in batches:
            at, out = [], []
            for i, ids in enumerate(encode(b.column(1).to_pylist())):
                raw = ids + end
                begin, digests, lengths = 0, [], []
                for stop in cuts(np.frombuffer(raw, dtype="<u4")):
                    part = raw[4 * begin : 4 * stop]
                    digest = hashlib.sha256(part).digest()
                    digests.append(digest)
                    lengths.append(stop - begin)
                    if digest not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(digest)
                        at.append(None)
                        out.append(("chunks", digest, stop - begin, compress(part), None, None, None))
                    begin = stop
                at.append(i)
                out.append(("recipes", None, len(raw) // 4, None, digests, lengths, merkle(digests)))
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])

    short_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, kind string, key binary, n_tokens long, data binary, digests array<binary>, lengths array<int>, root binary")


def write_store(docs: DataFrame, tokenizer: str, where: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, end each with ``end_id``, and write the store to the folder ``where``.

    Null text is empty. Documents are ordered by doc_id, nulls first; rows that
    share an id are ordered by content. Other columns are not read; an empty
    table gives an empty store. Texts are encoded once, and a chunk crosses the
    network about once for each task that met it.
    """
    spark = docs.sparkSession
    encoded = _encoded(docs, tokenizer, id_col, text_col, end_id)
    # A chunk's copies meet by digest, recipes are dealt by content, and both leave in one pass.
    deal = F.when(F.col("kind") == "chunks", F.xxhash64("key")).otherwise(F.xxhash64("root", "doc_id"))
    dealt = encoded.withColumn("deal", deal).repartition("deal")
    copy = F.row_number().over(Window.partitionBy("kind", "key", "deal").orderBy("n_tokens"))
    packs = f"{where}/packs"
    dealt.withColumn("copy", copy).where("kind = 'recipes' or copy = 1").drop("deal", "copy").write.partitionBy("kind").parquet(packs)
    recipes = spark.read.schema(encoded.schema).parquet(packs).where("kind = 'recipes'").select("doc_id", "n_tokens", "digests", "lengths", "root")
    placed = prefix_sums(recipes, [F.col("doc_id"), F.col("root")], "n_tokens", "store-recipes").withColumnRenamed("before", "start")
    placed.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{where}/recipes")
    _manifest(_recipes(spark, where, docs.select(id_col).schema[0].dataType.simpleString())).write.parquet(f"{where}/manifest")


def _recipes(spark: SparkSession, where: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"doc_id {id_type}, n_tokens bigint, digests array<binary>, lengths array<int>, root binary, start bigint").parquet(f"{where}/recipes")


def _chunks(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema("key binary, n_tokens bigint, data binary, kind string").parquet(f"{where}/packs").where("kind = 'chunks'")


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row: documents, n_tokens and the root of a SHA-256 tree over the documents' roots in order.

    Level by level, a node hashes the children in its stretch of places, so no task holds more than a stretch.
    """
    level = recipes.select(F.shiftright("start", 16).alias("at"), "start", "root", "n_tokens")
    tree = lambda d, order: d.groupBy("at").agg(F.array_sort(F.collect_list(F.struct(order, "root"))).alias("x"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens")).select("at", F.unhex(F.sha2(F.aggregate("x", F.lit(b""), lambda a, y: F.concat(a, y["root"])), 256)).alias("root"), "documents", "n_tokens")
    level = materialise(tree(level.withColumn("documents", F.lit(1).cast("bigint")), "start"), "store-tree")
    while level.select("at").distinct().count() > 1:
        level = materialise(tree(level.select(F.shiftright("at", 10).alias("at"), F.col("at").alias("place"), "root", "documents", "n_tokens"), "place"), "store-tree")
    return level.select("documents", "n_tokens", "root")


# ---------------------------------------------------------------- reading back


def _zero_bytes() -> list[list[np.ndarray]]:
    """For each k, four tables of 256 that move a CRC-32 over 2**k zero bytes."""
    apply = lambda columns, v: np.bitwise_xor.reduce(np.where(v[None, :] >> np.arange(32, dtype=np.uint32)[:, None] & np.uint32(1), columns[:, None], np.uint32(0)))
    one = np.concatenate(([np.uint32(0xEDB88320)], np.uint32(1) << np.arange(31, dtype=np.uint32))).astype(np.uint32)
    for _ in range(3):  # one bit, two, four, eight
        one = apply(one, one)
    out = []
    for _ in range(48):
        out.append([apply(one, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
        one = apply(one, one)
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """The share of each part's CRC-32 in that of a whole in which ``zeros`` bytes follow the part.

    The CRC-32 of joined parts is the exclusive-or of their shares.
    """
    crc = crc.astype(np.uint32)
    for k, t in enumerate(tables):
        on = np.flatnonzero(zeros >> k & 1)
        if len(on):
            v = crc[on]
            crc[on] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return crc


def verified(spark: SparkSession, where: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of the store.

    Every stored chunk is read and held against its digest, every recipe against
    its Merkle root, and all recipes against the manifest. A document's CRC-32
    is put together from those of its chunks, so ids do not cross the network.
    Whatever is missing or altered raises an error.
    """
    short_batches(spark)
    recipes = _recipes(spark, where, id_type)
    kept = spark.read.schema("documents bigint, n_tokens bigint, root binary").parquet(f"{where}/manifest")
    if [tuple(r) for r in _manifest(recipes).collect()] != [tuple(r) for r in kept.collect()]:
        raise ValueError("the recipes do not agree with the manifest")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            crc = []
            for key, n, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = open_(data)
                if len(raw) != 4 * n or hashlib.sha256(raw).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is not what was stored")
                crc.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64())], names=["key", "crc"])

    chunks = _chunks(spark, where).select("key", "n_tokens", "data").mapInArrow(check, "key binary, crc long")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, keys, after, lengths, at = [], [], [], [], []
            for i, (n, digests, sizes, root, start) in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 6)), strict=True)):
                if merkle(digests) != root or sum(sizes) != n:
                    raise ValueError(f"the recipe at {start} does not agree with its root")
                left = n - np.cumsum(sizes)
                at += [i] * len(sizes)
                starts += [start] * len(sizes)
                keys += digests
                after += left.tolist()
                lengths += sizes
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(keys, pa.binary()), pa.array(after, pa.int64()), pa.array(lengths, pa.int64())], names=["doc_id", "start", "key", "after", "length"])

    parts = recipes.mapInArrow(unfold, f"doc_id {id_type}, start long, key binary, after long, length long")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _zero_bytes()
        for b in batches:
            moved = shift_crc(b.column(4).to_numpy(), 4 * b.column(2).to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(moved.astype(np.int64))], names=["doc_id", "start", "length", "share"])

    joined = parts.join(chunks, "key", "left").select("doc_id", "start", "after", "length", F.when(F.col("crc").isNull(), F.raise_error(F.lit("a chunk is missing from the store"))).otherwise(F.col("crc")).cast("long").alias("crc"))
    shares = joined.mapInArrow(share, f"doc_id {id_type}, start long, length long, share long")
    whole = shares.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("n_tokens"), F.bit_xor("share").alias("ids_crc32"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, where: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start and ids (little-endian 32-bit) of every document, put together from its chunks."""
    short_batches(spark)

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([open_(x) for x in b.column(3).to_pylist()], pa.binary())], names=["doc_id", "start", "at", "ids"])

    parts = _recipes(spark, where, id_type).select("doc_id", "start", F.posexplode("digests").alias("at", "key"))
    found = parts.join(_chunks(spark, where).select("key", "data"), "key").select("doc_id", "start", "at", "data")
    rows = found.mapInArrow(inflate, f"doc_id {id_type}, start long, at int, ids binary")
    gathered = rows.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("x"))
    return gathered.select("doc_id", "start", F.aggregate("x", F.lit(b""), lambda a, y: F.concat(a, y["ids"])).alias("ids"))
