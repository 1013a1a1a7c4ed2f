"""Near-duplicates by SimHash fingerprints and an exact Jaccard test of five-word shingles.

The fingerprint of a text has BITS bits: a bit is 1 if over half of the text's
distinct shingles have it. Two texts of likeness 0.8 or more differ in a bit
with a chance of at most DIFFER. Those that differ in at most DISTANCE of the
first COMPARED bits are linked; strangers come that near with a chance of 2 in
10^14 (a distance of 4 in 64 bits finds copies alone: pairs at 0.8 lie some 10
of 64 bits apart, and among ten million texts every text has strangers within
12). Only texts that agree on all sampled bits of some key are compared; keys
have more bits and are more the more texts there are, and up to FILE texts have
one key of no bit, so that all pairs are compared.

The groups so linked say which texts may be alike. Within each group every pair
is open to an exact test on the whole shingle sets, and the pairs that pass are
searched as a graph whose spanning forest is returned, as in
``simhash.spanning_links``. By calculation a pair at the threshold is missed
with a chance of 3 in 100,000 at twelve million texts, of 15 in 100,000 if the
sets are of some fifteen shingles, and of 4 in 1000 at worst, which are texts
of eight and nine words; fewer texts and closer pairs have less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from factloom.llm.common import short_batches, utf8
from factloom.llm.rows import finder, with_places
from factloom.llm.simhash import components, keep_least
from factloom.scratch import materialise

SHINGLE, LIKENESS = 5, 0.8
#: Bits of a fingerprint; the first of them that are compared, at most DISTANCE apart; bits of the first 64 that may differ in a first look.
BITS, COMPARED, DISTANCE, GLANCE = 1024, 256, 68, 25
#: The chance that a bit differs at likeness 0.8 (0.15 for many shingles, 0.16 for some of few), and that no key of such a pair agrees.
DIFFER, MISS = 0.16, 2e-5
#: Members of one file, that is of one key: usual at most, and in a chunk of those that have more.
FILE = 1024
FILE_CHUNK = 4096
#: Members and bytes of shingles that one task compares; groups with more are dealt out as pairs of chunks.
CHUNK, CHUNK_BYTES = 1024, 8 << 20

_SEEDS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 values, ascending, of all shingles of a whole text in UTF-8; of a shorter text that of its words.

    Words are as in ``simhash.fingerprint``; a text without a word has none.
    """
    import xxhash

    words = text.lower().split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts)))


def fingerprint(marks: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes as BITS / 8 bytes: each hash gives BITS bits by splitmix64, and a bit is 1 if over half have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(marks), 255):
        z = marks[at : at + 255, None] + _SEEDS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(marks), bitorder="little")


def sampled(texts: int) -> np.ndarray:
    """The places of the bits of each key (a row a key) for so many texts: strangers share a file with FILE others at most."""
    bits = max(0, math.ceil(math.log2(max(1, texts) / FILE)))
    keys = math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFER) ** bits))) if bits else 1
    return np.random.default_rng(5).permuted(np.tile(np.arange(BITS), (keys, 1)), axis=1)[:, :bits]


def keys_of(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The keys of fingerprints (a row each), as many as ``places`` has rows; keys of different rows do not meet."""
    keys, bits = places.shape
    packed = np.packbits(np.unpackbits(prints, axis=1, bitorder="little")[:, places.ravel()].reshape(len(prints), keys, bits), axis=2, bitorder="little")
    wide = np.zeros((len(prints), keys, 8), dtype=np.uint8)
    wide[:, :, : packed.shape[2]] = packed
    return wide.view(np.int64)[:, :, 0] + (np.arange(keys, dtype=np.int64) << 40)


def bands(marks: np.ndarray, texts: int = 1 << 18) -> np.ndarray:
    """The keys, among so many texts, of a shingle set that is not empty."""
    return keys_of(fingerprint(marks)[None], sampled(texts))[0]


def close(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) between rows of COMPARED bits (as 64-bit words) that connect exactly what all pairs at most DISTANCE apart connect.

    They go from the first row of each component to its others, so that the
    files that hold the same texts give much the same links.
    """
    n = len(prints)
    first = np.ascontiguousarray(prints[:, 0])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    pairs = 0
    for at in range(0, n - 1, 256):
        x, y = np.nonzero(np.bitwise_count(first[at : at + 256, None] ^ first[None, at:]) <= GLANCE)
        x, y = x[x < y] + at, y[x < y] + at
        near = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= DISTANCE
        pairs += int(near.sum())
        if pairs > 4 * n:
            return _search(prints)
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
    return [(r, x) for x in list(parent) if (r := root(x)) != x]


def _search(prints: np.ndarray) -> list[tuple[int, int]]:
    """As ``close``, where pairs are many: a row is compared only with those not yet reached."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        seed, rest = int(rest[0]), rest[1:]
        stack = [seed]
        while stack and len(rest):
            near = np.bitwise_count(prints[rest] ^ prints[stack.pop()]).sum(axis=1, dtype=np.int64) <= DISTANCE
            found = rest[near].tolist()
            out.extend((seed, b) for b in found)
            stack.extend(found)
            rest = rest[~near]
    return out


def alike(sets: list[np.ndarray], likeness: float = LIKENESS) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the graph of pairs whose Jaccard likeness is ``likeness`` or more."""
    enough = lambda both, whole: both >= likeness * whole - 1e-9
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if enough(both, len(sets[0]) + len(sets[1]) - both) else []
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(names), dtype=bool)
    out: list[tuple[int, int]] = []
    rest = np.arange(len(sets))
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            a = stack.pop()
            if not enough(np.minimum(size[rest], size[a]), np.maximum(size[rest], size[a])).any():
                continue
            mine = flat[starts[a] : starts[a] + size[a]]
            own[mine] = True
            both = np.add.reduceat(own[flat], starts, dtype=np.int64)[rest]
            own[mine] = False
            near = enough(both, size[rest] + size[a] - both)
            found = rest[near].tolist()
            out.extend((a, b) for b in found)
            stack.extend(found)
            rest = rest[~near]
    return out


def _marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, carried: tuple[str, ...]) -> DataFrame:
    """id, fp (XXH64 of the shingle set), print (its SimHash; null without a word), body (XXH64 of the text) and the ``carried`` columns of every row."""
    import xxhash

    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            prints = pa.array([fingerprint(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), prints, *b.columns[2:]], names=["id", "fp", "print", *b.schema.names[2:]])

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("body"), *[F.col(c) for c in carried])
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("fp", LongType()), StructField("print", BinaryType()), *rows.schema[2:]]))


def near(prints: DataFrame) -> DataFrame:
    """Links a, b between fingerprints (fp, a name; print), each held once: at most DISTANCE bits apart and alike in a key.

    ``prints`` is read more than once. Whatever a file's size, no task holds
    more than two chunks of it, and few links are returned for each member.
    """
    short_batches(prints.sparkSession)
    places = sampled(prints.count())
    names = ["fp", *(f"w{i}" for i in range(COMPARED // 64))]

    def filed(whole: bool) -> DataFrame:
        """One row for each key of each fingerprint, with the bits to compare if ``whole``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                bits = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
                columns = [b.column(0).to_numpy(), *bits.view(np.int64).T[: COMPARED // 64]] if whole else []
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys_of(bits, places).ravel(), *(np.repeat(c, len(places)) for c in columns))], names=["key", *names[: len(columns)]])

        return prints.select("fp", "print").mapInArrow(run, ", ".join(f"{c} long" for c in ["key", *names[: len(names) * whole]]))

    large = materialise(filed(False).groupBy("key").agg(F.ceil(F.count("*") / FILE_CHUNK).cast("bigint").alias("parts")).where("parts > 1"), "neardup-files")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    dealt = filed(True)
    if large.head(1):  # at most one for each chunk of the fingerprints
        dealt = (
            dealt.join(large, "key", "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
            .select("key", "parts", "own", other.alias("other"), *names)
            .withColumn("key", F.when(F.col("parts") > 1, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key")))
            .select("key", *names)
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by file; each file is searched once its last row is in."""
        held: list[np.ndarray] = []
        for b in batches:
            held.append(np.column_stack([c.to_numpy() for c in b.columns]))
            if sum(map(len, held)) < 4 * FILE_CHUNK:
                continue
            rows = np.concatenate(held)
            last = np.searchsorted(rows[:, 0], rows[-1, 0])
            held = [rows[last:]]
            yield found(rows[:last])
        if held:
            yield found(np.concatenate(held))

    def found(rows: np.ndarray) -> pa.RecordBatch:
        edge = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist(), len(rows)]
        words = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        pairs = [np.array(stars) + at for at, end in pairwise(edge) if end - at > 1 and (stars := close(words[at:end]))]
        pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[pairs[:, i], 1]) for i in (0, 1)], names=["a", "b"])

    links = dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(search, "a long, b long")
    return links.distinct()


def _links(sets: DataFrame, likeness: float) -> DataFrame:
    """Links a, b between shingle sets (group, fp, marks) of a group. They connect exactly what all its alike pairs connect.

    Whatever a group's size, no task holds more than two chunks of it at once.
    """
    sizes = sets.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.octet_length("marks")) / CHUNK_BYTES)).cast("bigint").alias("parts"))
    large = materialise(sizes.where("parts > 1"), "neardup-large")  # at most one for each chunk of the input
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    dealt = (
        sets.join(large, "group", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .select("group", "fp", "marks", "own", other.alias("other"))
        .select("group", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp", "marks")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by file, so one file is held at a time."""
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        a: list[int] = []
        b: list[int] = []
        for _, file in groupby(rows, key=lambda r: r[:3]):
            held = {fp: marks for *_, fp, marks in file}  # rows that repeat are one
            if len(held) > 1:
                names = list(held)
                for x, y in alike([np.frombuffer(m, dtype=np.uint64) for m in held.values()], likeness):
                    a.append(names[x])
                    b.append(names[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["group", "one", "two"]
    return dealt.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component of texts alike, all columns as they were: that with the smallest id.

    Texts with equal shingle sets are alike, those without a word too. Null ids
    and repeated rows are as in ``simhash.keep_one``; an empty table gives no
    rows. Only fingerprints are dealt out, and the shingle sets of one row of
    each set that may be like another; texts stay where they are.
    """
    short_batches(docs.sparkSession)
    rows, file, at = with_places(docs)
    marks = materialise(_marks(rows, id_col, text_col, shingle, (file, at)), "neardup-marks")
    prints = materialise(marks.where("print IS NOT NULL").groupBy("fp").agg(F.first("print").alias("print")), "neardup-prints")
    loose = components(near(prints))
    grouped = loose.unionAll(loose.select(F.col("root"), "root").distinct()).select(F.col("node").alias("fp"), F.col("root").alias("group"))
    # The texts of one row of each set in a group are read again: their sets are exact, and only these are dealt out.
    first = materialise(marks.groupBy("fp").agg(F.min(F.struct(F.col(file).alias("file"), F.col(at).alias("at"))).alias("first")), "neardup-first")
    find = finder(first.join(grouped, "fp").select("first.file", "first.at", "group", "fp"), "file", "at", ["group", "fp"], "neardup-wanted")
    texts = rows.select(utf8(text_col).alias("text"), find(F.col(file), F.col(at)).alias("place")).where("place.found")
    # Written first: a task that looked places up and cut texts in one go would hold two Python workers.
    texts = materialise(texts.select("place.group", "place.fp", "text"), "neardup-texts")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, shingle).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["group", "fp", "marks"])

    sets = texts.mapInArrow(whole, "group long, fp long, marks binary")
    exact = components(_links(materialise(sets, "neardup-sets"), likeness))
    found = marks.select("id", "fp", "body", file, at).join(exact, marks.fp == exact.node, "left").select("id", "body", F.coalesce("root", "fp").alias("root"), file, at)
    return keep_least(rows, found, file, at)
