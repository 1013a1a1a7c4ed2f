"""Best-fit packing of token pieces into sequences.

Which document sits where matters only through its length, so the packing is
planned on the histogram of lengths (at most ``capacity`` counts), and the plan
is a short table of runs, whatever the number of documents. Items above one
third of the capacity go in first, at most two to a sequence: the longest is
matched with the longest that still fits beside it. Shorter items then fill,
longest first, the smallest gap that holds them. Each document finds its place
in the plan by its number among the documents of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from factloom.llm.common import positions, short_batches, utf8
from factloom.llm.tokens import encoder
from factloom.scratch import materialise

CAPACITY, END_ID = 1024, 2


# ---------------------------------------------------------------- the plan


@dataclass
class Plan:
    """Runs of equal sequences. Row i: of the items of length[i], those numbered rank[i] on for count[i] go to
    the sequences from sequence[i] on, one each, at offset[i]. Rows are sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class _Gaps:
    """Runs of sequences by the room left: room -> list of (first sequence, how many)."""

    def __init__(self):
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((first, count))

    def best(self, least: int) -> int | None:
        """The smallest room of at least ``least``."""
        i = bisect.bisect_left(self.rooms, least)
        return self.rooms[i] if i < len(self.rooms) else None

    def take(self, room: int, count: int) -> tuple[int, int]:
        first, held = self.runs[room].pop()
        used = min(held, count)
        if used < held:
            self.runs[room].append((first + used, held - used))
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return first, used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan the items of a histogram length -> count; lengths are 1 to ``capacity``."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("a length is outside 1 to the capacity")
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    gaps, sequences = _Gaps(), 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        rows.append((length, used.get(length, 0), count, sequence, offset))
        used[length] = used.get(length, 0) + count
        left[length] -= count

    # Large items: greedy matching from the longest down, each with the longest large partner that fits.
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:
            count = left[a]
            put(a, count, sequences, 0)
            gaps.add(capacity - a, sequences, count)
        else:
            b = large[i]
            count = left[a] // 2 if a == b else min(left[a], left[b])
            if count:
                put(a, count, sequences, 0)
                put(b, count, sequences, a)
                gaps.add(capacity - a - b, sequences, count)
            else:  # one item, whose only partner would be itself
                j = i - 1
                count = 1
                put(a, 1, sequences, 0)
                if j >= 0:
                    put(large[j], 1, sequences, a)
                gaps.add(capacity - a - (large[j] if j >= 0 else 0), sequences, 1)
        sequences += count
        large = [n for n in large if left[n]]
    # Small items, longest first, each into the smallest gap that holds it; a new sequence only where none does.
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            room = gaps.best(n)
            if room is None:
                each = capacity // n
                full, odd = divmod(left[n], each)
                if full:
                    for k in range(each):
                        put(n, full, sequences, k * n)
                    gaps.add(capacity - each * n, sequences, full)
                    sequences += full
                if odd:
                    for k in range(odd):
                        put(n, 1, sequences, k * n)
                    gaps.add(capacity - odd * n, sequences, 1)
                    sequences += 1
            else:
                first, count = gaps.take(room, left[n])
                put(n, count, first, capacity - room)
                gaps.add(room - n, first, count)
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of items by length and number within the length."""
    width = int(p.rank.max(initial=0) + p.count.max(initial=0)) + 1
    i = np.searchsorted(p.length * width + p.rank, length * width + rank, side="right") - 1
    return p.sequence[i] + rank - p.rank[i], p.offset[i]


# ---------------------------------------------------------------- pieces


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece of every whole text.

    Null text is empty and gives the end id alone. A document of more than
    ``capacity`` ids is cut into pieces of that many, of which the first may be
    shorter; no other is cut.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                head = n % capacity or capacity
                for k, start in enumerate([0, *range(head, n, capacity)]):
                    stop = head if k == 0 else start + capacity
                    part = ids[4 * start : 4 * stop]
                    at.append(i)
                    out.append((k, start, stop - start, zlib.crc32(part), part))
            columns = [pa.array(c, type=t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *(n for n, _ in fields)])

    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, name: str = "pack") -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length (1 to ``capacity``); other columns stay.

    Rows are numbered within their length by doc_id and piece; ties are
    interchangeable. Only the histogram of lengths comes to the driver.
    """
    short_batches(items.sparkSession)
    placed, total = positions(items, [F.col("length"), F.col("doc_id"), F.col("piece")], name)
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()} if total else {}
    p = plan(histogram, capacity)
    starts, before = np.zeros(capacity + 2, dtype=np.int64), 0
    for n in sorted(histogram):
        starts[n] = before
        before += histogram[n]
    shared = items.sparkSession.sparkContext.broadcast((p, starts))
    kept = items.columns
    where = [placed.columns.index("length"), placed.columns.index("position")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, starts = shared.value
        for b in batches:
            length = b.column(where[0]).to_numpy()
            sequence, offset = place(p, length, b.column(where[1]).to_numpy() - starts[length])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see ``pieces`` and ``pack``. An empty table gives no rows."""
    return pack(materialise(pieces(docs, tokenizer, id_col, text_col, with_ids=with_ids), "pack-pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit) and documents, one row each, of packed pieces that hold their ids."""
    order = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(order.alias("parts"))  # a sequence holds at most ``capacity`` pieces
    joined = F.aggregate("parts", F.lit(b""), lambda held, x: F.concat(held, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("documents"))
