"""Baseline JPEG media columns: a lossless DC writer and a DC-only luminance reader.

The writer stores one 8-bit sample in each 8x8 block, as the block's constant
value: with a DC quantiser of 8 the coefficient is the sample less 128, exactly,
so that a baseline decoder shows flat blocks and a DC-only thumbnail of the
image is the stored samples. Every row of blocks ends in a restart marker.

The reader parses the markers, finds the restart intervals of all scans in a
batch, and Huffman-decodes all of them in step: each numpy operation moves
every interval on by one symbol. AC coefficients are skipped, DC coefficients of
the first component become the luminance thumbnail. It reads any baseline JPEG
of 8 bits with interleaved or single-component scans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import short_batches, utf8

#: Blocks in a row of the images that are written, and rows of one image (65,535 lines at most).
WIDTH, HEIGHT = 64, 8191

# Fixed values of the format: marker codes.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE

#: Code lengths of the DC categories 0 to 8 of the images that are written; the only AC symbol is end of block.
#: A block of code, extra bits and end takes one byte, or two where neighbours differ by 32 or more, so that the
#: same text gives the same bytes wherever it stands, and the codec of the files that hold the images finds repeats.
_DC_LENGTHS = {0: 7, 1: 6, 2: 5, 3: 4, 4: 3, 5: 2, 6: 9, 7: 8, 8: 7}


# ---------------------------------------------------------------- Huffman tables


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table given as the format gives it: codes of each length, and the symbols in order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit prefix: length << 8 | symbol; 0 where there is no code."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for symbol, code, length in canonical(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _dc_table() -> tuple[list[int], list[int]]:
    order = sorted(_DC_LENGTHS, key=lambda s: (_DC_LENGTHS[s], s))
    return [sum(n == k for n in _DC_LENGTHS.values()) for k in range(1, 17)], order


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int, comment: bytes) -> bytes:
    counts, symbols = _dc_table()
    return b"".join(
        [
            bytes([0xFF, SOI]),
            _segment(COM, comment),
            _segment(DQT, bytes([0] + [8] + [1] * 63)),
            _segment(SOF0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            _segment(DHT, bytes([0x00, *counts, *symbols])),
            _segment(DHT, bytes([0x10, 1, *[0] * 15, 0])),
            _segment(DRI, WIDTH.to_bytes(2, "big")),
            _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """Code (with extra bits and the end of block, a single 0) and its length for each difference -255 to 255."""
    code, length = np.zeros(511, dtype=np.uint64), np.zeros(511, dtype=np.uint64)
    codes = {symbol: (c, n) for symbol, c, n in canonical(*_dc_table())}
    for d in range(-255, 256):
        category = abs(d).bit_length()
        c, n = codes[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        code[d + 255] = ((c << category | extra) << 1)
        length[d + 255] = n + category + 1
    return code, length


_tables: dict[str, object] = {}


def encode(payloads: list[bytes], comments: list[bytes]) -> list[bytes]:
    """Store each payload (a positive multiple of 64 bytes) as one image, or several in a row where it is long."""
    code, length = _tables.setdefault("writer", _writer_tables())
    frames = [(i, at, min(len(p), at + WIDTH * HEIGHT)) for i, p in enumerate(payloads) for at in range(0, len(p), WIDTH * HEIGHT)]
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDTH)
    dc = np.ascontiguousarray(samples.T).astype(np.int32)  # step by lane
    lanes = dc.shape[1]
    # A row takes at most 64 blocks of 16 bits, 128 bytes; stuffing comes after.
    out = np.zeros((lanes, 128), dtype=np.uint8)
    flat, base = out.reshape(-1), np.arange(lanes, dtype=np.int64) * 128
    held, bits, at = np.zeros(lanes, dtype=np.uint64), np.zeros(lanes, dtype=np.uint64), np.zeros(lanes, dtype=np.int64)
    last = np.full(lanes, 128, dtype=np.int32)
    for step in range(WIDTH):
        index = dc[step] - last + 255
        last = dc[step]
        n = length[index]
        held = held << n | code[index]
        bits += n
        if step % 2 or step == WIDTH - 1:  # up to 7 + 2 * 16 bits are held
            for _ in range(4):  # bytes
                full = np.flatnonzero(bits >= 8)
                if not len(full):
                    break
                left = bits[full] - np.uint64(8)
                flat[base[full] + at[full]] = (held[full] >> left).astype(np.uint8)
                bits[full] = left
                at[full] += 1
            held &= (np.uint64(1) << bits) - np.uint64(1)
    odd = np.flatnonzero(bits)
    room = np.uint64(8) - bits[odd]
    flat[base[odd] + at[odd]] = (held[odd] << room | (np.uint64(1) << room) - np.uint64(1)).astype(np.uint8)
    at[odd] += 1
    # Put the rows one after another with FF 00 for FF, and a restart marker after each.
    inside = np.arange(128)[None, :] < at[:, None]
    data = out[inside]
    stuffed = data == 0xFF
    row_of = np.repeat(np.arange(lanes), at)
    extra = np.cumsum(stuffed) - stuffed
    place = np.arange(len(data)) + extra + 2 * row_of
    body = np.zeros(len(data) + int(stuffed.sum()) + 2 * lanes, dtype=np.uint8)
    body[place] = data
    row_end = np.cumsum(at + np.bincount(row_of, weights=stuffed, minlength=lanes).astype(np.int64) + 2)
    body[row_end - 2] = 0xFF
    row = 0
    media: list[list[bytes]] = [[] for _ in payloads]
    for i, begin, stop in frames:
        rows = (stop - begin) // WIDTH
        marks = 0xD0 + np.arange(rows) % 8
        marks[-1] = EOI
        body[row_end[row : row + rows] - 1] = marks
        begin_byte = int(row_end[row - 1]) if row else 0
        media[i].append(_header(rows, comments[i]) + body[begin_byte : int(row_end[row + rows - 1])].tobytes())
        row += rows
    return [b"".join(m) for m in media]


# ---------------------------------------------------------------- reading

#: A marker that is neither stuffing nor a restart.
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass
class Frame:
    """What the markers of one image say, and where its entropy-coded scan lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    quantisers: dict[int, int] = field(default_factory=dict)  # the DC step
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    begin: int = 0
    end: int = 0


def parse(data: bytes) -> list[Frame]:
    """The images that follow each other in ``data``. Other than baseline, 8 bits, first scan: ValueError."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != bytes([0xFF, SOI]):
            raise ValueError("no start of image")
        frame, at = Frame(), at + 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            while data[at] == 0xFF:
                at += 1
            marker, size = data[at], int.from_bytes(data[at + 1 : at + 3], "big")
            body, at = data[at + 3 : at + 1 + size], at + 1 + size
            if marker == COM:
                frame.comment = body
            elif marker == DQT:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == DHT:
                while body:
                    n = 17 + sum(body[1:17])
                    frame.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                    body = body[n:]
            elif marker == DRI:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker in (SOF0, SOF0 + 1):
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker == SOS:
                ids = [c[0] for c in frame.components]
                frame.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
            elif 0xC1 < marker < 0xD0 and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
        if not (stop := _SCAN_END.search(data, at)):
            raise ValueError("the scan does not end")
        frame.begin, frame.end = at, stop.start()
        at = data.find(bytes([0xFF, EOI]), frame.end) + 2
        if at < 2:
            raise ValueError("the image does not end")
        out.append(frame)
    return out


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails (rows by columns of uint8) of the images in each element of ``media``."""
    frames = [(i, f) for i, data in enumerate(media) for f in parse(data)]
    groups: dict[tuple, list[int]] = {}
    for k, (_, f) in enumerate(frames):
        layout = tuple((c, f.components[c][1:3] if len(f.scan) > 1 else (1, 1), f.tables[0, d], f.tables[1, a]) for c, d, a in f.scan)
        groups.setdefault(layout, []).append(k)
    found: list[np.ndarray | None] = [None] * len(frames)
    for layout, members in groups.items():
        for k, thumb in zip(members, _decode(layout, [(media[frames[k][0]], frames[k][1]) for k in members]), strict=True):
            found[k] = thumb
    out: list[list[np.ndarray]] = [[] for _ in media]
    for (i, _), thumb in zip(frames, found, strict=True):
        out[i].append(thumb)
    return out


def _decode(layout: tuple, members: list[tuple[bytes, Frame]]) -> list[np.ndarray]:
    """Images with the same scan layout and tables, all restart intervals in step."""
    raw, lanes_of, units_of, size_of = [], [], [], []
    starts: list[np.ndarray] = []
    total = 0
    for data, f in members:
        scan = np.frombuffer(data, dtype=np.uint8)[f.begin : f.end]
        mark = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] >= 0xD0) & (scan[1:] <= 0xD7)) if len(scan) > 1 else np.empty(0, np.int64)
        drop = np.zeros(len(scan), dtype=bool)
        drop[1:] = (scan[:-1] == 0xFF) & (scan[1:] == 0)
        drop[mark] = drop[mark + 1] = True
        kept = scan[~drop]
        before = np.cumsum(~drop)
        starts.append(total + np.concatenate(([0], before[mark])))
        raw.append(kept)
        total += len(kept)
        hmax, vmax = max(c[1] for c in f.components), max(c[2] for c in f.components)
        h, v = layout[0][1]
        if len(layout) > 1:
            wide, high = -(-f.width // (8 * hmax)), -(-f.height // (8 * vmax))
        else:
            _, ch, cv, _ = f.components[layout[0][0]]
            wide, high = -(-(-(-f.width * ch // hmax)) // 8), -(-(-(-f.height * cv // vmax)) // 8)
        units = wide * high
        size_of.append((wide, high, h, v))
        lanes_of.append(len(mark) + 1)
        units_of.append(np.minimum(f.restart or units, units - np.arange(len(mark) + 1) * (f.restart or units)))
    stream = np.concatenate([*raw, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]  # 32 bits from each byte on
    at = np.concatenate(starts) * 8
    units = np.concatenate(units_of)
    lanes, longest = len(at), int(units.max())
    blocks = [(n, c) for n, (c, (h, v), _, _) in enumerate(layout) for _ in range(h * v)]
    dc_of = [lookup(list(t[:16]), list(t[16:])) for _, _, t, _ in layout]
    ac_of = [lookup(list(t[:16]), list(t[16:])) for _, _, _, t in layout]
    own = layout[0][1][0] * layout[0][1][1]
    value = np.zeros((longest * own, lanes), dtype=np.int16)
    last = np.zeros((len(layout), lanes), dtype=np.int32)
    limit = len(window) * 8 - 8

    def peek(at: np.ndarray) -> np.ndarray:
        """The 25 bits or more from a bit on, at the top of 32."""
        return window[at >> 3] << (at & 7).astype(np.uint32)

    for step in range(longest):
        live = None if int(units.min()) > step else np.flatnonzero(units > step)
        now = at if live is None else at[live]
        seen = 0
        for n, _ in blocks:
            bits = peek(np.minimum(now, limit))
            entry = dc_of[n][bits >> 16].astype(np.int64)
            if not entry.all():
                raise ValueError("a code that the DC table does not have")
            size, category = entry >> 8, entry & 255
            bits = peek(np.minimum(now + size, limit)).astype(np.int64)
            extra = (bits & 0xFFFFFFFF) >> (32 - category)
            extra = np.where(category == 0, 0, extra)
            difference = np.where(extra < (1 << category >> 1), extra - (1 << category) + 1, extra)
            now = now + size + category
            lane = slice(None) if live is None else live
            last[n, lane] += np.where(category == 0, 0, difference).astype(np.int32)
            if n == 0:
                value[step * own + seen, lane] = last[0, lane]
                seen += 1
            now = _skip_ac(now, ac_of[n], peek, limit)
        if live is None:
            at = now
        else:
            at[live] = now
    out, lane = [], 0
    for (_, f), count, (wide, high, h, v) in zip(members, lanes_of, size_of, strict=True):
        per = int((f.restart or wide * high) * own)
        dc = value[:per, lane : lane + count].T.reshape(-1)[: wide * high * own].astype(np.int32)
        lane += count
        grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        step = f.quantisers[f.components[layout[0][0]][3]]
        hmax, vmax = max(c[1] for c in f.components), max(c[2] for c in f.components)
        _, ch, cv, _ = f.components[layout[0][0]]
        tall, broad = -(-(-(-f.height * cv // vmax)) // 8), -(-(-(-f.width * ch // hmax)) // 8)
        # The mean of a block is its DC coefficient over 8, and 128.
        out.append(np.clip((grid[:tall, :broad] * step + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


def _skip_ac(at: np.ndarray, table: np.ndarray, peek, limit: int) -> np.ndarray:
    """Move past the 63 AC coefficients of a block in every lane."""
    at = at.copy()
    left = np.full(len(at), 63, dtype=np.int64)
    busy: np.ndarray | slice = slice(None)
    while True:
        entry = table[peek(np.minimum(at[busy], limit)) >> 16].astype(np.int64)
        if not entry.all():
            raise ValueError("a code that the AC table does not have")
        run, size = entry >> 4 & 15, entry & 15
        at[busy] += (entry >> 8) + size
        done = (run == 0) & (size == 0)
        left[busy] = np.where(done, 0, left[busy] - run - 1)
        if done.all():
            return at
        busy = np.flatnonzero(left > 0)
        if not len(busy):
            return at


def difference_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8 by 9 grid of means is darker than the next in its row."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    columns = np.linspace(0, thumb.shape[1], 10).astype(int)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), dtype=np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    top, low = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=thumb.shape[0])
    top = np.minimum(top, low - 1)
    left, right = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1).clip(max=thumb.shape[1])
    left = np.minimum(left, right - 1)
    sums = total[low][:, right] - total[top][:, right] - total[low][:, left] + total[top][:, left]
    means = sums / ((low - top)[:, None] * (right - left)[None, :])
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


# ---------------------------------------------------------------- columns

#: Bytes of payload that are encoded or decoded in one go.
GO = 1 << 20


def _goes(values: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, v in enumerate(values):
        if held and held + len(v) > GO:
            yield begin, i
            begin, held = i, 0
        held += len(v)
    if begin < len(values):
        yield begin, len(values)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (JPEG) of every whole text: its UTF-8 bytes and zero bytes up to a positive multiple of 64.

    The comment segment holds the length without the padding. Null text is empty.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for begin, end in _goes(texts):
                part = texts[begin:end]
                padded = [t + bytes(-len(t) % 64 if t else 64) for t in part]
                media = encode(padded, [b"bytes=%d" % len(t) for t in part])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, media binary")


def store(docs: DataFrame, where: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the media column of all documents to Parquet files at ``where``, compressed by zstandard, and return a scan of them."""
    rows = to_media(docs, id_col, text_col)
    rows.write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema(rows.schema).parquet(where)


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored images hold: dimensions, thumbnail hashes and digests of the samples read back.

    doc_id, n_bytes (null without the writer's comment), width, height and frames, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, thumbnail_hash and thumbnails_sha1. Images that follow each other in a value
    are one above the other: ``height`` is that of all, and the thumbnail hash is of all thumbnails of the first one's
    width together. Null media gives nulls.
    """
    short_batches(media.sparkSession)
    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    fields = [("n_bytes", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("thumbnail_hash", pa.string()), ("thumbnails_sha1", pa.string())]

    def describe(data: bytes, thumbs: list[np.ndarray]) -> tuple:
        frames = parse(data)
        first = frames[0]
        tower = np.concatenate([t for t in thumbs if t.shape[1] == thumbs[0].shape[1]])
        payload = b"".join(t.tobytes() for t in thumbs)
        stated = first.comment[6:] if first.comment.startswith(b"bytes=") else b""
        return (int(stated) if stated.isdigit() else None, first.width, sum(f.height for f in frames), len(thumbs), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(tower), hashlib.sha1(payload).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(1).to_pylist()
            there = [x for x in held if x is not None]
            found = []
            for begin, end in _goes(there):
                found += map(describe, there[begin:end], thumbnails(there[begin:end]))
            found = iter(found)
            out = [next(found) if x is not None else (None,) * len(fields) for x in held]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema[0].dataType.simpleString()}", *(f"{n} {kinds[t]}" for n, t in fields)]))
