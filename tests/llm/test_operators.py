"""Each operator against a plain version on a small table, and on empty and null rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import scratch
from factloom.llm import common, jpeg, langid, mixing, packing, quality, sharding, simhash, sketch, tokenstore, warc
from factloom.llm.queries import tokenizer_path

WORD_BPE, BYTE_BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def library_ids(path, text, end=2):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes()


# ---------------------------------------------------------------- op1


def test_warc_round_trip(spark):
    long = "é<p>WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60
    pages = [(1, "http://a/ b\r\n", long, 1), (2, None, long, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", "short", 1), (6, "u", "short", 1), (9, "u", long, 1), (9, "u", long, 1), (None, "u", long, 1), (7, "u", "x" * 999, 1), (8, "u", "x" * 999, 1)]
    where = scratch.path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string, response int"), where)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(spark, where).collect())
    want = Counter()
    for i, _, html, _ in pages:
        body = (html or "").encode()
        again = len(body) >= 1000 and i != 9
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None] += 1
    assert got == want
    kept = warc.read_warc(spark, where)
    assert kept.where("record_type = 'revisit'").count() == 3 and kept.where("target_uri is null").count() == 1
    assert {bytes(r.payload) for r in kept.where("record_type = 'response' and block_length > 1000").collect()} == {long.encode()}
    assert kept.where("record_type not in ('revisit') and payload_digest is not null").count() == 8
    assert warc.read_warc(spark, where, "skip").where("payload is not null").count() == 0


def test_warc_reads_gzip_and_empty(spark, tmp_path):
    import gzip
    import io

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in rows] == [b"hello"] * 2 and rows[0].headers["x-long"] == "a b"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(record[:-8])))
    for payload in ("keep", "digest", "skip"):  # cut in the payload, in the header, and under a predicate that passes the record over
        for cut in (record[:-8], record + record[:-8], record[:30]):
            with pytest.raises(ValueError):
                list(warc.records(io.BytesIO(cut), (), payload))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(record[:-8]), [("in", "warc-type", frozenset(["response"]), False)]))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(record + record[:-8])
    for payload in ("keep", "digest", "skip"):
        with pytest.raises(Exception, match="ends before its length"):
            warc.read_warc(spark, str(tmp_path / "cut"), payload).where("record_type = 'response'").count()
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.page_records(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- op2, op8


def test_langid(docs, empty, nulls, texts):
    got = {(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.predict_documents(docs).collect()}
    for i, held_out, lang, score in got:
        text = dict(texts)[i]
        assert held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in text or ""))
        if i < 60 and len(text.split()) > 8:
            assert lang == ("en" if i % 3 else "de"), text
    assert len(got) == len(texts) - 1  # one row is repeated
    assert langid.predict_documents(empty).count() == 0
    assert {r.lang_pred for r in langid.predict_documents(nulls).collect()} == {"und"}
    model = langid.learn(docs)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {70, 71, 72, 73}.isdisjoint(r.doc_id for r in kept.collect())


def test_bitmask_filters_name_every_language():
    text, other = "shared words here", "anders ganz sicher nicht"
    table = np.zeros(1 << 16, dtype=np.uint64)
    for lang, held in ((0, text), (1, text), (1, other)):
        for s in langid.slots(langid.ngram_hashes(held), 16, 3):
            table[s] |= np.uint64(1 << lang)
    model = langid.Model(["a", "b"], table, 16)
    assert model.predict(other)[0] == "b" and model.predict(text) == ("a", pytest.approx(1.0))


def test_quality(spark, docs, empty, nulls, texts):
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)] + [(None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.predict_documents(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.predicted == int(r.doc_id % 3 != 0) for r in got if r.doc_id < 60 and len(dict(texts)[r.doc_id].split()) > 20]
    assert sum(right) > 0.8 * len(right)
    assert quality.predict_documents(empty, labels).count() == 0
    assert quality.predict_documents(nulls, labels.limit(0)).count() == 4
    model = quality.learn_from_labels(docs, labels)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_on_held_out_shapes():
    rnd = np.random.default_rng(1)
    pool = [f"w{i:x}" for i in rnd.integers(0, 4000, 400)]
    good = [" ".join(rnd.choice(pool, 150)).encode() for _ in range(120)]
    bad = [" ".join(f"{w}!!" for w in rnd.choice(pool, 150)).upper().encode() for _ in range(120)]
    model = quality.fit(good[:80], bad[:80])
    assert min(map(model.score, good[80:])) > 0.7 > max(map(model.score, bad[80:]))


# ---------------------------------------------------------------- op3


def plain_fingerprint(text):
    import xxhash

    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    """Of {id: fingerprint}: id -> smallest id reachable."""
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance and find(i) != find(j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, empty, nulls, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts}
    want = plain_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{fps[i]:016x}", want[i]) for i, _ in texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted((r.id or -1, r.component_id or -1) for r in simhash.near_duplicates(nulls).collect())[:2] == [(-1, -1)] * 2
    assert simhash.keep_one(nulls).count() == 3


@pytest.mark.parametrize("blocks,chunk", [(5, 1024), (6, 8), (8, 1024)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rnd = np.random.default_rng(blocks)
    centres = rnd.integers(0, 1 << 63, 12).tolist()
    fps = {centres[k % 12] ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 8), replace=False)) for k in range(220)}
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, blocks=blocks)).collect()}
    own = plain_components({simhash._signed(x): x for x in fps} | {}, 4)
    assert {x: roots.get(x, x) for x in own} == own


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n) for n in (10, 10**6, 10**9, 10**11)] == [5, 6, 8, 9]


# ---------------------------------------------------------------- op4


def test_token_store(spark, docs, empty, nulls, texts):
    where = scratch.path(spark, "store-test")
    tokenstore.write_store(docs, WORD_BPE, where)
    start, want = 0, Counter()
    whole = {}
    for i, t in texts:
        raw = library_ids(WORD_BPE, t)
        want[i, start, len(raw) // 4, zlib.crc32(raw)] += 1
        whole[start] = raw
        start += len(raw) // 4
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.verified(spark, where).collect()) == want
    assert {r.start: bytes(r.ids) for r in tokenstore.read_documents(spark, where).collect()} == whole
    chunks = tokenstore._chunks(spark, where)
    assert chunks.count() == chunks.select("key").distinct().count() < tokenstore._recipes(spark, where).select(F.explode("digests")).count()
    order = [r.start for r in tokenstore._recipes(spark, where).coalesce(1).collect()]
    assert sorted(order) == sorted(whole)
    for table, n in ((empty, 0), (nulls, 4)):
        at = scratch.path(spark, "store-test")
        tokenstore.write_store(table, WORD_BPE, at)
        assert tokenstore.verified(spark, at).count() == n


def test_altered_store_is_refused(spark, tmp_path):
    where = str(tmp_path / "s")
    tokenstore.write_store(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), WORD_BPE, where)
    bad = tokenstore._chunks(spark, where).withColumn("n_tokens", F.col("n_tokens") + 1).drop("kind")
    bad.write.parquet(f"{where}/bad")
    spark.read.parquet(f"{where}/bad").write.mode("overwrite").parquet(f"{where}/packs/kind=chunks")
    with pytest.raises(Exception, match="not what was stored"):
        tokenstore.verified(spark, where).collect()


def test_cuts_follow_content_and_crcs_combine():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 49000, 9000).astype("<u4"), rnd.integers(0, 49000, 700).astype("<u4")
    ends, moved = tokenstore.cuts(a), tokenstore.cuts(np.concatenate((b, a)))
    assert ends[-1] == 9000 and max(np.diff([0, *ends])) <= tokenstore.MOST
    assert len({e + 700 for e in ends} & set(moved)) > len(ends) / 2
    tables = tokenstore._zero_bytes()
    parts = np.split(a, ends[:-1])
    after = len(a) * 4 - np.array(ends) * 4
    crc = np.array([zlib.crc32(p.tobytes()) for p in parts])
    assert np.bitwise_xor.reduce(tokenstore.shift_crc(crc, after, tables)) == zlib.crc32(a.tobytes())


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_cached_encoding_is_the_library_s(path):
    import random

    from factloom.llm.tokens import encoder

    e, rnd = encoder(path), random.Random(1)
    alphabet = ["a", "Th", "é", " ", "\n", ".", "'", "s", "1", "ü", "İ", "²", "’", "’t", "  ", "\t", "<|", "<|endoftext|>", "CAPS", "日", "\x1c", "\xa0"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        assert e.encode(text) == e.whole(text), repr(text)


# ---------------------------------------------------------------- op5


def plain_shingles(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_sketch_and_edited_texts(docs, empty, nulls, texts):
    got = defaultdict(list)
    for r in sketch.edited_documents(docs).collect():
        got[r.doc_id].append(r)
    errors = []
    for k, (i, text) in enumerate(texts):
        text, following = text or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = next(x for x in got[i] if i != 75 or x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = plain_shingles(text), plain_shingles(edited)
        errors.append(abs(r.near_edited - len(a & b) / max(1, len(a | b)))) if len(a) > 100 else None
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean(errors) < 0.15
    assert got[60][0].fingerprint == got[61][0].fingerprint != got[63][0].fingerprint and got[60][0].near_next == 1.0
    assert sketch.edited_documents(empty).count() == 0 and sketch.edited_documents(nulls).count() == 4


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:1000])), (2, " ".join(words[996:]))], "id int, text string")
    marked = sketch.with_sketch(rows, "text", "sketch").cache()
    whole, part = (marked.where(f"id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in (0, 1))
    low, high = part.join(whole).select(sketch.containment(F.col("s1"), F.col("s0")), sketch.containment(F.col("s0"), F.col("s1"))).first()
    assert low == 1.0 and abs(high - 0.25) < 0.08
    union = marked.where("id > 0").agg(sketch.merged(F.col("sketch"))).first()[0]
    assert union == marked.where("id = 0").first().sketch


# ---------------------------------------------------------------- op6


def test_jpeg_columns(docs, empty, nulls, texts, monkeypatch):
    media = jpeg.to_media(docs)
    want = Counter()
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = jpeg.features(media).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    assert all(r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() for r in got)
    assert jpeg.features(jpeg.to_media(empty)).count() == 0 and jpeg.features(jpeg.to_media(nulls)).count() == 4
    assert jpeg.features(media.limit(1).withColumn("media", F.lit(None).cast("binary"))).first().width is None
    monkeypatch.setattr(jpeg, "HEIGHT", 2)
    payload = bytes(range(256)) * 3
    assert b"".join(t.tobytes() for t in jpeg.thumbnails(jpeg.encode([payload], [b""]))[0]) == payload


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, table, symbol, extra=0, size=0):
        code, length = next((c, n) for s, c, n in jpeg.canonical(*table) if s == symbol)
        self.text += f"{code:0{length}b}" + (f"{extra:0{size}b}" if size else "")

    def done(self):
        self.text += "1" * (-len(self.text) % 8)
        return bytes(int(self.text[i : i + 8], 2) for i in range(0, len(self.text), 8)).replace(b"\xff", b"\xff\x00")


def test_reads_colour_images_with_ac_and_without_restarts():
    rnd = np.random.default_rng(3)
    dc_table, ac_table = ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12))), ([0, 2, 2, 1] + [0] * 12, [0x00, 0x01, 0x12, 0xF0, 0x05])
    wide, high = 3, 2  # of 16 by 16, the last partly outside
    value, last, bits = np.zeros((2 * high, 2 * wide), dtype=int), [0, 0, 0], Bits()
    for y in range(high):
        for x in range(wide):
            for component, v, h in [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0)]:
                dc = int(rnd.integers(-60, 60))
                if not component:
                    value[2 * y + v, 2 * x + h] = dc
                d, last[component] = dc - last[component], dc
                size = abs(d).bit_length()
                bits.put(dc_table, size, d if d >= 0 else d + (1 << size) - 1, size)
                kind = rnd.integers(0, 3)
                if kind == 1:
                    bits.put(ac_table, 0xF0), bits.put(ac_table, 0x12, 2, 2), bits.put(ac_table, 0x05, 31, 5)
                if kind == 2:
                    for _ in range(63):
                        bits.put(ac_table, 0x01, 1, 1)
                else:
                    bits.put(ac_table, 0x00)
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xE0, b"JFIF") + seg(jpeg.DQT, bytes([0x10]) + (16).to_bytes(2, "big") + bytes(126) + bytes([1, *[3] * 64]))
    data += seg(jpeg.SOF0, bytes([8, 0, 30, 0, 41, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    data += seg(jpeg.DHT, bytes([0x00, *dc_table[0], *dc_table[1], 0x10, *ac_table[0], *ac_table[1]])) + seg(jpeg.SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    ((thumb,),) = jpeg.thumbnails([data + bits.done() + b"\xff\xd9"])
    assert thumb.shape == (4, 6) and (thumb == np.clip(value * 2 + 128, 0, 255)).all()
    with pytest.raises(ValueError):
        jpeg.parse(data.replace(b"\xff\xc0", b"\xff\xc2") + b"\xff\xd9")


# ---------------------------------------------------------------- op7


def test_packing(docs, empty, nulls, texts):
    got = packing.pack_documents(docs, BYTE_BPE, with_ids=True).collect()
    pieces, want = defaultdict(list), Counter()
    for i, t in texts:
        raw = library_ids(BYTE_BPE, t)
        n = len(raw) // 4
        head = n % 1024 or 1024
        for k, start in enumerate([0, *range(head, n, 1024)]):
            part = raw[4 * start : 4 * (start + (head if k == 0 else 1024))]
            want[i, k, start, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        pieces[r.sequence_id].append(r)
    for held in pieces.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))] and sum(r.length for r in held) <= 1024
    assert len(pieces) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0 and packing.pack_documents(nulls, BYTE_BPE).count() == 4


def test_plan_is_a_packing_and_near_the_least():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        cap = rnd.choice([1, 5, 16, 100])
        histogram = {n: rnd.randint(1, 6) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, min(cap, 12)))}
        p = packing.plan(histogram, cap)
        length = np.concatenate([np.full(c, n) for n, c in histogram.items()])
        rank = np.concatenate([np.arange(c) for c in histogram.values()])
        sequence, offset = packing.place(p, length, rank)
        filled = np.zeros((p.sequences, cap), dtype=int)
        for n, s, o in zip(length, sequence, offset, strict=True):
            filled[s, o : o + n] += 1
        assert filled.max() == 1 and filled.sum() == length.sum() and (np.diff(filled, axis=1) <= 0).all()
        assert max(Counter(sequence[3 * length > cap]).values(), default=0) <= 2
        assert p.sequences <= 11 / 9 * -(-length.sum() // cap) + sum(2 * n > cap for n in length) * 0.5 + 4
    with pytest.raises(ValueError):
        packing.plan({17: 1}, 16)


# ---------------------------------------------------------------- op9, op10


def test_mixing(docs, empty, nulls, texts):
    got = mixing.mix(docs, mixing.words(F.col("text"))).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.copies <= 2
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full = {s: sum(r["size"] for r in v) for s, v in by.items()}
    target, free, left = {}, set(by), 1.5 * sum(full.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * full[s] <= weight[s] * level}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2 * full[s] for s in over}
        left -= sum(2 * full[s] for s in over)
        free -= over
    for s, held in by.items():
        assert held[0].source_size == full[s] and held[0].target == pytest.approx(target[s])
        assert abs(sum(r["size"] * r.copies for r in held) - target[s]) <= max(r["size"] for r in held) / 2 + 1
        assert sum(r.taken for r in held) == int(target[s] + 0.5) and all(0 <= r.taken <= 2 * r["size"] for r in held)
        assert sum(r.taken not in (r["size"] * k for k in range(3)) for r in held) <= 1
    again = mixing.mix(docs.repartition(5), mixing.words(F.col("text"))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in Counter(r.doc_id for r in got for _ in range(r.copies)).items() if n})
    assert mixing.mix(empty, mixing.words(F.col("text"))).count() == 0 and mixing.mix(nulls, mixing.words(F.col("text"))).count() == 4


def test_sharding(docs, empty, nulls, texts):
    got = sharding.interleave(docs, 7).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    mix = Counter((r.source, r.shard) for r in got)
    for s in {r.source for r in got}:
        held = [mix[s, k] for k in range(7)]
        assert max(held) - min(held) <= 2
    assert sharding.interleave(empty).count() == 0 and sharding.interleave(nulls).count() == 4


def test_positions_and_prefix_sums(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)] + [(None, None)], "k long, v long")
    placed, total = common.positions(rows, [F.col("k")], "t")
    ordered = sorted(placed.collect(), key=lambda r: r.position)
    assert total == 51 and [r.position for r in ordered] == list(range(51)) and [r.k for r in ordered] == [None, *range(50)]
    sums = sorted(common.prefix_sums(rows, [F.col("k")], "v", "t").collect(), key=lambda r: (r.k is not None, r.k))
    assert [r.before for r in sums] == [sum(x.v or 0 for x in sums[:i]) for i in range(51)]


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = Counter(map(tuple, now.collect())), scratch.materialise(stage(spark, now, folder), "p")
        after = Counter(map(tuple, now.collect()))
        assert now.columns == columns and set(after) <= set(before), name
        if name != "mixing to target weights":
            assert all(after[r] <= before[r] for r in after)
    got = Counter(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    want = Counter(map(tuple, corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()))
    assert sum(got.values()) == sum(want.values()) and Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
