"""Brute-force versions of what SQL cannot say: language filters, compression scores, sketches, image features, row lookups."""

import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom import scratch
from factloom.llm import jpeg, langid, mixing, neardup, quality, rows, sketch

# ---------------------------------------------------------------- op2


def plain_grams(text):
    run = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    run = " " * max(1, 3 - len(run)) + run + " "
    return [run[i : i + 4] for i in range(len(run) - 3)] if run.strip() else []


@pytest.mark.parametrize("text", ["a", "a!", "!a", " a b ", "ab", "ab.", "abc 1", "Äß-ü"])
def test_short_texts_have_ngrams(text):
    assert len(langid.ngram_hashes(text)) == len(plain_grams(text)) > 0


def test_language_filters_against_plain_sets(docs, texts):
    """The same n-grams, the same documents a language, sets in place of filters: a filter may only add false claims."""
    taught, grams = defaultdict(int), defaultdict(Counter)
    for r in docs.collect():
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            taught[r.lang] += 1
            grams[r.lang].update(set(plain_grams(r.text)))
    sets = {lang: {g for g, n in c.items() if n >= max(min(2, taught[lang]), taught[lang] * langid.MIN_SHARE)} for lang, c in grams.items()}
    model = langid.learn(docs.where(langid.bucket(F.col("doc_id"), 5) != 0))
    assert sorted(model.languages) == sorted(sets) and model.false_rate.max() < 0.01
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_documents(docs).collect()}
    for i, text in texts:
        own = plain_grams(text)
        assert len(langid.ngram_hashes(text or "")) == len(own) and len(set(langid.ngram_hashes(text or "").tolist())) == len(set(own))
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        share = {lang: sum(g in s for g in own) / len(own) for lang, s in sets.items()}
        best = max(share.values())
        assert got[i][1] == pytest.approx(best, abs=0.02)
        assert share[got[i][0]] >= best - 0.02


# ---------------------------------------------------------------- op8


def test_score_against_plain_compression(spark, docs):
    """The score from the sizes that zstandard itself gives, window by window."""
    import zstandard

    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(60)], "doc_id long, quality int")
    model = quality.learn_from_labels(docs, labels)
    assert model.good and model.bad
    for r in quality.score(docs.select("doc_id", "text"), model).collect():
        text = (r.text or "").encode()
        sizes = []
        for held in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(c.compress(text[i : i + 256])) for i in range(0, len(text), 256)))
        if not text:
            assert (r.score, r.predicted) == (0.0, 0)
            continue
        difference = min(model.high, max(model.low, (sizes[1] - sizes[0]) / sum(sizes)))
        odds = model.prior + len(text) / (len(text) + 512) * (model.offset + model.slope * difference)
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-12) and r.predicted == (r.score >= 0.7)


def test_labels_that_repeat_or_contradict(spark, docs):
    """Repeated labels count once, contradicting ones teach nothing, and the layout of the tables does not matter."""
    once = [(i, int(i % 3 != 0)) for i in range(60)]
    plain = quality.learn(docs, spark.createDataFrame(once, "doc_id long, quality int"))
    noisy = [*once, *once[:20], (60, 0), (60, 1), (61, None), (None, 1), (62, 7)]
    again = quality.learn(docs.repartition(7), spark.createDataFrame(noisy, "doc_id long, quality int").repartition(5))
    assert plain == again
    few = quality.learn(docs, spark.createDataFrame(once, "doc_id long, quality int"), class_bytes=4000)
    assert 0 < len(few.good) <= 4000 and few == quality.learn(docs.repartition(5), spark.createDataFrame(once, "doc_id long, quality int"), class_bytes=4000)


def test_held_out_accuracy_on_shouted_texts():
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(600)]
    sentence = lambda: " ".join(rnd.choice(pool) for _ in range(rnd.randint(3, 300)))
    good = [sentence() for _ in range(400)]
    bad = [" ".join(w.upper() + "!!" * (k % 2) for w in sentence().split()) for k in range(150)]
    encode = lambda part: [t.encode() for t in part]
    model = quality.fit(encode(good[:300]), encode(bad[:110]))
    kept, passed = [model.score(t) >= 0.7 for t in encode(good[300:])], [model.score(t) >= 0.7 for t in encode(bad[110:])]
    assert sum(kept) >= 0.97 * len(kept) and sum(passed) <= 0.2 * len(passed)
    assert model.score(b"a") == pytest.approx(300 / 410, abs=0.05)  # so short a text is no evidence


# ---------------------------------------------------------------- op5


def spark_xxhash64(values, seed=42):
    import xxhash

    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text):
    words = [spark_xxhash64([w.encode()]) for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (text or "").lower()).split(" ") if w]
    parts = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    return sorted({h for h in map(spark_xxhash64, parts) if h >= 0})


def plain_likeness(a, b, same):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else float(same)


def test_sketches_and_successors_against_a_plain_loop(docs, texts):
    got = defaultdict(list)
    for r in sketch.edited_documents(docs).collect():
        got[r.doc_id].append((r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)))
    text = lambda t: f"{spark_xxhash64([t.encode()]) & (1 << 64) - 1:016x}:" + "".join(f"{h:016x}" for h in plain_sketch(t))
    want = defaultdict(list)
    for k, (i, own) in enumerate(texts):
        own, following = own or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = map(plain_sketch, (own, edited, following))
        want[i].append((text(own), text(edited), round(plain_likeness(a, b, own == edited), 9), round(plain_likeness(a, c, own == following), 9)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_sketch_estimates_are_near_the_true_likeness(spark):
    rnd = random.Random(8)
    pairs, words = [], [f"w{i}" for i in range(3000)]
    for k in range(200):
        a = [rnd.choice(words) for _ in range(rnd.randint(20, 900))]
        b = list(a)
        for _ in range(rnd.randint(0, len(a) // 12)):
            b[rnd.randrange(len(b))] = "x"
        pairs.append((" ".join(a), " ".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    frame = sketch.with_sketch(sketch.with_sketch(frame, "a", "sa"), "b", "sb")
    errors = []
    for r in frame.select("a", "b", sketch.likeness(F.col("sa"), F.col("sb"), F.lit(False)).alias("x")).collect():
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (r.a, r.b))
        errors.append(abs(r.x - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.04 and max(errors) < 0.25


@pytest.mark.parametrize("ids", [[None] * 30 + list(range(30)), [7] * 40 + [None] * 3 + list(range(20)), [5] * 25 + [9] * 25, list(range(3)), [None] * 20, [1]])
def test_successors_with_hot_and_null_ids(spark, ids):
    """Every row's successor is the next in order of id (nulls first) and hash of the text, also where one id holds most rows."""
    rnd = random.Random(1)
    held = [(i, f"t{rnd.randrange(25)}") for i in ids]
    got = sketch.with_next(spark.createDataFrame(held, "id long, text string").repartition(3), "id", ["text"]).collect()
    order = sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, spark_xxhash64([r[1].encode()]) & (1 << 63) - 1))
    want = Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    assert Counter((r.id, r.text, r.next_text) for r in got) == want


# ---------------------------------------------------------------- op6


def plain_difference_hash(samples, width=64):
    """Means of an 8 by 9 grid by plain loops."""
    image = [samples[i : i + width] for i in range(0, len(samples), width)]
    tall, bits = len(image), []
    edge = lambda n, k: [int(n * i / k) for i in range(k + 1)]
    ys, xs = edge(tall, 8), edge(width, 9)
    for y in range(8):
        low = min(max(ys[y + 1], ys[y] + 1), tall)
        top = min(ys[y], low - 1)
        means = []
        for x in range(9):
            cell = [v for line in image[top:low] for v in line[xs[x] : xs[x + 1]]]
            means.append(sum(cell) / len(cell))
        bits += [means[x] < means[x + 1] for x in range(8)]
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def test_image_feature_against_plain_loops(spark, docs, texts, monkeypatch):
    media = jpeg.store(docs, scratch.path(spark, "media-test"))
    got = {r.doc_id: r for r in jpeg.features(media).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.width, r.height, r.thumbnail_hash) == (512, 8 * len(payload) // 64, plain_difference_hash(payload))
    monkeypatch.setattr(jpeg, "HEIGHT", 3)  # several images a text: the hash is of all of them
    one, other = bytes(range(64)) * 8, bytes(range(64)) * 4 + bytes(range(63, -1, -1)) * 4
    found = []
    for payload in (one, other):
        (data,) = jpeg.encode([payload], [b""])
        tower = np.concatenate(jpeg.thumbnails([data])[0])
        assert tower.tobytes() == payload
        found.append(jpeg.difference_hash(tower))
        assert found[-1] == plain_difference_hash(payload)
    assert found[0] != found[1]


# ---------------------------------------------------------------- rows by place


@pytest.mark.parametrize("bits", [18, 2])
def test_finder_brings_values_to_their_rows(spark, bits):
    frame = spark.range(1000).selectExpr("id", "concat('t', id) AS text", "id % 3 AS _row_at").repartition(3)
    placed, file, at = rows.with_places(frame.where("id < 900"))
    assert at != "_row_at" and placed.count() == placed.select(file, at).distinct().count() == 900
    table = placed.where("id % 7 = 0").select(file, at, (F.col("id") * -2).alias("v"))
    find = rows.finder(table, file, at, ["v"], "finder-test", bits)
    got = placed.select("id", find(F.col(file), F.col(at)).alias("hit")).collect()
    assert {r.id: r.hit.v for r in got} == {i: -2 * i if i % 7 == 0 else None for i in range(900)}
    none = rows.finder(table.limit(0), file, at, ["v"], "finder-test")
    assert placed.where(none(F.col(file), F.col(at))["found"]).count() == 0


def test_scans_are_told_from_other_frames(spark):
    scan = scratch.materialise(spark.range(9).selectExpr("id", "id AS b"), "scan-test")
    for frame in (scan, scan.where("id > 3").select("id")):
        assert rows._is_scan(frame)
    for frame in (spark.range(3), scan.union(scan), scan.select(F.explode(F.array(F.lit(1), F.lit(2)))), scan.distinct(), scan.join(scan.select("id"), "id")):
        assert not rows._is_scan(frame)
        placed, file, at = rows.with_places(frame)
        assert placed.select(file, at).distinct().count() == frame.count()


# ---------------------------------------------------------------- whole-table edges


@pytest.mark.parametrize("stage", [neardup.keep_one, mixing.mixed_rows])
def test_stages_on_repeated_rows_and_reserved_names(spark, stage):
    """Rows that repeat, and columns with the names that the stages use themselves."""
    clash = ["_row_file", "_row_at", "_stays", "_mix_hit", "_mix_copy", "_row_key", "copies", "_metadata"]
    held = [(1, "one two three four five six", "a", *("z" * len(clash))), (1, "one two three four five six", "a", *("z" * len(clash)))] * 3 + [(2, "other words in this text here", None, *("y" * len(clash)))]
    frame = spark.createDataFrame(held, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in clash))
    out = stage(frame)
    assert out.columns == frame.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(map(tuple, held))
    if stage is neardup.keep_one:
        assert sorted(got.values()) == [1, 1]


def test_mixed_rows_count_each_repeated_row_for_itself(spark):
    """Rows that share id, source and size are mixed one by one, so that they do not overshoot the budget."""
    held = [(1, "w w w w w w w w w w", "a")] * 40 + [(2, "v v v v v", "b")] * 8
    mixed = mixing.mixed_rows(spark.createDataFrame(held, "doc_id long, text string, source string"))
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    plan = {r.source: r.target for r in mixing.mix(spark.createDataFrame(held, "doc_id long, text string, source string"), mixing.words(F.col("text"))).collect()}
    assert all(abs(words[s] - plan[s]) <= 5 for s in plan)


def test_pipeline_stages_on_empty_and_null_tables(spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string, lang_pred string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    nulls = [(None,) * 8, (None,) * 8, (3, None, "en", None, 0, None, None, None), (4, "x y", None, "s", 3, "c", "c", "c")]
    for table in ([], nulls):
        docs = scratch.materialise(spark.createDataFrame(table, schema), "edge")
        for name, stage in corpus_pipeline.STAGES:
            out = scratch.materialise(stage(spark, docs, folder), "edge")
            assert out.count() <= 2 * len(table), name
            if name != "best-fit packing":
                assert out.columns == docs.columns, name


def test_texts_of_megabytes_are_read_whole(spark):
    """op2 and op8 judge by the whole text: what decides stands at its end."""
    good, bad = "the quiet words of a plain text go on ", "BUY!! NOW!! CHEAP!! "
    texts = [(i, (good if i % 2 else bad) * 20 + str(i), "en" if i % 2 else "xx") for i in range(120)]
    long = [(1000, good * 10 + bad * 200_000, None), (1001, bad * 10 + good * 100_000, None)]
    docs = spark.createDataFrame([*texts, *long], "doc_id long, text string, lang string")
    model = quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality.score(docs.where("doc_id >= 1000"), model).collect()}
    assert scores[1000] < 0.3 < 0.7 < scores[1001]
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs.where("doc_id >= 1000"), langid.learn(docs.where("doc_id < 1000"))).collect()}
    assert found == {1000: "xx", 1001: "en"}


def test_plans_deal_out_no_texts(spark, docs):
    """Neither near-dedup nor the mix has a join or an exchange on its way from the scan to the rows that it returns."""
    for stage in (neardup.keep_one, mixing.mixed_rows):
        plan = stage(docs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_queries_cover_their_sql_and_name_each_operator():
    from factloom.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries()) and [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert json.dumps(sorted(queries.oracle_sql())) == '["op10_sharding", "op1_warc", "op9_mixing"]'
