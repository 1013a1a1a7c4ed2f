"""The pipeline's near-dedup stage against all pairs by exact likeness."""

import random

import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import neardup


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids that are the least of their component, by all pairs."""
    sets, parent = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both, whole = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 5 >= whole * 4 and find(i) != find(j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted({find(i) for i in ids})


def planted():
    """Texts, copies with words changed here and there (likeness 0.6 to 0.97), a chain, a common passage, short and empty texts."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rnd.randrange(60, 300))] + passage
        rows.append(base)
        for changes in rnd.sample(range(1, 12), 4):
            copy = list(base)
            for _ in range(changes):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(copy)
    chain = [word() for _ in range(200)]
    for _ in range(8):
        rows.append(chain := chain[8:] + [word() for _ in range(8)])
    texts = [" ".join(r) for r in rows] + ["", " \n", "one two", "One  two", "one three", None]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [1024, 4])
def test_stage_keeps_one_of_each_component_at_four_fifths(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert kept == plain_kept(rows) and len(kept) < len(rows) - 60
    assert corpus_pipeline.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_bands_meet_at_the_threshold():
    rnd = np.random.default_rng(2)
    met = 0
    for _ in range(2000):
        marks = rnd.integers(0, 1 << 63, 108, dtype=np.uint64)  # two sets share 90 of 108: likeness 0.83
        met += bool((neardup.bands(marks[:99]) == neardup.bands(marks[9:])).any())
    assert met >= 1995


def prints():
    """Fingerprints of sets in groups near one another and of strangers, with their names."""
    rnd = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rnd.integers(0, 1 << 63, 100, dtype=np.uint64)
        sets += [np.concatenate((base[n:], rnd.integers(0, 1 << 63, n, dtype=np.uint64))) for n in range(0, 12, 2)]
    return [(i, neardup.fingerprint(s)) for i, s in enumerate(sets + [rnd.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(100)])]


def components_of(pairs):
    root = {}
    for a, b in pairs:
        a, b = root.setdefault(a, {a}), root.setdefault(b, {b})
        if a is not b:
            a |= b
            root.update(dict.fromkeys(b, a))
    return sorted({tuple(sorted(x)) for x in root.values()})


@pytest.mark.parametrize(("file", "chunk"), [(1024, 4096), (16, 4096), (16, 3)])
def test_candidates_are_fingerprints_a_distance_apart(spark, monkeypatch, file, chunk):
    """Whatever the number of keys and the size of the chunks, the links connect what all pairs of close fingerprints connect."""
    monkeypatch.setattr(neardup, "FILE", file)
    monkeypatch.setattr(neardup, "FILE_CHUNK", chunk)
    rows = prints()
    words = np.array([p for _, p in rows]).view(np.uint64)[:, : neardup.COMPARED // 64]
    apart = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    want = components_of(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= neardup.DISTANCE, 1))), strict=True))
    links = neardup.near(spark.createDataFrame([(i, p.tobytes()) for i, p in rows], "fp long, print binary")).collect()
    assert components_of((r.a, r.b) for r in links) == want and len(want) == 60
    assert len(links) <= 4 * len(rows)


def test_a_fingerprint_has_the_bits_of_over_half_the_shingles():
    marks = np.arange(1, 601, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def bits(x):
        out = 0
        for i in range(neardup.BITS // 64):
            z = (int(x) + (i + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
            out |= (z ^ z >> 31) << 64 * i
        return out

    all_bits = [bits(x) for x in marks]
    want = sum(1 << k for k in range(neardup.BITS) if sum(b >> k & 1 for b in all_bits) * 2 > len(marks))
    assert int.from_bytes(neardup.fingerprint(marks).tobytes(), "little") == want


def test_pairs_at_the_threshold_are_near_and_share_a_key():
    rnd = np.random.default_rng(6)
    places, missed = neardup.sampled(12_000_000), 0
    for _ in range(500):
        marks = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)  # two sets share 160 of 200: likeness 0.8
        two = np.array([neardup.fingerprint(marks[:180]), neardup.fingerprint(marks[20:])])
        words, keys = two.view(np.uint64), neardup.keys_of(two, places)
        missed += len(neardup.close(words[:, : neardup.COMPARED // 64])) == 0 or not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_the_stage_needs_its_fingerprints(spark, monkeypatch):
    """Without links of fingerprints only texts of equal shingle sets are one: there is no other way to a candidate."""
    monkeypatch.setattr(neardup, "near", lambda prints: prints.sparkSession.createDataFrame([], "a long, b long"))
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.keep_one_of_each(spark, docs, "").count() == len({frozenset(plain_set(t)) for _, t in rows})
