"""Texts encoded many at once, and the store that is written from them."""

import random

import pytest

from factloom.llm import tokens, tokenstore
from factloom.llm.queries import tokenizer_path

SIGNS = ["", "", "", ",", ".", "!!", "%%%", ".%%%", "'", "'s", "-x", "7", "_", "…", "’", "\"", ")"]


def _texts(n: int) -> list[str]:
    """Words of 1 to 40 letters in any case, with signs, odd characters, line ends and runs of spaces."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéßøñȺçɏ" if rnd.random() < 0.1 else "abcde") for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 23, 24, 25, 40]))) for _ in range(150)]
    shape = lambda w: rnd.choice([w, w, w.title(), w.upper()]) + rnd.choice(SIGNS)
    texts = [rnd.choice([" ", "\n", "  "]).join(shape(rnd.choice(words)) for _ in range(rnd.randrange(40))) for _ in range(n)]
    return ["", " ", "\n \n", *texts, "日本 a", "a b", "a\tb", "<|endoftext|> a", " a ", "x" * 3000, texts[-1]]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("room", [0, 3, 200, 1 << 20])
@pytest.mark.parametrize("stretch", [1, 64, 1 << 19])
def test_ids_of_many_texts_are_those_of_the_library(file, room, stretch, monkeypatch):
    monkeypatch.setattr(tokens, "ROOM", room)
    monkeypatch.setattr(tokens, "CACHE", room)
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    encoder, texts = tokens.Encoder(tokenizer_path(file)), _texts(300)
    want = [encoder.whole(t) for t in texts]
    for at in (0, 150, 0):
        assert encoder.encode_all(texts[at:]) == want[at:]
    assert encoder.encode_all([]) == [] and encoder.encode_all(["", " "]) == [b"", encoder.whole(" ")]
    assert encoder.words.n <= room


def test_a_word_is_made_once_in_all_its_forms(monkeypatch):
    encoder = tokens.Encoder(tokenizer_path("word_bpe_49k.json"))
    rnd, made, model = random.Random(4), [], encoder.model
    words = ["".join(rnd.choice("abcdefghijklé") for _ in range(9)) for _ in range(5000)]
    monkeypatch.setattr(encoder, "model", lambda piece: made.append(piece) or model(piece))
    encoder.words = tokens.Table(tokens._stems(encoder))
    texts = [" ".join(words), " ".join(w.title() + ".%%%" for w in words), " ".join(w.upper() + "!!" for w in words)] * 2
    want = [encoder.whole(t) for t in texts]
    for t, ids in zip(texts, want, strict=True):
        assert encoder.encode_all([t]) == [ids]
    assert sum(p[0].isalpha() for p in made) == len({*words}) and encoder.words.n == 3 * len({*words}) and not encoder.first

    asked, missing = [], encoder.words.missing
    encoder.words.missing = lambda word: asked.append(word) or missing(word)
    assert encoder.encode_all([*texts, "new New new", "new"])[: len(texts)] == want
    assert asked == ["new", "New"]


def test_a_chunk_is_stored_once_and_every_row_has_its_recipe(spark, tmp_path):
    rnd = random.Random(5)
    text = " ".join(f"w{rnd.randrange(10_000)}" for _ in range(3000))
    rows = [(i // 3, text if i % 2 else text + " end") for i in range(120)] + [(None, text), (None, text), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    where = str(tmp_path / "store")
    tokenstore.write_store(docs, tokenizer_path("word_bpe_49k.json"), where)
    keys = [bytes(r.key) for r in tokenstore._chunks(spark, where).select("key").collect()]
    recipes = tokenstore._recipes(spark, where).select("doc_id", "digests").collect()
    assert len(keys) == len({*keys}) and {*keys} == {bytes(d) for r in recipes for d in r.digests}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in recipes) == sorted((i is not None, i or 0) for i, _ in rows)
    assert tokenstore.verified(spark, where).count() == len(rows)
