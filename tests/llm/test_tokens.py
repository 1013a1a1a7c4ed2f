"""The word caches of the encoder."""

import pytest

from factloom.llm import tokens
from factloom.llm.queries import tokenizer_path

TEXT = "The the THE word, Word. word's (word) wo-rd x1 1x école, École ÉCOLE don't a, a. A, is? is?! \"quoted\" end:\nnext, ß, words; word"


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_held_once(file):
    encoder = tokens.Encoder(tokenizer_path(file))
    words = [f"wo{chr(97 + i)}rd{chr(97 + j)}" for i in range(10) for j in range(10)]
    text = " ".join(["x", *words, *(w + "," for w in words)])
    assert encoder.encode(text) == encoder.whole(text)
    assert len({*encoder.first, *encoder.later}) == 201 and not encoder.letters


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("room", [0, 3, 1000])
def test_ids_are_those_of_the_library_however_full_the_caches(file, room, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", room)
    monkeypatch.setattr(tokens, "PIECES", room)
    encoder = tokens.Encoder(tokenizer_path(file))
    for text in [TEXT, *TEXT.split(), " ".join(reversed(TEXT.split())), TEXT.upper(), TEXT]:
        assert encoder.encode(text) == encoder.whole(text)
    assert max(map(len, (encoder.first, encoder.later, encoder.letters))) <= room
