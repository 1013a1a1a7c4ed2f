"""Whole-text encoding with the tokenizers library, through bounded word caches.

A tokenizer of the byte-pair kind treats every pre-token alone, so a text may
be cut at places that are pre-token borders in any context, and the ids of
equal cuts need be computed only once. Texts that hold anything for which
those borders are not certain go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Letters for which the cuts below are certain.
_L = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: A character outside letters, ASCII and signs that are neither space nor number.
_ODD = re.compile(f"[^\\n -~{_L}¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€]")
_ODD_ASCII = re.compile("[^\\n -~]")
_PARTS = re.compile(f" ?[{_L}]+|[^{_L}]+")
#: ASCII characters that may follow a run of letters and are encoded apart from it, whatever they are.
_TAIL = "".join(c for c in map(chr, range(33, 127)) if c != "'" and not c.isalpha())
#: Entries of a cache of words, and of runs of letters amid signs; some 150 MB in all when full. A full cache is kept as it is.
CACHE, PIECES = 600_000, 100_000
#: Entries of a table of words, each of at most LONGEST bytes of UTF-8; some 60 MB when full. A full table is kept as it is, too.
ROOM, LONGEST = 1 << 20, 24
#: Bytes of text whose words are looked up at once.
STRETCH = 1 << 19


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)


def _word_cache(encoder: Encoder, before: str = "") -> dict[str, bytes]:
    """Word -> ids, made when first asked for and kept while there is room. ``before`` stands ahead of each word."""
    table, model, letters, signs, whole, room = encoder.table, encoder.model, encoder.letters, encoder.signs, encoder.whole, CACHE

    def made(piece: str) -> bytes:
        return array("I", [t.id for t in model(piece)]).tobytes()

    def of_letters(piece: str) -> bytes:
        ids = letters.get(piece)
        if ids is None:
            ids = made(piece)
            if len(letters) < PIECES:
                letters[piece] = ids
        return ids

    class Words(dict):
        def __missing__(self, key: str) -> bytes:
            word = before + key
            if key.isalpha():
                piece = word.translate(table)
                ids = self.get(piece) if not before and piece != key and piece.translate(table) == piece else None
                if ids is None:
                    ids = made(piece)
            elif "'" in word or "\n\n" in word:
                ids = whole(word)
            elif key[:-1].isalpha():  # a word, which stands here by itself too, and its sign
                ids = self[key[:-1]] + signs(key[-1])
            else:
                ids = b"".join([of_letters(p.translate(table)) if p[-1].isalpha() else signs(p) for p in _PARTS.findall(word)])
            if len(self) < room:
                self[key] = ids
            return ids

    return Words()


def _stems(encoder: Encoder) -> Callable[[str], bytes]:
    """What makes the ids of a word without spaces around it. Only runs of letters are kept, in lower case if that is all the same."""
    table, model, signs, whole, room, fold = encoder.table, encoder.model, encoder.signs, encoder.whole, CACHE, encoder.fold
    same = all(table[ord(c)] == c for c in "abcdefghijklmnopqrstuvwxyz") and fold is str.lower

    class Stems(dict):
        def __missing__(self, key: str) -> bytes:
            ids = array("I", [t.id for t in model(key if same and key.isascii() else key.translate(table))]).tobytes()
            if len(self) < room and len(key) <= LONGEST:
                self[key] = ids
            return ids

    stems = Stems()

    def made(word: str) -> bytes:
        stem = word.rstrip(_TAIL)
        if stem.isalpha():
            ids = stems[fold(stem)]
            return ids if len(stem) == len(word) else ids + signs(word[len(stem) :])
        if "'" in word:
            return whole(word)
        return b"".join([stems[fold(p)] if p[-1].isalpha() else signs(p) for p in _PARTS.findall(word)])

    return made


def _grown(a: np.ndarray, need: int) -> np.ndarray:
    """``a`` with room for ``need`` entries; memory that is not written to yet takes no place."""
    if need <= len(a):
        return a
    out = np.empty((max(2 * len(a), need), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class Table:
    """Words and their ids in flat arrays, so that the words of a stretch of text are found together.

    A word is three numbers of eight bytes, filled up with zeros: what is found is equal, not only of equal hash.
    """

    _MASKS = np.array([[(1 << 8 * min(8, max(0, n - 8 * i))) - 1 for i in range(LONGEST // 8)] for n in range(LONGEST + 1)], np.uint64)
    _MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self, missing: Callable[[str], bytes]):
        #: The ids of a word that is not held.
        self.missing = missing
        self.n, self.used = 0, 0
        self.keys, self.begin, self.count = np.empty((1024, 3), np.uint64), np.empty(1024, np.int32), np.empty(1024, np.int32)
        self.pool = np.empty(4096, np.uint32)
        self._deal(12)

    def _deal(self, bits: int) -> None:
        """Four to two slots an entry."""
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)
        self._file(np.arange(self.n, dtype=np.int32))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * self._MIX[0]
        for i in (1, 2):
            h ^= h >> np.uint64(31)
            h = (h + keys[:, i]) * self._MIX[i]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _file(self, entries: np.ndarray) -> None:
        at, last = self._home(self.keys[entries]), (1 << self.bits) - 1
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]  # of several that want a slot one gets it
            left = self.slots[at] != entries
            entries, at = entries[left], at[left] + 1 & last

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        at, last = self._home(keys), (1 << self.bits) - 1
        found = self.slots[at]
        open_ = np.flatnonzero(found >= 0)
        while len(open_):
            held, want = self.keys[found[open_]], keys[open_]
            open_ = open_[(held[:, 0] != want[:, 0]) | (held[:, 1] != want[:, 1]) | (held[:, 2] != want[:, 2])]
            at[open_] = at[open_] + 1 & last
            found[open_] = self.slots[at[open_]]
            open_ = open_[found[open_] >= 0]
        return found

    def _add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        keys = keys[: ROOM - self.n]
        if not len(keys):
            return
        flat, count = np.frombuffer(b"".join(ids[: len(keys)]), np.uint32), np.array([len(x) // 4 for x in ids[: len(keys)]], np.int32)
        n, used = self.n + len(keys), self.used + len(flat)
        self.keys, self.begin, self.count, self.pool = _grown(self.keys, n), _grown(self.begin, n), _grown(self.count, n), _grown(self.pool, used)
        self.keys[self.n : n], self.count[self.n : n], self.pool[self.used : used] = keys, count, flat
        self.begin[self.n : n] = self.used + np.cumsum(count) - count
        old, self.n, self.used = self.n, n, used
        if 2 * n > 1 << self.bits:
            self._deal((4 * n - 1).bit_length() - 1)
        else:
            self._file(np.arange(old, n, dtype=np.int32))

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words of UTF-8 ``data``; where each word begins, and the number of ids ahead of it and at last of all."""
        padded = np.frombuffer(b"%b%b" % (data, bytes(LONGEST)), np.uint8)
        gap = np.concatenate(([True], padded[: len(data) + 1] <= 32))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, size = edge[::2], edge[1::2] - edge[::2]
        if not len(start):
            return np.empty(0, np.uint32), start, np.zeros(1, np.int64)
        short = size <= LONGEST
        keys = np.ndarray((len(data) + 1,), f"V{LONGEST}", padded, 0, (1,))[start].view(np.uint64).reshape(-1, 3)
        keys &= self._MASKS[np.minimum(size, LONGEST)]
        entry = self._find(keys)
        if not short.all():
            entry[~short] = -1
        away = np.flatnonzero(entry < 0)
        count, begin = self.count[entry], self.begin[entry]
        new: dict[bytes, bytes] = {}
        if len(away):
            words = [data[a:b] for a, b in zip(start[away].tolist(), (start + size)[away].tolist(), strict=True)]
            first = []
            for i, w in enumerate(words):
                if w not in new:
                    new[w] = self.missing(w.decode())
                    first.append(i)
            extra = [new[w] for w in words]
            count[away] = [len(x) // 4 for x in extra]
        ahead = np.concatenate((np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)))
        place = np.repeat(begin - ahead[:-1], count) + np.arange(ahead[-1])
        if len(away):
            other = np.repeat(entry < 0, count)
            place[other] = 0
            ids = self.pool[place]
            ids[other] = np.frombuffer(b"".join(extra), np.uint32)
            kept = [i for i in first if len(words[i]) <= LONGEST]
            self._add(keys[away[kept]], [extra[i] for i in kept])
        else:
            ids = self.pool[place]
        return ids, start, ahead


class Encoder:
    """Encodes texts to the little-endian 32-bit ids of one tokenizers file, special tokens not added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        normalize = self.library.normalizer.normalize_str if self.library.normalizer else str
        pretokens = self.library.pre_tokenizer.pre_tokenize_str
        self.model = self.library.model.tokenize
        #: What a letter (or the space before it) becomes ahead of the model, as the library has it.
        known = [c for c in map(chr, range(0x250)) if re.match(f"[{_L}]", c)]
        known += sorted({c.lower() for c in known if len(c.lower()) == 1} - {*known})
        self.table = {ord(c): "".join(piece for piece, _ in pretokens(normalize(c))) for c in known}
        self.table[32] = "".join(piece for piece, _ in pretokens(" a"))[:-1]
        #: What maps words to fewer words of the same ids.
        self.fold = str.lower if all(self.table[ord(c)] == self.table.get(ord(c.lower()[0])) and len(c.lower()) == 1 for c in known) else str
        #: The ids of runs of letters as they reach the model, and of runs of signs.
        self.letters: dict[str, bytes] = {}
        self.signs = lru_cache(10_000)(lambda part: array("I", [t.id for piece, _ in pretokens(normalize(part)) for t in self.model(piece)]).tobytes())
        #: Whether spaces belong to ids (byte-level) or are dropped (words with ends).
        self.spaced = self.whole("a  b") != self.whole("a b")
        self.first = _word_cache(self)
        #: Words after a space.
        self.later = _word_cache(self, " ") if self.spaced else self.first
        #: Words for many texts at once, where spaces are dropped.
        self.words = Table(_stems(self))

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def certain(self, text: str) -> bool:
        """Whether every space of the text is a border between pre-tokens in any context."""
        if "<|" in text or (_ODD_ASCII if text.isascii() else _ODD).search(text):
            return False
        return not self.spaced or not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ")

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as bytes of little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.certain(text):
            return self.whole(text)
        if not self.spaced:
            return b"".join(map(self.first.__getitem__, text.split()))
        start, _, rest = text.partition(" ")
        ids = self.first[start]
        return ids + b"".join(map(self.later.__getitem__, rest.split(" "))) if rest else ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; where spaces are dropped, all words of a stretch are looked up together."""
        if self.spaced:
            return [self.encode(t) for t in texts]
        out = [b"" if not t or self.certain(t) else self.whole(t) for t in texts]
        plain = [i for i, (t, ids) in enumerate(zip(texts, out, strict=True)) if t and not ids]
        parts = [texts[i].encode() for i in plain]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        data, at, total, found = b" ".join(parts), 0, 0, []
        bounds = np.zeros(len(parts), np.int64)  # the number of ids up to the end of each text
        while at < len(data):
            stop = len(data) if len(data) - at <= STRETCH else max(data.rfind(b" ", at, at + STRETCH), data.rfind(b"\n", at, at + STRETCH)) + 1
            if stop <= at:  # a long word
                stop = min((x for x in (data.find(b" ", at), data.find(b"\n", at)) if x > at), default=len(data) - 1) + 1
            ids, start, ahead = self.words.encode(data[at:stop])
            i, j = np.searchsorted(ends, [at, stop], "right")
            bounds[i : j + 1] = total + ahead[np.searchsorted(start, ends[i : j + 1] - at)]
            found.append(ids)
            total, at = total + len(ids), stop
        flat, begin = b"".join(found), 0
        for i, end in zip(plain, bounds.tolist(), strict=True):
            out[i], begin = flat[4 * begin : 4 * end], end
        return out
