"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each language is kept bit-sliced: a slot holds a word
whose bit l is set if the filter of language l has that slot set. Looking an
n-gram up in k slots and joining the words by AND gives all languages that
(probably) contain it at once. A text's hits are counted for each language,
the hits that the filter's false-positive rate explains are taken off, and the
language with most hits is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from factloom.llm.common import filter_texts, short_batches, spare
from factloom.scratch import materialise

#: Code points of an n-gram; slots of a filter as a power of two; hash functions.
NGRAM, SLOT_BITS, HASHES = 4, 19, 3
#: Documents of each language that the filters are learnt from (in expectation, by hash of doc_id).
PER_LANGUAGE = 3000
#: An n-gram belongs to a language if this share of its documents, and two at least, hold it.
MIN_SHARE = 0.004
#: Texts whose best language explains less of their n-grams are rejected by ``keep_identified``.
MIN_SCORE = 0.35

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngram_hashes(text: str, n: int = NGRAM) -> np.ndarray:
    """A 64-bit hash of each n-gram of a whole text, repeats included; empty if it has no letter.

    The text is lower-cased, and each run of other characters than letters counts as one space.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    run = np.where(letter, codes, np.uint32(32))[kept]
    run = run[:-1] if run[-1] == 32 else run
    run = np.concatenate(([32] * (1 + max(0, n - 2 - len(run))), run, [32])).astype(np.uint64)
    count = len(run) - n + 1
    h = run[:count].copy()
    for i in range(1, n):
        h *= _STEP
        h += run[i : i + count]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(29))


def slots(h: np.ndarray, bits: int, k: int) -> list[np.ndarray]:
    return [(h * _MIX[i]) >> np.uint64(64 - bits) for i in range(k)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bits: int = SLOT_BITS
    k: int = HASHES
    n: int = NGRAM

    def __post_init__(self):
        size = len(self.table)
        fill = np.array([np.count_nonzero(self.table >> np.uint64(i) & np.uint64(1)) / size for i in range(len(self.languages))])
        #: The chance that a language's filter claims an n-gram that it was never given.
        self.false_rate = np.minimum(fill**self.k, 0.999)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the corrected share of n-grams that it explains; ``und`` and 0 without a letter.

        Ties go to the language that taught most documents. With no learnt language every text is ``und``.
        """
        h = ngram_hashes(text, self.n) if text else ()
        if not len(h) or not self.languages:
            return "und", 0.0
        first, *rest = slots(h, self.bits, self.k)
        mask = self.table[first]
        for s in rest:
            mask &= self.table[s]
        hits = np.array([np.count_nonzero(mask & np.uint64(1 << i)) for i in range(len(self.languages))], dtype=float)
        share = np.clip((hits / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE, bits: int = SLOT_BITS, k: int = HASHES, n: int = NGRAM) -> Model:
    """Learn the filters from the given rows; rows without text or language teach nothing.

    About ``per_language`` rows of each language, by hash of the id, are read
    whole. What comes to the driver is the filter, 2**bits slots at most,
    whatever the corpus holds. At most 64 languages fit the mask; more are an error.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(65).collect()}
    if len(counts) > 64:
        raise ValueError("the language mask holds 64 languages")
    languages = sorted(counts, key=lambda lang: (-counts[lang], lang))
    if not languages:
        return Model([], np.zeros(1 << bits, dtype=np.uint64), bits, k, n)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.coalesce("id", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).select(place[F.col("lang")].cast("int").alias("lang"), "text")
    schema = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(np.unique(ngram_hashes(text, n)))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int32()), pa.array([None], pa.int64()), pa.array([1], pa.int64())], schema=schema)
            for lang, grams in held.items():
                value, times = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), lang, np.int32)), pa.array(value.view(np.int64)), pa.array(times)], schema=schema)

    # A row with no gram counts a document, so that shares are of the documents read.
    grams = sample.mapInArrow(count, "lang int, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    grams = materialise(grams, "langid-grams")
    read = {r["lang"]: r["docs"] for r in grams.where("gram is null").collect()}
    least = F.create_map(*[F.lit(x) for lang, m in read.items() for x in (lang, max(min(2, m), m * min_share))]) if read else F.create_map(F.lit(0), F.lit(1.0))
    kept = grams.where(F.col("gram").isNotNull() & (F.col("docs") >= least[F.col("lang")]))
    spread = pa.schema([("slot", pa.int64()), ("mask", pa.int64())])

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, gram = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            at = np.concatenate(slots(gram, bits, k)).astype(np.int64)
            mask = np.tile(np.uint64(1) << lang.astype(np.uint64), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask)], schema=spread)

    filled = kept.select("lang", "gram").mapInArrow(place_bits, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(1 << bits, dtype=np.uint64)
    table[filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    return Model(languages, table, bits, k, n)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to the ``keep`` columns (all, if None). Null or letterless text: ``und``, 0.

    Every whole text is read. The columns lang_pred and score of the input, if any, are replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias(spare(docs, "_langid_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is in a learnt language, all columns as they were. Null and letterless texts go."""

    def keeps(m: Model, text: str | None) -> bool:
        lang, score = m.predict(text)
        return lang != "und" and score >= least

    return filter_texts(docs, F.col(text_col), keeps, model)


def predict_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows whose bucket of five is not 0, and predict every row: doc_id, held_out, lang_pred, score."""
    held_out = (bucket(F.col(id_col), 5) == 0).alias("held_out")
    model = learn(docs.where(~held_out), id_col)
    return identify(docs.select(F.col(id_col).alias("doc_id"), held_out, "text"), model, "text", ["doc_id", "held_out"])
