"""A compression classifier: how much better do good texts compress a text than bad ones do?

One zstandard dictionary is trained on labelled good texts and one on bad ones.
Each whole text is cut into windows, every window is compressed with both, and
the difference of the two compressed sizes over their sum is calibrated by
logistic regression. Nothing else of the text enters the score but its length,
which says how much evidence the difference is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from factloom.llm.common import filter_texts, short_batches, spare, utf8
from factloom.llm.langid import bucket
from factloom.scratch import materialise

#: Bytes of a window: short, so that what the dictionary holds matters more than what the window repeats.
WINDOW = 256
#: Labelled documents of each class that dictionaries and calibration read (in expectation), and bytes read of a class.
PER_CLASS, CLASS_BYTES = 3000, 24 << 20
#: Bytes of either dictionary at most, and the compression level.
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Bytes of text at which the difference counts half as much as in a text without end.
HALF_EVIDENCE = 512
#: Documents that score less are rejected.
THRESHOLD = 0.7


@dataclass
class Model:
    """Two dictionaries and a calibration: log odds = prior + evidence * (offset + slope * difference).

    The difference is held to ``low`` and ``high``, the range that the calibration has seen.
    """

    good: bytes
    bad: bytes
    prior: float
    offset: float = 0.0
    slope: float = 0.0
    low: float = 0.0
    high: float = 0.0
    _open: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": []}

    def _compressors(self):
        if not self._open:
            import zstandard as z

            for held in (self.good, self.bad):
                content = z.ZstdCompressionDict(held)
                content.precompute_compress(level=LEVEL)
                self._open.append(z.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False, write_checksum=False))
        return self._open

    def difference(self, text: bytes) -> float:
        """Bytes that the bad dictionary's output has more than the good one's, over the sum of both; of an empty text 0."""
        if not text or not self.good:
            return 0.0
        good, bad = (c.compress for c in self._compressors())
        g = b = 0
        for at in range(0, len(text), WINDOW):
            part = text[at : at + WINDOW]
            g += len(good(part))
            b += len(bad(part))
        return (b - g) / (b + g)

    def score(self, text: bytes) -> float:
        """The calibrated chance that the label is 1; of an empty text 0."""
        if not text:
            return 0.0
        return float(_sigmoid(self.prior + evidence(len(text)) * (self.offset + self.slope * min(self.high, max(self.low, self.difference(text))))))


def evidence(n):
    """How much the difference of a text of n bytes counts, from 0 to 1."""
    return n / (n + HALF_EVIDENCE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, given: float = 0.0, ridge: float = 0.1, rounds: int = 100, each: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls.

    ``given`` are log odds that every row has besides; ``each`` row counts so often (1).
    """
    each = np.ones(len(y)) if each is None else each
    loss = lambda w: each @ np.logaddexp(0, (1 - 2 * y) * (given + x @ w)) + ridge * (w @ w) / 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(given + x @ w)
        grad = x.T @ (each * (p - y)) + ridge * w
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step, now = np.linalg.solve(hess, grad), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """A dictionary of the windows of each class. Both aim at the same size, an eighth of the smaller class at most.

    Where there is too little to train on, the texts themselves, one after another, serve.
    """
    import zstandard as z

    whole = min(sum(map(len, texts)) for texts in (good, bad))
    size = min(DICTIONARY_BYTES, max(256, whole // 8))
    try:
        return tuple(z.train_dictionary(size, [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)], level=LEVEL).as_bytes() for texts in (good, bad))
    except z.ZstdError:
        return tuple(b"\n".join(texts)[:whole] for texts in (good, bad))


def fit(good: list[bytes], bad: list[bytes], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Every second text of each class trains its dictionary, the others calibrate: none is judged by a dictionary that it made.

    With one class only, every text scores as that class; of a class with one
    text, that text serves both ends. ``weights``: how many labelled texts a
    good and a bad one stand for.
    """
    good, bad = [t for t in good if t], [t for t in bad if t]
    if not good or not bad:
        return Model(b"", b"", 4.0 if good or not bad else -4.0)
    half = lambda rows, k: rows[k::2] or rows
    prior = float(np.log(len(good) * weights[0] / (len(bad) * weights[1])))
    model = Model(*dictionaries(half(good, 0), half(bad, 0)), prior)
    left = [*half(good, 1), *half(bad, 1)]
    y = np.array([1.0] * len(half(good, 1)) + [0.0] * len(half(bad, 1)))
    raw, counts = np.array([model.difference(t) for t in left]), evidence(np.array([len(t) for t in left]))
    each = np.where(y == 1, *weights)
    centre = float(np.average(raw, weights=each))
    scale = float(np.sqrt(np.average((raw - centre) ** 2, weights=each))) + 1e-9
    offset, slope = logistic(np.column_stack([counts, counts * (raw - centre) / scale]), y, prior, each=each)
    model.offset, model.slope = float(offset - slope * centre / scale), float(slope / scale)
    model.low, model.high = float(raw.min()), float(raw.max())
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    """Fit on about ``per_class`` labelled rows of each class, chosen by hash of the id.

    The sample, whose ids are broadcast, is written to scratch and is the only
    thing that comes to the driver: in the order of the hash, texts of a class
    are taken until ``class_bytes`` are reached, so the model does not depend on
    how the tables are laid out. Each row counts for as many as it was drawn
    from, so the chance of a class does not depend on the bounds. Rows without
    label or text, texts over ``class_bytes`` and ids with contradicting labels
    teach nothing; repeated labels of an id count once, and labels other than 0
    and 1 are ignored. Every row of a repeated id teaches.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    marks = materialise(marks.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("_id", "label"), "quality-labels")
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {c: min(1.0, per_class / max(1, counts.get(c, 0))) for c in (0, 1)}
    share = F.when(F.col("label") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("_id")), F.lit(1 << 30))
    sample = marks.withColumn("draw", draw).where(F.col("draw") / float(1 << 30) < share)
    body = utf8(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), body.alias("body")).where(F.octet_length("body").between(1, class_bytes)).join(F.broadcast(sample), "_id")
    rows = materialise(rows.withColumn("tie", F.xxhash64("body")), "quality-sample")
    place = ["draw", "_id", "tie"]
    so_far = Window.partitionBy("label").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = rows.select("label", "draw", "_id", "tie", F.sum(F.octet_length("body")).over(so_far).alias("bytes"))  # some 2 x per_class rows
    ends = {r["label"]: r for r in order.groupBy("label").agg(F.count("*").alias("drawn"), F.count(F.when(F.col("bytes") <= class_bytes, 1)).alias("taken"), F.max(F.when(F.col("bytes") <= class_bytes, F.struct(*place))).alias("last")).collect()}
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    stand_for = {0: 1.0, 1: 1.0}
    for c, end in ends.items():
        taken = rows.where(F.col("label") == c).where(F.struct(*place) <= F.struct(*[F.lit(x).cast(rows.schema[n].dataType).alias(n) for n, x in zip(place, end["last"], strict=True)]))
        texts[c] = [bytes(r["body"]) for r in taken.orderBy(*place).select("body").collect()]
        stand_for[c] = end["drawn"] / max(1, len(texts[c])) / shares[c]
    return fit(texts[1], texts[0], (stand_for[1], stand_for[0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score and predicted to the ``keep`` columns (all, if None). Every whole text is read; null and empty texts score 0.

    The columns score and predicted of the input, if any, are replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], utf8(text_col).alias(spare(docs, "_quality_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=[*kept, "score", "predicted"])

    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they were."""
    return filter_texts(docs, utf8(text_col), lambda m, text: m.score(text) >= threshold, model)


def learn_from_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labels whose bucket of four is not 2."""
    return learn(docs, labels.where(bucket(F.col("doc_id"), 4) != 2))


def predict_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels whose bucket of four is not 2, and score every row: doc_id, held_out, score, predicted."""
    model = learn_from_labels(docs, labels)
    held_out = (bucket(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(docs.select("doc_id", held_out, "text"), model, "text", ["doc_id", "held_out"])
