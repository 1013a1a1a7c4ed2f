"""Threshold-scaled sketches of word shingles, in DataFrame functions only.

A text's sketch is every hash of its five-word shingles that lies below a fixed
fraction of the hash range. The rule looks at one hash at a time, so sketches
merge by union, and containment and likeness can be estimated between texts
of very unequal length.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import literal_longs, shuffle_partitions, spare

#: Words of a shingle; one hash in FRACTION is retained (a power of two).
SHINGLE, FRACTION = 5, 2
#: Stretches of ids for each shuffle partition, so that chance leaves no partition with many more than another.
STRETCHES = 16


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Add ``name``: the sorted distinct retained hashes (longs from 0 to 2**64 / fraction) of the text column.

    Words are runs of characters other than 0x20 and 0x09-0x0D, lower-cased; a
    text of fewer words than a shingle is one shingle; null and wordless texts
    have an empty sketch.
    """
    words = spare(df, f"_{name}_words")
    if fraction & (fraction - 1) or fraction < 2:
        raise ValueError("fraction is a power of two")
    plain = F.lower(F.coalesce(F.col(text), F.lit("")))
    hashed = F.transform(F.filter(F.split(plain, "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn(words, hashed)
    # The hashes stand in a column of their own, named more than once, so that they are computed once for each row.
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (shingle - 1)), lambda i: F.xxhash64(F.slice(F.col(words), i, shingle)))
    all_ = F.when(F.size(words) >= shingle, many).when(F.size(words) > 0, F.array(F.xxhash64(F.col(words)))).otherwise(F.array().cast("array<bigint>"))
    below = (1 << 64) // fraction
    kept = F.filter(all_, lambda h: (h >= 0) & (h < below)) if fraction > 2 else F.filter(all_, lambda h: h >= 0)
    return df.withColumn(name, F.array_sort(F.array_distinct(kept))).drop(words)


def fingerprint(text: Column, sketch: Column) -> Column:
    """The sketch as text: XXH64 of the whole text, a colon, and the retained hashes, each as 16 hex digits."""
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(digits(F.xxhash64(F.coalesce(text, F.lit("")))), F.lit(":"), F.array_join(F.transform(sketch, digits), ""))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of common shingles in all shingles of two texts; of two empty sketches 1 if ``same``, else 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.when(same, 1.0).otherwise(0.0)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of all texts of a group together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def _stretch(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: two short searches, of about the root of their number.

    The bounds stand in the plan as two literals, however many there are.
    """
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.lit(0).cast("bigint")
    heads = literal_longs([g[0] for g in groups])
    tails = F.from_json(F.lit(json.dumps([g[1:] for g in groups])), "array<array<bigint>>")
    group = F.size(F.filter(heads, lambda b: b <= column))
    within = F.size(F.filter(F.get(tails, group - 1), lambda b: b <= column))
    return F.when(column.isNull() | (group == 0), 0).otherwise((group - 1) * width + 1 + within).cast("bigint")


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the row with the next id; after the last comes the first.

    Ids are whole numbers; null ids come first, and rows that share an id are
    ordered by hash of the carried columns. Ids are cut into stretches at their
    approximate quantiles; an id (or null) that holds several quantiles is cut
    further, by that hash. Each stretch also gets the first row of the next
    one, so that every row finds its successor beside it. One number for each
    stretch comes to the driver, and rows are shuffled once.
    """
    spark = docs.sparkSession
    count = shuffle_partitions(spark) * STRETCHES
    steps = [i / count for i in range(1, count)]
    id_ = F.col(id_col).cast("bigint")
    found = docs.select(id_.alias("id")).agg(F.percentile_approx("id", steps, 10 * count).alias("q"), F.count("*").alias("rows"), F.count("id").alias("there")).first()
    held = Counter(found["q"] or [])
    hot = {q: n for q, n in held.items() if n > 1}
    nulls = 1 + (found["rows"] - found["there"]) * count // max(1, found["rows"])
    at, tie, sent = spare(docs, "_at"), spare(docs, "_tie"), spare(docs, "_sent")
    # Hashes are made not negative, so that their high bits cut a hot id into ranges of them.
    placed = docs.withColumn(tie, F.xxhash64(*carried).bitwiseAND(F.lit((1 << 63) - 1)))
    pieces = F.try_element_at(F.map_from_arrays(literal_longs(list(hot)), literal_longs(list(hot.values()))), id_) if hot else F.lit(None).cast("bigint")
    pieces = F.when(id_.isNull(), F.lit(nulls).cast("bigint")).otherwise(F.coalesce(pieces, F.lit(0).cast("bigint")))
    # Null ids are stretches of their own; so are hot ids, ahead of the greater ids up to the next quantile.
    piece = F.when(pieces > 0, F.shiftright(F.shiftright(F.col(tie), 39) * pieces, 24)).otherwise(F.lit(1 << 24)).cast("bigint")
    placed = placed.withColumn(at, F.when(id_.isNull(), piece).otherwise((_stretch(id_, sorted(held)) + 1) * (1 << 25) + piece))
    firsts = placed.groupBy(at).agg(F.min(F.struct(id_.alias("id"), F.col(tie).alias("tie"))).alias("first"))
    starts = sorted((r[at], r["first"]["id"], r["first"]["tie"]) for r in firsts.collect())
    # The first row of a stretch goes to the stretch before it too, that of the first stretch to the last.
    to: dict[tuple, set[int]] = {}
    for k, (_, i, t) in enumerate(starts):
        to.setdefault((i, t), set()).add(starts[k - 1][0])
    lent = spark.createDataFrame([(*place, sorted(held)) for place, held in to.items()], "_lent_id bigint, _lent_tie bigint, _lent_to array<bigint>")
    # One row for each stretch, so it is sent to every task and the texts are dealt out once, by stretch.
    mixed = placed.join(F.broadcast(lent), id_.eqNullSafe(F.col("_lent_id")) & (F.col(tie) == F.col("_lent_tie")), "left")
    own = F.array(F.struct(F.col(at).alias("at"), F.lit(0).alias("copy")))
    others = F.transform(F.coalesce("_lent_to", F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("at"), F.lit(1).alias("copy")))
    dealt = mixed.withColumn(sent, F.explode(F.concat(own, others)))
    order = Window.partitionBy(F.col(f"{sent}.at")).orderBy(F.col(f"{sent}.copy"), id_.asc_nulls_first(), tie)
    led = dealt.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{sent}.copy").alias(at), *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.where(F.col(at) == 0).drop(at)


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's. Null text is empty; a lone
    document is its own successor; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"]).withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    for text, name in (("text", "sketch"), ("next_text", "next_sketch"), ("edited", "edited_sketch")):  # made after the shuffle, so that they are not dealt out
        rows = with_sketch(rows, text, name)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
    )
