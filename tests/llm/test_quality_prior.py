"""The bounded label sample does not shift the score."""

import numpy as np

from factloom.llm import quality


def table(spark):
    """3600 good and 360 bad texts that share most of their words, so that many scores lie between 0 and 1."""
    rnd = np.random.default_rng(4)
    pool = [f"w{i:x}" for i in rnd.integers(0, 4000, 500)]
    rows = []
    for i in range(3960):
        weights = np.ones(500)
        weights[:250] = 1.0 if i % 11 else 2.2
        rows.append((i, " ".join(rnd.choice(pool, 60, p=weights / weights.sum())), int(i % 11 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    return docs.cache(), [t.encode() for _, t, _ in rows]


def test_capped_and_uncapped_fits_agree(spark):
    docs, texts = table(spark)
    capped, whole = (quality.learn(docs.drop("quality"), docs, per_class=n) for n in (360, 10_000))
    a, b = (np.array([m.score(t) for t in texts]) for m in (capped, whole))
    assert abs(a.mean() - b.mean()) < 0.03 and abs(a.mean() - 10 / 11) < 0.03
    assert abs((a >= quality.THRESHOLD).mean() - (b >= quality.THRESHOLD).mean()) < 0.05
    docs.unpersist()
