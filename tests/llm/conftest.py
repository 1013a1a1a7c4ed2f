import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, position string, key string"


def rows():
    """Null, empty, letterless and very long texts, exact and near copies, repeated ids, a hot source, clashing columns."""
    rnd = random.Random(7)
    en = "the and that with from this have were which their would there could people about other".split()
    de = "der die und nicht mit eine werden durch zwischen können während größer über schließlich".split()
    make = lambda pool, n: " ".join(rnd.choice(pool) + rnd.choice(["", "", "s", "ly"]) for _ in range(n))
    out = []
    for i in range(60):
        pool, lang = (en, "en") if i % 3 else (de, "de")
        out.append((i, make(pool, rnd.randint(1, 120)), lang, None if i % 11 == 0 else f"s{0 if i % 2 else i % 5}"))
    base = out[4][1] + " " + make(en, 200)
    words = base.split()
    for i in range(60, 70):
        near = list(words)
        near[rnd.randrange(len(near))] = "changed"
        out.append((i, " ".join(near) if i > 62 else base, "en", "s0"))
    out += [(70, None, "en", "s1"), (71, "", "en", "s1"), (72, " \n\t ", None, "s1"), (73, "12 34!", "de", None), (74, make(en, 30_000), "en", "s0"), (75, "The it's  “odd” ² <|endoftext|> 日本 don't\r\n\tÉté", "en", "s2"), (75, "The it's  “odd” ² <|endoftext|> 日本 don't\r\n\tÉté", "en", "s2"), (76, "a", None, "ß")]
    return [(i, t, lang, s, len(t or ""), "clash", "clash", "clash", "clash") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) in order of id."""
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None,) * 9, (None,) * 9, (None, "only text here", None, None, 1, None, None, None, None), (5, "x", None, None, 1, None, None, None, None)], SCHEMA)
