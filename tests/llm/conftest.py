import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size int, target string"


def rows_of(seed=7):
    """Small documents with nulls, empty and long texts, repeated rows, ties, near copies and columns whose names operators use inside."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = line(60)
    for i in range(0, 30, 3):
        texts[i] += "\n" + shared
    texts += [texts[0], texts[1], texts[2].replace(texts[2].split()[0], "changed", 1), "", None, "   ", "\n\n", "a b", line(20_000)]
    langs, sources = ["en", "fr", None], ["s1", "s2", None, "s10"]
    out = [(i, t, langs[i % 3], sources[i % 4], len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, "no id here at all, just words", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def rows():
    return rows_of()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in ids] + [(None, None, None), (5, None, None)], "doc_id bigint, quality int, toxic int")
