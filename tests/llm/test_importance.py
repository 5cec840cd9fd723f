"""Importance resampling against plain Python, with nulls, repeats, long texts and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from siftworks.llm import importance_duckdb as m

TARGET = ["the text of a target with its own words", "another target text", None, "", "mixed CASE Ünïcode\x00words 123"]


def features(text, grams=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=25, seed=7, least=20, grams=2, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(r[0], *features(r[1], grams)) for r in rows]
    s, t = Counter(bucket(f) for _, _, fs in docs for f in fs), Counter(bucket(f) for x in target for f in features(x, grams)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for doc_id, n, fs in docs:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, (r[:5] for r in out)), key=repr)


def plain(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id bigint, text string")


def test_report_equals_brute_force(spark, docs, rows, target):
    got = plain(m.importance_report(docs, target))
    assert got == brute(rows, TARGET)
    assert sum(r[4] is not None for r in got) > 5


def test_other_parameters(docs, rows, target):
    how = {"percent": 60, "seed": 3, "grams": 3, "buckets": 500}
    got = m.importance(docs, target, least_words=5, **how)
    assert plain(got) == brute(rows, TARGET, least=5, **how)


def test_drawn_rows_keep_their_columns(spark, docs, rows, target):
    got = m.resample(docs, target, percent=50, least_words=0)
    assert got.columns == docs.columns
    want = Counter(r[0] for r in brute(rows, TARGET, percent=50, least=0) if r[4])
    kept = [tuple(r) for r in got.collect()]
    assert Counter(r[0] for r in kept) == want and not Counter(kept) - Counter(rows)


def test_empty_tables(none, docs, rows, target):
    assert m.importance_report(none, target).collect() == []
    assert plain(m.importance_report(docs, target.where("false"))) == brute(rows, [])


def test_repeated_rows_are_drawn_one_by_one(spark, target):
    """A hot group of equal rows, in the midst of which the draw ends."""
    rows = [(5, "the text of a target " * 6)] * 300 + [(i, f"other words {i} " * 8) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [r.rank for r in m.importance(df, target).collect() if r.rank]
    assert sorted(got) == list(range(1, 101))
    assert m.resample(df, target).count() == 100


def test_words_and_grams_in_duckdb():
    con = m.connect()
    texts = ["A b", "", "one", "é-Ü 1x\x00y z", "w " * 50_000]
    words, counts, flat = m.bucketed(pa.array([re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in texts], pa.string()), con, m.feature_sql(3, 9_999), 3)
    want = [features(t, 3) for t in texts]
    assert words.tolist() == [n for n, _ in want] and counts.tolist() == [len(f) for _, f in want]
    assert Counter(flat.tolist()) == Counter(zlib.crc32(f.encode()) % 9_999 for _, fs in want for f in fs)
    assert con.sql("select zlib_crc32(x) from (values ('abc'), (null), ('')) v(x)").fetchall() == [(zlib.crc32(b"abc"),), (None,), (0,)]
