"""The exact similarity join against all pairs, at several thresholds and block sizes."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftworks.functions import grams
from siftworks.operators import dedup, simjoin


def made(seed, n=120):
    """Sets with common and rare members, near copies, equal sets, subsets, an empty and a null one."""
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        kind = rng.random()
        if i > 5 and kind < 0.5:
            base = set(sets[rng.randrange(i)] or [])
            for _ in range(rng.randint(0, max(1, len(base) // 3))):
                (base.discard(rng.choice(sorted(base))) if base and rng.random() < 0.5 else base.add(rng.randint(-40, 400)))
        else:
            base = {int(rng.paretovariate(0.6)) % 300 for _ in range(rng.randint(1, 40))}
        sets[i] = sorted(base)
    return sets | {n: [], n + 1: None, n + 2: sets[0], n + 3: sets[0], n + 4: [7], n + 5: [7]}


def brute(sets, percent):
    out = []
    for a in sets:
        for b in sets:
            x, y = set(sets[a] or []), set(sets[b] or [])
            if a < b and x and y and 100 * len(x & y) > percent * len(x | y):
                out.append((a, b, len(x & y), len(x & y) / len(x | y)))
    return sorted(out)


@pytest.mark.parametrize("percent, hot", [(70, simjoin.HOT), (70, 3), (50, 5), (90, 1), (99, 2)])
def test_no_pair_is_lost(spark, percent, hot):
    """Also where every shared member is dealt to blocks."""
    sets = made(percent + hot)
    df = spark.createDataFrame(list(sets.items()), "id bigint, members array<bigint>").repartition(4)
    got = sorted(tuple(r) for r in simjoin.jaccard_join(df, "id", "members", percent, hot).collect())
    assert [r[:3] for r in got] == [r[:3] for r in brute(sets, percent)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in brute(sets, percent)])


def test_empty_table_and_bad_threshold(spark):
    df = spark.createDataFrame([], "id bigint, members array<bigint>")
    assert simjoin.jaccard_join(df, "id", "members").collect() == []
    with pytest.raises(ValueError):
        simjoin.jaccard_join(df, "id", "members", percent=0)


def test_classes_are_named_by_their_least_id(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, None)], "id bigint, k string")
    assert sorted(tuple(r) for r in simjoin.classes(df, "id", F.col("k")).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_grams_of_long_texts_are_found_once(spark):
    """A text of 30,000 words takes no longer than its length asks for."""
    words = [f"w{i % 5000}" for i in range(30_000)]
    df = spark.createDataFrame([(" ".join(words),), ("a B",), (None,), ("A b-c",)], "text string")
    got = [r.g for r in df.select(dedup.ngrams(F.col("text")).alias("g")).collect()]
    assert len(got[0]) == 5000 and got[1] == [] and not got[2] and got[3] == ["a b c"]


def test_hashes_of_grams_are_those_of_the_texts():
    """Distinct 3-grams of [a-z0-9]+, whatever parts the words; texts of a slice do not run into each other; another seed gives other hashes."""
    texts = ["", "a b", "a b c", "  a-b\u00e9c\n", "a b c a b c", "\u65e5a\u672cb c d", "ab c", None, "x1 2 3 \x00 4", "c", "a b c"]
    at = pa.array(["skipped", *[t or "" for t in texts]], pa.string()).slice(1)
    row, h = grams.hashes(at)
    want = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (re.findall("[a-z0-9]+", t or "") for t in texts)]
    names = {}
    for k, g in enumerate(want):
        own = h[row == k].tolist()
        assert len(own) == len(g) == len(set(own))
        names.setdefault(frozenset(g), set()).add(tuple(own))
    assert all(len(x) == 1 for x in names.values()) and len({v for x in names.values() for own in x for v in own}) == len(set().union(*want))
    broken = pa.StringArray.from_buffers(1, pa.py_buffer(b"\0\0\0\0\7\0\0\0"), pa.py_buffer(b"a\xffb\xc3 c"[:7].ljust(7)))
    assert grams.hashes(broken)[1].tolist() == h[row == 2].tolist()
    seeded = grams.hashes(pa.array(["a b c", "a b c"]), pa.array(["s", "t"]))[1].tolist()
    assert len({*seeded, h[row == 2][0]}) == 3
