"""Spelling variants against plain Python: the tree, the pairs one edit apart, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftworks.llm import spelling_wavelet as m


def spoilt(rows, least=7):
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 31 == 0 else run
            if len(word) >= least:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor=10):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_tree_reports_what_a_scan_finds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 65, 200):
        perm = rng.permutation(n)
        tree = m.WaveletTree(perm)
        q = rng.integers(0, n + 1, (50, 4))
        query, value = tree.report(*q.T)
        want = sorted((k, int(v)) for k, (l, r, a, b) in enumerate(q) for v in perm[l:r] if a <= v < b)
        assert sorted(zip(query.tolist(), value.tolist())) == want


def family(rng, letters, count, least=7, most=12):
    """Words that are edits of few others, so that groups are dense."""
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(max(2, count // 20))]
    words = set(stems)
    while len(words) < count:
        w = list(rng.choice(sorted(words)[: count // 2 + 1]))
        i = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(i, rng.choice(letters))
        elif i < len(w) and (kind == 1 or len(w) > least):
            w[i : i + 1] = [rng.choice(letters)] if kind == 1 else []
        if len(w) >= least:
            words.add("".join(w))
    return words


@pytest.mark.parametrize("letters, limit", [("ab", m.GROUP), ("aé", 4), ("abcdefgh", 25), ("xyÿ", 1)])
def test_variants_equal_brute_force(spark, monkeypatch, letters, limit):
    """Also where groups are halved down to single positions, and where chunks end after few words."""
    monkeypatch.setattr(m, "CHUNK", 40)
    rng = random.Random(len(letters) + limit)
    words = {w: rng.choice([2, 3, 25, 30, 250, 2500]) for w in family(rng, letters, 250)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert plain(m.variants(df, limit=limit)) == brute(words)


def test_long_words_and_runs_of_one_letter(spark):
    words = {"a" * n: 10**k for k, n in enumerate((7, 8, 9, 10, 12))} | {"b" * 500: 5, "b" * 499 + "c": 60, "b" * 250 + "x" + "b" * 250: 700, "b" * 501: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert plain(m.variants(df)) == brute(words)
    assert {r[0]: r[2] for r in brute(words)}["a" * 7] == "a" * 10


def test_report_equals_brute_force(spark, docs, rows):
    assert plain(m.variant_report(docs)) == brute(spoilt(rows))


def test_report_over_words_with_typos(spark):
    """Runs beside digits, marks and capitals beyond A-Z, repeated rows, a null id; one word is a third of all."""
    rng = random.Random(5)
    words = sorted(family(rng, "abcé", 60))
    rows = [(i % 50 if i % 7 else None, " ".join(rng.choice(words).capitalize() + rng.choice(["", "9", "-x", "É"]) + " commonest" for _ in range(15))) for i in range(200)]
    rows += rows[:20] + [(1, None), (2, "")]
    got = plain(m.variant_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)))
    want = brute(spoilt(rows))
    assert got == want and any(r[1] for r in want)


def test_empty_table(none):
    assert m.variant_report(none).collect() == []
