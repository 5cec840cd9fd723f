"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed lower-case words and word beginnings of five letters. The machine adds a weight for each term and, through
low-rank factors, one for each pair of terms, so an insult together with a group mention can weigh more
than both apart. It is fitted on a bounded sample of labelled rows. Terms get parameters if labels tell them apart by themselves, or
if they are of a pair that labels tell apart from what its two terms lead to expect: a pair counts even where each of
its terms alone says nothing. All other terms get none, which keeps long clean texts at the base score. Scoring covers every whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, released

BITS = 18
FACTORS = 6
MAX_TRAIN = 12_000
FREQUENT = 4096  # terms of which pairs are tried: those in most rows of the sample
MAX_TERMS = 1024  # with parameters; half of them at most for pairs
MIN_Z, MIN_PAIR_Z, MIN_ROWS = 3.5, 6.0, 3
THRESHOLD = 0.7
PREFIX = 5
WORD = re.compile(r"[^\W_]+")


def term(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << BITS) - 1)


def word_terms(word: str) -> list[int]:
    """The term of a word, and of its first letters where it has more."""
    return [term(word), term(word[:PREFIX] + "*")] if len(word) > PREFIX else [term(word)]


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    return np.unique(np.array([t for w in set(WORD.findall((text or "").lower())) for t in word_terms(w)], np.int32))


@dataclass
class Machine:
    """bias, and for each known term (sorted) a weight and a row of factors."""

    known: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, active: np.ndarray) -> float:
        """Probability for the positions `active` in known."""
        v = self.factors[active]
        pairs = 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.bias + self.weight[active].sum() + pairs, -30, 30))))


def chosen(seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms that labels tell apart, strongest first; the FREQUENT commonest terms). seen: [label, term] rows, n: [label] rows."""
    both = seen.sum(0) / n.sum()
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    told = np.flatnonzero((np.abs(z) >= MIN_Z) & (seen.sum(0) >= MIN_ROWS))
    often = np.flatnonzero(seen.sum(0) >= MIN_ROWS)
    return told[np.argsort(-np.abs(z[told]), kind="stable")], often[np.argsort(-seen.sum(0)[often], kind="stable")[:FREQUENT]]


def telling_pairs(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Columns of x (rows by terms, 0 or 1) in pairs whose toxic rows differ from what both terms' rates lead to expect; strongest first.

    Pairs are counted for some columns and rows at a time, so that no more than x, a byte a cell, is held.
    """
    toxic = labels.astype(np.float32)
    base, width = toxic.mean(), x.shape[1]
    rate = (toxic @ x + 1) / (x.sum(0, dtype=np.float32) + 1 / base)  # drawn to the base rate
    strength = np.zeros(width, np.float32)
    for i in range(0, width, 256):
        j = min(i + 256, width)
        both, hit = np.zeros((width, j - i), np.float32), np.zeros((width, j - i), np.float32)
        for k in range(0, len(x), 1024):
            rows = x[k : k + 1024].astype(np.float32)
            part = rows[:, i:j]
            both += rows.T @ part
            hit += rows.T @ (part * toxic[k : k + 1024, None])
        want = np.clip(rate[:, None] * rate[None, i:j] / base, 0.02 * base, 0.98)
        z = np.where((both >= 8) & (both < 0.5 * len(x)), (hit - both * want) / np.maximum(np.sqrt(both * want * (1 - want)), 1.0), 0.0)
        z[np.arange(i, j), np.arange(j - i)] = 0
        strength = np.maximum(strength, np.abs(z).max(1))
    found = np.flatnonzero(strength >= MIN_PAIR_Z)
    return found[np.argsort(-strength[found], kind="stable")]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 2, rounds: int = 200) -> Machine:
    """fit_columns() on sets of terms."""
    labels = np.asarray(labels, np.int64)
    seen = np.zeros((2, 1 << BITS))
    for r, y in zip(rows, labels.tolist()):
        seen[y][r] += 1
    if not len(labels) or labels.min() == labels.max():
        return fit_columns(np.zeros((len(labels), 0), np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32), labels)
    told, often = chosen(seen, np.bincount(labels, minlength=2))
    columns = np.unique(np.concatenate([told[:MAX_TERMS], often])).astype(np.int32)
    x = np.zeros((len(rows), len(columns)), np.uint8)
    for i, r in enumerate(rows):
        x[i, np.isin(columns, r, assume_unique=True)] = 1
    return fit_columns(x, columns, told, labels, seed, rounds)


def fit_columns(x: np.ndarray, columns: np.ndarray, told: np.ndarray, labels: np.ndarray, seed: int = 2, rounds: int = 200) -> Machine:
    """Full-batch Adam on the class-balanced logistic loss. x: 1 where a row has the term of a column; told: terms, strongest first.

    Without both labels the machine scores 0 or 1 for all.
    """
    empty = np.zeros(0, np.int32)
    if not len(labels) or labels.min() == labels.max():
        return Machine(empty, 30.0 if len(labels) and labels.max() > 0 else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    paired = columns[telling_pairs(x, labels)][: MAX_TERMS // 2]
    known = np.unique(np.concatenate([paired, told[: MAX_TERMS - len(paired)]])).astype(np.int32)
    x = x[:, np.searchsorted(columns, known)].astype(np.float32)
    n = np.bincount(labels, minlength=2)
    rng = np.random.default_rng(seed)
    p = [np.zeros(1, np.float32), np.zeros(len(known), np.float32), rng.normal(0, 0.05, (len(known), FACTORS)).astype(np.float32)]
    decay = [0.0, 2e-3, 2e-2]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight, labels = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0]).astype(np.float32), labels.astype(np.float32)
    xt = np.ascontiguousarray(x.T)
    for t in range(1, rounds + 1):
        xv = x @ p[2]
        margin = p[0] + x @ p[1] + 0.5 * ((xv**2).sum(1) - x @ (p[2] ** 2).sum(1))
        g = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        xg = xt @ g
        grads = [np.array([g.sum()]), xg, xt @ (g[:, None] * xv) - p[2] * xg[:, None]]
        for i in range(3):
            d = grads[i] + decay[i] * p[i] / max(1, len(known))
            m[i], s[i] = 0.9 * m[i] + 0.1 * d, 0.999 * s[i] + 0.001 * d * d
            p[i] -= 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Machine(known, float(p[0][0]), p[1].astype(float), p[2].astype(float))


def _terms(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([terms(x.as_py()) for x in b.column(0)], pa.list_(pa.int32())), b.column(1)], names=["terms", "toxic"])


def _bits(columns: np.ndarray):
    """Of each row's terms, those among `columns`, one bit each."""
    place = np.full(1 << BITS, -1, np.int32)
    place[columns] = np.arange(len(columns))

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(0):
                at = place[np.asarray(t.values)]
                bits = np.zeros(len(columns), np.uint8)
                bits[at[at >= 0]] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], names=["bits", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """A machine from at most max_train labelled rows that are not held out, those of least hash of doc_id.

    A document with several labels counts as toxic if one says so, and so do equal sets of terms, which teach once; null labels and ids
    are left out. Spark counts the terms, at most 2 ** BITS; a row is gathered as one bit for each of at most FREQUENT + MAX_TERMS terms.
    """
    picked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(max_train).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "_toxic")
    rows = cut(rows.mapInArrow(_terms, "terms array<int>, toxic int").groupBy("terms").agg(F.max("toxic").alias("toxic")))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit([np.zeros(0, np.int32)] * len(n), np.array(sorted(n), np.int64))
    seen = np.zeros((2, 1 << BITS))
    counts = rows.select(F.explode("terms").alias("term"), "toxic").groupBy("term", "toxic").agg(F.count("*").alias("n")).toArrow()
    seen[counts["toxic"].to_numpy(), counts["term"].to_numpy()] = counts["n"].to_numpy()
    told, often = chosen(seen, np.array([n[0], n[1]]))
    columns = np.unique(np.concatenate([told[:MAX_TERMS], often])).astype(np.int32)
    got = sorted((bytes(r.bits), r.toxic) for r in rows.mapInArrow(_bits(columns), "bits binary, toxic int").collect())
    x = np.unpackbits(np.frombuffer(b"".join(b for b, _ in got), np.uint8).reshape(len(got), -1), axis=1, count=len(columns))
    return fit_columns(x, columns, told, np.array([y for _, y in got], np.int64))


def scorer(machine: Machine):
    """A function from an iterator of Arrow batches (doc_id, text, held_out) to one with scores."""
    place = np.full(1 << BITS, -1, np.int16)
    place[machine.known] = np.arange(len(machine.known))

    def run(batches):
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            scores = []
            for text in b.column(1):
                words = set(WORD.findall((text.as_py() or "").lower()))
                active: set[int] = set()
                for w in words:
                    known = cache.get(w)
                    if known is None:
                        known = cache[w] = tuple(int(place[t]) for t in word_terms(w) if place[t] >= 0)
                    if known:
                        active.update(known)
                scores.append(machine.score(np.array(sorted(active), np.int64)))
                if len(cache) > 200_000:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Null and empty texts have no terms and get the base score; repeated rows and texts of equal terms get equal ones; texts of any length
    are scored whole. An empty table gives an empty result. Ids, labels and columns of other names do not enter.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out().alias("held_out"))
    out = rows.mapInArrow(scorer(machine), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all columns, whatever their names; nulls, ties and long texts as score() says."""
    run = scorer(machine)
    schema = docs.schema

    def kept(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            none = pa.nulls(b.num_rows)
            (scored,) = run([pa.RecordBatch.from_arrays([none, b.column(at), none], names=["doc_id", "text", "held_out"])])
            yield b.filter(pa.array([x < threshold for x in scored.column(2).to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(kept), schema)
