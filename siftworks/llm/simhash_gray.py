"""SimHash near-duplicates found through a hierarchical index over fingerprints in Gray order.

Fingerprints are made in Arrow batches. The distinct ones are dealt by ranges of their Gray rank and sorted by it; the bits that
all fingerprints of a part have in common are its node, and the nodes of all parts are the index's upper level, which every executor
gets. Runs of LEAF neighbours share a (mask, pattern) of common bits. A run goes to its own part
and to those later parts whose node differs from the run's in MAX_DIFF common bits or fewer; all others are pruned there. In a part,
own and foreign fingerprints form two trees; the search goes down pairs of nodes and leaves out whole groups once the differing bits
that all their members share exceed the limit.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, marked, marks, pack, released, unpack

SEED = 42
SHINGLE = 3
MAX_DIFF = 2
FANOUT = 8
LEAF = 64
PER_PART, MAX_PARTS = 20_000, 4096
ONE = np.uint64(1)


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of ASCII-lowered k-word shingles, repeats included; no word gives 0.

    Fewer than k words form one shingle. A bit is set if it is set in over half of the XXH64 values.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < k:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), 0
    while part := [digest(g, SEED) for g in islice(grams, 8192)]:
        n += len(part)
        counts += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches):
    for b in batches:
        fp = [fingerprint(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint, text_hash bigint) of whole texts."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(released(_fingerprints), "doc_id bigint, fp bigint, text_hash bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def common(fps: np.ndarray, first: np.ndarray):
    """(mask of the bits that all members share, their pattern) of the runs that begin at `first`."""
    ones, zeros = np.bitwise_and.reduceat(fps, first), np.bitwise_and.reduceat(~fps, first)
    return ones | zeros, ones


def levels(fps: np.ndarray):
    """Nodes bottom-up over fingerprints in Gray order, as (mask of common bits, their pattern, first child, end of children); one top node."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = [(np.full(len(fps), full), fps, None, None)]
    while len(out[-1][0]) > 1:
        mask, pattern = out[-1][:2]
        first = np.arange(0, len(mask), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        zeros = np.bitwise_and.reduceat(~pattern & mask, first)
        out.append((ones | zeros, ones, first, np.append(first[1:], len(mask))))
    return out


def _children(first, end, other_first, other_end, a, b, same: bool):
    """Pairs of children of the node pairs (a, b); in one tree each unordered pair once."""
    na, nb = end[a] - first[a], other_end[b] - other_first[b]
    n = na * nb
    at = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = first[a][at] + k // nb[at], other_first[b][at] + k % nb[at]
    if same:
        keep = x <= y
        x, y = x[keep], y[keep]
    return x, y


def descend(tree, other, max_diff: int = MAX_DIFF, chunk: int = 500_000):
    """Arrays (a, b) of leaves of the two trees (in one tree: a < b) within max_diff bits, and at last the number of node pairs compared.

    Trees of unlike height wait at the top of the lower one. Memory is bounded by `chunk`.
    """
    same, compared = tree is other, 0
    stack = [(len(tree) - 1, len(other) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        (mask, pattern, first, end), (other_mask, other_pattern, other_first, other_end) = tree[i], other[j]
        compared += len(a)
        near = np.bitwise_count((pattern[a] ^ other_pattern[b]) & mask[a] & other_mask[b]) <= max_diff
        a, b = a[near], b[near]
        if i == j == 0:
            yield (a[a < b], b[a < b]) if same else (a, b)
            continue
        down, across = i >= j, j >= i  # the higher tree goes down, both if they are level
        step = chunk // FANOUT**2 + 1
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            if down and across:
                x, y = _children(first, end, other_first, other_end, x, y, same)
            elif down:
                n = end[x] - first[x]
                y = np.repeat(y, n)
                x = np.repeat(first[x], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            else:
                n = other_end[y] - other_first[y]
                x = np.repeat(x, n)
                y = np.repeat(other_first[y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            stack.append((i - down, j - across, x, y))
    yield compared


def _find(label: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = label[i]
        if (up == i).all():
            return i
        i = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(label, a), _find(label, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def link(own: np.ndarray, foreign: np.ndarray | None = None, max_diff: int = MAX_DIFF):
    """(fp, representative) pairs that connect all of `own`, or all of `own` with all of `foreign`, within max_diff bits, and the node pairs compared.

    The number of pairs is at most that of the fingerprints. Both are distinct and in any order.
    """
    own = own[np.argsort(gray_rank(own))]
    if foreign is None:
        fps, tree = own, levels(own)
        other, base = tree, 0
    else:
        foreign = foreign[np.argsort(gray_rank(foreign))]
        fps, tree, other, base = np.concatenate([own, foreign]), levels(own), levels(foreign), len(own)
    label, compared = np.arange(len(fps)), 0
    if len(own) and (foreign is None or len(foreign)):
        for got in descend(tree, other, max_diff):
            if isinstance(got, int):
                compared = got
            else:
                _union(label, got[0], got[1] + base)
    root = _find(label, np.arange(len(fps)))
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]], compared


def _deal(mask: np.ndarray, pattern: np.ndarray):
    """Blobs (part, own, data) of fingerprints for their own part and for each later part whose node may hold a near one.

    Rows (fp, part) come in Gray order within a part.
    """

    def run(batches):
        for b in batches:
            fps, part, out = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), []
            for p in np.unique(part).tolist():
                mine = fps[part == p]
                out.append((p, True, pack(mine)))
                first = np.arange(0, len(mine), LEAF)
                own_mask, own_pattern = common(mine, first)
                near = np.bitwise_count((own_pattern[:, None] ^ pattern[p + 1 :]) & own_mask[:, None] & mask[p + 1 :]) <= MAX_DIFF
                for q in np.flatnonzero(near.any(0)).tolist():
                    out.append((p + 1 + q, False, pack(mine[np.repeat(near[:, q], np.diff(np.append(first, len(mine))))])))
            parts, own, data = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(own, pa.bool_()), pa.array(data, pa.binary())], names=["part", "own", "data"])

    return run


FOREIGN = 500_000  # foreign fingerprints that are held at once


def _link_parts(batches):
    """Edges of each part, whose blobs stand together, its own ones first."""
    part, own, tried, foreign, n = None, [], False, [], 0

    def edges(*sides):
        a, b, _ = link(*sides)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def flush():
        nonlocal own, tried, foreign, n
        if own and not tried:
            own, tried = [np.concatenate(own)], True
            yield edges(own[0])
        if own and foreign:
            yield edges(own[0], np.concatenate(foreign))
        foreign, n = [], 0

    for b in batches:
        for p, mine, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if p != part or n > FOREIGN:
                yield from flush()
            if p != part:
                part, own, tried = p, [], False
            (fps,) = unpack(data.as_buffer(), "<u8")
            if mine:
                own.append(fps)
            else:
                foreign.append(fps)
                n += len(fps)
    yield from flush()


def gray_column(fp):
    """Gray rank of a bigint column, less 2 ** 63, so that signed order is rank order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def links(distinct: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of `distinct` (column fp, no repeats) at MAX_DIFF or fewer differing bits."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MAX_PARTS, distinct.count() // per_part + 1)
    ranked = distinct.select("fp", gray_column(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    ranked = cut(ranked.select("fp", F.spark_partition_id().alias("part")))
    both = ranked.groupBy("part").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")).collect()  # a node a part
    mask, pattern = (np.zeros(1 + max((r.part for r in both), default=0), np.uint64) for _ in range(2))
    for r in both:
        ones, zeros = np.array([r.ones, r.zeros], np.int64).view(np.uint64)
        mask[r.part], pattern[r.part] = ones | zeros, ones
    dealt = ranked.mapInArrow(_deal(mask, pattern), "part int, own boolean, data binary")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", F.desc("own")).mapInArrow(_link_parts, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, with_hash: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, any others).

    Null and empty texts have fingerprint zero and link like any other; texts of any length count whole. Repeated rows and ties share a
    class; component_id is the least non-null doc_id reachable, null if there is none. An empty table gives an empty result. Columns
    of other names are not looked at. with_hash adds text_hash, XXH64 of the text.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    out = prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")
    return out if with_hash else out.drop("text_hash")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each near-duplicate class: the one with the least doc_id, with all columns, whatever their names.

    Rows that repeat that doc_id stay once, the one with the least text hash. Rows without an id pass
    through, as a class cannot name them. Null, empty and long texts and empty tables are treated as near_duplicates says.
    """
    own_id, own_hash, kept, text_hash = fresh(docs.columns, "_id", "_own_hash", "_kept", "_hash")
    classes = near_duplicates(docs.select("doc_id", "text"), with_hash=True).where("doc_id is not null")
    groups = classes.groupBy("doc_id", "text_hash").agg(F.max("component_id").alias("component_id"), F.count("*").alias("n"))
    first = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own_id)).agg(F.min("text_hash").alias(own_hash))
    stays = (F.col("text_hash") == F.col(own_hash)) & F.col(own_hash).isNotNull()
    groups = cut(groups.join(first, F.col("doc_id") == F.col(own_id), "left").select("doc_id", "text_hash", "n", F.coalesce(stays, F.lit(False)).alias(kept)))
    # Most rows stay and are the only ones of their id and text: a table of bits tells them, and only the others' texts are shuffled.
    table = marks(groups.where(~F.col(kept) | (F.col("n") > 1)), F.xxhash64("doc_id", "text_hash"))
    own, place = docs.where("doc_id is not null"), F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    asked = marked(own, place, table).withColumn(text_hash, F.xxhash64("text"))
    wanted = groups.where(F.col(kept)).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    found = asked.join(wanted, (F.col("doc_id").cast("bigint") == F.col(own_id)) & (F.col(text_hash) == F.col(own_hash)), "left_semi").dropDuplicates(["doc_id", text_hash])
    return marked(own, place, table, "left_anti").unionByName(found.drop(text_hash)).unionByName(docs.where("doc_id is null"))
