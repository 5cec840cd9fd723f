"""Spelling variants by two-dimensional range reporting.

A word one edit away from another shares with it what stands before the edit and what stands behind. Sorted forwards, the words with the
same beginning are an interval; sorted by their reversals, those with the same end are another. A wavelet tree over the permutation
between both orders reports the words in the two intervals, for each position of an edit.

Words are dealt to groups that hold all pairs one edit apart: for words of length n and n + 1, pairs whose edit lies in the positions
[lo, hi) share lo first and n - hi last code points. The positions are halved once, and again wherever a group is large, so that no
group grows with the table: a single position leaves a few thousand words at most. One tree serves all groups of a length in a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released

# Letters of the runs; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, SPOIL, FACTOR = 7, 2, 31, 10
GROUP = 20_000  # words of a group that is not halved again
CHUNK = 100_000  # words that one tree is built over, beyond which a chunk ends with its group


def spoilt_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoil: int = SPOIL) -> DataFrame:
    """(word, n) of the runs of letters in docs (doc_id, text), of which one in `spoil` loses a code point by the hash of its document and itself.

    Runs that are too short before a loss are never looked at: losing makes none longer. A null id counts as '', null texts have no runs.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run"))
    runs = runs.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % spoil == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A permutation of 0..n-1, level by level: the node of values [v, v + width) holds its positions at [v, v + width) of its level."""

    def __init__(self, permutation: np.ndarray):
        self.n = len(permutation)
        self.height = max(1, int(self.n - 1).bit_length()) if self.n else 0
        self.ones, level = [], permutation
        for k in range(self.height):
            shift = self.height - 1 - k
            self.ones.append(np.concatenate([[0], np.cumsum(level >> shift & 1)]))
            level = level[np.argsort(level >> shift, kind="stable")]

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) at the positions [left, right), for arrays of queries."""
        query = np.flatnonzero((left < right) & (low < high))
        node, left, right = np.zeros(len(query), np.int64), left[query], right[query]
        for k in range(self.height):
            half, ones = 1 << (self.height - 1 - k), self.ones[k]
            before, in_left, in_right = ones[node], ones[left], ones[right]
            one_left, one_right = in_left - before, in_right - before
            sides = []
            for side, l, r in ((0, left - node - one_left, right - node - one_right), (half, one_left, one_right)):
                start = node + side
                keep = np.flatnonzero((l < r) & (start < high[query]) & (start + half > low[query]))
                sides.append((query[keep], start[keep], (start + l)[keep], (start + r)[keep]))
            query, node, left, right = (np.concatenate(x) for x in zip(*sides))
        return query, node


def _intervals(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) for each row of a sorted order: the rows around it that share `depth` symbols; shared: with the row before."""
    edge = shared < depth
    edge[0] = True
    starts = np.flatnonzero(edge)
    group = np.cumsum(edge) - 1
    return starts[group], np.append(starts[1:], len(shared))[group]


class Orders:
    """Words of one length and of one more, in groups, sorted forwards and by their reversals."""

    def __init__(self, words: list[str], length: int, group: np.ndarray):
        m, wide = len(words), length + 1
        self.length, self.long = length, np.fromiter((len(w) > length for w in words), bool, m)
        points = np.zeros((m, wide), np.uint32)
        points[np.arange(wide) < np.where(self.long, wide, length)[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        turned = points[:, ::-1].copy()
        turned[~self.long] = np.roll(turned[~self.long], -1, axis=1)  # the empty place of shorter words stays last
        self.points = points
        self.forward, self.at_forward, self.shared = self._sorted(points, group)
        self.backward, self.at_backward, self.shared_end = self._sorted(turned, group)

    @staticmethod
    def _sorted(points: np.ndarray, group: np.ndarray):
        """(rows in order, place of each row, symbols that each place shares with the one before: -1 at a group's first)."""
        order = np.lexsort((*(points[:, k] for k in range(points.shape[1] - 1, -1, -1)), group))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sorted_points = points[order]
        shared = np.full(len(order), -1, np.int64)
        differs = sorted_points[1:] != sorted_points[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), points.shape[1])
        shared[1:] = np.where(group[order][1:] == group[order][:-1], first, -1)
        return order, place, shared

    def near(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, row) of all pairs one edit apart whose leftmost difference lies in the positions [low, high) of the first; both directions."""
        found = []
        for long in (False, True):  # which words are looked for: replaced code points keep the length
            members = self.long == long
            counts = [np.concatenate([[0], np.cumsum(members[order])]) for order in (self.forward, self.backward)]
            rows_back = self.backward[members[self.backward]]  # the row of each value of the tree
            tree = WaveletTree(counts[1][self.at_backward[self.forward[members[self.forward]]]])
            for i in range(self.length + long):
                rows = np.flatnonzero(~self.long & (low <= i) & (i < high))
                if not len(rows):
                    continue
                start, end = (x[self.at_forward[rows]] for x in _intervals(self.shared, i))
                start_end, end_end = (x[self.at_backward[rows]] for x in _intervals(self.shared_end, self.length - i - (not long)))
                box = [counts[0][start], counts[0][end], counts[1][start_end], counts[1][end_end]]
                least = 1 if long else 2  # a word is in its own intervals
                some = np.flatnonzero((box[1] - box[0] >= least) & (box[3] - box[2] >= least))
                query, value = tree.report(*(x[some] for x in box))
                a, b = rows[some[query]], rows_back[value]
                # A pair is taken where its words first differ, once.
                keep = (self.points[b, i] != self.points[a, i]) if long else a != b
                found.append((a[keep], b[keep]))
                if long:
                    found.append((b[keep], a[keep]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _summed(words: list[str], n: np.ndarray, length: int, low: np.ndarray, high: np.ndarray, group: np.ndarray) -> pa.RecordBatch | None:
    """For each word that has near ones in its group: how many, and the one of largest n, least by code points."""
    orders = Orders(words, length, group)
    a, b = orders.near(low, high)
    if not len(a):
        return None
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((orders.at_forward, -n))] = np.arange(len(words))
    by = np.lexsort((rank[b], a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in a[first]], pa.string()), pa.array(np.diff(np.append(first, len(a))).astype(np.int64)), pa.array(n[b[first]]), pa.array([words[k] for k in b[first]], pa.string())], ["word", "n_near", "form_n", "form"])


def _halves(low, middle, high):
    return F.explode(F.array(*(F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in ((low, middle), (middle, high)))))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the hash of what the words of their group share."""
    ends = F.greatest(F.col("length") - F.col("high"), F.lit(0))
    return rows.withColumn("key", F.xxhash64("length", "low", "high", F.left("word", F.col("low")), F.right("word", ends)))


def dealt(words: DataFrame, least_length: int = LEAST_LENGTH, limit: int = GROUP) -> DataFrame:
    """(word, n, length, low, high, key): each word in its groups, as one of the shorter words of a length or of those one longer."""
    size = F.char_length("word")
    lengths = F.explode(F.when(size > least_length, F.array(size, size - 1)).otherwise(F.array(size)))
    x = words.select("word", "n", lengths.alias("length"))
    middle = F.floor((F.col("length") + 1) / 2)
    halves = _halves(F.lit(0), middle, F.col("length") + 1)
    waiting = _keyed(x.withColumn("node", halves).select("word", "n", "length", "node.low", "node.high"))
    out = None
    while True:
        large = cut(waiting.where("high - low > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limit).select("key"))
        if large.isEmpty():
            return waiting if out is None else out.unionByName(waiting)
        whole = waiting.join(large, "key", "left_anti").select(waiting.columns)
        out = whole if out is None else out.unionByName(whole)
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        halves = _halves(F.col("low"), middle, F.col("high"))
        split = waiting.join(large, "key", "left_semi").withColumn("node", halves)
        waiting = cut(_keyed(split.select("word", "n", "length", "node.low", "node.high")))


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, limit: int = GROUP) -> DataFrame:
    """(word, n_near, form_n, form) for each of words (word, n), distinct and of least_length code points or more, that has near ones: their number, and the one of largest n."""

    def run(batches):
        held: list = []

        def flush():
            word = [w for part in held for w in part[0]]
            n, length, low, high, key = (np.concatenate([part[k] for part in held]) for k in range(1, 6))
            group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (length[1:] != length[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) - 1
            held.clear()
            alone = np.bincount(group)[group] == 1
            for size in np.unique(length[~alone]):
                rows = np.flatnonzero((length == size) & ~alone)
                batch = _summed([word[k] for k in rows], n[rows], int(size), low[rows], high[rows], group[rows])
                if batch is not None:
                    yield batch

        for batch in batches:
            part = [batch.column("word").to_pylist(), *(batch.column(c).to_numpy() for c in ("n", "length", "low", "high", "key"))]
            if sum(len(p[0]) for p in held) >= CHUNK:
                # The chunk ends with its last group, whose rows may go on in this batch.
                last = (held[-1][2][-1], held[-1][3][-1], held[-1][4][-1], held[-1][5][-1])
                same = (part[2] == last[0]) & (part[3] == last[1]) & (part[4] == last[2]) & (part[5] == last[3])
                ends = len(same) if same.all() else int(same.argmin())
                if ends:
                    held.append([p[:ends] for p in part])
                if ends < len(same):
                    yield from flush()
                    held.append([p[ends:] for p in part])
            else:
                held.append(part)
        if held:
            yield from flush()

    rows = dealt(words, least_length, limit).repartition("key").sortWithinPartitions("length", "low", "high", "key")
    each = rows.mapInArrow(released(run), "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the steps taken; n grows tenfold a step, so they are few."""
    chain = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = step.select("word", "root")
        if step.where("moved").isEmpty():
            return chain


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, factor: int = FACTOR, limit: int = GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n): a word's form is its near word of largest n if that is `factor` times its own or more."""
    words = cut(words.select("word", "n"))
    near = near_words(words, least_length, limit)
    true_form = F.col("form_n") >= factor * F.col("n")
    x = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(true_form, F.col("form")).alias("form"), F.when(true_form, F.col("form_n")).alias("form_n"))
    x = cut(x)
    return x.join(roots(x.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variant_report(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text), spoilt as spoilt_words() says.

    Null and empty texts have no words; a text or run of any length counts whole. Rows that repeat another count again. Of near words of equal n
    the first by code points is the form. Empty tables give an empty result; columns of other names are not looked at.
    """
    return variants(spoilt_words(docs.select("doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")
