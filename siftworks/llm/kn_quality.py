"""Quality rules: word and line statistics, and bands of n-gram perplexity for each language.

Each language with MIN_ROWS documents or more has an alphabet of its own: white space, its most frequent letters, as many as cover all but a
hundredth of what it writes, two classes of other letters, digits, punctuation and the rest; rarer languages share one. Symbols have 5 to 12 bits
and n-grams as many symbols as 25 bits hold: five of a small alphabet, four of one of sixty, two of a thousand syllables or ideographs. Spark counts the n-grams of all texts. From them
a modified Kneser-Ney model with three discounts an order is made and stored as sorted arrays of 64-bit hashes with log probabilities and
back-off weights; it grows with the n-grams that the corpus holds. Scoring searches the arrays once for each distinct n-gram of some texts.
A document outside its language's perplexity band, which follows from the quartiles over all documents that pass the plain rules, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, pieces
from .line_forms import powers, sums

GRAM_BITS = 25
LEAST_BITS, MOST_BITS = 5, 12
COVER = 0.99  # of the letters that a language writes, which have symbols of their own, as far as MOST_BITS hold them
SPACE, OTHER, DIGIT, MARK, REST = 0, 1, 3, 4, 5  # classes; their symbols but that of white space follow the letters'
CLASSES = 6
MIN_ROWS = 20  # documents from which a language has a model and a band of its own
MAX_ENTRIES = 12_000_000  # n-grams of the languages that are scored together; 12 bytes each on an executor
LEAST = 2  # an n-gram found once in all is known from the text that is scored only
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of words
WINDOW = 5
FENCE = 4.0  # quartile distances from the quartiles to the ends of a band
SHORT = 8.0  # a mean over n symbols may lie SHORT / sqrt(n) further out: some three deviations of a symbol's bits
BIN = 0.01
PIECE = 2_000_000  # bytes of text worked on at once
STATS = "doc_id bigint, slot int, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_grams bigint, bits double"

SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WORD_BYTES = mix64(np.arange(256)) * ~SPACES  # white space weighs nothing in a word,
LINE_BYTES = mix64(np.arange(256) + 1000)
LINE_BYTES[10] = 0  # a newline nothing in a line


def views(column):
    """(bytes of all rows, offsets) of an Arrow binary column; null rows are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def lower_points(part: bytes, ends: list[int]):
    """(lower-case code points of all rows, number of each row's)."""
    codes = [np.frombuffer(part[a:b].decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4") for a, b in zip(ends, ends[1:])]
    return np.concatenate(codes), np.array([len(c) for c in codes])


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The class of every code point; letters have two, OTHER and the next, in turn."""
    if not _kinds:
        out = np.full(0x110000, REST, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = OTHER + i % 2
            elif c.isdigit():
                out[i] = DIGIT
            elif c.isspace():
                out[i] = SPACE
        out[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
        _kinds.append(out)
    return _kinds[0]


def room(bits: int) -> int:
    """Letters that have a symbol of their own beside the classes."""
    return (1 << bits) - CLASSES


def bits_of(letters: list[int]) -> int:
    """Bits of a symbol in the least alphabet with room for the letters."""
    return next(b for b in range(LEAST_BITS, MOST_BITS + 1) if room(b) >= len(letters) or b == MOST_BITS)


def symbol(kind: int, bits: int) -> int:
    return kind if kind == SPACE else room(bits) + kind


def alphabet(found: list[int]) -> np.ndarray:
    """The symbol of every code point; found: a language's letters, the most frequent first."""
    bits = bits_of(found)
    out = np.array([symbol(k, bits) for k in range(CLASSES)], np.uint16)[kinds()]
    out[found[: room(bits)]] = np.arange(1, 1 + len(found[: room(bits)]))
    return out


def grams(symbols: np.ndarray, n: np.ndarray, bits: int = LEAST_BITS) -> np.ndarray:
    """The code of each symbol with those before it that GRAM_BITS hold; rows of n symbols start after white space."""
    order = GRAM_BITS // bits
    padded = np.zeros(len(symbols) + (order - 1) * len(n), np.uint32)
    at = np.arange(len(symbols)) + (order - 1) * (np.repeat(np.arange(len(n)), n) + 1)
    padded[at] = symbols
    code = padded.copy()
    for i in range(1, order):
        code[i:] |= padded[:-i] << np.uint32(bits * i)
    return code[at]


def _letter_counts(batches):
    for b in batches:
        slots = b.column(0).to_numpy()
        data, offsets = views(b.column(1))
        for i, j in pieces(np.diff(offsets).tolist(), PIECE):
            codes, n = lower_points(data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist())
            own = np.repeat(slots[i:j], n).astype(np.uint64) << np.uint64(32) | codes
            kind = kinds()[codes]
            found, count = np.unique(own[(kind == OTHER) | (kind == OTHER + 1)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(32)).astype(np.int32)), pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(count)], names=["slot", "letter", "n"])


def alphabets(rows: DataFrame) -> dict[int, list[int]]:
    """{slot: its most frequent letters} over all texts of rows (slot, text): those of the least alphabet that covers COVER of them, or of the largest."""
    counts = rows.select("slot", "text").mapInArrow(_letter_counts, "slot int, letter int, n bigint").groupBy("slot", "letter").agg(F.sum("n").alias("n"))
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "letter"))), 1, room(MOST_BITS))  # of at most some hundred thousand letters
    out = {}
    for r in counts.groupBy("slot").agg(first.alias("first"), F.sum("n").alias("total")).collect():
        covered = np.cumsum([-x.n for x in r.first])
        enough = int(np.searchsorted(covered, COVER * r.total)) + 1
        out[r.slot] = [x.letter for x in r.first[: room(bits_of(r.first[:enough]))]]
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def _symbols(letters: dict[int, list[int]]):
    """A function from (slots, code points, number of each row's) to symbols."""
    tables: dict[int, np.ndarray] = {}

    def encode(slots, codes, n):
        out, ends = np.zeros(len(codes), np.uint16), np.cumsum(n)
        for s in np.unique(slots).tolist():
            if s not in tables:
                if len(tables) >= 16:
                    tables.clear()
                tables[s] = alphabet(letters.get(s, []))
            for k in np.flatnonzero(slots == s).tolist():
                a, b = ends[k] - n[k], ends[k]
                out[a:b] = tables[s][codes[a:b]]
        return out

    return encode


def _coded(letters: dict[int, list[int]]):
    """A function from (slots, code points, number of each row's) to the n-gram codes that end at each."""
    encode, wide = _symbols(letters), {s: bits_of(x) for s, x in letters.items()}

    def code(slots, codes, n):
        symbols, bits = encode(slots, codes, n), np.array([wide.get(s, LEAST_BITS) for s in slots.tolist()])
        out = np.zeros(len(codes), np.uint32)
        for b in np.unique(bits).tolist():
            rows = bits == b
            here = np.repeat(rows, n)
            out[here] = grams(symbols[here], n[rows], b)
        return out

    return code


def _counts(letters: dict[int, list[int]]):
    def run(batches):
        code, held, size = _coded(letters), [], 0

        def rows(codes, n):
            return pa.RecordBatch.from_arrays([pa.array((codes >> np.uint64(GRAM_BITS)).astype(np.int32)), pa.array((codes & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int32)), pa.array(n)], names=["slot", "gram", "n"])

        for b in batches:
            slots = b.column(0).to_numpy()
            data, offsets = views(b.column(1))
            for i, j in pieces(np.diff(offsets).tolist(), PIECE):
                codes, n = lower_points(data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist())
                gram = code(slots[i:j], codes, n)
                found, count = np.unique(np.repeat(slots[i:j], n).astype(np.uint64) << np.uint64(GRAM_BITS) | gram, return_counts=True)
                if len(found):
                    held.append((found, count.astype(np.int64)))
                    size += len(found)
                if size > 3_000_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield rows(*held.pop())
                        size = 0
        if held:
            yield rows(*_merged(held))

    return run


def keys(slot: int, order: int, grams_) -> np.ndarray:
    return mix64((np.asarray(grams_, np.uint64) << np.uint64(24)) | np.uint64(slot << 3 | order))


@dataclass
class Model:
    """Sorted hashes of (language slot, order, n-gram) with log2 probabilities, and of contexts with log2 back-off weights."""

    seen: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    bits: dict[int, int]  # of a slot's symbols, LEAST_BITS where it is not there

    @staticmethod
    def _get(hashes, values, wanted, missing):
        if not len(hashes):
            return np.full(len(wanted), missing, np.float32)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, values[at], np.float32(missing))

    def log2(self, slot: int, codes: np.ndarray) -> np.ndarray:
        """log2 P(last symbol | those before) of codes, from the longest n-gram that is known, with the back-off weights of longer contexts."""
        codes, bits = np.asarray(codes, np.uint64), self.bits.get(slot, LEAST_BITS)
        out, open_, weight = np.zeros(len(codes), np.float32), np.arange(len(codes)), np.zeros(len(codes), np.float32)
        for n in range(GRAM_BITS // bits, 0, -1):
            low = codes[open_] & np.uint64((1 << bits * n) - 1)
            p = self._get(self.seen, self.logp, keys(slot, n, low), np.nan)
            known = ~np.isnan(p)
            out[open_[known]] = p[known] + weight[open_[known]]
            open_, low = open_[~known], low[~known]
            weight[open_] += self._get(self.contexts, self.backoff, keys(slot, n - 1, low >> np.uint64(bits)), 0.0)
        out[open_] = weight[open_] - bits  # the uniform distribution below order 1
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, by counts of counts; 0.5, 1, 1.5 where those do not tell."""
    n = [int((counts == i).sum()) for i in range(5)]
    if min(n[1:5]) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = np.array([0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]])
    return np.clip(d, 0.01, [0.01, 0.99, 1.99, 2.99]) * [0, 1, 1, 1]


def estimate(counts: dict[int, tuple[np.ndarray, np.ndarray]], least: int = 1, bits: dict[int, int] | None = None) -> Model:
    """A model from {slot: (n-gram codes, counts)} and the slots' bits a symbol, LEAST_BITS unless given. Orders below the highest count distinct symbols to the left.

    n-grams of the highest order found fewer than `least` times enter the estimate but are not stored: scoring backs off from them.
    """
    seen, logp, contexts, backoff = [], [], [], []
    for slot, (gram, n) in counts.items():
        b = (bits or {}).get(slot, LEAST_BITS)
        most = GRAM_BITS // b
        order = np.argsort(gram)
        orders = [(np.asarray(gram, np.int64)[order], np.asarray(n, np.float64)[order])]
        for k in range(most - 1, 0, -1):
            codes, left = np.unique(orders[0][0] & ((1 << b * k) - 1), return_counts=True)
            orders.insert(0, (codes, left.astype(np.float64)))
        lower_codes, lower = np.zeros(1, np.int64), np.array([1 / (1 << b)])
        for k, (codes, c) in enumerate(orders, 1):
            step = discounts(c)[np.minimum(c, 3).astype(int)]
            context = codes >> b
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            total, lost = np.add.reduceat(c, first), np.add.reduceat(step, first)
            size = np.diff(np.append(first, len(codes)))
            gamma = lost / total
            below = lower[np.searchsorted(lower_codes, codes & ((1 << b * (k - 1)) - 1))]
            p = (c - step) / np.repeat(total, size) + np.repeat(gamma, size) * below
            stored = c >= (least if k == most else 1)
            seen.append(keys(slot, k, codes[stored]))
            logp.append(np.log2(p[stored]))
            contexts.append(keys(slot, k - 1, context[first]))
            backoff.append(np.log2(np.maximum(gamma, 1e-30)))
            lower_codes, lower = codes, p
    if not seen:
        return Model(*(np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)), bits or {})
    seen, logp, contexts, backoff = (np.concatenate(x) for x in (seen, logp, contexts, backoff))
    a, c = np.argsort(seen), np.argsort(contexts)
    return Model(seen[a], logp[a].astype(np.float32), contexts[c], backoff[c].astype(np.float32), bits or {})


def _of_rows(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of marks in each row."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[ends])


def _repeated(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each hash how often its row holds it."""
    mixed = mix64(hashes ^ mix64(row))
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    out = np.zeros(len(order), np.int64)
    out[order] = np.repeat(np.diff(np.append(first, len(order))), np.diff(np.append(first, len(order))))
    return out


def plain(part: np.ndarray, ends: np.ndarray):
    """(words, code points in words, symbol characters, repeated lines, words in repeated windows) of each row of UTF-8 bytes.

    Windows and lines are compared by 64-bit hashes.
    """
    space = SPACES[part]
    begin = ~space
    begin[1:] &= space[:-1]
    rows = ends[:-1][np.diff(ends) > 0]
    begin[rows] = ~space[rows]
    start = np.flatnonzero(begin)
    words = _of_rows(begin, ends)
    repeat, dups = np.zeros(len(ends) - 1, np.int64), np.zeros(len(ends) - 1, np.int64)
    if len(start):
        row = np.repeat(np.arange(len(words)), words)
        hashes = sums(WORD_BYTES[part], start)
        if len(hashes) >= WINDOW:
            p = powers(WINDOW, 0x9FB21C651E98DF25)
            windows = sum(hashes[i : len(hashes) - WINDOW + 1 + i] * p[i] for i in range(WINDOW))
            whole = row[: len(windows)] == row[WINDOW - 1 :]
            many = np.zeros(len(windows), bool)
            many[whole] = _repeated(windows[whole], row[: len(windows)][whole]) > 1
            step = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(step, np.flatnonzero(many), 1)
            np.add.at(step, np.flatnonzero(many) + WINDOW, -1)
            repeat = np.bincount(row, np.cumsum(step)[:-1] > 0, len(words)).astype(np.int64)
        line = part == 10
        line_start = np.unique(np.concatenate([rows, np.flatnonzero(line) + 1]))
        line_start = line_start[line_start < len(part)]
        place = np.searchsorted(line_start, start, "right") - 1
        held = np.unique(place)  # lines with a word
        values = np.where(line, np.uint64(0), LINE_BYTES[part])
        line_row = np.searchsorted(ends, line_start[held], "right") - 1
        count = _repeated(sums(values, line_start)[held], line_row)
        # All but one line of each group repeat an earlier one.
        dups = np.round(np.bincount(line_row, 1 - 1 / count, len(words))).astype(np.int64)
    chars = _of_rows(~space & ((part < 128) | (part >= 192)), ends)
    return words, chars, _of_rows(SYMBOLS[part], ends), dups, repeat


def _score(shared, letters: dict[int, list[int]]):
    def run(batches):
        model, coded = shared.value, _coded(letters)
        for b in batches:
            slots = b.column(1).to_numpy()
            data, offsets = views(b.column(2))
            for i, j in pieces(np.diff(offsets).tolist(), PIECE):
                part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                codes, n = lower_points(part.tobytes(), ends.tolist())
                own = slots[i:j]
                gram = coded(own, codes, n)
                row = np.repeat(np.arange(j - i), n)
                bits = np.zeros(j - i)
                for s in np.unique(own).tolist():
                    here = (own == s)[row]
                    packed = np.sort(gram[here].astype(np.uint64) << np.uint64(32) | row[here].astype(np.uint64))
                    code = packed >> np.uint64(32)
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                    value = model.log2(int(s), code[first]).astype(np.float64)
                    bits -= np.bincount((packed & np.uint64(0xFFFFFFFF)).astype(np.int64), np.repeat(value, np.diff(np.append(first, len(code)))), j - i)
                stats = [pa.array(x, pa.int64()) for x in plain(part, ends)]
                mean = pa.array(np.where(n > 0, bits / np.maximum(n, 1), 0.0), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *stats, pa.array(n, pa.int64()), mean], names=[c.split()[0] for c in STATS.split(", ")])

    return run


def slotted(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, text binary): languages of MIN_ROWS documents or more have slots of their own by name, from 1; all others, and none, share slot 0."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    names = [r.lang for r in docs.groupBy(lang.alias("lang")).count().where(F.col("count") >= MIN_ROWS).orderBy("lang").select("lang").collect()]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("_lang"), F.col("text").cast("binary").alias("text"))
    number = F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i + 1))) if names else None
    slot = F.coalesce(number[F.col("_lang")], F.lit(0)) if names else F.lit(0)
    return rows.select("doc_id", slot.cast("int").alias("slot"), "text")


def together(entries: dict[int, int], most: int = MAX_ENTRIES) -> list[list[int]]:
    """Slots in groups of at most `most` n-grams together, or one slot of more."""
    out: list[list[int]] = []
    total = 0
    for s, n in sorted(entries.items(), key=lambda x: (-x[1], x[0])):
        if not out or total + n > most:
            out.append([])
            total = 0
        out[-1].append(s)
        total += n
    return out


def scored(rows: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """STATS of rows (doc_id, slot, text). Languages are scored in groups whose models fit an executor together."""
    spark = rows.sparkSession
    letters = alphabets(rows)
    counts = cut(rows.select("slot", "text").mapInArrow(_counts(letters), "slot int, gram int, n bigint").groupBy("slot", "gram").agg(F.sum("n").alias("n")))
    groups = together({r.slot: r.n for r in counts.groupBy("slot").agg(F.count("*").alias("n")).collect()}, most) or [[0]]
    out = None
    for group in groups:
        got = (counts if len(groups) == 1 else counts.where(F.col("slot").isin(group))).toArrow()  # `most` rows, or the n-grams of one language: 2 ** GRAM_BITS at most
        slot, gram, n = (got.column(i).to_numpy() for i in range(3))
        model = spark.sparkContext.broadcast(estimate({int(s): (gram[slot == s], n[slot == s]) for s in np.unique(slot)}, LEAST, {s: bits_of(x) for s, x in letters.items()}))
        mine = rows if len(groups) == 1 else rows.where(F.col("slot").isin(group))
        part = cut(mine.mapInArrow(_score(model, letters), STATS))
        model.unpersist()
        out = part if out is None else out.unionByName(part)
    if len(groups) > 1:  # texts of slots without any symbol are in no group
        rest = rows.where(~F.col("slot").isin([s for g in groups for s in g]))
        empty = spark.sparkContext.broadcast(estimate({}))
        out = out.unionByName(rest.mapInArrow(_score(empty, letters), STATS))
    return out


def bands(stats: DataFrame, fence: float = FENCE) -> dict[int, tuple[float, float]]:
    """{slot: (least, most)} bits a symbol, from the quartiles of all rows of `stats` (slot, bits), in bins of BIN."""
    bins = stats.groupBy("slot", F.floor(F.col("bits") / BIN).alias("bin")).count().collect()
    out = {}
    for s in {r.slot for r in bins}:
        own = sorted((r.bin, r["count"]) for r in bins if r.slot == s)
        at, n = np.array([x for x, _ in own]) * BIN, np.cumsum([x for _, x in own])
        q1, q3 = (at[np.searchsorted(n, q * n[-1])] for q in (0.25, 0.75))
        wide = max(q3 - q1, 5 * BIN)
        out[s] = float(q1 - fence * wide), float(q3 + BIN + fence * wide)
    return out


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): word and line statistics, base_failed, kept, perplexity.

    Null and empty texts have no words and fail the base rules; repeated rows and ties get equal values; texts of any length count whole.
    perplexity is per symbol, null for texts without one. An empty table gives an empty result. Columns of other names are not looked at.
    """
    stats = cut(scored(slotted(docs)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    ends = bands(stats.where("not base_failed"))
    margin, inside = SHORT / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1))), F.lit(True)
    if ends:
        low, high = (F.create_map(*(F.lit(x) for s, e in sorted(ends.items()) for x in (s, e[k])))[F.col("slot")] for k in (0, 1))
        inside = F.coalesce(F.col("bits").between(low - margin, high + margin), F.lit(True))
    out = stats.withColumn("kept", ~F.col("base_failed") & inside).withColumn("perplexity", F.when(F.col("n_grams") > 0, F.pow(F.lit(2.0), "bits")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
