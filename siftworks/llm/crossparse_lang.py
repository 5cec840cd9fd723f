"""Language identification by cross-parsing entropy.

One suffix automaton a language is built from a bounded sample of labelled text. A text is parsed into phrases, each the
longest match that the automaton knows from where the last phrase ended; the language that needs the fewest
phrases a symbol has the lowest cross entropy and wins. Each language has its own alphabet: the letters of its sample are symbols, the
rarer ones of a large alphabet DIGITS digits each, so no learned letter is merged with another; letters that the sample lacks share one.
Automata become dense transition tables, and blocks of 256 symbols from many texts are parsed in step, so no Python loop runs over characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces

MAX_LANGS = 64
DOCS_PER_LANG = 60
CHARS_PER_LANG = 24_000
TABLE_BYTES = 128_000_000  # of all languages' tables; with more languages each has a smaller sample
LONG = 8_000
SYMBOLS = 64
COMMON, BASE, DIGITS = 40, 22, 3  # of more than SYMBOLS - 2 letters, the COMMON most frequent are symbols, the others DIGITS digits
BLOCK = 256
NONE = 65_535


def automaton(text: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Dense transitions of the suffix automaton of a symbol sequence: [state, symbol] -> state, NONE for none; state 0 starts."""
    most = 2 * len(text) + 2
    step = np.full((most, symbols), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and step[p, c] < 0:
            step[p, c] = cur
            p = link[p]
        if p >= 0:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step[copy] = step[q]
                while p >= 0 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    if len(link) > NONE:
        raise ValueError("the sample is too long for 16-bit states")
    return np.where(step < 0, NONE, step)[: len(link)].astype(np.uint16)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """Runs of symbol 0 become one."""
    return symbols[~((symbols == 0) & (np.concatenate([[1], symbols[:-1]]) == 0))]


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000))
    return _letters[0]


class Alphabet:
    """Symbols of a language's letters: 0 for all but letters, 1 for letters that its sample lacks."""

    def __init__(self, found: list[int]):
        """found: the letters of the sample, the most frequent first."""
        self.found = found
        self.first = letters().copy()
        common = found if len(found) <= SYMBOLS - 2 else found[:COMMON]
        self.first[common] = np.arange(2, 2 + len(common))
        self.rest = np.array(sorted(set(found) - set(common)), np.uint32)[: BASE**DIGITS]
        if len(self.rest):
            self.first[self.rest] = SYMBOLS

    def encode(self, codes: np.ndarray) -> np.ndarray:
        symbols = self.first[codes]
        if len(self.rest) and (rare := np.flatnonzero(symbols == SYMBOLS)).size:
            number = np.searchsorted(self.rest, codes[rare])
            n = np.ones(len(symbols), np.int64)
            n[rare] = DIGITS
            at = (np.cumsum(n) - n)[rare]
            symbols = np.repeat(symbols, n)
            for i in range(DIGITS):
                symbols[at + i] = 2 + COMMON + number // BASE**i % BASE
        return squeeze(symbols)

    def __reduce__(self):
        return Alphabet, (self.found,)


@dataclass
class Model:
    """langs by name, with an alphabet and a dense automaton each."""

    langs: list[str]
    alphabets: list[Alphabet] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)


def fit(samples: dict[str, str]) -> Model:
    model = Model(sorted(k for k, v in samples.items() if any(map(str.isalpha, v))))
    most = min(2 * CHARS_PER_LANG, NONE // 2 - 2, TABLE_BYTES // (4 * SYMBOLS * max(1, len(model.langs))))  # symbols: two states of SYMBOLS 16-bit numbers each
    for lang in model.langs:
        codes = points(samples[lang])
        found, n = np.unique(codes, return_counts=True)
        alpha = letters()[found] == 1
        found, n = found[alpha], n[alpha]
        model.alphabets.append(Alphabet(found[np.lexsort((found, -n))].tolist()))
        model.tables.append(automaton(model.alphabets[-1].encode(codes)[:most]))
    return model


def phrases(table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Number of phrases of each text. Texts are symbol arrays; a phrase ends at each multiple of BLOCK."""
    sizes = np.array([len(t) for t in texts])
    lanes = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), lanes)
    if not len(owner):
        return np.zeros(len(texts), np.int64)
    flat = np.zeros((len(owner), BLOCK), np.uint8)
    left = np.zeros(len(owner), np.int64)
    row = 0
    for t, k in zip(texts, lanes):
        view = flat[row : row + k].reshape(-1)
        view[: len(t)] = t
        left[row : row + k] = np.minimum(BLOCK, len(t) - BLOCK * np.arange(k))
        row += k
    order = np.argsort(-left, kind="stable")
    flat, left, owner = np.ascontiguousarray(flat[order].T), left[order], owner[order]
    active = (left[:, None] > np.arange(BLOCK)).sum(0)  # lanes are sorted: the first active[i] have a symbol i
    steps, symbols = table.ravel(), table.shape[1]
    start = table[0]
    state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
    for i in range(BLOCK):
        k = active[i]
        if not k:
            break
        c = flat[i, :k]
        now = state[:k]
        to = steps[now * symbols + c]
        miss = to == NONE
        count[:k] += miss
        to = np.where(miss, start[c], to)
        unknown = to == NONE  # not even the symbol is known: a phrase of its own
        count[:k] += unknown & (now > 0)
        state[:k] = np.where(unknown, 0, to)
    count += state > 0
    return np.bincount(owner, count, len(texts)).astype(np.int64)


def predict(model: Model, texts: list[str | None]):
    """[(language, score)]: und and 0 for texts without a letter or models without a language.

    The score is the share of phrases by which the runner-up needs more than the winner; 1 if there is no other language.
    Equal counts go to the first language by name.
    """
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not model.langs:
        return out
    for i, j in pieces([4 * len(t or "") + 1 for t in texts]):
        codes = [points(t) if t else np.zeros(0, np.uint32) for t in texts[i:j]]
        lettered = [k for k, c in enumerate(codes) if letters()[c].any()]
        if not lettered:
            continue
        n = np.stack([phrases(table, [alphabet.encode(codes[k]) for k in lettered]) for alphabet, table in zip(model.alphabets, model.tables)], axis=1)
        for k, own in zip(lettered, n):
            best = int(np.argmin(own))
            others = np.delete(own, best)
            out[i + k] = model.langs[best], float(1 - own[best] / others.min()) if len(others) else 1.0
    return out


def sample(docs: DataFrame) -> dict[str, str]:
    """{language: text}: at most CHARS_PER_LANG characters of at most DOCS_PER_LANG distinct texts of each of the MAX_LANGS commonest languages.

    Held-out rows and null texts are never read. However often a text is repeated, it counts once, and so do languages' numbers of texts. Texts up
    to LONG characters come before longer ones, then by a hash of the text. A first count of each language's texts sets a bound on the hash that
    leaves about four times those needed, or all where there are no more; copies become one row before they are shuffled, and no task gathers a language.
    """
    rows = docs.where("lang is not null and text is not null").where(~held_out())
    rows = rows.select("lang", F.left("text", F.lit(CHARS_PER_LANG)).alias("text"), (F.length("text") > LONG).alias("long"), F.xxhash64(F.lit(5), "text").alias("h"))
    texts = rows.groupBy("lang", "h").agg(F.max("long").alias("long"))
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("long")).alias("short")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    kept, place = F.lit(False), F.pmod(F.col("h"), F.lit(1 << 30))
    for r in counts:
        enough = r.short >= DOCS_PER_LANG
        bound = int((1 << 30) * min(1.0, 4 * DOCS_PER_LANG / max(1, r.short if enough else r.n)))
        kept |= (F.col("lang") == r.lang) & (place < bound) & (~F.col("long") if enough else F.lit(True))
    got = rows.where(kept).groupBy("lang", "h", "long").agg(F.min("text").alias("text")).collect()  # about 240 texts a language of at most CHARS_PER_LANG characters
    out: dict[str, str] = {}
    taken: dict[str, int] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.long, r.h % (1 << 30), r.text)):
        had = out.get(r.lang, "")
        if len(had) < CHARS_PER_LANG and taken.get(r.lang, 0) < DOCS_PER_LANG:
            out[r.lang], taken[r.lang] = (had + "\n" + r.text)[:CHARS_PER_LANG], taken.get(r.lang, 0) + 1
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text; lang where a model is still to be fitted).

    Null and empty texts and texts without a letter are `und` with score 0; repeated rows get equal answers and teach no more than one does; texts of any length are
    parsed whole. A row held out by its id teaches nothing, even if another row repeats the id; null languages teach nothing. Ties go
    to the first language by name. An empty table gives an empty result. Columns of other names are not looked at.
    """
    model = model or fit(sample(docs.select("doc_id", "text", "lang")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE_BYTES at most, and 1 MB an alphabet once in a worker

    def run(batches):
        for b in batches:
            got = predict(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
