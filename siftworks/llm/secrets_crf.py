"""Secret scan: base patterns, and a linear-chain conditional random field over tokens.

Three fixed patterns give the base spans. The field tags tokens, plain words too, as secret begin, inside or outside from their shape, the
neighbouring words and features of the whole file, and Viterbi decodes the tags of a chain. Every token is in one chain: those up to CONTEXT
before and after a trigger, which is a lead word or a token that looks drawn at random, in one with it, the others of a line in chains of
PIECE at most. Of these only chains are decoded that a bound does not show to be outside as a whole. The field is fitted by stochastic gradient on a generated, labelled corpus of lines whose size is a
parameter; it needs no labelled rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base; a shorter match is dropped.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is what the pattern of any length keeps
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "crf")

LEADS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "bearer", "credential", "credentials", "apikey", "authorization", "auth",
         "passwort", "kennwort", "zugangscode", "contraseña", "contrasena", "senha", "jeton", "пароль", "токен")
PHRASES = ("mot de passe", "clé secrète", "clé api", "code d'accès", "clave secreta", "clave de acceso", "clave privada", "chave secreta", "chiave segreta", "api-schlüssel", "zugangsschlüssel", "секретный ключ")
LEAD = re.compile(r"(?<![a-z])(?:" + "|".join((*LEADS, *PHRASES)) + r"|(?:api|access|private|secret|signing|client)[ _-]?key|recovery codes?|client[ _-]secret)(?![a-z])", re.I)
STEMS = (*LEADS, *PHRASES, "key", "recovery code")  # one of which is in whatever a lead matches
FOLDED = re.compile("[\u0130\u0131\u017f\u212a\u1c80-\u1c8f]")  # letters that a pattern takes for others, in lower case or not
LONG = re.compile(r"[A-Za-z0-9+/_-]{12,}")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Za-z0-9+/_-]*[a-z][A-Z]+[a-z0-9]*[A-Z0-9])[A-Za-z0-9+/_-]{12,}")
CHUNK = re.compile(r"\S+")
PAIRED = re.compile(r"""["']?[A-Za-z_][A-Za-z0-9_.-]{1,40}["']?(?::=|=>|[:=])["']?(?=[^\s/:=])""")
CONTEXT, PIECE = 6, 8
KNOWN = 300_000  # words whose weights a worker keeps
CHARACTERS = 1 << 16  # of texts whose chains are bounded at once
B, I, O = 0, 1, 2  # noqa: E741
ROWS = 1 << 16
WORDS = [10, 12, 13, 14, 15, 16]  # places of the features that name words
LINES, EPOCHS = 5000, 6
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in that order; offsets in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def file_features(text: str) -> list[str]:
    """Features of the whole text: its size, and how much of it are digits, assignments and code marks."""
    n = len(text) + 1
    share = lambda chars: min(6, int(math.log2(1 + 200 * sum(map(text.count, chars)) / n)))
    return [f"file_size={int(math.log10(n))}", f"file_digits={share(string.digits)}", f"file_assign={share('=:')}", f"file_code={share('{};()[]')}"]


def _kind(word: str) -> str:
    if word.islower() and word.isalpha():
        return "lower"
    if word.isdigit():
        return "number"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", word) and not word.isalpha():
        return "hex"
    if word.isalpha():
        return "lower" if word.islower() else "upper" if word.isupper() else "title" if word[1:].islower() else "mixed"
    return "alnum" if word.isalnum() else "marked" if any(map(str.isalnum, word)) else "marks"


CLASSES = str.maketrans({c: k for k, chars in (("a", string.ascii_lowercase), ("A", string.ascii_uppercase), ("0", string.digits)) for c in chars})
REPEATS, MARKS = re.compile(r"(.)\1+"), re.compile(r"[^0A]")


@lru_cache(1 << 14)
def _bits(counts: tuple[int, ...]) -> int:
    n = sum(counts)
    return int(-2 * sum(c / n * math.log2(c / n) for c in counts))


def _parts(w: str, low: str) -> tuple:
    """What the features of a word alone are told by: kind, length, shape, entropy, changes of kind, size, vowels."""
    n, plain = len(w), w.isascii() and w.isalpha()
    if plain and w.islower():
        kind, short, changes = "lower", "a", 0
    elif plain and n > 1 and w[0].isupper() and w[1:].islower():
        kind, short, changes = "title", "Aa", min(8, 16 // n)
    else:
        kind, same = _kind(w), w.translate(CLASSES)
        short = REPEATS.sub(r"\1", same)[:6]
        if w.isascii():  # marks and small letters are alike, neither digits nor capitals
            turns = len(REPEATS.sub(r"\1", MARKS.sub("a", same))) - 1
        elif kind == "lower":
            turns = 0
        else:
            turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(w, w[1:]))
        changes = min(8, turns * 16 // n)
    vowels = low.count("a") + low.count("e") + low.count("i") + low.count("o") + low.count("u")
    return kind, min(12, n // 3), short, _bits(tuple(sorted(map(w.count, set(w))))), changes, min(6, n // 4), vowels * 8 // n


def _names(parts: tuple) -> list[str]:
    kind, length, short, bits, changes, size, vowels = parts
    return ["bias", f"kind={kind}", f"length={length}", f"shape={short}", f"entropy={bits}", f"changes={changes}", f"size={kind}/{size}", f"vowels={kind}/{vowels}"]


def _leads(low: str) -> bool:
    return bool(LEAD.fullmatch(low)) or any(x in LEADS for x in re.split(r"[\W\d_]+", low))


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of what stands between blanks, without the brackets, quotes and stops around it; a key and its value apart."""
    out = []
    for m in CHUNK.finditer(text, start, len(text) if end is None else end):
        if (chunk := m[0]).isalpha():
            out.append(m.span())
        else:
            a = m.start()
            out += [(a + i, a + k) for i, k in _cut(chunk)]
    return out


@lru_cache(1 << 16)
def _cut(chunk: str) -> tuple[tuple[int, int], ...]:
    """The tokens of a chunk."""
    a, b, out = 0, len(chunk), []
    if pair := PAIRED.match(chunk):
        key = pair[0].strip("\"':=>")
        at = pair[0].index(key)
        out.append((at, at + len(key)))
        a = pair.end()
    while a < b and chunk[a] in "\"'([{<,;":
        a += 1
    if (quote := re.search("[\"']", chunk[a:b])) and quote.start():
        b = a + quote.start()
    if noise := re.search(r"([!?#*$%&|])\1+$", chunk[a:b]):
        b = a + noise.start()
    while a < b and (chunk[b - 1] in "\"')]}>,;.:" or (chunk[b - 1] in "!?" and chunk[a : b - 1].rstrip("!?").isalpha())):
        b -= 1
    out.append((a, b) if a < b else (0, len(chunk)))
    return tuple(out)


def features(text: str, spans: list[tuple[int, int]], whole: list[str]) -> np.ndarray:
    """Hashed features of each token: shape, the words around it and features of the file; as many for each."""
    words = [text[a:b] for a, b in spans]
    low = [w.lower()[:24] for w in words]
    pad = ["<"] * 4 + low + [">"] * 2
    ends = lambda i: any(LEAD.fullmatch(" ".join(low[i - k : i + 1])) for k in range(min(i, 2) + 1))  # noqa: E731  a lead of up to three words
    lead = [ends(i) or any(x in LEADS for x in re.split(r"[\W\d_]+", w)) for i, w in enumerate(low)]
    out = []
    for i, w in enumerate(words):
        parts, n = _parts(w, low[i]), len(w)
        kind, same = parts[0], f"{parts[0]}/{parts[5]}"
        back = next((k for k in range(1, 5) if i >= k and lead[i - k]), 0)
        name = [
            *_names(parts), f"lead={back}", f"lead_kind={back}/{same}", f"own={low[i]}", f"is_lead={lead[i]}", f"after={pad[i + 5]}", f"before={pad[i + 3]}", f"before2={pad[i + 2]}", f"pair={pad[i + 2]}/{pad[i + 3]}", f"before_kind={pad[i + 3]}/{kind}",
            f"before_shape={_kind(words[i - 1]) if i else '<'}/{kind}", f"once={kind}/{n < 6 or text.count(w) == 1}", *whole,
        ]
        out.append([zlib.crc32(x.encode()) & (ROWS - 1) for x in name])
    return np.array(out)


def triggers(text: str) -> list[int]:
    """Where leads and tokens that look drawn at random start."""
    low = text.lower()
    leads = {m.start() for m in LEAD.finditer(text)} if any(x in low for x in STEMS) or not low.isascii() and FOLDED.search(text) else set()
    return sorted(leads | {m.start() for m in LONG.finditer(text) if RANDOM.match(m[0])})


def near(text: str):
    """Lists of (start, end): on each line with a trigger, the tokens up to CONTEXT before and after one."""
    at = triggers(text)
    i = 0
    while i < len(at):
        begin, end = text.rfind("\n", 0, at[i]) + 1, text.find("\n", at[i])
        end = len(text) if end < 0 else end
        own = [x for x in at[i : i + bisect_left(at[i:], end)]]
        i += len(own)
        # Tokens near a trigger stand within some hundred characters of it, or are themselves as long.
        run: list[tuple[int, int]] = []
        for x in own:
            if run and x < run[-1][1]:
                continue
            left = text.rfind(" ", begin, max(begin, x - 40 * CONTEXT)) + 1 if x - begin > 40 * CONTEXT else begin
            before = tokens(text, max(begin, left), x)[-CONTEXT:]
            start = max(text.rfind(" ", begin, x) + 1, text.rfind("\t", begin, x) + 1, begin)
            stop = x
            for _ in range(CONTEXT + 1):
                m = CHUNK.search(text, stop, end)
                if not m:
                    break
                stop = m.end()
            near = [t for t in before if t[1] <= start] + tokens(text, start, stop)
            if run and near and near[0][0] > run[-1][1] and text[run[-1][1] : near[0][0]].strip(" \t\"'([{<>}]),;.:=!?"):
                yield run
                run = []
            run += [t for t in near if not run or t[0] >= run[-1][1]]
        if run:
            yield run


def far(text: str, runs: list[list[tuple[int, int]]]):
    """Lists of (start, end), PIECE at most: the tokens that no run holds, those next to each other on a line."""
    taken = sorted(t for run in runs for t in run)
    i, stop, stretch = 0, -1, []
    for t in tokens(text):
        while i < len(taken) and taken[i][1] <= t[0]:
            i += 1
        held = i < len(taken) and taken[i][0] < t[1]
        if held or t[0] > stop or len(stretch) == PIECE:
            if stretch:
                yield stretch
            stretch = []
            if t[0] > stop:
                stop = text.find("\n", t[0])
                stop = len(text) if stop < 0 else stop
        if not held:
            stretch.append(t)
    if stretch:
        yield stretch


BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def pieces(text: str, runs: list[list[tuple[int, int]]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts, ends, lengths of lists) of what far gives, all lists in one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[True], BLANK[np.minimum(codes, len(BLANK) - 1)], [True]]).view(np.int8))
    start, end, words = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0), text.split()
    marked = np.flatnonzero(~np.fromiter(map(str.isalpha, words), bool, len(words))).tolist()
    if marked:
        cuts = [_cut(words[i]) for i in marked]
        many = np.ones(len(words), np.int64)
        many[marked] = [len(c) for c in cuts]
        at = np.cumsum(many) - many
        if len(words) < many.sum():  # some are a key and a value
            words = [words[i] for i in np.repeat(np.arange(len(words)), many).tolist()]
            start, end = np.repeat(start, many), np.repeat(end, many)
        place = [at_i + k for at_i, c in zip(at[marked].tolist(), cuts) for k in range(len(c))]
        inner = np.array([x for c in cuts for x in c])
        for i, (a, b) in zip(place, inner.tolist()):
            words[i] = words[i][a:b]
        end[place] = start[place] + inner[:, 1]
        start[place] += inner[:, 0]
    held = np.zeros(len(words), bool)
    if taken := sorted(t for run in runs for t in run):
        first, last = np.array(taken).T
        i = np.searchsorted(np.maximum.accumulate(last), start, "right")
        held = np.append(first, np.iinfo(np.int64).max)[i] < end
    line = np.searchsorted(np.flatnonzero(codes == 10), start)
    new = np.ones(len(words), bool)
    new[1:] = (line[1:] != line[:-1]) | held[:-1]
    if held.any():
        keep = ~held
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
        start, end, new = start[keep], end[keep], new[keep]
    first = np.flatnonzero(new)
    nth = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    return words, start, end, np.diff(np.append(np.flatnonzero(nth % PIECE == 0), len(words)))


def chains(text: str):
    """Lists of (start, end) that hold every token of the text once: those near triggers, then the others."""
    runs = list(near(text))
    yield from runs
    yield from far(text, runs)


PAIR, BEFORE_KIND, OWN, AFTER, BEFORE, BEFORE2 = (zlib.crc32(f"{x}=".encode()) for x in ("pair", "before_kind", "own", "after", "before", "before2"))  # of what a word is behind


@lru_cache(1 << 8)
def _behind(n: int) -> np.ndarray:
    """(4, 256): what each byte of a checksum adds, in the low bits of that of the same text with n bytes more, whose own checksum is told apart."""
    zeros = b"\0" * n
    return np.array([[(zlib.crc32(zeros, v << 8 * k) ^ zlib.crc32(zeros)) & (ROWS - 1) for v in range(256)] for k in range(4)], np.uint16)


class Checksums:
    """CRC-32, in the low bits, of texts put together from a front of known checksum and an end of known checksum and length, for many at once."""

    def __init__(self):
        self.table = np.zeros((0, 4, 256), np.uint16)

    def join(self, front: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        most = int(size.max(initial=0))
        if most >= len(self.table):
            self.table = np.stack([_behind(n) for n in range(most + 1)])
        out, flat, at = (end & (ROWS - 1)).astype(np.uint16), self.table.reshape(-1), size.astype(np.int64) << 10
        for k in range(4):
            out = out ^ flat[at + (k << 8) + ((front >> 8 * k) & 255)]
        return out


class Bound:
    """How much better than outside throughout the best other path of a chain is at most, for many chains at once, by sums of weights kept for each word.

    All is exact but for the feature that asks if a word is met once, of which the larger weight counts.
    """

    LAST = frozenset([p.split()[-1] for p in PHRASES] + ["key", "code", "codes", "secret"])  # of leads of several words

    def __init__(self, field: Field):
        self.gain = field.weight[:, [B, I]] - field.weight[:, [O]]
        step = field.step - field.step[O, O]
        self.step = step
        self.kinds = ["<", "number", "hex", "lower", "upper", "title", "mixed", "alnum", "marked", "marks"]
        self.shapes = np.array([[self.of(f"before_shape={a}/{b}") for b in self.kinds] for a in self.kinds])
        self.alone: dict[tuple, tuple] = {}  # what words alone add, by their parts
        names = [k.encode() for k in self.kinds]
        self.kind_crc, self.kind_size, self.checksums = np.array([zlib.crc32(k) for k in names]), np.array([len(k) for k in names]), Checksums()
        self.empty()

    def of(self, *names: str) -> np.ndarray:
        return self.gain[[zlib.crc32(x.encode()) & (ROWS - 1) for x in names]].sum(0)

    def empty(self) -> None:
        """Forgets all words but the marks before and behind a chain."""
        self.ids, self.known, self.rows, self.crcs = {}, 0, np.zeros((KNOWN + 2, 10)), np.zeros((KNOWN + 2, 4), np.int64)
        self.again = np.zeros(KNOWN + 2, bool)  # words met again after the text that they were learned from
        if len(self.alone) > KNOWN:
            self.alone.clear()
        self.learn(["<", ">"])
        self.ids, self.rows[:2, 8] = {}, 0  # as marks they are of no kind, as words they are learned like any other

    def make_room(self) -> None:
        """Forgets words that were met once; all, if many are left."""
        kept = [(w, k) for w, k in self.ids.items() if self.again[k]]
        at, rows, crcs = [k for _, k in kept], self.rows, self.crcs
        self.empty()
        if len(kept) < KNOWN // 2:
            self.known += len(kept)
            self.ids = {w: k for k, (w, _) in enumerate(kept, 2)}
            self.rows[2 : self.known], self.crcs[2 : self.known] = rows[at], crcs[at]

    def learn(self, words: list[str]) -> None:
        """Takes up words that are not known yet."""
        crc, first, more, alone, crcs = zlib.crc32, self.known, [], [], []
        for k, w in enumerate(words, first):
            low = w.lower()[:24]
            e, parts = low.encode(), _parts(w, low)
            own = self.alone.get(parts + (len(w) < 6,))
            if own is None:
                kind = parts[0]
                once = self.of(f"once={kind}/True")
                once = once if len(w) < 6 else np.maximum(once, self.of(f"once={kind}/False"))
                own = self.alone[parts + (len(w) < 6,)] = (*(self.of(*_names(parts), "lead=0", f"lead_kind=0/{kind}/{parts[5]}", "is_lead=False") + once).tolist(), self.kinds.index(kind))
            self.ids[w] = k
            crcs += (crc(e), len(e), crc(b"/", crc(e, PAIR)), crc(b"/", crc(e, BEFORE_KIND)))
            lead = low in self.LAST or low in LEADS if low.isalpha() else low in self.LAST or _leads(low)
            more += (crc(e, OWN), crc(e, AFTER), crc(e, BEFORE), crc(e, BEFORE2))
            alone += (*own, lead)
        self.known += len(words)
        at, alone = slice(first, self.known), np.array(alone, float).reshape(-1, 4)
        self.crcs[at] = np.array(crcs, np.int64).reshape(-1, 4)
        self.rows[at, :8] = self.gain[np.array(more, np.int64).reshape(-1, 4) & (ROWS - 1)].reshape(-1, 8)
        self.rows[at, :2] += alone[:, :2]
        self.rows[at, 8:] = alone[:, 2:]

    def doubtful(self, words: list[str], size: np.ndarray, whole: np.ndarray) -> list[int]:
        """Which of the chains, of these lengths and with these gains by features of their files, may hold a secret."""
        out, many = [], KNOWN // PIECE
        for i in range(0, len(size), many):
            some, begin = size[i : i + many], int(size[:i].sum())
            own = words[begin : begin + int(some.sum())] if len(size) > many else words
            if self.known + len(own) > KNOWN:
                self.make_room()
                if self.known + len(own) > KNOWN:
                    self.empty()
            out += [i + k for k in self._doubtful(own, some, whole[i : i + many])]
        return out

    def _doubtful(self, words: list[str], size: np.ndarray, whole: np.ndarray) -> list[int]:
        before = self.known
        if new := set(words).difference(self.ids):
            self.learn(sorted(new))
        piece = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(words)) + 3 * piece + 2  # two marks stand before a chain, one behind it
        every = np.zeros(len(words) + 3 * len(size), np.int64)
        every[np.cumsum(size + 3) - 1] = 1
        every[at] = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        rows = self.rows
        own, one, two = every[at], every[at - 1], every[at - 2]
        self.again[own[own < before]] = True
        kind, crcs, join = rows[own, 8].astype(int), self.crcs, self.checksums.join
        pairs = join(crcs[two, 2], crcs[one, 0], crcs[one, 1])
        befores = join(crcs[one, 3], self.kind_crc[kind], self.kind_size[kind])
        gain = rows[own, 0:2] + rows[every[at + 1], 2:4] + rows[one, 4:6] + rows[two, 6:8] + self.gain[pairs] + self.gain[befores] + self.shapes[rows[one, 8].astype(int), kind] + whole[piece]
        g = np.full((PIECE, len(size), 2), -np.inf)
        g[np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size), piece] = gain
        none, s = np.full(len(size), -np.inf), self.step
        b, i, o, most = g[0, :, 0], none, none, g[0, :, 0].copy()  # o: outside again
        for t in range(1, PIECE):
            b, i, o = np.maximum(np.maximum(s[O, B], o + s[O, B]), np.maximum(b + s[B, B], i + s[I, B])) + g[t, :, 0], np.maximum(b + s[B, I], i + s[I, I]) + g[t, :, 1], np.maximum(np.maximum(b + s[B, O], i + s[I, O]), o)
            most = np.where(t < size, np.maximum(np.maximum(b, i), o), most)
        may = most > -1e-6
        may[piece[rows[own, 9] > 0]] = True
        return np.flatnonzero(may).tolist()


class Field:
    """Weights of (hashed feature, tag) and of tag to tag; inside never follows outside or the start."""

    def __init__(self):
        self.weight = np.zeros((ROWS + 1, 3))  # the last row stays zero
        self.step = np.zeros((3, 3))
        self.begin = np.array([0.0, -np.inf, 0.0])
        self.step[O, I] = -np.inf
        self.known: Bound | None = None

    def bound(self) -> Bound:
        if self.known is None:
            self.known = Bound(self)
        return self.known

    def emissions(self, at: np.ndarray) -> np.ndarray:
        return self.weight[at].sum(1)

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """The best tags of one chain, the earlier tag winning ties."""
        best, back = self.begin + emit[0], []
        for e in emit[1:]:
            to = best[:, None] + self.step
            back.append(to.argmax(0))
            best = to.max(0) + e
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def marginals(self, emit: np.ndarray):
        """(tag marginals, summed transition marginals) by forward and backward sums, scaled at each token."""
        n, step = len(emit), np.exp(self.step)
        e = np.exp(emit - emit.max(axis=1, keepdims=True))
        f, b = np.empty((n, 3)), np.ones((n, 3))
        x, y = np.exp(self.begin) * e[0], b[-1]
        f[0] = x = x / x.sum()
        for t in range(1, n):
            x = (x @ step) * e[t]
            f[t] = x = x / x.sum()
        for t in range(n - 2, -1, -1):
            y = step @ (e[t + 1] * y)
            b[t] = y = y / y.sum()
        own = f * b
        pairs = f[:-1, :, None] * step * (e[1:] * b[1:])[:, None, :]
        return own / own.sum(axis=1, keepdims=True), (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(0)

    def fit(self, examples: list[tuple[np.ndarray, list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, seed: int = 1) -> Field:
        """Adagrad on the log likelihood, one chain at a time, in an order fixed by the seed."""
        self.known = None
        square, square_step = np.full_like(self.weight, 1e-6), np.full((3, 3), 1e-6)
        order, rng = list(range(len(examples))), random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                at, tags = examples[k]
                if rng.random() < 0.5:  # words are left out at times, so that shapes and places learn to tell
                    at = at.copy()
                    at[:, WORDS] = ROWS
                p, pairs = self.marginals(self.emissions(at))
                p[np.arange(len(tags)), tags] -= 1
                own, place = np.unique(at, return_inverse=True)
                g = decay * self.weight[own]
                np.add.at(g, place.reshape(-1), np.repeat(p, at.shape[1], axis=0))
                square[own] += g * g
                self.weight[own] -= rate * g / np.sqrt(square[own])
                for a, b in zip(tags, tags[1:]):
                    pairs[a, b] -= 1
                self.weight[ROWS] = 0
                square_step += pairs * pairs
                self.step -= rate * pairs / np.sqrt(square_step)
        return self


def generated(n: int = LINES, seed: int = 1, unseen: bool = False):
    """(text, spans of secrets) of made-up lines: keys, tokens, pass codes and phrases, and prose, numbers, names and dates that are none.

    unseen: other leads, marks and forms of secrets, for evaluation only.
    """
    rng = random.Random(seed)
    some = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    hexa, letters = "0123456789abcdef", string.ascii_letters
    alnum = letters + string.digits
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "que", "sch", "ion", "ung", "mente"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    phrase = lambda: " ".join(word() + word() for _ in range(rng.randint(3, 5)))
    secrets = [
        lambda: some(hexa, 16, 40), lambda: some(alnum, 12, 44), lambda: some(letters, 14, 40), lambda: "sk_live_" + some(alnum, 24, 24), lambda: "ghp_" + some(alnum, 36, 36), lambda: some(alnum + "+/", 38, 38) + "=",
        lambda: word().title() + some("!@#$%&*", 1, 2) + some(string.digits, 1, 4) + word(), lambda: some(alnum + "!@#$%^&*", 10, 20), lambda: "".join(word().title() for _ in range(rng.randint(3, 5))),
        lambda: "eyJ" + some(alnum, 20, 30) + ".eyJ" + some(alnum, 30, 60) + "." + some(alnum + "-_", 20, 43), lambda: " ".join(some(hexa, 8, 12) for _ in range(rng.randint(2, 4))), phrase, phrase,
        lambda: "-".join(some("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", 4, 4) for _ in range(rng.randint(2, 4))), lambda: some(letters, 2, 4).lower() + "-" + some(alnum, 20, 40), lambda: some(alnum + "_-", 24, 43),
    ]
    plain = [
        lambda: some(string.digits, 9, 19), lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4)), lambda: f"+{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(1000000, 9999999)}",
        lambda: word() + word() + str(rng.randint(1, 2030)), lambda: f"{word()}/{word()}/{word()}{rng.randint(1, 99)}.html", lambda: f"{word()}-{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", lambda: f"{word()}_{word()}_{rng.randint(1, 64)}",
        lambda: f"{some(hexa, 8, 8)}-{some(hexa, 4, 4)}-{some(hexa, 4, 4)}-{some(hexa, 4, 4)}-{some(hexa, 12, 12)}", lambda: f"{word()}.{some('abcxyz', 2, 3)}{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: f"https://{word()}.example.org/{word()}?{word()}={rng.randint(1, 999)}",
        lambda: word().title() + word().title() + str(rng.randint(1, 9)), word, word, lambda: some(hexa, 7, 16),
    ]
    leads = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth", "Bearer", "credential", "client_secret", "passphrase", "pwd", "Authorization: Bearer", "signing key", "recovery codes", "the password", "das Passwort", "Kennwort", "mot de passe", "le jeton", "contraseña", "clave secreta", "пароль", "client key"]
    others = ["id", "date", "host", "phone", "version", "card", "order", "ref", "build", "see", "from", "page", "file", "total", "invoice", "isbn", "commit", "uuid", "sha", "md5", "checksum", "digest", "etag"]
    marks = [" = ", "=", ": ", ":", ' = "', '="', ": '", " is ", " ", " -> ", " | ", " set to ", "\t", " lautet ", " est ", " es ", " ist "]
    prose = ["the secret of {}", "a token of {} and {}", "keep it secret from {}", "lost the password for {}", "bearer of {}", "auth for {} failed", "{} token {} was {}", "his password was {}"]
    if unseen:
        leads, marks = ["db_password", "master secret", "login token", "session_token", "PASSCODE", "private key", "x-api-key", "my pwd"], [" := ", " => ", " - ", " was ", ' : "']
        others, prose = ["serial", "tracking", "model", "from:", "room"], ["no secret that {} is {}", "they took the token to {}", "an open secret among {}"]
        secrets = [lambda: some(letters, 18, 30), lambda: "xoxb-" + some(string.digits, 11, 11) + "-" + some(alnum, 24, 24), lambda: word().title() + "$" + some(alnum, 6, 9) + "?" + word(), lambda: "AIza" + some(alnum + "_-", 35, 35), phrase, lambda: some("ABCDEFGHJKMNPQRSTVWXYZ23456789", 5, 5) + "-" + some("ABCDEFGHJKMNPQRSTVWXYZ23456789", 5, 5)]
    for _ in range(n):
        head, tail = (" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(2))
        rest = "\n" + " ".join(word() for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.25:
            p = rng.choice(prose)
            yield f"{head} {p.format(*(word() for _ in range(p.count('{}'))))} {tail}" + rest, []
            continue
        secret = rng.random() < 0.55
        lead = rng.choice(leads if secret or rng.random() < 0.05 else [*others, word()])
        value, mark = rng.choice(secrets if secret else plain)(), rng.choice(marks)
        if secret and " " in value and mark in (" ", "=", ":"):
            mark = ": "  # a phrase of words is one only behind a plain mark
        if rng.random() < 0.1:
            lead = lead.upper()
        before = f"{head} {lead}{mark}"
        quote = mark[-1] if mark[-1] in "'\"" else ""
        stop = quote + rng.choice([".", "\n", ", "]) if " " in value and not re.search("[0-9]", value) else quote + rng.choice([" ", ".", "\n", ", "])
        yield before + value + stop + (" " + tail if not stop.endswith("\n") else tail) + rest, [(len(before), len(before) + len(value))] if secret else []


def ordinary(n: int, seed: int = 1):
    """Lines of words in any case, with accents, stops and numbers, that hold no secret."""
    rng = random.Random(seed)
    parts = ["der", "ung", "sch", "é", "ß", "ö", "ain", "ber", "que", "SS", "Mc", "ÉT", "or", "an", "ci", "ö", "ñ", "ST", "na", "l'", "-", "к", "до", "за"]
    forms = [str, str, str, str.title, str.upper, str.capitalize, lambda w: w + rng.choice(".,;:!?)"), lambda w: f"({w}", lambda w: w[:2].upper() + w[2:], lambda w: w + str(rng.randint(1, 99)), lambda w: f"{w}:{w[:3]}"]
    for _ in range(n):
        yield " ".join(rng.choice(forms)("".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for _ in range(PIECE))


@lru_cache(1)
def fitted(lines: int = LINES, seed: int = 1) -> Field:
    """A field fitted on `lines` generated lines."""
    examples = []
    for k, (text, spans) in enumerate(generated(lines, seed)):
        whole = file_features(text)
        runs = list(near(text))
        # Of plain words far from triggers a share is enough to learn from; a first line without a trigger counts whole.
        plain = list(far(text, runs))
        for run in runs + (plain[-1:] if k % 4 == 0 else []) + ([] if runs else plain[:2]):
            tags = []
            for start, end in run:
                inside = any(a <= start and end <= b for a, b in spans)
                tags.append(O if not inside else I if tags and tags[-1] != O else B)
            examples.append((features(text, run, whole), tags))
    for text in ordinary(lines // 4, seed):
        whole = file_features(text)
        examples += [(features(text, run, whole), [O] * len(run)) for run in chains(text)]
    return Field().fit(examples)


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """(start, end) of tagged secrets, a begin and the insides that follow it."""
    return spans_of([text], field)[0]


def spans_of(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """field_spans of each text; chains of all are bounded at once."""
    runs, whole = [list(near(text)) for text in texts], [file_features(text) for text in texts]
    # A chain ends with its line, so texts are lines of one.
    begin = np.cumsum([0] + [len(text) + 1 for text in texts])
    words, starts, ends, size = pieces("\n".join(texts), [[(a + at, b + at) for a, b in run] for own, at in zip(runs, begin.tolist()) for run in own])
    first = np.cumsum(size) - size
    home = np.searchsorted(begin, starts[first], "right") - 1
    if words:
        bound = field.bound()
        for k in bound.doubtful(words, size, np.array([bound.of(*w) for w in whole])[home]):
            own, at = slice(first[k], first[k] + size[k]), begin[home[k]]
            runs[home[k]].append(list(zip((starts[own] - at).tolist(), (ends[own] - at).tolist())))
    out = []
    for text, own, features_of in zip(texts, runs, whole):
        found = []
        for run in own:
            tags = field.viterbi(field.emissions(features(text, run, features_of)))
            for (start, end), tag in zip(run, tags):
                if tag == B:
                    found.append((start, end))
                elif tag == I and found:
                    found[-1] = (found[-1][0], end)
        out.append(found)
    return out


def scan(text: str, field: Field):
    """(base spans, all spans), each (start, kind, end): the field's spans that no base span covers are added."""
    return next(scans([text], field))


def scans(texts: list[str], field: Field):
    """scan of each text, CHARACTERS of text at a time."""
    i = 0
    while i < len(texts):
        k, n = i + 1, len(texts[i])
        while k < len(texts) and n + len(texts[k]) <= CHARACTERS:
            n, k = n + len(texts[k]), k + 1
        for text, found in zip(texts[i:k], spans_of(texts[i:k], field)):
            base = base_spans(text)
            yield base, sorted(base + [(a, 3, b) for a, b in found if not any(s <= a and b <= e for s, _, e in base)])
        i = k


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) for every row of docs (doc_id, text).

    Null texts count as empty and give no spans; repeated rows give equal rows; texts of any length are scanned whole. Of equally likely
    tags the earlier of begin, inside, outside wins. An empty table gives an empty result. Columns of other names are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fitted())  # ROWS times three weights

    def run(batches):
        for b in batches:
            out = []
            for base, spans in scans([text or "" for text in b.column(1).to_pylist()], shared.value):
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                out.append((*n[:3], hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans), n[3]))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by `mark`; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fitted())

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                if text:
                    end, parts = 0, []
                    for a, _, z in scan(text, shared.value)[1]:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, z)
                    text = "".join(parts) + text[end:]
                out.append(text)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field("text"), pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
