"""Lines of whole texts in numpy: normal forms, hashes, SimHashes and the keys under which like lines meet.

A line's lower-case words, which ASCII punctuation and white space part, make its normal form. All lines of some texts are
worked on at once over their bytes; no Python loop runs over words. A form has KEYS keys of 40 bits at most:

- SHINGLES hashes of two adjacent words. They are the first in an order by an exponential draw by hash, divided by the eighth power
  of the shingle's length, so that long words, which are rare, come first and common ones hardly ever. Lines with more than LONG_WORDS bytes a word, as in
  scripts without blanks, have shingles of WINDOW characters instead.
- Lines of SHORT words or fewer have half as many shingles, and hashes of both ends: of the two longest LEVELS of characters, up
  to two fifths of the form, that it begins and that it ends with.
"""

from __future__ import annotations

import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix64, pieces

SHINGLES, SHORT = 6, 10
KEYS, KEY_BITS = 8, 40
PACKED = [f"k{i}" for i in range(KEYS * KEY_BITS // 64)]
# Numbers of characters at either end of a line that are hashed, each at least 5 / 4 times the one before.
LEVELS = [2]
while LEVELS[-1] < 1 << 31:
    LEVELS.append(-(-LEVELS[-1] * 5 // 4))
LONG_WORDS, WINDOW = 24, 6
CONTENT, ENOUGH = 5, 4  # a SimHash is over words of CONTENT bytes or more, if there are ENOUGH: short ones are common to most lines
LINES = "doc_id bigint, text_hash bigint, line int, form bigint, norm string, size int, words int, simhash bigint, " + ", ".join(f"{k} bigint" for k in PACKED)
PARTING = bytes(32 if (chr(i) in string.punctuation or i < 33 or i == 127) and i != 10 else i for i in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)
BYTES = mix64(np.arange(256))
BYTES[:33] = 0  # what parts words weighs nothing
MASK = np.uint64((1 << KEY_BITS) - 1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


UP = 0xD6E8FEB86659FD93
DOWN = pow(UP, -1, 1 << 64)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the runs of values that begin at `first`: values weighted by a power of their place in the run, summed modulo 2 ** 64."""
    return mix64(np.add.reduceat(values * powers(len(values), UP), first) * powers(len(values), DOWN)[first])


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes of one long line."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0]


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes in flat, the bits set in over half of them.

    Counters are bit-sliced: plane k holds bit k of all 64 counts of a line in one word, so that adding the
    next hash of all lines is some operations on words. Lines of more than 255 words are counted one by one.
    """
    out = np.zeros(len(sizes), "<u8")
    first = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(sizes > 255):
        out[i] = _majority(flat[first[i] : first[i] + sizes[i]])
    order = np.flatnonzero(sizes <= 255)
    order = order[np.argsort(-sizes[order], kind="stable")]
    n, at = sizes[order], first[order]
    planes = np.zeros((8, len(order)), "<u8")
    active = np.searchsorted(-n, -np.arange(n.max(initial=0)))  # the first active[p] lines have a word p
    for p, k in enumerate(active):
        carry = flat[at[:k] + p]
        for plane in planes[: (p + 1).bit_length()]:
            now = plane[:k]
            over = now & carry
            now ^= carry
            carry = over
    more, same = np.zeros(len(order), "<u8"), np.full(len(order), 0xFFFFFFFFFFFFFFFF, "<u8")
    for k in range(7, -1, -1):
        half = np.where((n // 2) >> k & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        more |= same & planes[k] & ~half
        same &= ~(planes[k] ^ half)
    out[order] = more
    return out


def end_keys(form: str) -> list[int]:
    """Hashes of the two longest LEVELS of characters, up to two fifths of the form, that it begins and that it ends with.

    The shorter of two forms at 0.8 has its longest level in common with the other, as that one's longest or the one below.
    """
    n = len(form)
    if n < 4:  # no edit is within 0.8
        return []
    j, h, out = bisect_right(LEVELS, max(2, 2 * n // 5)) - 1, xxhash.xxh64_intdigest, []
    for i in (j, j - 1):
        if i >= 0:
            size = LEVELS[i]
            out += [h(form[:size], 2 * i), h(form[-size:], 2 * i + 1)]
    return out


def _first_keys(hashes: np.ndarray, weight: np.ndarray, line: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
    """(n, KEYS) the first distinct hashes of each line by weighted draw, `most` of a line at most; 0 where there are fewer."""
    out = np.zeros((n, KEYS), np.uint64)
    if not len(hashes):
        return out
    draw = np.log2(-np.log(((hashes >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))) - 8 * np.log2(weight)
    order = np.lexsort((draw, line)) if max(len(hashes) >> 24, n >> 20) else None
    if order is None:  # line, draw and place fit one word, which sorts sooner
        packed = line.astype(np.uint64) << np.uint64(44) | np.clip((draw + 200) * 4096, 0, (1 << 20) - 1).astype(np.uint64) << np.uint64(24) | np.arange(len(hashes), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
    line, hashes = line[order], hashes[order]
    new = np.ones(len(line), bool)  # repeats of a shingle have the same draw and stand together
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    line, hashes = line[new], hashes[new]
    count = np.bincount(line, minlength=n)
    rank = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    few = rank < most[line]
    out[line[few], rank[few]] = hashes[few] & MASK | np.uint64(1)
    return out


def pack_keys(keys: np.ndarray) -> list[np.ndarray]:
    """(n, KEYS) keys in words of 64 bits."""
    data = keys.astype("<u8").view(np.uint8).reshape(len(keys), KEYS, 8)[:, :, : KEY_BITS // 8]
    return list(np.ascontiguousarray(data).reshape(len(keys), -1).view("<i8").T)


def unpack_keys(words: list[np.ndarray]) -> np.ndarray:
    data = np.ascontiguousarray(np.stack(words, axis=1).astype("<i8")).view(np.uint8).reshape(len(words[0]), KEYS, KEY_BITS // 8)
    out = np.zeros((len(words[0]), KEYS, 8), np.uint8)
    out[:, :, : KEY_BITS // 8] = data
    return out.view("<u8").reshape(len(words[0]), KEYS)


def analyse(data: bytes):
    """(number of each line with a word, hash of its form, its form, characters, words, SimHash, keys) of lower-case UTF-8 text.

    Forms that stand in the data before have no text and no keys, which the first of them has.
    """
    part = np.frombuffer(data.translate(PARTING), np.uint8)
    if not len(part):
        return None
    word = part > 32
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    start = np.flatnonzero(begin)
    if not len(start):
        return None
    last = word.copy()
    last[:-1] &= ~word[1:]
    length = np.flatnonzero(last) + 1 - start
    number = np.cumsum(part == 10, dtype=np.int32)[start]
    hashes = sums(BYTES[part], start)
    new = np.ones(len(start), bool)
    new[1:] = number[1:] != number[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    form = sums(hashes, first)
    word[start[~new] - 1] = True  # a blank before each word but a line's first
    flat = part[word]
    size = np.add.reduceat(length, first) + n - 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    chars = np.add.reduceat((flat & 0xC0) != 0x80, offsets[:-1], dtype=np.int32)
    line = np.repeat(np.arange(len(n)), n)
    fresh = np.zeros(len(form), bool)
    fresh[np.unique(form, return_index=True)[1]] = True
    spaced = size <= LONG_WORDS * n
    at = np.flatnonzero((line[1:] == line[:-1]) & (fresh & spaced)[line[:-1]])
    shingle, weight, owner = mix64(hashes[at] * ODD + hashes[at + 1]), (length[at] + length[at + 1]).astype(float), line[at]
    features, counts = _contents(hashes, length, first, line)
    odd = np.flatnonzero(fresh & ~spaced)
    if len(odd):  # scripts without blanks: windows of characters stand for words
        got = [_windows(flat[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in odd]
        more = np.concatenate(got)
        shingle, weight = np.append(shingle, more), np.append(weight, np.ones(len(more)))
        owner = np.append(owner, np.repeat(odd, [len(x) for x in got]))
        split = np.split(features, np.cumsum(counts)[:-1])
        for i, x in zip(odd.tolist(), got):
            split[i] = x
        features, counts = np.concatenate(split), np.array([len(x) for x in split])
    prints = majority(features, counts)
    short = (n <= SHORT) & fresh
    keys = _first_keys(shingle, weight, owner, len(n), np.where(short, SHINGLES // 2 + 1, SHINGLES))
    text, ends = flat.tobytes(), offsets.tolist()
    for i in np.flatnonzero(short).tolist():
        for k, h in enumerate(end_keys(text[ends[i] : ends[i + 1]].decode())):
            keys[i, KEYS - 1 - k] = h & int(MASK) | 1
    kept = flat if fresh.all() else flat[np.repeat(fresh, size)]
    at = np.concatenate([[0], np.cumsum(np.where(fresh, size, 0))]).astype(np.int32)
    norm = pa.StringArray.from_buffers(len(n), pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes()), pa.array(fresh).buffers()[1])
    return number[first], form, norm, chars, n, prints, keys


def _contents(hashes: np.ndarray, length: np.ndarray, first: np.ndarray, line: np.ndarray):
    """(hashes of the words that a SimHash is over, their number in each line)."""
    long = length >= CONTENT
    long |= (np.add.reduceat(long, first, dtype=np.int64) < ENOUGH)[line]
    return hashes[long], np.add.reduceat(long, first, dtype=np.int64)


def sketches(forms: list[str], n: int = 4) -> np.ndarray:
    """(forms, n) SimHashes of forms over the same words, by n hashes of each word."""
    part = np.frombuffer("\n".join(forms).encode(), np.uint8)
    word = part > 32
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    start = np.flatnonzero(begin)
    word[:-1] &= ~word[1:]
    length = np.flatnonzero(word) + 1 - start
    line = np.cumsum(part == 10)[start]
    first = np.searchsorted(line, np.arange(len(forms)))
    flat, counts = _contents(sums(BYTES[part], start), length, first, line)
    return np.stack([majority(mix64(flat + np.uint64(i)), counts) for i in range(n)], axis=1)


def _windows(form: str) -> np.ndarray:
    """A hash of each run of WINDOW characters; of the whole form if it has fewer."""
    codes = mix64(np.frombuffer(form.encode("utf-32-le"), "<u4"))
    k = min(WINDOW, len(codes))
    p = powers(k, UP)
    return mix64(sum(codes[i : len(codes) - k + 1 + i] * p[i] for i in range(k)))


def _chunks(text: str, most: int = 1 << 20):
    """(number of the first line, lower-case UTF-8) of a text, cut between lines about every `most` bytes."""
    data, line, begin = text.lower().encode(), 0, 0
    while len(data) - begin > most and (end := data.find(b"\n", begin + most)) >= 0:
        yield line, data[begin : end + 1]
        line += data.count(b"\n", begin, end + 1)
        begin = end + 1
    yield line, data[begin:] if begin else data


def line_batches(batches):
    """LINES rows for Arrow batches (doc_id, text, text_hash)."""
    for b in batches:
        ids, hashes = b.column(0), b.column(2)
        chunks = [(k, *c) for k, text in enumerate(b.column(1)) if text.is_valid for c in _chunks(text.as_py())]
        for i, j in pieces([len(c[2]) for c in chunks], 1 << 20):
            data = b"\n".join(c[2] for c in chunks[i:j])
            got = analyse(data)
            if got is None:
                continue
            number, form, norm, chars, n, prints, keys = got
            # Each chunk begins at a line of its own in the joined data.
            begins = np.cumsum([0] + [c[2].count(b"\n") + 1 for c in chunks[i : j - 1]])
            place = np.searchsorted(begins, number, "right") - 1
            owner = pa.array(np.array([c[0] for c in chunks[i:j]])[place])
            line = number - begins[place] + np.array([c[1] for c in chunks[i:j]])[place]
            again = pc.is_null(norm).to_numpy(zero_copy_only=False)
            columns = [ids.take(owner), hashes.take(owner), pa.array(line.astype(np.int32)), pa.array(form.view(np.int64)), norm, pa.array(chars), pa.array(n.astype(np.int32)), pa.array(prints.view(np.int64)), *(pa.array(k, mask=again) for k in pack_keys(keys))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LINES.split(", ")])


def normal_form(line: str) -> str:
    """The words of a line joined by a space."""
    got = analyse(line.replace("\n", " ").lower().encode())
    return got[2][0].as_py() if got else ""
