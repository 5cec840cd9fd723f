"""Distinct word n-grams of lower-case texts as 64-bit hashes, over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20  # bytes of text that are handled at once, and a text
_WORD = np.full(256, ord(" "), np.uint8)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = [*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every [a-z0-9]+ of the texts. Bytes of other letters, and of broken ones, part words as any other character does."""
    texts = texts.cast(pa.string())
    offsets, data = texts.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = _WORD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    ascii_texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(plain.tobytes()))
    parts = pc.ascii_split_whitespace(ascii_texts)
    row = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    words = parts.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    coded = words.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return row[full], hashes[coded.indices.to_numpy(zero_copy_only=False)][full]


def hashes(texts: pa.Array, seeds: pa.Array | None = None, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted, of the distinct n-grams of each text; texts without n words have none. A seed tells grams of its text from those of texts with another."""
    row, words = _words(texts)
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = row[: len(row) - n + 1] == row[n - 1 :]
    h = np.zeros(len(row) - n + 1, np.uint64)
    for k in range(n):
        h = _mixed(h + words[k : len(words) - n + 1 + k])
    row, h = row[: len(h)][whole], h[whole]
    if seeds is not None:
        h = _mixed(h + pd.util.hash_array(seeds.to_numpy(zero_copy_only=False).astype(object), categorize=False)[row])
    h = h.view(np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE bytes of their column `text`."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def lists(batches, n: int = 3):
    """Batches (id, text, ...) as (id, members): of each text, which is not null, its distinct n-grams. A third column is the seed."""
    for batch in batches:
        for part in _slices(batch):
            row, h = hashes(part.column("text"), part.column(2) if part.num_columns > 2 else None, n)
            offsets = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))], names=["id", "members"])


def keys(batches, n: int = 3):
    """Batches (id, text) as (id, size, key): of texts with n-grams their number and a SHA-256 that texts with the same ones share."""
    for batch in batches:
        for part in _slices(batch):
            row, h = hashes(part.column("text"), None, n)
            offsets = np.searchsorted(row, np.arange(len(part) + 1))
            own = np.flatnonzero(np.diff(offsets))
            key = [hashlib.sha256(h[offsets[k] : offsets[k + 1]].tobytes()).digest() for k in own]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(np.diff(offsets)[own].astype(np.int32)), pa.array(key, pa.binary())], names=["id", "size", "key"])
