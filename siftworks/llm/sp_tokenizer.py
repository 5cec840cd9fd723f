"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here, and its normaliser, white-space marker, unigram scores or merges and byte
fallback are rebuilt. Texts are cut where no piece can cross, between a character and a following marker;
the distinct parts of a batch are encoded by the library's threads and remembered. Parity is verified by
encoding every part with the sentencepiece library as well.
"""

from __future__ import annotations

import heapq
import hashlib
import importlib
import os
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from .common import pieces, released

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KNOWN_PARTS = 200_000  # remembered by a task: some 50 MB
PIECE_CHARS = 500_000  # of texts that are cut into parts at once
LONG_PART = 400  # characters from which a part, as in scripts without blanks, is not remembered
os.environ.setdefault("RAYON_NUM_THREADS", "2")  # the cores of a task's executor share the library's threads


def default_model() -> str:
    """Place of the installed model file; any other path can be given to the operators."""
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def _varint(b: bytes, i: int):
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def fields(b: bytes):
    """(number, value) of each field of a protobuf message: int, bytes, or raw fixed-width bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Model:
    """Pieces, scores, kinds and switches of a model file, and encoders made of them."""

    def __init__(self, proto: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, norm = {}, {}
        for n, v in fields(proto):
            if n == 1:
                x = dict(fields(v))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif n == 2:
                trainer = dict(fields(v))
            elif n == 3:
                norm = dict(fields(v))
        self.type = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.trim = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.unk = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.plain = {p: i for p, i in self.ids.items() if self.kinds[i] in (NORMAL, USER)}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.plain)
        if self.type not in (UNIGRAM, BPE) or not self.splits or USER in self.kinds:
            raise ValueError("only unigram and BPE models without user symbols or pieces across a marker are rebuilt")
        self.char_norm = normalizers.Precompiled(self.charsmap) if self.charsmap else None
        self.tokenizer = Tokenizer(self._unigram() if self.type == UNIGRAM else self._bpe())
        self.odd: set[str] = set()  # parts seen without parity
        self.bytes_of = [self._bytes(i) for i in range(len(self.pieces))]

    def _unigram(self):
        return models.Unigram(list(zip(self.pieces, self.scores)), unk_id=self.unk, byte_fallback=self.byte_fallback)

    def _bpe(self):
        merges = []
        for p, i in self.plain.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in self.plain and b in self.plain:
                    merges.append((-self.scores[i], i, self.plain[a], self.plain[b], a, b))
        merges.sort()
        return models.BPE(self.ids, [m[-2:] for m in merges], unk_token=self.pieces[self.unk], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)

    def _bytes(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        """The text as the model sees it: characters mapped, spaces trimmed, marked and prefixed."""
        if self.char_norm:
            text = self.char_norm.normalize_str(text)
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return text
        return (" " * self.dummy_prefix + text).replace(" ", MARK)

    def _tied(self, part: str) -> list[int]:
        """Merges of a BPE part by best score, the leftmost of equal ones first: for runs of markers, whose pieces tie."""
        symbols = list(part)
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        heap: list = []

        def offer(i):
            if i >= 0 and after[i] >= 0:
                p = symbols[i] + symbols[after[i]]
                if p in self.plain:
                    heapq.heappush(heap, (-self.scores[self.plain[p]], i, after[i], p))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if symbols[i] is None or after[i] != j or symbols[i] + symbols[j] != p:
                continue
            symbols[i], symbols[j] = p, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        out = []
        for s in symbols:
            if s in self.plain:
                out.append(self.plain[s])
            elif s is not None:
                out += [self.ids[f"<0x{x:02X}>"] for x in s.encode()] if self.byte_fallback else [self.unk]
        return out

    def learn(self, parts: set[str], known: dict[str, bytes]) -> None:
        """Encodes the parts that known lacks, on the library's threads, into little-endian int32 ids."""
        new = parts.difference(known)
        plain = [p for p in new if self.type == UNIGRAM or not p.startswith(MARK * 2)]
        for p, e in zip(plain, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
            known[p] = array("i", e.ids).tobytes()
        for p in new.difference(plain):
            known[p] = array("i", self._tied(p)).tobytes()

    def verify(self, parts: set[str], known: dict[str, bytes], other) -> set[str]:
        """The parts that the sentencepiece processor encodes otherwise.

        A text's parts are encoded apart from each other by both, so texts without such a part have parity.
        """
        parts = list(parts)
        return {p for p, ids in zip(parts, other.encode([p[1:].replace(MARK, " ") for p in parts], num_threads=1)) if array("i", ids).tobytes() != known[p]}

    def split(self, text: str) -> list[str]:
        """The normalised text cut where no piece can cross."""
        text = self.normalise(text)
        if text[:1] == MARK and MARK * 2 not in text and text[-1] != MARK:
            return [MARK + w for w in text[1:].split(MARK)]  # what the pattern finds, sooner
        return PARTS.findall(text)

    def encode_batch(self, texts: list[str], known: dict[str, bytes] | None = None, other=None) -> list[bytes] | list[tuple[bytes, bool]]:
        """Ids of each text as little-endian int32 bytes; with `other`, a sentencepiece processor, also its parity.

        known: parts encoded before, which the call adds to. Parity is verified on each part when it is first met,
        or on whole texts for models whose normaliser is more than a prefix and markers.
        """
        known = {} if known is None else known
        if len(known) > KNOWN_PARTS:
            known.clear()
        split = [self.split(t) for t in texts]
        found = [list(map(known.get, s)) for s in split]
        unseen = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {s[i] for s, o in zip(split, unseen) for i in o}
        self.learn(new, known)
        for s, f, o in zip(split, found, unseen):
            for i in o:
                f[i] = known[s[i]]
        ids = [b"".join(f) for f in found]
        if other is not None and new and not (self.char_norm or self.trim or not self.dummy_prefix):
            self.odd |= self.verify(new, known, other)
        for p in [p for p in new if len(p) > LONG_PART]:
            del known[p]
        if other is None:
            return ids
        if self.char_norm or self.trim or not self.dummy_prefix:
            return [(x, array("i", other.encode(t)).tobytes() == x) for x, t in zip(ids, texts)]
        return [(x, not self.odd or self.odd.isdisjoint(s)) for x, s in zip(ids, split)]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian int32 ids; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.dummy_prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


@lru_cache(2)
def load(proto: bytes) -> tuple[Model, sentencepiece.SentencePieceProcessor]:
    return Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


def model_bytes(path: str | None = None) -> bytes:
    """Content of a model file, some hundred kB, which goes to the executors with the function that uses it."""
    with open(os.fspath(path or default_model()), "rb") as f:
        return f.read()


def _texts(column):
    """Lists of the column's texts, null ones as '', of about PIECE_CHARS each; a longer text stands alone."""
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    for start, end in pieces(lengths, PIECE_CHARS):
        yield [x or "" for x in column.slice(start, end - start).to_pylist()]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary): little-endian int32 ids of each whole text; null and empty texts have none."""
    proto = model_bytes(path)

    def run(batches):
        model, known = load(proto)[0], {}
        for b in batches:
            ids = [x for part in _texts(b.column(1)) for x in model.encode_batch(part, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids binary); null ids give ''."""
    proto = model_bytes(path)

    def run(batches):
        model = load(proto)[0]
        for b in batches:
            texts = [model.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip, parity) for every row of docs (doc_id, text).

    ids_sha256 is of little-endian int32 ids; round_trip: decoding gives the normalised text back; parity: the sentencepiece
    library makes the same ids of all of the text. Null and empty texts have no tokens; repeated rows give equal rows; texts of any length are
    encoded whole. Pieces of equal score merge from the left. An empty table gives an empty result. Columns of other names are not looked at.
    """
    proto = model_bytes(path)

    def run(batches):
        (model, own), known = load(proto), {}
        for b in batches:
            out = []
            for part in _texts(b.column(1)):
                for text, (ids, same) in zip(part, model.encode_batch(part, known, own)):
                    want = model.normalise(text).replace(MARK, " ")
                    want = want[1:] if model.dummy_prefix else want
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), model.decode(ids) == want, same))
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean, parity boolean"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(released(run), schema)
