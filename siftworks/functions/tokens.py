"""Token counts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  # where the driver finds it; any other path can be given


@lru_cache(2)
def load(content: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(content)
    out.encode_special_tokens = True
    return out


# Where a text falls into pieces whose tokens do not depend on each other, as the pattern of byte-level vocabularies begins a part there and looks
# no farther back: at a lone blank or line end between others than blanks, behind such a line end, and between a letter and a stop.
PIECES = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-z])(?=[.,;:!?])")
KNOWN_PIECES, LONG_PIECE = 500_000, 400  # pieces remembered by a task; characters from which a piece is not


def apart(own) -> bool:
    """Whether a vocabulary's tokens of a text are those of its pieces: byte-level parts by the usual pattern, nothing before them, no added token that is looked for in whole texts."""
    form = json.loads(own.to_str())
    before, model = form["pre_tokenizer"] or {}, form["model"]
    added = any(not x["special"] for x in form["added_tokens"]) or not own.encode_special_tokens
    return before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and form["normalizer"] is None and form["truncation"] is None and form["padding"] is None and model.get("dropout") is None and not added


def counts(own, texts: list[str], known: dict[str, int]) -> list[int]:
    """The number of tokens of each text, from its pieces, of which those in `known` are not encoded again."""
    if len(known) > KNOWN_PIECES:
        known.clear()
    split = [PIECES.split(t) for t in texts]
    new = list({p for parts in split for p in parts if p not in known})
    now = dict(zip(new, (len(e) for i in range(0, len(new), 4096) for e in own.encode_batch_fast(new[i : i + 4096], add_special_tokens=False))))
    out = [sum([known[p] if p in known else now[p] for p in parts]) for parts in split]
    known.update((p, n) for p, n in now.items() if len(p) < LONG_PIECE)
    return out


def lengths(df: DataFrame, column: str, path: str = VOCABULARY) -> DataFrame:
    """df without the text column, with tokens: the number of tokens of each whole text; null has none. The vocabulary goes to executors with the function."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    rest = [c for c in df.columns if c != column]
    kinds = ", ".join(f"{df.schema[c].name} {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        own, known = load(content), {}
        whole = lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        count = (lambda texts: counts(own, texts, known)) if apart(own) else whole
        for b in batches:
            texts = [t or "" for t in b.column(column).to_pylist()]
            n = [x for i in range(0, len(texts), 256) for x in count(texts[i : i + 256])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], names=[*rest, "tokens"])

    return df.mapInArrow(run, f"{kinds}, tokens bigint")
