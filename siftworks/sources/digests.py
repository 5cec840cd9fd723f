"""SHA-256 of files of any size: a large file is hashed piece by piece, by tasks that hand on the state of the hash."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

LARGE = 256 << 20  # bytes of a file over which it is hashed in pieces, each what one task reads of it
PACKED = re.compile(r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$")  # Spark's readers of lines would unpack these
MARK = b"\xef\xbb\xbf"  # which they leave out at the start of a file
STATE = 112  # bytes of libcrypto's SHA256_CTX


@lru_cache(1)
def library():
    """libcrypto, whose SHA-256 can be taken up from a state that another process left; None where it is not there."""
    try:
        lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Init.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
    except (OSError, AttributeError):
        return None
    return lib


def begun() -> bytes:
    held = ctypes.create_string_buffer(STATE)
    library().SHA256_Init(held)
    return held.raw


def told(state: bytes, content: bytes) -> bytes:
    """The state after content."""
    held = ctypes.create_string_buffer(state, STATE)
    library().SHA256_Update(held, content, len(content))
    return held.raw


def ended(state: bytes) -> str:
    held, out = ctypes.create_string_buffer(state, STATE), ctypes.create_string_buffer(32)
    library().SHA256_Final(out, held)
    return out.raw.hex()


def hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size) of each file in the folder and those below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = files.where(F.col("length") > LARGE).select("path", "length").collect() if library() else []
    large = {r.path: r.length for r in listed if not PACKED.search(r.path)}
    whole = files.where(F.col("length") <= LARGE) if large else files  # a bound on length keeps the reader from the others' content
    if large and len(large) < len(listed):
        whole = whole.unionByName(spark.read.format("binaryFile").load([literal(r.path) for r in listed if r.path not in large]))
    rows = whole.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").cast("bigint").alias("size"))
    if not large:
        return rows
    done = spark.createDataFrame([(p, h, large[p]) for p, h in in_pieces(spark, large).items()], "path string, sha256 string, size bigint")
    return rows.unionByName(done)


def literal(path: str) -> str:
    """The path as a pattern that means just it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def in_pieces(spark: SparkSession, sizes: dict[str, int]) -> dict[str, str]:
    """SHA-256 of the files of these names and sizes. The k-th pieces of all files are hashed side by side, after those before; states of some hundred bytes pass the driver."""
    root = scratch.folder(spark, "pieces")
    pieces = {path: split(spark, path, f"{root}/{i}") for i, path in enumerate(sizes)}
    state = {path: begun() for path in sizes}
    for path, size in sizes.items():
        more = sum(n for _, n in pieces[path]) - size
        # Each line was written with its end. The last may have had none, and a mark at the start was left out.
        front = MARK if more < -1 else b""
        state[path] = told(state[path], front)
        more += len(front)
        if more not in (0, 1):
            raise ValueError(f"{path} is not whole in its pieces")
        pieces[path] = [(p, n - more * (k == len(pieces[path]) - 1)) for k, (p, n) in enumerate(pieces[path])]
    for k in range(max(map(len, pieces.values()))):
        now = {own[k][0]: (path, own[k][1], state[path]) for path, own in pieces.items() if k < len(own)}

        def run(batches, now=now):
            for b in batches:
                known = [now[p] for p in b.column(0).to_pylist()]
                after = [told(held, content.as_buffer().to_pybytes()[:n]) for (_, n, held), content in zip(known, b.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in known], pa.string()), pa.array(after, pa.binary())], names=["path", "state"])

        read = spark.read.format("binaryFile").load(list(now)).select("path", "content")
        state |= {r.path: bytes(r.state) for r in read.mapInArrow(run, "path string, state binary").collect()}
    scratch.remove(spark, root)
    return {path: ended(held) for path, held in state.items()}


def split(spark: SparkSession, path: str, out: str) -> list[tuple[str, int]]:
    """(name, bytes) of files, in order, that hold what Spark's tasks read of a file, cut at ends of lines; the last line ends in any case."""
    x = spark.read.text(literal(path), lineSep="\n")
    x = x.select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    x.sortWithinPartitions("block", "n").select("value", "block").write.partitionBy("block").text(out, lineSep="\n", compression="none")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select("path", "length").collect()
    return [tuple(r) for r in sorted(rows, key=lambda r: (int(re.search(r"/block=(\d+)/", r.path)[1]), r.path))]
