"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow batch are handed to numpy in pieces of about this many text bytes.
PIECE_BYTES = 4_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session, as in tests, gets a temporary one; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="siftworks-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of the actions within go as soon as each action has ended; their results are written tables."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared checkpoint folder, for rows that compress well there. drop_table removes it."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # hashes and texts, of which few repeat
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes what tabled() wrote; nothing that is still to be computed may read it."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


MARK_BITS = 24


def marks(keys: DataFrame, hashed) -> DataFrame:
    """A fixed table of 2 ** MARK_BITS bits, in words of 64, in which the rows of keys set the bit of their 64-bit hash; at most 2 ** (MARK_BITS - 6) rows."""
    place = F.shiftrightunsigned(hashed, 64 - MARK_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    return cut(keys.groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))


def marked(rows: DataFrame, hashed, table: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose bit is set in marks(), or with left_anti the others: those are surely not among the keys and need no shuffle to tell."""
    word, bits = fresh(rows.columns, "_word", "_bits")
    table = F.broadcast(table.toDF(word, bits))
    place = F.shiftrightunsigned(hashed, 64 - MARK_BITS)
    return rows.join(table, (F.shiftright(place, 6) == F.col(word)) & (F.getbit(F.col(bits), place.bitwiseAND(F.lit(63)).cast("int")) == 1), how)


def fresh(columns, *names: str) -> list[str]:
    """The names, each made longer until no column has it in either case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another behind their lengths, for blobs that stand for many rows in a shuffle."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit keys."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BATCH_ROWS = 4000


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of this session hold BATCH_ROWS rows at most: whole texts pass through them, on both sides of the pipe to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def released(run):
    """run, a function of Arrow batches, that hands free memory back to the system when a task's batches end: workers live on and serve other stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if libc := ctypes.util.find_library("c"):
            trim = getattr(ctypes.CDLL(libc), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return wrapped


def held_out(doc_id="doc_id"):
    """True where crc32(doc_id as text) mod 3 is 1: rows that nothing may be learned from. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def pieces(lengths, limit: int = PIECE_BYTES):
    """(start, end) of consecutive rows whose lengths sum to about `limit`; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step of alternating connected components over (a, b) edges with a > b.

    Every neighbour of a node (small: every smaller one) is linked to the least neighbour. Hubs are
    summed to one row before the join, and the joins' skewed partitions are split by AQE.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the least node reachable.

    edges: (a bigint, b bigint). Nodes without an edge are absent. Alternates large-star and small-star
    steps until all edges are stars, each node having one lesser neighbour and no greater one, or only greater ones; each round is cut
    into the shared checkpoint folder and only whether there is any other node reaches the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    for _ in range(max_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
        sides = ends.groupBy("node").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater"))
        if sides.where("lesser > 1 or (lesser = 1 and greater = 1)").agg(F.count("*").alias("n")).first().n == 0:
            break
        now = cut(_star(_star(now, False), True))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
