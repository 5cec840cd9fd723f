"""Importance resampling towards a target distribution of hashed n-grams, which DuckDB makes in each partition.

In each task DuckDB unnests the words of a few megabytes of text at a time, forms n-grams by window functions, and hashes them with a
registered function over zlib's CRC-32. What comes out are bucket numbers: the task's counts, and for each document the buckets of its
features in two bytes each. Spark spills both to Parquet in the shared folder, merges the counts into one gain for each bucket,
weighs documents by the spilled buckets without reading a text again, and ranks them by weight plus Gumbel noise.
"""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop_table, fresh, marked, marks, pieces, released, tabled

# All but ASCII control characters, blanks, marks and capitals, which are lower-cased before.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 2, 10_000, 7, 25, 20
PIECE_BYTES = 2_000_000  # texts that DuckDB holds at once; a longer text stands alone
MEMORY = "400MB"


def _crc(features: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC-32 of each feature's UTF-8 bytes."""
    crc, out = zlib.crc32, []
    for chunk in features.chunks if isinstance(features, pa.ChunkedArray) else [features]:
        chunk = chunk.cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int64, len(chunk) + 1, 8 * chunk.offset).tolist()
        data = data.to_pybytes() if data else b""
        sums = np.fromiter((crc(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint32, len(chunk))
        out.append(pa.array(sums, mask=chunk.is_null().to_numpy(zero_copy_only=False)))
    return out[0] if len(out) == 1 else pa.chunked_array(out, pa.uint32()).combine_chunks()


def connect() -> duckdb.DuckDBPyConnection:
    """A database in memory, of one thread, that writes nothing to disk, with the function zlib_crc32."""
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": True})
    con.create_function("zlib_crc32", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def feature_sql(grams: int = GRAMS, buckets: int = BUCKETS) -> str:
    """(doc, b1, ..., bn) for each word of the table `texts` (doc, text), in order: the buckets of the n-grams of 1, ..., n words that begin there, null past the end."""
    following = "".join(f", lead(word, {k}) over w as w{k}" for k in range(1, grams))
    gram = lambda n: " || ' ' || ".join(["word", *(f"w{k}" for k in range(1, n))])
    hashed = "".join(f", (zlib_crc32({gram(n)}) % {buckets})::integer as b{n}" for n in range(1, grams + 1))
    return f"""
        with lists as (select doc, regexp_extract_all(text, '{WORDS}') as words from texts),
        words as (select doc, unnest(words) as word, generate_subscripts(words, 1) as pos from lists),
        grams as (select doc, pos, word{following} from words window w as (partition by doc order by pos))
        select doc{hashed} from grams order by doc, pos"""


def bucketed(texts: list, con: duckdb.DuckDBPyConnection, sql: str, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, number of features of each text, all features' buckets, text after text)."""
    docs = pa.table({"doc": pa.array(np.arange(len(texts), dtype=np.int32)), "text": texts})
    con.register("texts", docs)
    got = con.sql(sql).to_arrow_table().combine_chunks()
    con.unregister("texts")
    doc = got.column("doc").to_numpy()
    each = np.stack([pc.fill_null(got.column(f"b{n}"), -1).to_numpy() for n in range(1, grams + 1)], axis=1) if len(doc) else np.empty((0, grams), np.int32)
    there = each >= 0
    features = np.bincount(doc, weights=there.sum(axis=1), minlength=len(texts)).astype(np.int64)
    return np.bincount(doc, minlength=len(texts)), features, each[there].astype(np.uint16)


SPILLED = "doc_id bigint, text_hash bigint, n_words bigint, n_features bigint, buckets binary, counts array<bigint>"


def spill(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Rows of SPILLED, written as Parquet in the shared folder, from rows (doc_id, text): one for each text, and one for each task that has counts alone.

    Null texts have no words. Rows are told apart by nothing: repeated ones stay. A text of any length is taken whole.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")
    sql = feature_sql(grams, buckets)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        con, counts = None, np.zeros(buckets, np.int64)
        for batch in batches:
            con = con or connect()
            text = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
            for start, end in pieces(pc.binary_length(text).to_pylist(), PIECE_BYTES):
                n = end - start
                words, features, flat = bucketed(text.slice(start, n), con, sql, grams)
                counts += np.bincount(flat, minlength=buckets)
                ends = np.zeros(n + 1, np.int64)
                np.cumsum(2 * features, out=ends[1:])
                blobs = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, n), batch.column("text_hash").slice(start, n), pa.array(words.astype(np.int64)), pa.array(features), blobs, pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
        if con is not None:
            yield pa.RecordBatch.from_pylist([{"counts": counts.tolist()}], schema)
            con.close()

    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return tabled(rows.mapInArrow(released(run), SPILLED))


def merged(spilled: DataFrame) -> DataFrame:
    """(bucket, n) from the tasks' counts."""
    return spilled.where("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A gain for each bucket, floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), from merged() counts of raw and target rows."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    sums = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    rows = {r.bucket: (r.s, r.t) for r in sums.collect()}  # `buckets` rows at most
    s, t = (np.array([rows.get(b, (0.0, 0.0))[k] for b in range(buckets)]) for k in (0, 1))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(spilled: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight): the floored mean of the gains of a text's features; 0 without any."""

    def run(batches):
        for batch in batches:
            sums, n = [], batch.column("n_features").to_numpy()
            for blob in batch.column("buckets"):
                sums.append(int(gain[np.frombuffer(blob.as_buffer(), np.uint16)].sum()))
            weight = np.array(sums, np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "n_words", "n_features")), pa.array(weight)], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    rows = spilled.where("counts is null").select("doc_id", "text_hash", "n_words", "n_features", "buckets")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id, seed: int = SEED):
    """floor(-1000 * ln(-ln(u))), a thousandfold Gumbel number, with u from the first 8 hex digits of sha256 of '<seed>:<doc_id>'. A null id counts as ''."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank, 1 for the first by `order`. Rows are sorted by ranges; the ranges' sizes alone reach the driver."""
    at, part, ahead = fresh(rows.columns, "_at", "_part", "_ahead")
    x = cut(rows.orderBy(*order).withColumns({at: F.monotonically_increasing_id(), part: F.spark_partition_id()}))
    sizes = x.groupBy(part).agg(F.count("*").alias(ahead)).orderBy(part).collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r[part], total))
        total += r[ahead]
    base = F.broadcast(x.sparkSession.createDataFrame(starts, f"{part} int, {ahead} bigint"))  # a row for each partition
    return x.join(base, part).withColumn("rank", F.col(ahead) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, part, ahead)


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text_hash, n_features, weight, score, rank) of every row of docs (doc_id, text), drawn towards the texts of target (text).

    Of the N rows of least_words words or more, floor(percent * N / 100) of the highest score are drawn, and have ranks from 1; ties go to the
    smaller doc_id, null ids last, then to the text's hash; rows that repeat another are drawn one by one. Null and empty texts have no feature
    and weight 0; texts count whole, whatever their length. An empty target leaves weights that favour rare buckets; empty docs
    give an empty result. Columns of other names are not looked at.
    """
    spilled = spill(docs.select("doc_id", "text"), grams, buckets)
    wanted = spill(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), grams, buckets)
    scored = weigh(spilled, gains(merged(spilled), merged(wanted), buckets)).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    drop_table(spilled)
    drop_table(wanted)
    able = F.col("n_words") >= least_words
    take = percent * scored.where(able).count() // 100
    # A row's own number lets ranges end between rows that repeat one another.
    first = ranked(scored.where(able), [F.desc("score"), F.col("doc_id").asc_nulls_last(), "text_hash", "row"])
    first = first.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    columns = ["doc_id", "text_hash", "n_features", "weight", "score", "rank"]
    return first.select(columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")).select(columns))


def importance_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; all cases as importance() says."""
    return importance(docs, target).drop("text_hash")


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that importance() draws, with all their columns, whatever their names.

    Of rows that repeat id and text, of which the draw may take some, those that come first in the order of their other columns' hash are taken.
    """
    own_id, own_hash, taken, rows, nth = fresh(docs.columns, "_id", "_hash", "_taken", "_rows", "_nth")
    each = importance(docs, target, **how).groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.count("rank").alias(taken), F.count("*").alias(rows))
    each = cut(each.where(F.col(taken) > 0))
    place = F.xxhash64(docs.doc_id.cast("bigint"), F.xxhash64(docs.text))
    same = docs.doc_id.cast("bigint").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs.text) == F.col(own_hash))
    joined = marked(docs, place, marks(each, F.xxhash64(own_id, own_hash))).join(each, same)
    whole = joined.where(F.col(taken) == F.col(rows))
    # The draw ends within one such group of rows at most.
    order = W.partitionBy(own_id, own_hash).orderBy(F.xxhash64(*(docs[c] for c in docs.columns)))
    part = joined.where(F.col(taken) < F.col(rows)).withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= F.col(taken)).drop(nth)
    return whole.unionByName(part).select(*docs.columns)

