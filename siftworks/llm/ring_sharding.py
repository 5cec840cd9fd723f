"""Consistent-hash ring with virtual nodes and bounded loads.

Shards stand on a ring at many virtual nodes; a document belongs to the next node clockwise of its
hash. No shard takes more than (1 + slack) times the mean load in bytes: what overflows a full shard goes on
clockwise. Loads are summed by arc, a fixed number of rows that bounds what the driver plans over; the
plan cuts each arc's documents, in ring order, into runs that stay or move on, and every document finds
its run by the bytes before it in its arc. No task holds more than some arcs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
VIRTUAL = 256
SLACK = 0.0002
OVERHEAD = 16
SEED = 6


def ring(spark, shards: int, virtual: int):
    """[(position, shard)] in ring order, positions being unsigned hashes of (shard, virtual node)."""
    nodes = spark.range(shards * virtual).select((F.col("id") / virtual).cast("int").alias("shard"), (F.col("id") % virtual).alias("v"))
    hashed = nodes.select(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "shard", "v"), 1).alias("at"), "shard")
    return sorted((r.at, r.shard) for r in hashed.collect())


def fill(loads: list[int], owner: list[int], shards: int, capacity: float):
    """Runs (arc, first byte, shard) in the order that documents are taken; a run ends where the arc's next begins.

    Going clockwise, a node first takes its own arc, in ring order, then what earlier nodes carried on, the
    longest carried first. A full shard hands all on. One round more is made for what passes the start.
    """
    room = [capacity] * shards
    runs: list[tuple[int, int, int]] = []
    carried: list[tuple[int, int, int]] = []
    for turn in range(2):
        for node, shard in enumerate(owner):
            queue = ([(node, 0, loads[node])] if turn == 0 and loads[node] else []) + carried
            carried = []
            for arc, begin, end in queue:
                take = min(end - begin, int(room[shard]))
                if take > 0:
                    runs.append((arc, begin, shard))
                    room[shard] -= take
                if begin + take < end:
                    carried.append((arc, begin + take, end))
        if not carried:
            break
    # Whole bytes: capacities may leave a last few bytes of a table without room.
    runs += [(arc, begin, owner[arc]) for arc, begin, _ in carried]
    return sorted(runs)


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text).

    The law is `bytes`: sizes by shard differ by little, as no shard holds over (1 + slack) times the mean
    plus one document. Null texts have size 16 and the checksum of no bytes; texts of any length count whole. Rows that repeat an id fall to
    the same arc, those without one to that of their text; their order among each other, ties included, is that of checksum and size. Slots
    number each shard's rows from 0 without gaps. grown_shard is null, as no law about growth is promised here. An empty table gives
    an empty result. Columns of other names are not looked at.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))
    # Rows without an id stand where their text does, not all in one place.
    place = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(SEED), "text_crc32", "size")).otherwise(F.xxhash64(F.lit(SEED), "doc_id"))
    rows = rows.withColumn("at", F.shiftrightunsigned(place, 1))
    nodes = ring(spark, shards, virtual)
    places, owner = [x[0] for x in nodes], [x[1] for x in nodes]

    def arcs(batches):
        ends = np.array(places)
        for b in batches:
            arc = np.searchsorted(ends, b.column("at").to_numpy()) % len(ends)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arc.astype(np.int32))], [*b.schema.names, "arc"])

    rows = cut(rows.mapInArrow(arcs, "doc_id bigint, size bigint, text_crc32 bigint, at bigint, arc int"))  # numbers only

    sums = {r.arc: r.load for r in rows.groupBy("arc").agg(F.sum("size").alias("load")).collect()}  # one row a virtual node
    loads = [sums.get(i, 0) for i in range(len(places))]
    runs = fill(loads, owner, shards, (1 + slack) * sum(loads) / shards + 1)
    by_arc: dict[int, list] = {}
    for arc, begin, shard in runs:
        by_arc.setdefault(arc, []).append((begin, shard))
    cuts = spark.createDataFrame([(a, [b for b, _ in r], [s for _, s in r]) for a, r in by_arc.items()], "arc int, begins array<bigint>, shards array<int>")

    order = W.partitionBy("arc").orderBy("at", "doc_id", "text_crc32", "size")
    placed = rows.withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).withColumn("nth", F.row_number().over(order))
    placed = placed.join(F.broadcast(cuts), "arc")  # at most two rounds of runs for each virtual node
    run = F.size(F.filter("begins", lambda b: b <= F.col("before")))
    placed = cut(placed.withColumn("run", run).withColumn("shard", F.element_at("shards", F.col("run"))).drop("begins", "shards", "at"))

    counts = placed.groupBy("arc", "run", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("arc", "run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("arc", "run", (ahead - F.col("first")).alias("base"))
    out = placed.join(F.broadcast(bases), ["arc", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
