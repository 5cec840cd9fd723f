"""Work over a table shard by shard, with a log of what is done: a run that is killed goes on with the shards that are missing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch


def name_of(shard: int) -> str:
    return f"shard-{shard:03d}"


def finished(spark: SparkSession, path: str) -> dict[int, dict]:
    """The manifest of each shard that is done. One whose manifest is not whole JSON is not done."""
    out = {}
    for name in scratch.names(spark, path):
        if name.startswith("shard-") and scratch.exists(spark, f"{path}/{name}/manifest.json"):
            try:
                out[int(name[6:])] = json.loads(scratch.read_text(spark, f"{path}/{name}/manifest.json"))
            except ValueError:
                continue
    return out


def run(rows: DataFrame, key: str, shards: int, work: Callable[[DataFrame], DataFrame], totals: dict[str, Column], path: str, resume: bool = True) -> dict:
    """Writes work(rows of a shard) below path, shard by shard, each with a manifest of its totals, and returns what was done and what was skipped.

    A key's rows are in one shard, pmod(xxhash64(key), shards); null keys are one key. A shard's rows are a table of any size, made by a
    Spark job; its manifest is written last, so what a killed run left half-done is done again. totals: aggregates over work's rows.
    Without resume everything is done anew. ValueError where what is there was made with another number of shards.
    """
    spark = rows.sparkSession
    if not resume and scratch.exists(spark, path):
        scratch.remove(spark, path)
    done = finished(spark, path)
    if any(m["shards"] != shards for m in done.values()):
        raise ValueError("other shards are there")
    ran = []
    for shard in range(shards):
        if shard in done:
            continue
        at = f"{path}/{name_of(shard)}"
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(shards)) == shard)
        work(part).write.mode("overwrite").parquet(f"{at}/rows")
        sums = spark.read.parquet(f"{at}/rows").agg(F.count("*").alias("rows"), *(c.alias(n) for n, c in totals.items())).first().asDict()
        scratch.write_text(spark, f"{at}/manifest.json", json.dumps({"shard": shard, "shards": shards, "totals": sums}, sort_keys=True))
        ran.append(shard)
    return {"ran": ran, "skipped": sorted(done)}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all shards with their shard, in one scan. ValueError where a shard is missing or does not hold what its manifest says."""
    done = finished(spark, path)
    if not done or sorted(done) != list(range(next(iter(done.values()))["shards"])):
        raise ValueError(f"shards are missing: {sorted(done)}")
    rows = spark.read.parquet(*(f"{path}/{name_of(k)}/rows" for k in sorted(done)))
    rows = rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"shard-(\d+)/rows/[^/]*$", 1).cast("int"))
    counts = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    for k, m in done.items():
        if counts.get(k, 0) != m["totals"]["rows"]:
            raise ValueError(f"{name_of(k)} holds {counts.get(k, 0)} rows, its manifest says {m['totals']['rows']}")
    return rows


def consolidate(spark: SparkSession, path: str, names: list[str]) -> dict:
    """Sums of the shards' totals, from their manifests alone."""
    done = finished(spark, path)
    return {n: sum(m["totals"][n] or 0 for m in done.values()) for n in ("rows", *names)}
