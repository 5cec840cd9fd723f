"""Queries on versioned tables and resumable shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scratch, shards, versions
from .catalogue import register, table
from .streams import delivered_to


@register(
    "claims_stream",
    "ST7 J11 K7",
    "with l as (select user_id, event_type, arg_max(value < 50, (ts, event_id)) as claimed from events group by user_id, event_type) select user_id, coalesce(string_agg(case when claimed then event_type end, ',' order by event_type), '') as tags, COUNT_IF(claimed) as claims from l group by user_id",
)
def claims_stream(spark, sf_dir):
    """Events under 50 claim their type for a user, others give it up, applied by a stream whose every batch is repeated; the last event of each counts."""
    held = versions.VersionedTable(spark, scratch.folder(spark, "claims"), ["family", "tag"], ["us", "id"])

    def apply(batch, i):
        events = batch.select(F.col("user_id").alias("family"), F.col("event_type").alias("tag"), (F.col("value") < 50).alias("claimed"), F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"))
        for _ in range(2):
            versions.claims(held, events, ("claims", i))

    x = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # In deliveries that do not follow the order of time.
    delivered_to(spark, x, (F.col("event_id") % 3).cast("int"), apply)
    held.compact()
    now = held.snapshot()
    tags = F.array_join(F.sort_array(F.collect_list(F.when(F.col("claimed"), F.col("tag")))), ",")
    return now.groupBy(F.col("family").alias("user_id")).agg(tags.alias("tags"), F.count_if("claimed").alias("claims"))


@register("manifest_index", "K7 J11 K6", "select case doc_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, LONG(count(*)) as rows, LONG(sum(n_chars)) as chars, LONG(3) as splits from documents group by 1")
def manifest_index(spark, sf_dir):
    """The index of manifests after three imports and a second one of train, as its JSON file has it: the last import of a split replaces it alone."""
    at = scratch.folder(spark, "manifest")
    held = versions.VersionedTable(spark, f"{at}/versions", ["split"])
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test")
    counts = {r.split: {"rows": r.rows, "chars": r.chars} for r in table(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).collect()}
    imports = [("train", {"rows": 0, "chars": 0})] + [(s, counts[s]) for s in ("val", "test", "train") if s in counts]
    for k, (name, detail) in enumerate(imports):
        versions.update_index(held, f"{at}/manifest.index.json", "documents", name, detail, f"2024-01-0{k + 1}T00:00:00Z")
    index = spark.read.option("multiLine", "true").schema("splits array<string>, splits_detail map<string, struct<rows: bigint, chars: bigint>>").json(f"{at}/manifest.index.json")
    return index.select(F.explode("splits_detail").alias("split", "d"), F.size("splits").cast("bigint").alias("splits")).select("split", "d.rows", "d.chars", "splits")


@register(
    "shard_resume",
    "S7 ST6 K5",
    "with w as (select source, LONG(count(*)) as docs, LONG(sum(n_chars)) as chars from documents group by source) select source, docs, chars, (select LONG(sum(docs)) from w) as all_docs from w",
)
def shard_resume(spark, sf_dir):
    """Sums by source, made in eight shards by a run that is lost after three and one that does the others."""
    at, tries = scratch.folder(spark, "shards"), []

    def work(part):
        tries.append(1)
        if len(tries) == 4:
            raise RuntimeError("lost")
        return part.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))

    docs, totals = table(spark, sf_dir, "documents"), {"docs": F.sum("docs")}
    try:
        shards.run(docs, "source", 8, work, totals, at)
    except RuntimeError:
        shards.run(docs, "source", 8, work, totals, at)
    all_docs = shards.consolidate(spark, at, ["docs"])["docs"]
    return shards.scan(spark, at).select("source", "docs", "chars", F.lit(all_docs).cast("bigint").alias("all_docs"))
