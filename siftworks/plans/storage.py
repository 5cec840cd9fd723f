"""Queries that write JSON lines from the tables and scan them again: readers, sinks, locks and guards on real files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records, scratch
from .catalogue import register, table


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid sample for each document, with its number."""
    d = table(spark, sf_dir, "documents")
    text = F.concat_ws(" ", F.lit("write"), F.coalesce("source", F.lit("none")))
    return d.select(
        "doc_id", F.concat(F.lit("m_"), F.col("doc_id").cast("string")).alias("sample_id"), F.col("source").alias("family_id"), (F.col("doc_id") % 5).cast("int").alias("difficulty"), F.lit("code_generation").alias("task_type"),
        F.lit("python").alias("language"), text.alias("instruction"), F.col("text").alias("target_code"), F.lit("assert f()").alias("public_tests"), (F.col("doc_id") % 3 == 0).alias("verified"),
    ).withColumn("target_code", F.concat(F.lit("x = 1 # "), F.coalesce("target_code", F.lit(""))))


def _lines(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


def spoilt_lines(spark: SparkSession, sf_dir: str) -> str:
    """A file of JSON lines: of ten documents one is cut off, one has a bad difficulty, one a blank instruction."""
    x, k = samples(spark, sf_dir), F.col("doc_id") % 10
    x = x.withColumn("difficulty", F.when(k == 1, 9).otherwise(F.col("difficulty"))).withColumn("instruction", F.when(k == 2, "  ").otherwise(F.col("instruction")))
    line = F.to_json(F.struct(*[c for c in x.columns if c != "doc_id"]))
    return _lines(x.select(F.when(k == 0, F.left(line, F.lit(20))).otherwise(line).alias("value")), scratch.folder(spark, "lines"))


ERROR = "case doc_id % 10 when 0 then 'malformed' when 1 then 'difficulty' when 2 then 'instruction' else 'ok' end"


@register("jsonl_lenient_scan", "S3 O3", f"select {ERROR} as error, LONG(count(*)) as n from documents group by 1")
def jsonl_lenient_scan(spark, sf_dir):
    return records.read_counting(spark, spoilt_lines(spark, sf_dir)).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@register("jsonl_skipping_scan", "S4", "select source as family_id, LONG(count(*)) as n from documents where doc_id % 10 <> 0 group by source")
def jsonl_skipping_scan(spark, sf_dir):
    return records.read_skipping(spark, spoilt_lines(spark, sf_dir)).groupBy("family_id").agg(F.count("*").alias("n"))


@register("jsonl_strict_scan", "S1 S2", "select cast(doc_id % 5 as int) as difficulty, LONG(count(*)) as n, min(concat('m_', TEXT(doc_id))) as first_id from documents group by 1")
def jsonl_strict_scan(spark, sf_dir):
    """Two files read as one; a row that breaks a rule would fail the job."""
    x, paths = samples(spark, sf_dir), [scratch.folder(spark, "strict") for _ in range(2)]
    for i, path in enumerate(paths):
        records.write_jsonl(x.where(F.col("doc_id") % 2 == i).drop("doc_id"), path)
    return records.read_strict(spark, paths).groupBy("difficulty").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"))


@register("chat_rejecting_scan", "S5 S6", "select 'samples' as kind, LONG(count(*)) as n from documents union all select 'chat', LONG(count(distinct conv_id)) from conversations")
def chat_rejecting_scan(spark, sf_dir):
    """Samples through the reader that fails on chat records, and chat records through the one that takes either."""
    a, b = (scratch.folder(spark, k) for k in ("samples", "chat"))
    records.write_jsonl(samples(spark, sf_dir).drop("doc_id"), a)
    chat = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    records.write_jsonl(chat, b)
    own = records.read_samples_only(spark, a).agg(F.lit("samples").alias("kind"), F.count("*").alias("n"))
    return own.unionByName(records.read_either(spark, b).where(F.size("messages") > 0).agg(F.lit("chat").alias("kind"), F.count("*").alias("n")))


@register("registry_scan", "S8 S9", "select source as family_id, case when min(doc_id) % 2 = 0 then 'train' else 'val' end as source_split, LONG(count(*)) as samples from documents group by source")
def registry_scan(spark, sf_dir):
    """A JSON object of objects, one for each family, in one file."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"), F.collect_list(F.concat(F.lit("m_"), F.col("doc_id").cast("string"))).alias("sample_ids"))
    entry = F.struct(F.when(F.col("first") % 2 == 0, "train").otherwise("val").alias("source_split"), F.array(F.lit("train")).alias("usage"), "sample_ids")
    whole = d.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("source", entry))).alias("families"))).alias("value"))
    path = _lines(whole.coalesce(1), scratch.folder(spark, "registry"))
    return records.read_registry(spark, path).select("family_id", "source_split", F.size("sample_ids").cast("bigint").alias("samples"))


@register("line_count_scan", "S13 S10", "select COUNT_IF(doc_id % 4 <> 0) as lines, LONG(count(distinct source)) as families from documents")
def line_count_scan(spark, sf_dir):
    """Lines that are not blank, counted without a parse, and the distinct keys by a scan of one column."""
    d = samples(spark, sf_dir)
    blank, whole = scratch.folder(spark, "blank"), scratch.folder(spark, "keys")
    _lines(d.select(F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("sample_id")).alias("value")), blank)
    records.write_jsonl(d.drop("doc_id"), whole)
    keys = records.read_skipping(spark, whole, "family_id STRING").agg(F.count_distinct("family_id").alias("families"))
    return keys.select(F.lit(records.count_lines(spark, blank)).cast("bigint").alias("lines"), F.col("families"))


@register("jsonl_round_trip", "K1 K2 K6", "select doc_id, text, n_chars from documents")
def jsonl_round_trip(spark, sf_dir):
    """Whole texts written as sorted JSON lines and read back: characters beyond ASCII, newlines and nulls stay."""
    path = scratch.folder(spark, "texts")
    records.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), path, order=["doc_id"])
    return spark.read.schema("doc_id bigint, text string, n_chars bigint").json(path)


@register("split_sink", "K3 K4 K5 K6 K9", "select case doc_id % 3 when 0 then 'test' when 1 then 'train' else 'val' end as split, LONG(count(*)) as manifest_rows, LONG(count(*)) as rows_read, LONG(2 * COUNT_IF(trim(coalesce(text, '')) = '')) as rejects from documents group by 1")
def split_sink(spark, sf_dir):
    """A folder and a manifest entry for each split; rejected rows with their reason appended to a log, twice."""
    x = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "train").otherwise("val").alias("split"))
    path, log = scratch.folder(spark, "splits"), scratch.folder(spark, "rejects")
    manifest = records.write_split(x, path)
    rejected = records.split_rejects(x, F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank"))[1]
    for _ in range(2):
        records.write_jsonl(rejected, log, mode="append")
    counted = spark.createDataFrame([(k, v["rows"]) for k, v in manifest.items()] or [(None, None)], "split string, manifest_rows bigint").where("split is not null")
    read = spark.read.schema("doc_id bigint, split string").json(path).groupBy("split").agg(F.count("*").alias("rows_read"))
    lost = spark.read.schema("split string, rejection_reason string").json(log).where("rejection_reason = 'blank'").groupBy("split").agg(F.count("*").alias("rejects"))
    return counted.join(read, "split").join(lost, "split", "left").select("split", "manifest_rows", "rows_read", F.coalesce("rejects", F.lit(0)).cast("bigint").alias("rejects"))


@register("overwrite_guards", "K10 K11", "select 'backup' as file, COUNT_IF(doc_id % 2 = 0) as n from documents union all select 'current', COUNT_IF(doc_id % 2 = 1) from documents union all select 'refused', LONG(2)")
def overwrite_guards(spark, sf_dir):
    """A file backed up once before two overwrites, and two writes refused: where one exists, and below a frozen folder."""
    x, path = samples(spark, sf_dir), scratch.folder(spark, "guarded")
    records.write_once(x.where("doc_id % 2 = 0").select("sample_id"), path)
    refused = 0
    for at, frozen in ((path, ()), (f"{path}-frozen/x", (f"{path}-frozen",))):
        try:
            records.write_once(x.select("sample_id"), at, frozen)
        except (FileExistsError, ValueError):
            refused += 1
    for k in (2, 1):
        records.backup_once(spark, path)
        records.write_jsonl(x.where(f"doc_id % 2 = {k % 2}").select("sample_id"), path, mode="overwrite")
    read = lambda p, name: spark.read.schema("sample_id string").json(p).agg(F.lit(name).alias("file"), F.count("*").alias("n"))
    return read(path + ".bak", "backup").unionByName(read(path, "current")).unionByName(spark.createDataFrame([("refused", refused)], "file string, n bigint"))


@register("frozen_lock", "A25 Q1 Q15 Q7", "select 'intact' as state, LONG(0) as errors union all select 'changed', LONG(2) union all select 'missing', LONG(1) union all select 'fields', LONG(2)")
def frozen_lock(spark, sf_dir):
    """A lock over three files checked: as they were, after one changed, with one gone; and a report's fields that are missing."""
    x, paths = samples(spark, sf_dir), {}
    for name, column in (("families", "family_id"), ("test_raw", "sample_id"), ("rejected", "instruction")):
        paths[name] = _lines(x.select(F.col(column).alias("value")).distinct().orderBy("value").coalesce(1), scratch.folder(spark, name))
    whole, each = records.lock_hash(spark, list(paths.values()))
    lock = {f"{n}_sha256": each[p] for n, p in paths.items()} | {"sha_lock": whole}
    states = [("intact", len(records.lock_errors(spark, lock, paths)))]
    spark.createDataFrame([("one more line",)], "value string").coalesce(1).write.mode("append").text(paths["rejected"])
    states.append(("changed", len(records.lock_errors(spark, lock, paths))))
    states.append(("missing", len(records.lock_errors(spark, lock, paths | {"families": paths["families"] + "-none"}))))
    states.append(("fields", len(records.missing_fields({"base": {"pass": 1.0, "lift": None}}, ["base.pass", "base.lift", "other"]))))
    return spark.createDataFrame(states, "state string, errors bigint")


@register("markdown_report", "K8", "select concat('| ', lang, ' | ', TEXT(count(*)), ' |') as line from documents where lang is not null group by lang")
def markdown_report(spark, sf_dir):
    """The table rows of a rendered report of languages."""
    counts = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row a language
    text = records.markdown("Languages", {"counts": [r.asDict() for r in counts]})
    rows = [(line,) for line in text.split("\n") if line.startswith("| ") and not line.startswith(("| lang", "| ---"))]
    return spark.createDataFrame(rows, "line string")


@register("artifact_manifest", "K9 S19 S13", "select lang || '.jsonl' as folder, LONG(count(*)) as rows from (select coalesce(lang, 'none') as lang from documents) d group by lang union all select '', null")
def artifact_manifest(spark, sf_dir):
    """A folder of JSON lines for each language, a note, and files that listings pass over: rows by folder as the manifest of files has them."""
    path = scratch.folder(spark, "artifacts")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id")
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):  # a folder for each language
        docs.where(F.col("lang") == lang).select(F.to_json(F.struct("doc_id")).alias("value")).write.text(f"{path}/{lang}.jsonl")
    for name in ("note.md", "__pycache__/m.jsonl", "x.pyc", "artifact-manifest.json", ".git/a/b.jsonl"):
        scratch.write_text(spark, f"{path}/{name}", "{}\n")
    return records.artifact_manifest(spark, path).groupBy("folder").agg(F.sum("row_count").alias("rows"))
