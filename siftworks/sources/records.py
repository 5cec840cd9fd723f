"""JSON-lines readers and writers with the validation rules of training records."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SAMPLE = (
    "sample_id STRING, family_id STRING, difficulty INT, task_type STRING, language STRING, skill_tags ARRAY<STRING>, instruction STRING, broken_code STRING, "
    "execution_feedback STRING, target_code STRING, public_tests STRING, hidden_tests STRING, verified BOOLEAN, "
    "verification STRUCT<syntax_ok:BOOLEAN,pytest_ok:BOOLEAN,ruff_ok:BOOLEAN,timeout:BOOLEAN>, generator STRING, created_at STRING, dataset_version STRING, "
    "variant_type STRING, bug_type STRING, source_split STRING"
)
TRAJECTORY = "trajectory_id STRING, task_id STRING, steps ARRAY<STRUCT<step_index:INT,goal:STRING,action_type:STRING,arguments:STRING,result_kind:STRING,memory_before:STRING,memory_after:STRING>>, success_label BOOLEAN, verified BOOLEAN"


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def violation() -> Column:
    """The first rule that a sample breaks, or null."""
    repair = F.col("task_type").isin("static_repair", "execution_repair")
    rules = [
        (~F.col("difficulty").between(0, 4) | F.col("difficulty").isNull(), "difficulty"),
        (~F.col("task_type").eqNullSafe("code_generation") & ~F.coalesce(repair, F.lit(False)), "task_type"),
        (~F.col("language").eqNullSafe("python"), "language"),
        (_blank("instruction"), "instruction"),
        (_blank("target_code"), "target_code"),
        (_blank("public_tests"), "public_tests"),
        (repair & _blank("broken_code"), "broken_code"),
        ((F.col("task_type") == "execution_repair") & _blank("execution_feedback"), "execution_feedback"),
    ]
    return F.coalesce(*(F.when(bad, F.lit(name)) for bad, name in rules))


def read_strict(spark: SparkSession, paths: str | list[str], schema: str = SAMPLE) -> DataFrame:
    """Records of one or more files; the first malformed row or broken rule fails the job."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    if schema != SAMPLE:
        return df
    guard = F.when(violation().isNotNull(), F.raise_error(F.concat(F.lit("sample breaks rule "), violation())).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard)


def read_counting(spark: SparkSession, paths: str | list[str], schema: str = SAMPLE) -> DataFrame:
    """Records with error: the raw line that did not parse, the rule that was broken, or null."""
    df = spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    broken = violation() if schema == SAMPLE else F.lit(None)
    return df.withColumn("error", F.coalesce(F.when(F.col("_corrupt").isNotNull(), F.lit("malformed")), broken)).drop("_corrupt")


def read_skipping(spark: SparkSession, paths: str | list[str], schema: str = SAMPLE) -> DataFrame:
    """Records without the malformed rows."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_samples_only(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Samples of files that may not hold chat records: one that does fails the job."""
    df = spark.read.schema(f"{SAMPLE}, messages ARRAY<STRUCT<role:STRING,content:STRING>>").json(paths)
    guard = F.when(F.col("messages").isNotNull(), F.raise_error(F.lit("chat record where samples are expected")).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard).drop("messages")


def read_either(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample_id, messages) of files that hold samples or chat records."""
    df = spark.read.schema(f"{SAMPLE}, messages ARRAY<STRUCT<role:STRING,content:STRING>>").json(paths)
    return df.select("sample_id", F.coalesce("messages", chat_messages()).alias("messages"))


def read_shards(spark: SparkSession, folder: str, schema: str = SAMPLE) -> DataFrame:
    """All shards' verified records with their shard's name."""
    return spark.read.schema(schema).json(f"{folder}/*/verified.jsonl").withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(family_id, usage, sample_ids) of a JSON object of objects."""
    text = spark.read.text(path, wholetext=True)
    entry = "struct<source_task_id:string,source_split:string,usage:array<string>,sample_ids:array<string>>"
    families = F.from_json("value", f"struct<families:map<string,{entry}>>")["families"]
    return text.select(F.explode(families).alias("family_id", "e")).select("family_id", "e.source_split", "e.usage", "e.sample_ids")


def count_lines(spark: SparkSession, paths: str | list[str]) -> int:
    return spark.read.text(paths).where(F.trim("value") != "").count()


def chat_messages() -> Column:
    """System, user and assistant messages of a sample; absent parts are left out of the user's text."""
    block = lambda c: F.when(~_blank(c), F.concat(F.lit("```python\n"), F.col(c), F.lit("\n```")))
    user = F.concat_ws("\n\n", F.col("instruction"), block("broken_code"), F.when(~_blank("execution_feedback"), F.col("execution_feedback")))
    part = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(part("system", F.lit("You are a careful Python programmer.")), part("user", user), part("assistant", F.concat(F.lit("```python\n"), F.col("target_code"), F.lit("\n```"))))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One JSON object a line, nulls kept; sorted over all part files if order is given. mode: append for logs."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_split(df: DataFrame, path: str, column: str = "split") -> dict:
    """Writes one folder for each split and returns the manifest: counts and order-independent hashes."""
    df.write.mode("errorifexists").partitionBy(column).option("ignoreNullFields", "false").json(path)
    digest = F.sum(F.xxhash64(*[c for c in df.columns if c != column]).cast("decimal(38,0)"))
    return {r[column]: {"rows": r.n, "checksum": str(r.digest)} for r in df.groupBy(column).agg(F.count("*").alias("n"), digest.alias("digest")).collect()}


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with rejection_reason) by a reason that is null for accepted rows."""
    x = df.withColumn("rejection_reason", reason)
    return x.where("rejection_reason is null").drop("rejection_reason"), x.where("rejection_reason is not null")


def artifact_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size, lines) of every file under a folder, each hashed on an executor as it stands there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(sha256=[hashlib.sha256(c).hexdigest() for c in pdf.content], lines=[c.count(b"\n") for c in pdf.content]).rename(columns={"length": "size"})[["path", "sha256", "size", "lines"]]

    return files.mapInPandas(run, "path string, sha256 string, size bigint, lines bigint")


def lock_hash(spark: SparkSession, paths: list[str]) -> tuple[str, dict[str, str]]:
    """(SHA-256 of the files' bytes one after another in the order given, SHA-256 of each), CRLF read as LF. For small files that are frozen."""
    whole, each = hashlib.sha256(), {}
    for path in paths:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").orderBy("path").toLocalIterator()
        data = b"".join(bytes(r.content) for r in rows).replace(b"\r\n", b"\n")
        whole.update(data)
        each[path] = hashlib.sha256(data).hexdigest()
    return whole.hexdigest(), each


def lock_errors(spark: SparkSession, lock: dict, paths: dict[str, str]) -> list[str]:
    """What differs between a lock, {name_sha256: ..., sha_lock: ...}, and the files by name, whose order is the lock's."""
    missing = [f"{name}: file missing" for name, path in paths.items() if not scratch.exists(spark, path)]
    if missing:
        return missing
    whole, each = lock_hash(spark, list(paths.values()))
    found = {f"{name}_sha256": each[path] for name, path in paths.items()} | {"sha_lock": whole}
    return [f"{k}: lock={lock.get(k)} actual={v}" for k, v in found.items() if lock.get(k) != v]


def missing_fields(report: dict, fields: list[str]) -> list[str]:
    """Dotted fields that a report lacks or that are null in it."""
    out = []
    for name in fields:
        at = report
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            out.append(name)
    return out


def backup_once(spark: SparkSession, path: str, mark: str = ".bak") -> bool:
    """Copies what is at path to path + mark if there is no such copy yet; True if it did."""
    if not scratch.exists(spark, path) or scratch.exists(spark, path + mark):
        return False
    scratch.copy(spark, path, path + mark)
    return True


def write_once(df: DataFrame, path: str, frozen: tuple[str, ...] = ()) -> None:
    """Writes JSON lines where nothing is yet, and never below a frozen folder."""
    inside = [f for f in frozen if path.rstrip("/") == f.rstrip("/") or path.startswith(f.rstrip("/") + "/")]
    if inside:
        raise ValueError(f"frozen: {inside[0]}")
    if scratch.exists(df.sparkSession, path):
        raise FileExistsError(path)
    write_jsonl(df, path)


def markdown(title: str, sections: dict[str, list[dict]]) -> str:
    """A report: a heading, then for each section a heading and a table of its rows; nulls show as '-'."""
    lines = [f"# {title}"]
    for name, rows in sections.items():
        lines += ["", f"## {name}", ""]
        columns = list(dict.fromkeys(c for r in rows for c in r))
        if columns:
            lines += ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
        lines += ["| " + " | ".join("-" if r.get(c) is None else str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in rows] or ["(none)"]
    return "\n".join(lines) + "\n"


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True, ensure_ascii=False)


FAMILY_KEYS = ("families", "validation_family_ids", "frozen_family_ids", "train_family_ids")


def read_family_ids(spark: SparkSession, path: str) -> DataFrame:
    """(source_key, family_id) of JSON objects, one a line, that hold families under any of FAMILY_KEYS, as strings or as objects with family_id or id.

    The schema is told row by row: lines are variants, so that one file may hold all shapes. Keys that are absent, null or no list, and items of other
    types, give nothing; so do lines that are no JSON.
    """
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    lists = F.array(*(F.struct(F.lit(k).alias("source_key"), F.try_variant_get("v", f"$.{k}", "array<variant>").alias("items")) for k in FAMILY_KEYS))
    items = lines.select(F.explode(lists).alias("l")).select("l.source_key", F.explode("l.items").alias("item"))
    text = lambda v, at: F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.try_variant_get(v, at, "string"))
    named = F.coalesce(F.nullif(text("item", "$.family_id"), F.lit("")), text("item", "$.id"))
    kind = F.schema_of_variant("item")
    out = items.select("source_key", F.when(kind == "STRING", F.try_variant_get("item", "$", "string")).when(kind.startswith("OBJECT"), named).alias("family_id"))
    return out.where("family_id is not null").distinct()


IGNORED_FOLDERS = ("__pycache__", ".git", ".pytest_cache", "node_modules")
IGNORED_FILES = ("*.pyc", "*.crc", "_SUCCESS", "artifact-manifest.json")


def artifact_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, folder, sha256, size, row_count) of the files below path whose name matches a glob, without IGNORED_FOLDERS and IGNORED_FILES.

    row_count: lines that are not blank of files named .jsonl or .jsonl.gz, or that stand in a folder named so; null for others. Files go to tasks one by one and are hashed
    there (2 GB each at most); lines are counted in splits of any size, and no list of files is gathered. Empty files, which Spark's readers pass over, are not listed.
    """
    like = lambda glob: "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    # The whole path as readers report it, whatever way it was named.
    at, fs = scratch._path(spark, path)
    root = fs.resolvePath(at).toString().rstrip("/") + "/"
    inside = lambda p: F.substring(F.regexp_replace(p, r"^file:/+", "file:/"), len(re.sub(r"^file:/+", "file:/", root)) + 1, 1 << 30)

    def kept(x: DataFrame) -> DataFrame:
        name = F.element_at(F.split("file", "/"), -1)
        x = x.withColumn("folder", F.regexp_extract("file", "^(.*)/[^/]*$", 1))
        bad = F.exists(F.split("file", "/"), lambda part: part.isin(*IGNORED_FOLDERS))
        for glob in IGNORED_FILES:
            bad |= name.rlike(like(glob))
        return x.where(~bad & name.rlike(like(pattern)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = kept(files.select(inside(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")))
    lined = F.col("file").rlike(r"\.jsonl(\.gz)?(/|$)")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(inside(F.col("_metadata.file_path")).alias("file"), "value")
    counts = lines.where(lined & (F.trim("value") != "")).groupBy("file").agg(F.count("*").alias("n"))
    return files.join(counts, "file", "left").select("file", "folder", "sha256", "size", F.when(lined, F.coalesce("n", F.lit(0))).alias("row_count"))
