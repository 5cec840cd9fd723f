"""Upserts by key on files: every commit is a folder of changed rows and one line in a log that no two writers can both write.

A reader takes for each key the row that comes last. A batch of a stream is committed once, however often it is repeated; a writer that
has read version n and finds that others have changed the same keys since is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch


class Conflict(Exception):
    """Others have changed the same keys since the version that the writer has read."""


class VersionedTable:
    """A table below `path` with unique keys. order: columns by which the last row of a key is told before versions are; none: the last commit wins.

    Changes hold all columns and `gone`, true for a key that is removed. Null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str] = ()):
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), list(order)

    def log(self) -> list[dict]:
        """The commits, oldest first. A file that its writer has not finished is not there yet."""
        out = []
        for name in scratch.names(self.spark, f"{self.path}/log"):
            if name.endswith(".json"):
                text = scratch.read_text(self.spark, f"{self.path}/log/{name}")
                if not text:
                    break
                out.append(json.loads(text))
        return out

    def version(self) -> int:
        log = self.log()
        return log[-1]["version"] if log else 0

    def _changes(self, log: list[dict]) -> DataFrame | None:
        """Rows of the commits with their version, in one scan."""
        if not log:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{c['folder']}" for c in log))
        known = F.broadcast(self.spark.createDataFrame([(c["folder"], c["version"]) for c in log], "_folder string, _version bigint"))  # a row for each commit since the last compaction
        return rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"(rows-[0-9a-f]{32})/[^/]*$", 1)).join(known, "_folder").drop("_folder")

    def commit(self, changes: DataFrame, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Writes changes (all columns, gone) and returns the version that holds them.

        base: the version that changes were made from; Conflict where a key of theirs has been changed since, else they go on top of what
        has come. batch: (writer, number); one that has been committed changes nothing and returns its version. ValueError where keys repeat.
        """
        log = self.log()
        if batch and (done := [c["version"] for c in log if c.get("batch") == list(batch)]):
            return done[0]
        folder = f"rows-{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        if not written.groupBy(*self.keys).count().where("count > 1").isEmpty():
            scratch.remove(self.spark, f"{self.path}/{folder}")
            raise ValueError("a key is changed twice")
        checked = base
        while True:
            head = log[-1]["version"] if log else 0
            if checked is not None and head > checked:
                since = self._changes([c for c in log if c["version"] > checked and not c.get("whole")])
                same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
                if since is not None and not written.alias("a").join(since.alias("b"), same, "left_semi").isEmpty():
                    scratch.remove(self.spark, f"{self.path}/{folder}")
                    raise Conflict(f"keys changed between versions {base} and {head}")
                checked = head
            entry = {"version": head + 1, "folder": folder, "batch": list(batch) if batch else None, "base": base}
            if scratch.create_once(self.spark, f"{self.path}/log/{head + 1:020d}.json", json.dumps(entry)):
                return head + 1
            log = self.log()
            if batch and (done := [c["version"] for c in log if c.get("batch") == list(batch)]):
                scratch.remove(self.spark, f"{self.path}/{folder}")
                return done[0]

    def snapshot(self, version: int | None = None) -> DataFrame | None:
        """The table as it stands at a version, or now; None before the first commit."""
        log = [c for c in self.log() if version is None or c["version"] <= version]
        start = max((k for k, c in enumerate(log) if c.get("whole")), default=0)
        rows = self._changes(log[start:])
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in (*self.keys, "_version")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order, "_version")).alias("_last"))
        return last.select(*self.keys, "_last.*").where("not gone").drop("gone")

    def compact(self) -> int:
        """Commits the whole table as it stands, from which later snapshots begin. Rows behind a removed key of a table with an order are kept as gone."""
        log = self.log()
        start = max((k for k, c in enumerate(log) if c.get("whole")), default=0)
        rows = self._changes(log[start:])
        if rows is None:
            return 0
        rest = [c for c in rows.columns if c not in (*self.keys, "_version")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order, "_version")).alias("_last")).select(*self.keys, "_last.*")
        folder = f"rows-{uuid.uuid4().hex}"
        (last if self.order else last.where("not gone")).write.parquet(f"{self.path}/{folder}")
        head = log[-1]["version"]
        if not scratch.create_once(self.spark, f"{self.path}/log/{head + 1:020d}.json", json.dumps({"version": head + 1, "folder": folder, "batch": None, "base": head, "whole": True})):
            scratch.remove(self.spark, f"{self.path}/{folder}")
            raise Conflict("another commit came first")
        return head + 1


def claims(table: VersionedTable, events: DataFrame, batch: tuple[str, int]) -> int:
    """Applies events (family, tag, claimed, us, id) to a table of claims keyed by family and tag: the last event of each by (us, id) counts, whenever it comes.

    Claiming twice, and giving up what is not claimed, change nothing.
    """
    last = events.groupBy("family", "tag").agg(F.max(F.struct("us", "id", "claimed")).alias("e"))
    return table.commit(last.select("family", "tag", "e.us", "e.id", "e.claimed", F.lit(False).alias("gone")), batch=batch)


def update_index(table: VersionedTable, path: str, source: str, split: str, detail: dict, updated_at: str, tries: int = 10) -> dict:
    """Puts one split's detail into the index of manifests, whose rows are the table's and whose JSON file is `path`; other splits' entries stay.

    Writers of different splits do not hinder each other; one of the same split that came between is replaced, as the last import counts.
    """
    spark = table.spark
    row = spark.createDataFrame([(split, json.dumps(detail, ensure_ascii=False, sort_keys=True), source, updated_at, False)], "split string, detail string, source string, updated_at string, gone boolean")
    for _ in range(tries):
        try:
            table.commit(row, base=table.version())
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"{split} was changed {tries} times meanwhile")
    rows = sorted(table.snapshot().collect(), key=lambda r: r.split)  # a row for each split
    newest = max(rows, key=lambda r: (r.updated_at, r.split == split))
    index = {"source": newest.source, "splits": [r.split for r in rows], "updated_at": newest.updated_at, "splits_detail": {r.split: json.loads(r.detail) for r in rows}}
    scratch.write_text(spark, path, json.dumps(index, indent=2, ensure_ascii=False))
    return index
