"""Versioned tables under replays, two writers and lost ones; shards of a killed run."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from siftworks.sources import scratch, shards, versions

SCHEMA = "k string, v int, gone boolean"


def rows_of(table, version=None):
    snap = table.snapshot(version)
    return {} if snap is None else {r.k: r.v for r in snap.collect()}


def change(spark, *rows):
    return spark.createDataFrame([(*r, False)[:3] if len(r) == 2 else r for r in rows], SCHEMA)


def test_versions_removals_and_compaction(spark, tmp_path):
    t = versions.VersionedTable(spark, f"{tmp_path}/t", ["k"])
    assert t.version() == 0 and t.snapshot() is None and t.compact() == 0
    assert t.commit(change(spark, ("a", 1), ("b", 1), (None, 7))) == 1
    assert t.commit(change(spark, ("a", 2), ("b", 1, True))) == 2
    assert rows_of(t) == {"a": 2, None: 7} and rows_of(t, 1) == {"a": 1, "b": 1, None: 7}
    assert t.compact() == 3 and rows_of(t) == {"a": 2, None: 7} and rows_of(t, 1) == {"a": 1, "b": 1, None: 7}
    t.commit(change(spark, ("b", 5)))
    assert rows_of(t) == {"a": 2, "b": 5, None: 7}
    with pytest.raises(ValueError, match="twice"):
        t.commit(change(spark, ("a", 1), ("a", 2)))
    assert t.version() == 4


def test_writer_whose_keys_changed_is_refused(spark, tmp_path):
    one = versions.VersionedTable(spark, f"{tmp_path}/t", ["k"])
    two = versions.VersionedTable(spark, f"{tmp_path}/t", ["k"])
    one.commit(change(spark, ("a", 1), ("b", 1)))
    base = two.version()
    one.commit(change(spark, ("a", 2)), base=base)
    with pytest.raises(versions.Conflict):
        two.commit(change(spark, ("a", 3)), base=base)
    assert two.commit(change(spark, ("b", 3)), base=base) == 3  # other keys go on top
    one.compact()
    assert two.commit(change(spark, ("c", 1)), base=3) == 5
    assert rows_of(one) == {"a": 2, "b": 3, "c": 1}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    t = versions.VersionedTable(spark, f"{tmp_path}/t", ["k"])
    assert t.commit(change(spark, ("a", 1)), batch=("w", 0)) == 1
    t.commit(change(spark, ("a", 2)), batch=("w", 1))
    assert t.commit(change(spark, ("a", 1)), batch=("w", 0)) == 1
    assert t.commit(change(spark, ("z", 9)), batch=("other", 0)) == 3
    assert rows_of(t) == {"a": 2, "z": 9}


def test_rows_of_a_lost_writer_do_not_count(spark, tmp_path):
    t = versions.VersionedTable(spark, f"{tmp_path}/t", ["k"])
    t.commit(change(spark, ("a", 1)))
    change(spark, ("a", 99)).write.parquet(f"{tmp_path}/t/rows-{'0' * 32}")  # written, but not committed
    assert rows_of(t) == {"a": 1}


def test_claims_in_any_order(spark, tmp_path):
    """A late event does not undo a newer one; giving up what nobody claimed does nothing."""
    t = versions.VersionedTable(spark, f"{tmp_path}/t", ["family", "tag"], ["us", "id"])
    events = lambda *rows: spark.createDataFrame(rows, "family string, tag string, claimed boolean, us bigint, id bigint")
    versions.claims(t, events(("f", "p2", True, 5, 1), ("f", "p2", True, 4, 9), ("g", "p2", False, 1, 1)), ("c", 0))
    versions.claims(t, events(("f", "p2", False, 3, 2), ("g", "p3", True, 2, 2)), ("c", 1))
    versions.claims(t, events(("g", "p3", False, 2, 3)), ("c", 2))
    versions.claims(t, events(("f", "p2", False, 3, 2), ("g", "p3", True, 2, 2)), ("c", 1))
    t.compact()
    assert {(r.family, r.tag): r.claimed for r in t.snapshot().collect()} == {("f", "p2"): True, ("g", "p2"): False, ("g", "p3"): False}


def test_of_many_writers_one_makes_the_file(spark, tmp_path):
    won = []
    writers = [threading.Thread(target=lambda i=i: won.append(i) if scratch.create_once(spark, f"{tmp_path}/log/1.json", f"writer {i}") else None) for i in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and scratch.read_text(spark, f"{tmp_path}/log/1.json") == f"writer {won[0]}"
    assert scratch.names(spark, f"{tmp_path}/log") == ["1.json"]


def test_two_writers_of_an_index(spark, tmp_path):
    make = lambda: versions.VersionedTable(spark, f"{tmp_path}/v", ["split"])
    path = f"{tmp_path}/manifest.index.json"
    versions.update_index(make(), path, "s", "train", {"n": 1}, "2024-01-01")
    versions.update_index(make(), path, "s", "val", {"n": 2, "ü": "é"}, "2024-01-02")
    index = versions.update_index(make(), path, "s", "train", {"n": 3}, "2024-01-03")
    assert index == json.loads(scratch.read_text(spark, path))
    assert index == {"source": "s", "splits": ["train", "val"], "updated_at": "2024-01-03", "splits_detail": {"train": {"n": 3}, "val": {"n": 2, "ü": "é"}}}


def test_killed_run_goes_on_with_missing_shards(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 17}" if i % 17 else None, i) for i in range(200)], "key string, v int")
    calls, path = [], f"{tmp_path}/s"

    def work(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part.groupBy("key").agg(F.sum("v").alias("v"))

    total = {"v": F.sum("v")}
    with pytest.raises(RuntimeError):
        shards.run(rows, "key", 5, work, total, path)
    with pytest.raises(ValueError, match="missing"):
        shards.scan(spark, path)
    scratch.write_text(spark, f"{path}/shard-000/manifest.json", '{"shard": 0, "sha')  # half a manifest
    assert shards.run(rows, "key", 5, work, total, path) == {"ran": [0, 2, 3, 4], "skipped": [1]}
    assert shards.run(rows, "key", 5, work, total, path) == {"ran": [], "skipped": [0, 1, 2, 3, 4]}
    got = {r.key: r.v for r in shards.scan(spark, path).collect()}
    assert got == {r.key: r.v for r in rows.groupBy("key").agg(F.sum("v").alias("v")).collect()}
    assert shards.consolidate(spark, path, ["v"]) == {"rows": 17, "v": sum(range(200))}
    with pytest.raises(ValueError, match="other shards"):
        shards.run(rows, "key", 4, work, total, path)
    manifest = json.loads(scratch.read_text(spark, f"{path}/shard-001/manifest.json"))
    manifest["totals"]["rows"] += 1
    scratch.write_text(spark, f"{path}/shard-001/manifest.json", json.dumps(manifest))
    with pytest.raises(ValueError, match="shard-001"):
        shards.scan(spark, path)
    assert shards.run(rows, "key", 4, work, total, path, resume=False)["ran"] == [0, 1, 2, 3]
