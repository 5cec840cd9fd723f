"""Library functions: golden values, readers and writers, rewrites, parsers, splits and streams."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftworks.functions import protocols, python_code, statistics
from siftworks.operators import dedup, sampling, state
from siftworks.sources import records
from siftworks.streaming import monitor

GOOD = {"sample_id": "m_1", "family_id": "f1", "difficulty": 1, "task_type": "code_generation", "language": "python", "instruction": "add", "target_code": "x = 1", "public_tests": "assert x"}


def test_golden_statistics():
    assert [round(statistics.mcnemar_exact(*p), 4) for p in ((0, 0), (40, 86), (49, 35), (33, 72), (49, 26), (64, 96), (4, 4))] == [1.0, 0.0001, 0.1557, 0.0002, 0.0106, 0.014, 1.0]
    assert [round(statistics.wilson_lower(*p), 4) for p in ((75, 75), (24, 25), (44, 50), (0, 9))] == [0.9652, 0.8391, 0.7843, 0]
    assert statistics.safe_rate(1, 0) == 0.0
    low, high = statistics.bootstrap_interval([0] * 50 + [1] * 50, [1] * 60 + [0] * 40, draws=500)
    assert low < 0.1 < high


def test_golden_quotas():
    total, chosen = sampling.feasible_total({"code": 612, "boundary": 754, "static": 589, "execution": 589}, {"code": 0.3, "boundary": 0.2, "static": 0.2, "execution": 0.3}, 0.03)
    assert total == 2181 and sum(chosen.values()) == 2181 and chosen["execution"] == 589
    assert sampling.allocate({"a": 5, "b": 3, "c": 3}, 10) == {"a": 5, "b": 3, "c": 2}


def test_readers_and_writers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([json.dumps(GOOD), "", "{broken", json.dumps(GOOD | {"sample_id": "m_2", "language": "go"})]))
    assert [r.error for r in records.read_counting(spark, str(path)).collect()] == [None, "malformed", "language"]
    assert records.read_skipping(spark, str(path)).count() == 2 and records.count_lines(spark, str(path)) == 3
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.read_strict(spark, str(path)).count()
    good = tmp_path / "b.jsonl"
    good.write_text(json.dumps(GOOD) + "\n" + json.dumps({"messages": [{"role": "user", "content": "hi"}]}))
    assert [len(r.messages) for r in records.read_either(spark, str(good)).collect()] == [3, 1]
    df = records.read_skipping(spark, str(path))
    kept, rejected = records.split_rejects(df, records.violation())
    assert kept.count() == 1 and [r.rejection_reason for r in rejected.collect()] == ["language"]
    manifest = records.write_split(df.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert manifest["train"]["rows"] == 2
    with pytest.raises(PySparkException):
        records.write_jsonl(df, str(tmp_path / "out"))
    registry = tmp_path / "r.json"
    registry.write_text(json.dumps({"families": {"f1": {"usage": ["a"], "sample_ids": []}, "f2": {"usage": [], "sample_ids": ["x"]}}}))
    assert records.read_registry(spark, str(registry)).count() == 2
    shard = tmp_path / "shards" / "shard-000"
    shard.mkdir(parents=True)
    (shard / "verified.jsonl").write_text(json.dumps(GOOD))
    assert [r.shard for r in records.read_shards(spark, str(tmp_path / "shards")).collect()] == ["shard-000"]
    assert records.artifact_manifest(spark, str(tmp_path / "shards")).count() == 1


def test_rewrites():
    code = "def f(xs):\n    t = 0\n    for i in range(len(xs)):\n        if xs[i] > 2:\n            t = t + xs[i]\n    return sorted(xs)[0] + t\n"
    bugs = dict(python_code.variants(code, python_code.BUGS))
    assert "xs[i] >= 2" in bugs["condition_error"] and "range(len(xs) - 1)" in bugs["off_by_one"] and "return None" in bugs["return_value_error"]
    assert "t = 1" in bugs["initialization_error"] and "[1] + t" in bugs["index_error"] and "pass" in bugs["branch_deletion"]
    mutants = dict(python_code.variants(code, python_code.MUTATIONS))
    assert "reverse=True" in mutants["wrong_sort_dir"] and "xs[i] <= 2" in mutants["flip_comparison"] and "t - xs[i]" in mutants["wrong_arithmetic"]
    assert python_code.variants("def (", python_code.BUGS) == [] and python_code.variants(None, python_code.BUGS) == []
    assert python_code.structural_hash("a = 1") == python_code.structural_hash("b = 2") != python_code.structural_hash("b = f()")
    assert python_code.safety_findings("import os\neval('1')\nopen('x', 'w')") == ["call eval", "import os", "open for writing"]
    assert python_code.compile_error("x =") and python_code.compile_error("x = 1") is None
    assert python_code.verify("x = 1", "assert x == 1")["passed"] and not python_code.verify("x = 1", "")["passed"] and not python_code.verify("x = 1", "assert x == 2")["passed"]
    assert python_code.run_python("while True: pass", 0.5)["timed_out"]
    sets = python_code.boundary_sets([5, "a"])
    assert len(sets) == 3 and sum(map(len, sets)) == 8


def test_parsers():
    assert protocols.extract_json('noise ```json\n{"a": 1,}\n``` x') == {"a": 1}
    assert protocols.extract_json('x {"a": {"b": 1}') == {"a": {"b": 1}} or protocols.extract_json('x {"a": {"b": 1}') == {"b": 1}
    assert protocols.extract_json("nothing") is None
    assert protocols.parse_tags('<action name="finish">path: a.py\ntext: <content>x: 1</content></action>') == {"action": "finish", "arguments": {"path": "a.py", "text": "x: 1"}}
    assert protocols.parse_dsl("ACTION finish\nsummary <<E\na\nb\nE\nk v") == {"action": "finish", "arguments": {"summary": "a\nb", "k": "v"}}
    assert protocols.parse_dsl("ACTION finish\nsummary <<E\na") is None
    assert [protocols.path_error(p) for p in ("/abs", "C:x", "a/../b", ".env", "k.pem", "http://x", "", "a/b.py")] == ["absolute", "absolute", "parent", "secret name", "key file", "url", "empty", None]
    assert protocols.pytest_counts("1 passed\n== 2 failed, 3 passed, 1 error in 1s ==") == {"passed": 3, "failed": 2, "error": 1}
    assert protocols.diagnose(None)["failure_class"] == "FORMAT_PARSE_FAIL"


def test_dedup_and_splits(spark):
    df = spark.createDataFrame([(1, "A  b", "x"), (2, "a b", "y"), (3, "c", "y"), (4, None, "z")], "id int, text string, split string")
    assert sorted(r.id for r in dedup.keep_first(df.where("text is not null"), dedup.normal_text(F.col("text")), ["id"]).collect()) == [1, 3]
    assert {(r.split, r.representative) for r in dedup.cross_split_classes(df, dedup.normal_text(F.col("text")), "split", "id").collect()} == {("x", 1), ("y", 2)}
    groups = spark.range(400).selectExpr("id", "concat('g', id % 40) as g")
    for exact in (False, True):
        got = sampling.group_split(groups, "g", {"train": 0.7, "val": 0.1, "test": 0.2}, exact=exact)
        by = {r.split: (r.g, r.n) for r in got.groupBy("split").agg(F.count_distinct("g").alias("g"), F.count("*").alias("n")).collect()}
        assert by == {"train": (28, 280), "val": (4, 40), "test": (8, 80)}
    assert sampling.cap(groups, ["g"], ["id"], 3).count() == 120
    both = spark.createDataFrame([(1, "one two three four five six")], "id int, text string")
    hit = dedup.contamination(both, both.withColumnRenamed("id", "item"), "id", "item", least=4).first()
    assert hit.shared == 4 and hit.containment == 1.0


def test_early_stop_batch_and_stream(spark, tmp_path):
    rows = [(1, i, v) for i, v in enumerate([1.0, 2.5, 2.6, 2.7, 2.8, 2.9, 3.0, 9.0])] + [(2, 0, 1.0)]
    df = spark.createDataFrame(rows, "k long, ts long, v double")
    got = {r.k: (r.n, r.best, r.stopped_at) for r in state.early_stop(df, "k", ["ts"], "v").collect()}
    assert got == {1: (8, 2.5, 7), 2: (1, 1.0, None)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitor.early_stop(stream, "k", "v").writeStream.outputMode("update").format("memory").queryName("stops").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: (r.best, r.reason) for r in spark.table("stops").collect()} == {1: (2.5, "patience"), 2: (1.0, None)}


def test_streamed_windows(spark):
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    q = monitor.windowed_rates(monitor.distinct_events(events), "1 day", late=None).writeStream.outputMode("append").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").count() > 0


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert got.returncode == 0 and int(got.stdout.split()[-1]) > 100, got.stderr
