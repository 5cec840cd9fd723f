"""The workspace's tools, replays clean and spoilt, the stop machine, locks and the rewrites of comparisons and ranges."""

import random

import pytest

from siftworks.functions import python_code, workspace
from siftworks.functions.workspace import ToolError, Workspace
from siftworks.operators import bootstrap, dedup, stopping
from siftworks.plans.procedural import TASKS, trajectory
from siftworks.sources import records


def space(k=0):
    return Workspace({"solution.py": TASKS[k][0], "test_solution.py": TASKS[k][3]})


def passing(code, tests, seconds):
    """A runner in this process for code that the tests here bring themselves."""
    scope = {}
    try:
        exec(code + "\n" + tests, scope)
        return {"passed": True, "output": "1 passed"}
    except AssertionError:
        return {"passed": False, "output": "x" * 20_000}


def test_patch_must_match_once_and_is_logged():
    s = space()
    with pytest.raises(ToolError, match="not found"):
        s.apply_patch("solution.py", "nothing", "x")
    s.files["twice.py"] = "a a"
    with pytest.raises(ToolError, match="2 times"):
        s.propose_patch("twice.py", "a", "b")
    before = s.files["solution.py"]
    done = s.apply_patch("solution.py", "sum(xs) - 1", "sum(xs)")
    assert [r["success"] for r in s.log] == [False, True] and "- 1" not in s.files["solution.py"] and s.inspect_error("last_patch") == "old text not found"
    undo = s.rollback_patch(done)
    assert s.files["solution.py"] == before and s.log[-1]["before"] == s.log[1]["after"] and s.log[1]["rolled_back"]
    for bad in (done, "patch_1", "patch_99"):
        with pytest.raises(ToolError, match="not reversible"):
            s.rollback_patch(bad)
    with pytest.raises(ToolError, match="backup"):
        s.rollback_patch(undo)


def test_tests_run_only_without_network(monkeypatch):
    s = space()
    monkeypatch.delenv(workspace.NETWORK, raising=False)
    with pytest.raises(ToolError, match="network"):
        s.run_tests()
    monkeypatch.setenv(workspace.NETWORK, "0")
    for bad in ({"path": "notes.txt"}, {"path": "../test_a.py"}, {"seconds": 0}, {"seconds": 31}):
        with pytest.raises(ToolError):
            s.run_tests(**bad)
    with pytest.raises(ToolError, match="no prior"):
        s.inspect_error("last_test")
    assert not s.run_tests(runner=passing)["passed"] and len(s.inspect_error("last_test")) == workspace.OUTPUT
    with pytest.raises(ToolError):
        s.inspect_error("other")


def test_other_tools():
    s = space()
    assert s.list_files() == ["solution.py", "test_solution.py"] and s.search_text("solution(")[0][:2] == ("solution.py", 1)
    assert s.read_file("solution.py", 2, 2) == "    return sum(xs) - 1"
    assert s.write_memory({"a": 1}) == ({}, {"a": 1}) and s.write_memory({"b": 2})[0] == {"a": 1}
    for bad in ("/etc/passwd", "../x", "C:\\x", "http://x/y", "a/../b", "id.pem", ".env", ""):
        with pytest.raises(ToolError):
            workspace.checked(bad)


@pytest.mark.parametrize("k", range(len(TASKS)))
def test_replays(monkeypatch, k):
    monkeypatch.setenv(workspace.NETWORK, "0")
    actions = trajectory(*TASKS[k][1:3])
    run = lambda kind, at: workspace.replay(space(k), workspace.spoilt(actions, kind, at), runner=passing)
    clean = run(None, 0)
    assert clean["success"] and clean["tests"] == 2 and clean["passed"] == 1 and clean["tool_errors"] == clean["mismatch"] == 0 and clean["valid"] == len(actions)
    at = [a["kind"] for a in actions].index
    wrong = run("wrong_patch", at("apply_patch"))
    assert not wrong["success"] and wrong["tool_errors"] == 1 and wrong["mismatch"] == 1 and wrong["patched"] == 0
    path = run("invalid_path", at("apply_patch"))
    assert not path["success"] and path["valid"] == path["actions"] - 1
    early = run("skip_tests_before_finish", at("run_tests"))
    assert early["finished"] and not early["success"] and early["finish_without_tests"] == 1 and early["mismatch"] == 0
    never = run("exceed_max_steps", 0)
    assert never["max_steps_hit"] and not never["finished"] and never["actions"] == workspace.MAX_STEPS
    assert not run("wrong_action_type", at("apply_patch"))["success"] and run("wrong_patch", 0) == clean


def test_stop_rules():
    s = stopping.Stopping()
    for v in (0.5, 0.504, 0.5, 0.5, 0.5):  # no gain of more than 0.005
        s.probe(v)
    assert s.pending and not s.stopped and s.idle == 4 and s.best_probe == 0.5
    s.full(0.506, 1)  # the first full validation beats the best probe
    assert not s.pending
    s.probe(0.5)
    assert s.pending
    s.full(0.5, 1)
    assert s.stopped and s.reason == "confirmed"
    s = stopping.Stopping(pending=True)
    s.best_probe = 0.6
    s.full(0.6, 1)  # a first one without gain neither lifts nor confirms
    assert s.pending and not s.stopped
    for call, why in (
        (lambda s: s.probe(float("nan")), "nan_or_inf"), (lambda s: s.full(None, 0), "bucket_missing"), (lambda s: s.probe(1.0, timeout=0.081), "timeout_rate"), (lambda s: s.full(1.0, 3), "max_epochs"),
        (lambda s: (s.probe(1.0, 0.9), s.probe(2.0, 0.84)), "syntax_drop"),
    ):
        s = stopping.Stopping()
        call(s)
        assert s.stopped and s.reason == why
    s = stopping.Stopping()
    s.probe(1.0, 0.9, 0.08)
    s.probe(2.0, 0.86)
    assert not s.stopped


def test_stop_machine_over_rows(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.choice(["probe"] * 5 + ["full"]), rng.choice([None, float("nan")]) if rng.random() < 0.02 else rng.random() / 20, float(i // 30), 1 - rng.random() / 30, rng.choice([0.0] * 60 + [0.1])) for u in (1, 2, 3, None) for i in range(120)]
    want = {}
    for u, _, kind, value, epoch, syntax, timeout in rows:
        s, seen, at = want.setdefault(u, [stopping.Stopping(), 0, None])
        s = stopping.Stopping.restore(vars(s))  # carried on from its fields
        seen += 1
        if not s.stopped:
            s.full(value, epoch, syntax, timeout) if kind == "full" else s.probe(value, syntax, timeout)
            at = seen if s.stopped else None
        want[u] = [s, seen, at]
    df = spark.createDataFrame(rows, "u bigint, i bigint, kind string, value double, epoch double, syntax double, timeout double").repartition(5)
    got = {r.u: r for r in stopping.fold(df, "u", ["i"]).collect()}
    assert {u: (r.seen, r.stopped_at, r.reason, r.pending, r.best_probe) for u, r in got.items()} == {u: (n, at, s.reason, s.pending, s.best_probe) for u, (s, n, at) in want.items()}
    assert stopping.Stopping(last_full=1.0, idle=2).snapshot()["last_full"] is None and stopping.Stopping(idle=2).snapshot()["idle"] == 2


def test_first_operator_that_has_another_and_innermost_range():
    assert python_code.rewrite_first("x = a in b < c", python_code.BUGS["condition_error"][0]) == "x = a in b <= c"
    assert python_code.rewrite_first("for i in range(len(range(n))):\n    pass", python_code.BUGS["off_by_one"][0]).startswith("for i in range(len(range(n - 1)))")


def test_bootstrap_against_rows():
    import numpy as np

    delta = np.array([-1.0, 0.0, 1.0])
    means = bootstrap.replicate_means(delta, np.array([10, 60, 30]), 10_000, 1)
    rng = np.random.default_rng(5)
    rows = np.repeat(delta, [10, 60, 30])
    w = rng.poisson(1, (10_000, 100))
    brute = np.sort((w * rows).sum(1) / w.sum(1))
    assert len(means) == 10_000 and abs(means[250] - brute[250]) < 0.02 and abs(means[9750] - brute[9750]) < 0.02


def test_short_items_count_as_contamination(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "nothing of it is in here")], "id int, text string")
    items = spark.createDataFrame([(7, "two three four five")], "item int, text string")
    assert [tuple(r) for r in dedup.contamination(docs, items, "id", "item").collect()] == [(1, 7, 2, 1.0)]


def test_locks_read_crlf_as_lf(spark, tmp_path):
    import hashlib

    paths = {}
    for name, data in (("a", b"1\r\n2\r\n"), ("b", b"3\n")):
        (tmp_path / name).write_bytes(data)
        paths[name] = str(tmp_path / name)
    whole, each = records.lock_hash(spark, list(paths.values()))
    assert whole == hashlib.sha256(b"1\n2\n3\n").hexdigest() and each[paths["a"]] == hashlib.sha256(b"1\n2\n").hexdigest()
    lock = {"a_sha256": each[paths["a"]], "b_sha256": each[paths["b"]], "sha_lock": whole}
    assert records.lock_errors(spark, lock, paths) == [] and len(records.lock_errors(spark, lock | {"sha_lock": "0"}, paths)) == 1
    (tmp_path / "b").unlink()
    assert records.lock_errors(spark, lock, paths) == ["b: file missing"]


def test_reports_and_guards(spark, tmp_path):
    text = records.markdown("T", {"x": [{"a": 1, "b": None}, {"a": "p|q"}], "none": []})
    assert text == "# T\n\n## x\n\n| a | b |\n| --- | --- |\n| 1 | - |\n| p\\|q | - |\n\n## none\n\n(none)\n"
    chat = spark.createDataFrame([("c", [("user", "hi")])], "sample_id string, messages array<struct<role:string,content:string>>")
    records.write_once(chat, str(tmp_path / "chat"))
    with pytest.raises(Exception, match="chat record"):
        records.read_samples_only(spark, str(tmp_path / "chat")).collect()
    with pytest.raises(FileExistsError):
        records.write_once(chat, str(tmp_path / "chat"))
    assert records.missing_fields({"a": {"b": 0}}, ["a.b", "a.c", "d"]) == ["a.c", "d"]


def test_expected_outputs_become_tests():
    code = "def f(x):\n    if x == 3:\n        raise ValueError\n    return {1} if x == 2 else [x]\n"
    out = python_code.expected_outputs(code, "f", [[1], [2], [3]])
    assert out == [{"ok": True, "value": [1]}, {"ok": False, "error": "TypeError"}, {"ok": False, "error": "ValueError"}]
    assert python_code.assertions("f", [[1], [2], [3]], out) == ["assert f(1) == [1]"]
    assert python_code.expected_outputs("def f(x:", "f", [[1]]) is None


def test_token_lengths(spark):
    from siftworks.functions import tokens

    rows = [(1, "the cat"), (2, None), (3, "日本 <|endoftext|>")]
    got = {r.i: r.tokens for r in tokens.lengths(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    own = tokens.load(open(tokens.VOCABULARY, encoding="utf-8").read())
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
