"""Replays by all three criteria, recombined recoveries, and metrics of recorded steps."""

import random

import pytest

from siftworks.functions import workspace as ws
from siftworks.operators import trajectory

CODE, TESTS = "def solution(x):\n    return x - 1\n", "assert solution(1) == 2\n"
RIGHT = {"path": "solution.py", "old": "x - 1", "new": "x + 1"}
PASSING = lambda code, tests, seconds: {"passed": "x + 1" in code, "output": "log"}


@pytest.fixture(autouse=True)
def offline(monkeypatch):
    monkeypatch.setenv(ws.NETWORK, "0")


def replayed(*actions, **how):
    space = ws.Workspace({"solution.py": CODE, "test_solution.py": TESTS})
    return ws.replay(space, [{"kind": a} if isinstance(a, str) else a for a in actions], runner=PASSING, **how)


def finish(criterion="test_pass", **more):
    return {"kind": "finish", "criterion": criterion, **more}


def patch(**more):
    return {"kind": "apply_patch", **RIGHT, **more}


def test_any_passed_run_counts_not_the_last():
    got = replayed(patch(), "run_tests", {"kind": "rollback_patch", "action_id": "patch_1"}, "run_tests", finish(tests_passed=True))
    assert got["success"] and got["mismatch"] == 0 and got["tests"] == 2 and got["passed"] == 1


@pytest.mark.parametrize("claim, right, mismatch", [(True, False, 1), (False, True, 1), (True, True, 0), (False, False, 0)])
def test_the_replay_decides_and_not_the_claim(claim, right, mismatch):
    got = replayed(*([patch()] if right else []), "run_tests", finish(tests_passed=claim))
    assert got["success"] is right and got["mismatch"] == mismatch


def test_patch_applied_and_identify_bug():
    assert replayed(patch(), finish("patch_applied", tests_passed=True))["success"]
    none = replayed(patch(old="nowhere"), finish("patch_applied"))
    assert not none["success"] and none["tool_errors"] == 1 and none["patches"] == 1 and none["mismatch"] == 0
    assert replayed(finish("identify_bug", verified=True))["success"] and not replayed(finish("identify_bug"))["success"]


def test_finish_without_tests_and_no_finish():
    assert replayed(finish())["finish_without_tests"] == 1 and replayed("run_tests", finish())["finish_without_tests"] == 0
    early = replayed("list_files")
    assert early["max_steps_hit"] and not early["finished"] and not early["success"]
    assert replayed(*["list_files"] * 5, finish(), max_steps=5)["max_steps_hit"]


def test_sentinels_are_invalid_and_unknown_kinds_forbidden():
    got = replayed({"kind": "", "sentinel": True}, "open_socket", finish("identify_bug"))
    assert (got["invalid"], got["forbidden"], got["valid"], got["actions"]) == (1, 1, 1, 3)


def test_stateless_actions_call_no_tool():
    got = replayed("list_files", {"kind": "inspect_error", "source": "last_test"}, {"kind": "write_memory", "memory": {"a": 1}}, {"kind": "search_text", "query": "def"}, {"kind": "rollback_patch", "action_id": "nothing"}, finish("identify_bug"))
    assert got["tools"] == 3 and got["tool_errors"] == 1


STEPS = "trajectory string, step bigint, kind string, readable boolean, ok boolean, criterion string, claim boolean, verified boolean"


def made(seed, n=40):
    rng, rows = random.Random(seed), []
    for t in range(n):
        for k in range(rng.randint(1, 30)):
            rows.append((f"t{t}", k, rng.choice([*ws.KINDS, "apply_patch", "run_tests", "finish", "other", None]), rng.random() < 0.95, rng.random() < 0.6, rng.choice([*ws.CRITERIA, None]), rng.random() < 0.5, rng.choice([True, False, None])))
    return rows


def cut_and_gone_on(rows, max_steps):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for t, steps in by.items():
        for p in [r[1] for r in steps if r[2] == "apply_patch"]:
            if max_steps is None or p < max_steps:
                new = steps[: p + 1] + [r for r in steps[p + 1 :] if r[2] in trajectory.RECOVERY]
                out += [(f"failed_patch_{t}_s{p}", k, *r[2:]) for k, r in enumerate(new[:max_steps])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_steps", [5, 20, None])
def test_recoveries_equal_lists_cut_and_gone_on(spark, max_steps):
    rows = made(4)
    df = spark.createDataFrame(rows, STEPS).repartition(3)
    assert sorted((tuple(r) for r in trajectory.recombined(df, max_steps).collect()), key=repr) == cut_and_gone_on(rows, max_steps)


class Recorded:
    """A workspace whose tools do what the steps say."""

    def __init__(self):
        self.ok = True

    def run_tests(self, runner=None):
        return {"passed": self.ok}

    def __getattr__(self, kind):
        def tool():
            if not self.ok:
                raise ws.ToolError(kind)

        return tool


def test_metrics_equal_a_replay(spark):
    rows = made(8)
    got = {r.trajectory: r for r in trajectory.evaluated(spark.createDataFrame(rows, STEPS)).collect()}
    for t in {r[0] for r in rows}:
        steps = [r for r in rows if r[0] == t]
        space = Recorded()
        # Only tools that the replay calls may fail.
        actions = [{"kind": r[2] or "none", **({"sentinel": True} if not r[3] else {}), **({"criterion": r[5] or "test_pass", "tests_passed": bool(r[6]), "verified": bool(r[7])} if r[2] == "finish" else {})} for r in steps]
        oks = iter(r[4] or r[2] in ("inspect_task", *ws.STATELESS) for r in steps)

        class Following(list):
            def __getitem__(self, s):
                return (self._set(a) for a in list.__getitem__(self, s))

            def _set(self, a):
                space.ok = next(oks)
                return a

        want = ws.replay(space, Following(actions))
        r = got[t]
        failed = sum(not s[4] and s[3] and s[2] == "inspect_task" for s in steps[: want["actions"]])
        assert (r.steps_executed, r.success, r.mismatch, r.max_steps_hit) == (want["actions"], want["success"], bool(want["mismatch"]), want["max_steps_hit"])
        assert (r.forbidden_action_count, r.invalid_action_count, r.finish_without_tests_count) == (want["forbidden"], want["invalid"], want["finish_without_tests"])
        share = lambda a, b: a / b if b else 0.0
        assert r.tool_error_rate == share(want["tool_errors"] + failed, want["tools"])
        assert (r.patch_success_rate, r.tests_pass_rate, r.action_validity_rate) == (share(want["patched"], want["patches"]), share(want["passed"], want["tests"]), share(want["valid"], want["actions"]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], STEPS)
    assert trajectory.evaluated(trajectory.recombined(none)).collect() == []
