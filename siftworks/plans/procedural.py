"""Queries whose rows come from Python functions or folds over ordered state; they have no SQL twin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import protocols, tokens, workspace
from ..operators import bootstrap, state, stopping
from ..operators import trajectory as trajectory_rows
from ..sources import digests
from .catalogue import register, table


@register("protocol_diagnostics", "X17 X19 X20 X21 X23 X13 X15")
def protocol_diagnostics(spark, sf_dir):
    """Turns wrapped in three protocols, parsed back and diagnosed."""

    def run(batches):
        for pdf in batches:
            rows = []
            for c, t, role, text in zip(pdf.conv_id, pdf.turn, pdf.role, pdf.text):
                word = (text or "x").split()[0:1] or ["x"]
                forms = {"json": f'note {{"action": "read_file", "arguments": {{"path": "{role}.py"}},', "tag": f'<action name="{role}">path: {word[0]}</action>', "dsl": f"ACTION finish\nsummary <<END\n{text}\nEND"}
                for name, parse in (("json", protocols.extract_json), ("tag", protocols.parse_tags), ("dsl", protocols.parse_dsl)):
                    d = protocols.diagnose(parse(forms[name]))
                    rows.append((c, t, name, d["format_ok"], d["type_ok"], d["failure_class"]))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "protocol", "format_ok", "type_ok", "failure_class"])

    return table(spark, sf_dir, "conversations").mapInPandas(run, "conv_id bigint, turn bigint, protocol string, format_ok boolean, type_ok boolean, failure_class string")


@register("paired_bootstrap", "T2")
def paired_bootstrap(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = docs.join(labels, "doc_id").select("lang", "doc_id", ((F.col("quality") == 1) & (F.col("n_chars") % 3 > 0)).cast("int").alias("a"), (F.col("quality") == 1).cast("int").alias("b"))
    return bootstrap.paired_interval(x, ["lang"], "a", "b")


@register("early_stop_fold", "ST3 ST4 B12 B13")
def early_stop_fold(spark, sf_dir):
    return state.early_stop(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@register("crc_seeds", "G24")
def crc_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(42).bitwiseXOR(F.crc32(F.concat(F.lit("m_"), F.col("doc_id").cast("string")).cast("binary")).bitwiseAND(65535)).alias("seed"))


@register("file_manifest", "K9 A26 S19")
def file_manifest(spark, sf_dir):
    """A row for each file of the folder, and one named '.' for the folder: the hash of all names and hashes in order of name."""
    root = sf_dir.split("://")[-1].rstrip("/")
    inside = F.col("path").substr(F.instr("path", root) + len(root) + 1, F.length("path"))
    rows = digests.hashes(spark, sf_dir).select(inside.alias("file"), "sha256", "size")
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("file", "sha256"))), lambda x: F.concat(x["file"], x["sha256"]))
    return rows.unionByName(rows.agg(F.lit(".").alias("file"), F.sha2(F.array_join(pairs, ""), 256).alias("sha256"), F.sum("size").alias("size")))


@register("replay_trajectories", "V10 V10a S15")
def replay_trajectories(spark, sf_dir):
    return state.replay(table(spark, sf_dir, "conversations"))


# The machine as a recursive query: one row for each user and number of events told.
STOP_SQL = """
with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as rn, (event_id * 7919 + 13) % 1000 as nth, event_type = 'purchase' as full_, value / 100 as value from events),
x as (select user_id, rn, full_, case when nth % 331 = 5 then null else value end as value, (nth % 4)::double as epoch, case when nth % 11 = 3 then null else 1 - (nth % 7) / 100.0::double end as syntax, case when nth % 11 = 3 then null when nth = 0 then 0.1 else 0.0 end::double as timeout from e),
s as (
  select distinct user_id, 0::bigint as rn, null::double as best_probe, null::double as best_full, null::double as last_full, 0 as idle, null::double as syn, false as pending, null::bigint as stopped_at, '' as reason from x
  union all
  select user_id, k,
    case when calm and not full_ and gain then value else best_probe end,
    case when calm and full_ then greatest(coalesce(best_full, value), value) else best_full end,
    case when calm and full_ then value else last_full end,
    case when calm and not full_ then idle2 else idle end,
    case when calm and (syntax is not null or timeout is not null) then coalesce(syntax, 1) else syn end,
    case when calm and not full_ then pending or idle2 >= 4 when calm and full_ and lifted then false else pending end,
    case when stopped_at is not null then stopped_at when now_stop <> '' or confirmed or last_epoch then k end,
    case when stopped_at is not null then reason when now_stop <> '' then now_stop when confirmed then 'confirmed' when last_epoch then 'max_epochs' when not full_ and not pending and idle2 >= 4 then 'pending' when full_ and lifted then '' else reason end
  from (
    select *, calm and full_ and pending and not lifted and last_full is not null as confirmed, calm and full_ and epoch >= 3 as last_epoch from (
      select *, stopped_at is null and now_stop = '' as calm, case when gain then 0 else idle + 1 end as idle2, pending and coalesce(value > coalesce(last_full, best_probe) + 0.005, false) as lifted from (
        select s.*, x.rn as k, x.full_, x.value, x.epoch, x.syntax, x.timeout, best_probe is null or x.value > best_probe + 0.005 as gain,
          case when x.value is null then 'bucket_missing' when x.syntax is null and x.timeout is null then '' when x.timeout > 0.08 then 'timeout_rate' when syn - coalesce(x.syntax, 1) > 0.05 then 'syntax_drop' else '' end as now_stop
        from s join x on x.user_id = s.user_id and x.rn = s.rn + 1) q1) q2) q3)
select user_id, rn as seen, stopped_at, reason, pending, best_probe, best_full from s qualify row_number() over (partition by user_id order by rn desc) = 1
"""


def probe_rows(x):
    """Events of each user as probes and, where they are purchases, full validations; some measure nothing, a few lack a value."""
    nth = (F.col("event_id") * 7919 + 13) % 1000
    value = F.when(nth % 331 != 5, (F.col("value") / 100).cast("double"))
    syntax, timeout = F.when(nth % 11 != 3, 1 - (nth % 7) / 100.0), F.when(nth % 11 != 3, F.when(nth == 0, 0.1).otherwise(0.0))
    return x.select("user_id", "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "full").otherwise("probe").alias("kind"), value.alias("value"), (nth % 4).cast("double").alias("epoch"), syntax.alias("syntax"), timeout.alias("timeout"))


@register("stop_machine", "ST3", STOP_SQL)
def stop_machine(spark, sf_dir):
    """The stop machine folded over each user's events in order."""
    return stopping.fold(probe_rows(table(spark, sf_dir, "events")), "user_id", ["ts", "id"])


TASKS = (
    ("def solution(xs):\n    return sum(xs) - 1\n", "sum(xs) - 1", "sum(xs)", "assert solution([1, 2]) == 3\nassert solution([]) == 0\n"),
    ("def solution(s):\n    return s[1:]\n", "s[1:]", "s[::-1]", "assert solution('abc') == 'cba'\n"),
    ("def solution(n):\n    return n > 0\n", "n > 0", "n >= 0", "assert solution(0)\nassert not solution(-1)\n"),
)
PLAN = ("inspect_task", "list_files", "read_file", "run_tests", "propose_patch", "apply_patch", "run_tests", "write_memory", "finish")
REPLAY = ("actions", "valid", "tools", "tool_errors", "patches", "patched", "tests", "passed", "finish_without_tests", "mismatch")


def trajectory(old: str, new: str) -> list[dict]:
    """Inspect, test, patch, test again and finish."""
    patch = {"path": "solution.py", "old": old, "new": new}
    arguments = {"read_file": {"path": "solution.py"}, "propose_patch": patch, "apply_patch": patch, "write_memory": {"memory": {"done": True}}, "finish": {"criterion": "test_pass", "tests_passed": True}}
    return [{"kind": k} | arguments.get(k, {}) for k in PLAN]


# Turns as recorded steps: what a turn did is told by its numbers of words and characters.
STEP_KINDS = (*workspace.KINDS, "apply_patch", "run_tests", "finish", "open_socket")
STEPS_SQL = f"""t as (select conv_id, turn, role, coalesce(text, '') as text from conversations), n as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as step, role, len(regexp_extract_all(text, '[^ \\n]+')) as words, length(text) as chars from t),
steps as (select conv_id::varchar as trajectory, step, list_value({", ".join(f"'{k}'" for k in STEP_KINDS)})[(words % {len(STEP_KINDS)} + 1)::int] as kind, chars % 13 <> 0 as readable, chars % 4 <> 0 as ok, list_value('test_pass', 'identify_bug', 'patch_applied')[(chars % 3 + 1)::int] as criterion, chars % 2 = 0 as claim, chars % 5 < 3 as verified from n)"""
RECOMBINED_SQL = """x as (select *, sum((kind in ('rollback_patch', 'propose_patch', 'apply_patch', 'run_tests', 'finish'))::int) over (partition by trajectory order by step) as nth from steps),
r as (select 'failed_patch_' || a.trajectory || '_s' || p.step as trajectory, case when a.step <= p.step then a.step else p.step + a.nth - p.nth end as step, a.kind, a.readable, a.ok, a.criterion, a.claim, a.verified from x a join x p on p.trajectory = a.trajectory and p.kind = 'apply_patch' where a.step <= p.step or a.kind in ('rollback_patch', 'propose_patch', 'apply_patch', 'run_tests', 'finish'))"""


def evaluated_sql(rows: str) -> str:
    known = ", ".join(f"'{k}'" for k in workspace.KINDS)
    return f"""v as (select *, readable and kind in ({known}) as valid from {rows} where step < {workspace.MAX_STEPS}), e as (select *, min(case when valid and kind = 'finish' then step end) over (partition by trajectory) as finish_at from v),
u as (select * from e where finish_at is null or step <= finish_at),
g as (select trajectory, count(*) as actions, count_if(valid) as valid, count_if(not readable) as invalid, count_if(readable and not valid) as forbidden, count_if(valid and kind not in ('finish', 'inspect_error', 'write_memory')) as tools,
count_if(valid and kind not in ('finish', 'inspect_error', 'write_memory', 'run_tests') and not ok) as tool_errors, count_if(valid and kind = 'apply_patch') as patches, count_if(valid and kind = 'apply_patch' and ok) as patched, count_if(valid and kind = 'run_tests') as tests, count_if(valid and kind = 'run_tests' and ok) as passed,
max(case when valid and kind = 'finish' then criterion end) as criterion, bool_or(case when valid and kind = 'finish' then claim end) as claim, bool_or(case when valid and kind = 'finish' then verified end) as verified from u group by trajectory)
select trajectory, actions::bigint as steps_executed, coalesce(case criterion when 'test_pass' then passed > 0 when 'identify_bug' then verified when 'patch_applied' then patched > 0 end, false) as success, coalesce(criterion = 'test_pass' and claim <> (passed > 0), false) as mismatch, criterion is null as max_steps_hit,
valid / actions as action_validity_rate, case when tools > 0 then tool_errors / tools else 0 end::double as tool_error_rate, case when patches > 0 then patched / patches else 0 end::double as patch_success_rate, case when tests > 0 then passed / tests else 0 end::double as tests_pass_rate,
forbidden::bigint as forbidden_action_count, invalid::bigint as invalid_action_count, (criterion is not null and tests = 0)::bigint as finish_without_tests_count from g"""


def recorded_steps(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    words, chars = F.regexp_count("text", F.lit(r"[^ \n]+")), F.char_length("text")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    step = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return x.select(F.col("conv_id").cast("string").alias("trajectory"), step.cast("bigint").alias("step"), pick(STEP_KINDS, words).alias("kind"), (chars % 13 != 0).alias("readable"), (chars % 4 != 0).alias("ok"), pick(workspace.CRITERIA, chars).alias("criterion"), (chars % 2 == 0).alias("claim"), (chars % 5 < 3).alias("verified"))


@register("trajectory_metrics", "V10b A31 A35 S15", f"with {STEPS_SQL}, {evaluated_sql('steps')}")
def trajectory_metrics(spark, sf_dir):
    """Every conversation as a trajectory of recorded steps: validity, tools, patches, tests and success by the finish's criterion."""
    return trajectory_rows.evaluated(recorded_steps(spark, sf_dir))


# A replay's tools on a real file, as a recursive query: the text, and what each patch and test came to.
TOOL_KINDS = ("list_files", "read_file", "apply_patch", "search_text", "apply_patch", "run_tests", "propose_patch", "apply_patch", "open_socket", "write_memory", "run_tests", "finish")
TOOLS_SQL = f"""with recursive n as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as step, coalesce(text, '') as text from conversations),
a as (select conv_id, step, text, list_value({", ".join(f"'{k}'" for k in TOOL_KINDS)})[(len(regexp_extract_all(text, '[^ \\n]+')) % {len(TOOL_KINDS)} + 1)::int] as kind, regexp_extract(text, '[A-Za-z]+') as old, length(text) as chars from n where step < {workspace.MAX_STEPS}),
w as (select conv_id, 0::bigint as at, text as file, false as patched, null::boolean as ok from a where step = 0 union all
  select conv_id, step + 1, case when hit and kind = 'apply_patch' then replace(file, old, '@' || step) else file end, patched or (hit and kind = 'apply_patch'), case when kind in ('apply_patch', 'propose_patch') then hit when kind = 'run_tests' then patched else true end
  from (select w.conv_id, a.step, a.kind, a.old, w.file, w.patched, a.chars % 13 <> 0 and a.old <> '' and (length(w.file) - length(replace(w.file, a.old, ''))) = length(a.old) as hit from w join a on a.conv_id = w.conv_id and a.step = w.at) q),
steps as (select a.conv_id::varchar as trajectory, a.step, a.kind, a.chars % 13 <> 0 as readable, w.ok, list_value('test_pass', 'identify_bug', 'patch_applied')[(a.chars % 3 + 1)::int] as criterion, a.chars % 2 = 0 as claim, a.chars % 5 < 3 as verified from a join w on w.conv_id = a.conv_id and w.at = a.step + 1)"""


@register("conversation_replay", "V10 V10b V11 X27 S15", f"{TOOLS_SQL}, {evaluated_sql('steps')}")
def conversation_replay(spark, sf_dir):
    """Every conversation as actions on a file, its first turn, run through the tools: patches hit a turn's first word if it stands there once, tests pass once a patch did."""
    import os

    x = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    x = x.withColumn("step", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).where(F.col("step") < workspace.MAX_STEPS)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    chars = F.char_length("text")
    step = F.struct("step", pick(TOOL_KINDS, F.regexp_count("text", F.lit(r"[^ \n]+"))).alias("kind"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("old"), (chars % 13 == 0).alias("sentinel"), pick(workspace.CRITERIA, chars).alias("criterion"), (chars % 2 == 0).alias("claim"), (chars % 5 < 3).alias("verified"))
    each = x.groupBy("conv_id").agg(F.max(F.when(F.col("step") == 0, F.col("text"))).alias("file"), F.sort_array(F.collect_list(step)).alias("steps"))  # MAX_STEPS steps at most
    more = {"finish": lambda a: {"criterion": a["criterion"], "tests_passed": a["claim"], "verified": a["verified"]}, "read_file": lambda a: {"path": "file.txt"}, "search_text": lambda a: {"query": a["old"]}, "write_memory": lambda a: {"memory": {}}, "run_tests": lambda a: {}}
    patch = lambda a: {"path": "file.txt", "old": a["old"], "new": f"@{a['step']}"}

    def run(batches):
        os.environ[workspace.NETWORK] = "0"
        for pdf in batches:
            out = []
            for conv, file, steps in zip(pdf["conv_id"], pdf["file"], pdf["steps"]):
                space = workspace.Workspace({"file.txt": file, "solution.py": "", "test_solution.py": ""})
                patched = lambda code, tests, seconds, s=space: {"passed": any(r["success"] for r in s.log)}
                actions = [{"kind": a["kind"], **({"sentinel": True} if a["sentinel"] else {}), **(patch(a) if a["kind"].endswith("_patch") else more.get(a["kind"], lambda a: {})(a))} for a in steps]
                n = workspace.replay(space, actions, runner=patched)
                rate = lambda a, b, n=n: n[a] / n[b] if n[b] else 0.0
                out.append((str(conv), n["actions"], n["success"], bool(n["mismatch"]), n["max_steps_hit"], rate("valid", "actions"), rate("tool_errors", "tools"), rate("patched", "patches"), rate("passed", "tests"), n["forbidden"], n["invalid"], n["finish_without_tests"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in METRICS.split(", ")])

    return each.mapInPandas(run, METRICS)


METRICS = "trajectory string, steps_executed bigint, success boolean, mismatch boolean, max_steps_hit boolean, action_validity_rate double, tool_error_rate double, patch_success_rate double, tests_pass_rate double, forbidden_action_count bigint, invalid_action_count bigint, finish_without_tests_count bigint"


@register("recovered_trajectories", "V10c V10b", f"with {STEPS_SQL}, {RECOMBINED_SQL}, z as ({'with ' + evaluated_sql('r')}) select * from z where success")
def recovered_trajectories(spark, sf_dir):
    """Trajectories cut behind each patch and gone on with the later steps that recover, of which those that succeed are kept."""
    return trajectory_rows.evaluated(trajectory_rows.recombined(recorded_steps(spark, sf_dir))).where("success")


@register("workspace_replay", "V10 V10a V10b V10d V10e V10f V11 S15 A31 A35")
def workspace_replay(spark, sf_dir):
    """Each conversation's task replayed on a workspace, clean and spoilt in five ways at a step that its number sets. Equal replays run once."""
    import os

    kinds = ("none", *workspace.SPOILS)
    steps = len(PLAN)

    def run(batches):
        os.environ[workspace.NETWORK] = "0"  # the sandbox's processes get no network from here
        for pdf in batches:
            out = []
            for k, spoil, at in zip(pdf["task"], pdf["spoil"], pdf["at"]):
                code, old, new, tests = TASKS[k]
                space = workspace.Workspace({"solution.py": code, "test_solution.py": tests}, task=f"task {k}")
                got = workspace.replay(space, workspace.spoilt(trajectory(old, new), None if spoil == "none" else spoil, int(at)))
                undone = None
                if done := next((r["action_id"] for r in space.log if r["success"]), None):
                    space.rollback_patch(done)
                    undone = space.files["solution.py"] == code
                out.append([k, spoil, at, *(got[c] for c in REPLAY), got["success"], got["finished"], got["max_steps_hit"], undone])
            yield pd.DataFrame(out, columns=["task", "spoil", "at", *REPLAY, "success", "finished", "max_steps_hit", "undone"])

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    wanted = turns.select("conv_id", (F.col("conv_id") % len(TASKS)).cast("int").alias("task"), (F.col("turns") % steps).cast("int").alias("at"), F.explode(F.array(*map(F.lit, kinds))).alias("spoil"))
    schema = "task int, spoil string, at int, " + ", ".join(f"{c} int" for c in REPLAY) + ", success boolean, finished boolean, max_steps_hit boolean, undone boolean"
    done = wanted.select("task", "spoil", "at").distinct().repartition("task", "spoil", "at").mapInPandas(run, schema)
    return wanted.join(done, ["task", "spoil", "at"])


@register("token_lengths", "V13 A23 X34")
def token_lengths(spark, sf_dir):
    """Tokens of whole texts by an installed vocabulary, and by language how many are over the limit of training."""
    x = tokens.lengths(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.count_if(F.col("tokens") > 384).alias("truncated"))
