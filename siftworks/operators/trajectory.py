"""Trajectories as rows: recoveries recombined from a prefix and later steps, and what a replay of recorded steps comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.workspace import KINDS, MAX_STEPS, STATELESS

RECOVERY = ("rollback_patch", "propose_patch", "apply_patch", "run_tests", "finish")


def recombined(steps: DataFrame, max_steps: int | None = MAX_STEPS) -> DataFrame:
    """For each step that applies a patch, the trajectory in which it failed: all steps up to it, then those later ones that recover.

    steps: (trajectory, step from 0 on, kind, any others). The result's trajectories are named failed_patch_<trajectory>_s<step of the patch> and
    numbered anew. max_steps: only steps that a replay of so many reaches, which also bounds how often a long trajectory is copied; None: all.
    """
    later = F.col("kind").isin(*RECOVERY)
    run = W.partitionBy("trajectory").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    x = steps.withColumn("_nth", F.sum(F.coalesce(later, F.lit(False)).cast("bigint")).over(run))
    patches = x.where("kind = 'apply_patch'").select(F.col("trajectory").alias("_of"), F.col("step").alias("_patch"), F.col("_nth").alias("_before"))
    if max_steps is not None:
        patches = patches.where(F.col("_patch") < max_steps)
    both = x.join(patches, F.col("trajectory") == F.col("_of")).where((F.col("step") <= F.col("_patch")) | later)
    at = F.when(F.col("step") <= F.col("_patch"), F.col("step")).otherwise(F.col("_patch") + F.col("_nth") - F.col("_before"))
    named = F.concat(F.lit("failed_patch_"), F.col("trajectory").cast("string"), F.lit("_s"), F.col("_patch").cast("string"))
    out = both.withColumn("_at", at.cast("bigint")).withColumn("trajectory", named).withColumn("step", F.col("_at"))
    if max_steps is not None:
        out = out.where(F.col("_at") < max_steps)
    return out.select(steps.columns)


def evaluated(steps: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Metrics of each trajectory of recorded steps, as functions.workspace.replay has them for one that it runs.

    steps: (trajectory, step from 0 on, kind, readable, ok, criterion, claim, verified). A step that is not readable is invalid; of an unknown kind,
    forbidden; ok: the tool did what was asked, or tests passed. The first finish ends a trajectory, max_steps ends it without success. Rates
    of nothing are 0. Null flags are false, a null criterion is test_pass.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = steps.where((F.col("step") >= 0) & (F.col("step") < max_steps))
    x = x.withColumns({c: flag(c) for c in ("readable", "ok", "claim", "verified")}).withColumn("criterion", F.coalesce("criterion", F.lit("test_pass")))
    x = x.withColumn("valid", flag("readable") & F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
    ends = F.min(F.when(F.col("valid") & (F.col("kind") == "finish"), F.col("step"))).over(W.partitionBy("trajectory"))  # max_steps rows at most
    x = x.withColumn("_end", ends).where("_end is null or step <= _end")
    of = lambda *kinds: F.col("valid") & F.col("kind").isin(*kinds)
    tool = F.col("valid") & ~F.col("kind").isin("finish", *STATELESS)
    count = lambda what: F.count_if(F.coalesce(what, F.lit(False)))
    last = lambda c: F.max(F.when(of("finish"), F.col(c)))
    g = x.groupBy("trajectory").agg(
        F.count("*").alias("actions"), count(F.col("valid")).alias("valid"), count(~F.col("readable")).alias("invalid"), count(F.col("readable") & ~F.col("valid")).alias("forbidden"),
        count(tool).alias("tools"), count(tool & ~of("run_tests") & ~F.col("ok")).alias("tool_errors"), count(of("apply_patch")).alias("patches"), count(of("apply_patch") & F.col("ok")).alias("patched"),
        count(of("run_tests")).alias("tests"), count(of("run_tests") & F.col("ok")).alias("passed"), count(of("finish")).alias("finishes"), last("criterion").alias("criterion"), last("claim").alias("claim"), last("verified").alias("verified"),
    )
    passed = F.col("passed") > 0
    done = F.col("finishes") > 0
    success = done & F.when(F.col("criterion") == "test_pass", passed).when(F.col("criterion") == "identify_bug", F.col("verified")).when(F.col("criterion") == "patch_applied", F.col("patched") > 0).otherwise(False)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return g.select(
        "trajectory", F.col("actions").alias("steps_executed"), success.alias("success"), (done & (F.col("criterion") == "test_pass") & (F.col("claim") != passed)).alias("mismatch"), (~done).alias("max_steps_hit"),
        rate("valid", "actions").alias("action_validity_rate"), rate("tool_errors", "tools").alias("tool_error_rate"), rate("patched", "patches").alias("patch_success_rate"), rate("passed", "tests").alias("tests_pass_rate"),
        F.col("forbidden").alias("forbidden_action_count"), F.col("invalid").alias("invalid_action_count"), (done & (F.col("tests") == 0)).cast("bigint").alias("finish_without_tests_count"),
    )
