"""Folds over rows in order, one state at a time, and replay of trajectories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_in_order(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """(key, what finish(state) returns) for each key: state = step(state, *columns) over the key's rows in order.

    Rows are read from partitions sorted by key and order and folded as they come, so a key of any length needs the memory of one state.
    Null keys are one key. schema: that of finish()'s values.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]):
        now: tuple | None = None
        state = None
        for pdf in batches:
            out = []
            for k, *values in zip(*(pdf[c] for c in (key, *columns))):
                k = (None if pd.isna(k) else k,)
                if k != now:
                    if now is not None:
                        out.append([*now, *finish(state)])
                    now, state = k, start()
                state = step(state, *(None if pd.isna(v) else v for v in values))
            yield pd.DataFrame(out, columns=names, dtype=object)
        if now is not None:
            yield pd.DataFrame([[*now, *finish(state)]], columns=names, dtype=object)

    dealt = rows.select(*dict.fromkeys([key, *order, *columns])).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, f"{key} {kind}, {schema}")


def early_stop(rows: DataFrame, key: str, order: list[str], value: str, min_delta: float = 1.0, patience: int = 5) -> DataFrame:
    """(key, n, best, stopped_at): the best value and the 1-based position at which `patience` probes in a row have not beaten best + min_delta.

    best moves only by at least min_delta, so this is a recurrence and no running maximum; null values count as no gain.
    stopped_at is null where it never happens.
    """

    def step(state, v):
        n, best, bad, stop = state
        gain = v is not None and float(v) >= best + min_delta
        bad = 0 if gain else bad + 1
        if gain and stop is None:
            best = float(v)
        return n + 1, best, bad, n + 1 if stop is None and bad >= patience else stop

    return fold_in_order(rows, key, order, [value], lambda: (0, float("-inf"), 0, None), step, lambda s: (s[0], round(s[1], 6), s[3]), "n bigint, best double, stopped_at bigint")


def replay(turns: DataFrame) -> DataFrame:
    """(conv_id, corruption, steps, invalid, finished) of each conversation replayed clean and with five corruptions.

    wrong_action_type renames the second action, invalid_path and wrong_patch spoil its argument, skip_tests_before_finish drops
    user turns but the first, exceed_max_steps repeats the last action up to twenty steps.
    """
    steps = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), F.length(x["text"]).alias("size")))
    x = turns.groupBy("conv_id").agg(steps.alias("s"))
    kinds = ["none", "wrong_action_type", "invalid_path", "wrong_patch", "skip_tests_before_finish", "exceed_max_steps"]
    x = x.withColumn("corruption", F.explode(F.array(*map(F.lit, kinds))))
    c = F.col("corruption")
    changed = (
        F.when(c == "wrong_action_type", F.transform("s", lambda a, i: F.when(i == 1, F.struct(F.lit("unknown").alias("role"), a["size"].alias("size"))).otherwise(a)))
        .when(c.isin("invalid_path", "wrong_patch"), F.transform("s", lambda a, i: F.when(i == 1, F.struct(a["role"].alias("role"), F.lit(-1).alias("size"))).otherwise(a)))
        .when(c == "skip_tests_before_finish", F.filter("s", lambda a, i: (i == 0) | (a["role"] != "user")))
        .when(c == "exceed_max_steps", F.concat("s", F.array_repeat(F.element_at("s", -1), F.greatest(F.lit(0), 20 - F.size("s")))))
        .otherwise(F.col("s"))
    )
    x = x.withColumn("s", changed)
    invalid = F.size(F.filter("s", lambda a: ~a["role"].isin("user", "assistant", "system") | (a["size"] < 0)))
    return x.select("conv_id", "corruption", F.size("s").alias("steps"), invalid.alias("invalid"), ((F.element_at("s", -1)["role"] == "assistant") & (F.size("s") < 20)).alias("finished"))
