"""Structured Streaming over step logs: windows with late data, and early stopping as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .keyed import finite, folded


def windowed_rates(events: DataFrame, length: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window of ts; rows later than `late` are left out. None: events have a watermark."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return x.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of event_id within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def early_stop(probes: DataFrame, key: str, value: str, min_delta: float = 1.0, patience: int = 5, most: int | None = None) -> DataFrame:
    """One row whenever a key's state changes: (key, n, best, bad, reason).

    best moves by min_delta at least; patience probes in a row without that stop the key, as do a value that is no
    number and, if given, `most` probes. A stopped key stays stopped.
    """

    def step(keys, frames, state: GroupState):
        n, best, bad, reason = state.get if state.exists else (0, float("-inf"), 0, "")
        for pdf in frames:
            for v in pdf.sort_values("ts", kind="stable")[value]:
                if reason:
                    continue
                n += 1
                if v is None or v != v or v in (float("inf"), float("-inf")):
                    reason = "nan"
                elif v >= best + min_delta:
                    best, bad = float(v), 0
                else:
                    bad += 1
                reason = reason or ("patience" if bad >= patience else "max" if most and n >= most else "")
        state.update((n, best, bad, reason))
        yield pd.DataFrame([(keys[0], n, best, bad, reason or None)], columns=[key, "n", "best", "bad", "reason"])

    kind = probes.schema[key].dataType.simpleString()
    return probes.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, best double, bad long, reason string", "n long, best double, bad long, reason string", "update", GroupStateTimeout.NoTimeout)


def stop_states(batch: DataFrame, held: DataFrame | None, key: str, value: str, order: list[str], min_delta: float = 1.0, patience: int = 5, most: int | None = None) -> DataFrame:
    """(key, n, best, bad, reason) of all keys as early_stop has them, '' for no reason, folded by the engine; rows of a batch by order, nulls last. For keyed.Held."""
    row = F.struct(*(c for i, name in enumerate(order) for c in (F.col(name).isNull().alias(f"no{i}"), F.col(name).alias(f"o{i}"))), F.col(value).cast("double").alias("v"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(float("-inf")).alias("best"), F.lit(0).cast("bigint").alias("bad"), F.lit("").alias("reason"))

    def step(s, r):
        number = finite(r.v)
        better = number & (r.v >= s.best + min_delta)
        bad = F.when(better, 0).when(number, s.bad + 1).otherwise(s.bad).cast("bigint")
        reason = F.when(~number, "nan").when(bad >= patience, "patience")
        reason = reason.when(s.n + 1 >= most, "max") if most else reason
        return F.when(s.reason != "", s).otherwise(F.struct((s.n + 1).alias("n"), F.when(better, r.v).otherwise(s.best).alias("best"), bad.alias("bad"), reason.otherwise("").alias("reason")))

    return folded(batch, held, key, row, start, step)
