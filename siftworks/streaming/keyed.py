"""The stop machine and falling probes as keyed state by transformWithState, or as a table that each batch folds on; a schedule of evaluations and sessions by windows of event time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.stopping import FOLDED, Stopping, advance
from ..sources import scratch


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, as value, list and map state need; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Held:
    """The state of keys as a table in a shared folder, for foreachBatch: each batch makes it anew from that of the batch before, without a call in Python for each key.

    fold(batch, table or None) gives (key, the state's fields) of every key. A batch that is begun again starts from the same table, so its rows count once.
    """

    def __init__(self, path: str, fold):
        self.path, self.fold = path, fold

    def __call__(self, batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        before = sorted(n for n in map(int, scratch.names(spark, self.path)) if n < i)
        held = spark.read.parquet(f"{self.path}/{before[-1]}") if before else None
        self.fold(batch, held).write.mode("overwrite").parquet(f"{self.path}/{i}")
        for n in before[:-1]:
            scratch.remove(spark, f"{self.path}/{n}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{max(map(int, scratch.names(spark, self.path)))}")


def folded(batch: DataFrame, held: DataFrame | None, key: str, row: Column, start: Column, step) -> DataFrame:
    """(key, the fields of start) of all keys: step(state, row) over a key's rows of the batch, sorted, from the state held or start."""
    kind = batch.select(start.alias("s")).schema["s"].dataType
    fields, kind = kind.names, kind.simpleString()
    x = batch.select(key, row.alias("row"), F.lit(None).cast(kind).alias("held"))
    if held is not None:
        x = x.unionByName(held.select(key, F.struct(*fields).cast(kind).alias("held")), allowMissingColumns=True)
    x = x.groupBy(key).agg(F.sort_array(F.collect_list("row")).alias("rows"), F.first("held", ignorenulls=True).alias("held"))
    return x.select(key, F.aggregate("rows", F.coalesce("held", start.cast(kind)), step).alias("s")).select(key, *(f"s.{c}" for c in fields))


MACHINE = "best_probe double, best_full double, last_full double, idle int, syntax double, pending boolean, stopped boolean, reason string"
FIELDS = [c.split()[0] for c in MACHINE.split(", ")]


class StopProcessor(StatefulProcessor):
    """The stop machine of each key as value state, what it has been told as list state.

    Rows come in order of (ts, id) from batch to batch and are sorted within one. A row at or before the last one told has been told already,
    or comes too late to be told: it is left out, so a row that is delivered twice counts once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", f"{MACHINE}, seen bigint, stopped_at bigint, last_us bigint, last_id bigint")
        self.history = handle.getListState("history", "kind string, value double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.machine.get() if self.machine.exists() else None
        state = dict(zip([*FIELDS, "seen", "stopped_at", "last_us", "last_id"], held)) if held else {"seen": 0, "stopped_at": None, "last_us": None, "last_id": None}
        machine = Stopping(**{k: state[k] for k in FIELDS}) if held else Stopping()
        seen, at, last = state["seen"], state["stopped_at"], (state["last_us"], state["last_id"])
        told = []
        for r in sorted(rows, key=lambda r: (r.us, r.id)):
            if last[0] is not None and (r.us, r.id) <= last:
                continue
            last, seen = (r.us, r.id), seen + 1
            if not machine.stopped:
                advance(machine, r.kind, r.value, r.epoch, r.syntax, r.timeout)
                at = seen if machine.stopped else None
                told.append((r.kind, r.value))
        self.machine.update((*(getattr(machine, k) for k in FIELDS), seen, at, *last))
        if told:
            self.history.appendList(told)
        yield Row(key=key[0], seen=seen, stopped_at=at, reason=machine.reason, pending=machine.pending, best_probe=machine.best_probe, best_full=machine.best_full, history=sum(1 for _ in self.history.get()))

    def handleInitialState(self, key, initialState: Row, timerValues: TimerValues) -> None:
        """Takes up a snapshot: what the machine knows, without the history."""
        self.machine.update((*(initialState[k] for k in FIELDS), 0, None, None, None))

    def close(self) -> None:
        pass


def stop_stream(events: DataFrame, key: str, snapshots: DataFrame | None = None) -> DataFrame:
    """(key, seen, stopped_at, reason, pending, best_probe, best_full, history) whenever rows of a key come, as they stand then.

    events: a stream (key, ts, id, kind, value, epoch, syntax, timeout). snapshots: (key, the fields of Stopping.snapshot()), a table that machines
    start from; rows are counted anew from there. history: how many events the machine has been told. Start it within rocksdb().
    """
    kind = events.schema[key].dataType.simpleString()
    x = events.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").cast("bigint").alias("id"), "kind", *(F.col(c).cast("double").alias(c) for c in ("value", "epoch", "syntax", "timeout")))
    start = snapshots.select(F.col(key).alias("key"), *FIELDS).groupBy("key") if snapshots is not None else None
    out = x.groupBy("key").transformWithState(StopProcessor(), f"key {kind}, {FOLDED}, history bigint", "Update", "None", start)
    return out.withColumnRenamed("key", key)


class DropProcessor(StatefulProcessor):
    """The verdict of falling probes: the last probes and validations of each key, and whether a value was no number, as value state. Rows as StopProcessor has them."""

    def __init__(self, patience: int, min_delta: float, max_epochs: float):
        self.patience, self.min_delta, self.max_epochs = patience, min_delta, max_epochs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "probes array<double>, fulls array<double>, epoch double, nan boolean, seen bigint, us bigint, id bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        probes, fulls, epoch, nan, seen, *last = self.held.get() if self.held.exists() else ([], [], None, False, 0, None, None)
        probes, fulls, last = list(probes), list(fulls), tuple(last)
        for r in sorted(rows, key=lambda r: (r.us, r.id)):
            if last[0] is not None and (r.us, r.id) <= last:
                continue
            last, seen = (r.us, r.id), seen + 1
            if r.value is None or not math.isfinite(r.value):
                nan = True
            elif r.kind == "full":
                fulls, epoch = [*fulls, r.value][-2:], r.epoch
            else:
                probes = [*probes, r.value][-self.patience :]
        self.held.update((probes, fulls, epoch, nan, seen, *last))
        yield Row(key=key[0], seen=seen, verdict=self.verdict(probes, fulls, epoch, nan))

    def verdict(self, probes: list[float], fulls: list[float], epoch: float | None, nan: bool) -> str:
        """nan stops; `patience` probes, each min_delta below the one before, stop if the last validation fell too; so do max_epochs, unless probes wait to be confirmed."""
        fell = lambda xs: all(b < a - self.min_delta for a, b in zip(xs, xs[1:]))
        if nan:
            return "nan"
        if len(probes) >= self.patience >= 2 and fell(probes):
            return "awaiting" if len(fulls) < 2 else "confirmed" if fell(fulls) else "unconfirmed"
        return "max_epochs" if epoch is not None and epoch >= self.max_epochs else ""

    def close(self) -> None:
        pass


def drop_stream(events: DataFrame, key: str, patience: int, min_delta: float, max_epochs: float) -> DataFrame:
    """(key, seen, verdict) whenever rows of a key come; events as for stop_stream, without rates. Start it within rocksdb()."""
    kind = events.schema[key].dataType.simpleString()
    x = events.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").cast("bigint").alias("id"), "kind", *(F.col(c).cast("double").alias(c) for c in ("value", "epoch")))
    return x.groupBy("key").transformWithState(DropProcessor(patience, min_delta, max_epochs), f"key {kind}, seen bigint, verdict string", "Update", "None").withColumnRenamed("key", key)


def drop_states(batch: DataFrame, held: DataFrame | None, key: str, patience: int) -> DataFrame:
    """(key, probes, fulls, epoch, nan, seen, us, id): what DropProcessor holds of each key, folded by the engine. For Held."""
    row = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").cast("bigint").alias("id"), (F.col("kind") == "full").alias("full"), *(F.col(c).cast("double").alias(c) for c in ("value", "epoch")))
    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(*(F.array().cast("array<double>").alias(c) for c in ("probes", "fulls")), none("double").alias("epoch"), F.lit(False).alias("nan"), F.lit(0).cast("bigint").alias("seen"), none("bigint").alias("us"), none("bigint").alias("id"))

    def step(s, r):
        told = F.coalesce((r.us < s.us) | ((r.us == s.us) & (r.id <= s.id)), F.lit(False))
        bad, full = ~finite(r.value), F.coalesce(r.full, F.lit(False))
        last = lambda xs, n: F.concat(F.when(F.size(xs) >= n, F.slice(xs, 2, n - 1)).otherwise(xs), F.array(r.value))
        after = F.struct(
            F.when(bad | full, s.probes).otherwise(last(s.probes, patience)).alias("probes"), F.when(~bad & full, last(s.fulls, 2)).otherwise(s.fulls).alias("fulls"), F.when(~bad & full, r.epoch).otherwise(s.epoch).alias("epoch"),
            (s.nan | bad).alias("nan"), (s.seen + 1).alias("seen"), r.us.alias("us"), r.id.alias("id"),
        )
        return F.when(told, s).otherwise(after)

    return folded(batch, held, key, row, start, step)


def drop_verdict(patience: int, min_delta: float, max_epochs: float) -> Column:
    """DropProcessor.verdict of the fields of drop_states."""
    fell = lambda xs, n: F.forall(F.zip_with(F.slice(xs, 2, n), xs, lambda b, a: b.isNull() | (b < a - min_delta)), lambda x: x)
    streak = (F.size("probes") >= patience) & fell(F.col("probes"), patience) if patience >= 2 else F.lit(False)
    confirmed = F.when(F.size("fulls") < 2, "awaiting").when(fell(F.col("fulls"), 2), "confirmed").otherwise("unconfirmed")
    return F.when(F.col("nan"), "nan").when(streak, confirmed).when(F.col("epoch") >= max_epochs, "max_epochs").otherwise("")


def finite(value: Column) -> Column:
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def schedule(steps: DataFrame, every: int, origin_us: int, epoch_us: int, late: str, parts: int = 4) -> DataFrame:
    """(key, tier, mark, ts, step) of a stream of steps (key, ts, step): each mark fires once, with its earliest step, however late or often steps come.

    A run's epoch grows with event time from origin_us, by one each epoch_us, which `parts` divides. Tier 1: each step that `every` divides, over 0.
    Tier 2: each 1 / parts of an epoch that has begun, but for the very first. Tier 3: each whole epoch. Marks are windows of event time: one fires
    when the watermark, `late` behind the last step, has passed its end; later steps do not count. Start it within rocksdb().
    """
    if epoch_us % parts:
        raise ValueError("parts must divide epoch_us")
    x = steps.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    first = F.min(F.struct(F.unix_micros("ts").alias("us"), F.col("step").cast("bigint").alias("step"))).alias("first")

    def timed(tier: int, width: int) -> DataFrame:
        window = F.window("ts", f"{width} microseconds", None, f"{origin_us % width} microseconds")
        begun = x.where(F.unix_micros("ts") >= origin_us + width).groupBy("key", window.alias("w")).agg(first)
        mark = F.floor((F.unix_micros("w.start") - origin_us) / width).cast("bigint")
        return begun.select("key", F.lit(tier).alias("tier"), mark.alias("mark"), "first.us", "first.step")

    # Repeats of a step that `late` does not part are one.
    counted = x.where((F.col("step") > 0) & (F.col("step") % every == 0)).groupBy("key", F.col("step").cast("bigint").alias("mark"), F.session_window("ts", late)).agg(first)
    fired = counted.select("key", F.lit(1).alias("tier"), "mark", "first.us", "first.step").unionByName(timed(2, epoch_us // parts)).unionByName(timed(3, epoch_us))
    return fired.select("key", "tier", "mark", F.timestamp_micros("us").alias("ts"), "step")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, begin, end, n, total) of a stream of events (key, ts, value): rows less than `gap` apart are one session, which comes when the watermark has passed its end.

    A late row may join sessions that were two. One whose own session would have ended before the watermark is left out.
    """
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    x = x.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")
