"""Queries that run Structured Streaming over the events, part by part in order of time, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import keyed, monitor
from .catalogue import register, table
from .procedural import STOP_SQL, probe_rows

PARTS = 4


def feed(spark: SparkSession, sf_dir: str, path: str, parts: range = range(PARTS)) -> None:
    """Files of events in ranges of time that follow each other, each written by as many tasks as read the table; rows without a time come last."""
    x = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = x.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    width = max(1, ((ends.hi or 0) - (ends.lo or 0)) // PARTS + 1)
    part = F.coalesce(F.floor((F.unix_micros("ts") - (ends.lo or 0)) / width), F.lit(PARTS - 1))
    for i in parts:
        x.where(part == i).write.mode("append").parquet(path)


def stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema
    return spark.readStream.schema(schema).parquet(path)


def run(df: DataFrame, mode: str, out: str, checkpoint: str) -> None:
    """Runs a stream to the end of its input. Each batch goes to a folder of its own, so that one that is repeated after a failure replaces itself."""
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@register("stream_window_rates", "ST2 B12", "select event_type, LONG(floor(EPOCH(ts) / 3600)) as hour, LONG(count(*)) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_window_rates(spark, sf_dir):
    """Hourly counts and sums as they stand after the last batch."""
    path, out, checkpoint = (scratch.folder(spark, k) for k in ("events", "rates", "rates-log"))
    for i in range(PARTS):
        feed(spark, sf_dir, path, range(i, i + 1))
        run(monitor.windowed_rates(stream(spark, sf_dir, path), "1 hour", late="400 days"), "update", out, checkpoint)
    got = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return got.select("event_type", F.floor(F.unix_timestamp(F.col("window.start")) / 3600).cast("bigint").alias("hour"), "last.n", F.round("last.total", 4).alias("total"))


@register(
    "stream_nan_latch",
    "ST1 ST3 B13",
    "with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as rn from events), k as (select user_id, min(case when value > 90 then rn end) as first_bad, LONG(count(*)) as n from e group by user_id) select user_id, LONG(coalesce(first_bad, n)) as n, first_bad is not null as latched from k",
)
def stream_nan_latch(spark, sf_dir):
    """Values over 90 stand for no number: a user's state latches at the first and counts no further."""
    x, lo, width = timed(spark, sf_dir)
    value = F.when(F.col("value") > 90, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = x.select("user_id", "ts", "event_id", value.alias("value"), F.coalesce(F.floor((F.col("us") - lo) / width), F.lit(DELIVERIES - 1)).alias("number"))
    states = keyed.Held(scratch.folder(spark, "latch"), lambda batch, held: monitor.stop_states(batch, held, "user_id", "value", ["ts", "event_id"], patience=1 << 30))
    delivered_to(spark, rows, F.col("number"), states)
    return states.table(spark).select("user_id", "n", (F.col("reason") == "nan").alias("latched"))


@register("stream_resume", "ST6 ST4", "select event_type, LONG(count(*)) as n, LONG(count(distinct event_id)) as ids from events group by event_type")
def stream_resume(spark, sf_dir):
    """A stream stopped after half of the parts and started again from its log, with the rest there: each event once."""
    path, out, checkpoint = (scratch.folder(spark, k) for k in ("events", "seen", "seen-log"))
    for parts in (range(PARTS // 2), range(PARTS // 2, PARTS)):
        feed(spark, sf_dir, path, parts)
        run(stream(spark, sf_dir, path), "append", out, checkpoint)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


DELIVERIES = 3


def timed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """(events with ts as a timestamp and us, its microseconds; the least us; a third of their range and a bit)."""
    x = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    ends = x.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    return x, ends.lo or 0, max(1, ((ends.hi or 0) - (ends.lo or 0)) // DELIVERIES + 1)


def delivered(spark: SparkSession, rows: DataFrame, number, build, mode: str) -> DataFrame:
    """What the stream build(source) has put out, with its batch, once rows came in DELIVERIES by their number, the stream being stopped after each and started again from its log."""
    path, out, log = (scratch.folder(spark, k) for k in ("delivered", "out", "log"))
    with keyed.rocksdb(spark):
        for i in range(DELIVERIES):
            rows.where(number == i).write.mode("append").parquet(path)
            run(build(spark.readStream.schema(rows.schema).parquet(path)), mode, out, log)
    for folder in (path, log):  # what came out is read later
        scratch.remove(spark, folder)
    return spark.read.parquet(out)


def delivered_to(spark: SparkSession, rows: DataFrame, number, apply) -> None:
    """Calls apply(batch, its number) for rows that come in DELIVERIES by their number, the stream being started again for each."""
    path, log = (scratch.folder(spark, k) for k in ("delivered", "log"))
    for i in range(DELIVERIES):
        rows.where(number == i).write.mode("append").parquet(path)
        q = spark.readStream.schema(rows.schema).parquet(path).writeStream.foreachBatch(apply).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
    for folder in (path, log):
        scratch.remove(spark, folder)


@register("stop_machine_stream", "ST3 ST4", STOP_SQL)
def stop_machine_stream(spark, sf_dir):
    """The stop machine as keyed state, stopped and resumed from its state store between deliveries; every row is delivered twice."""
    x, lo, width = timed(spark, sf_dir)
    rows, nth = probe_rows(x), F.floor((F.unix_micros("ts") - lo) / width)
    twice = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    got = delivered(spark, twice, F.least(nth + F.col("again"), F.lit(DELIVERIES - 1)), lambda source: keyed.stop_stream(source, "user_id"), "update")
    last = got.groupBy("user_id").agg(F.max_by(F.struct("seen", "stopped_at", "reason", "pending", "best_probe", "best_full"), "batch").alias("last"))
    return last.select("user_id", "last.*")


@register(
    "stream_drop_streak",
    "ST5 W5 W7",
    """with e as (select user_id, event_type = 'purchase' as full_, case when event_id % 997 = 5 then null else value / 100 end as value, (event_id * 7919 + 13) % 4 as epoch, ts, event_id from events),
    f as (select *, row_number() over (partition by user_id, full_, value is null order by ts desc, event_id desc) as back from e), g as (select user_id, LONG(count(*)) as seen, bool_or(value is null) as nan,
    max(case when not full_ and value is not null and back = 1 then value end) as p1, max(case when not full_ and value is not null and back = 2 then value end) as p2, max(case when not full_ and value is not null and back = 3 then value end) as p3,
    max(case when full_ and value is not null and back = 1 then value end) as f1, max(case when full_ and value is not null and back = 2 then value end) as f2, max(case when full_ and value is not null and back = 1 then epoch end) as epoch from f group by user_id)
    select user_id, seen, case when nan then 'nan' when p1 < p2 - 0.05 and p2 < p3 - 0.05 then case when f2 is null then 'awaiting' when f1 < f2 - 0.05 then 'confirmed' else 'unconfirmed' end when epoch >= 3 then 'max_epochs' else '' end as verdict from g""",
)
def stream_drop_streak(spark, sf_dir):
    """Three probes that fall by 0.05, confirmed by validations or not, as each user stands at the end of three deliveries, the rows of one coming twice."""
    x, lo, width = timed(spark, sf_dir)
    value = F.when(F.col("event_id") % 997 != 5, F.col("value") / 100)
    kind = F.when(F.col("event_type") == "purchase", "full").otherwise("probe")
    rows = x.select("user_id", "ts", F.col("event_id").alias("id"), kind.alias("kind"), value.alias("value"), ((F.col("event_id") * 7919 + 13) % 4).cast("double").alias("epoch"), F.floor((F.col("us") - lo) / width).alias("number"))
    rows = rows.unionByName(rows.where("number = 0").withColumn("number", F.col("number") + 1))
    states = keyed.Held(scratch.folder(spark, "streaks"), lambda batch, held: keyed.drop_states(batch, held, "user_id", 3))
    delivered_to(spark, rows, F.col("number"), states)
    return states.table(spark).select("user_id", "seen", keyed.drop_verdict(3, 0.05, 3).alias("verdict"))


# Every 25th step; epochs of 5 days from 2024-01-01, in four parts.
EVERY, ORIGIN_US, EPOCH_US = 25, 1_704_067_200_000_000, 5 * 86_400_000_000


@register(
    "stream_schedule",
    "ST2 W9",
    f"with e as (select user_id, event_id, epoch_us(ts) as us from events), m as (select user_id, event_id, us, 1 as tier, event_id as mark from e where event_id > 0 and event_id % {EVERY} = 0 union all select user_id, event_id, us, 2, (us - {ORIGIN_US}) * 4 // {EPOCH_US} from e where (us - {ORIGIN_US}) * 4 // {EPOCH_US} > 0 union all select user_id, event_id, us, 3, (us - {ORIGIN_US}) // {EPOCH_US} from e where (us - {ORIGIN_US}) // {EPOCH_US} > 0) select user_id, tier, LONG(mark) as mark, arg_min(event_id, (us, event_id)) as step from m group by user_id, tier, mark",
)
def stream_schedule(spark, sf_dir):
    """Each mark of each user's run fires once, with its first step, although steps come up to two hours late and every tenth comes twice."""
    x, lo, width = timed(spark, sf_dir)
    late = F.col("us") + F.col("event_id") % 9 * 900_000_000
    number = F.least(F.floor((late - lo) / width), F.lit(DELIVERIES - 1))
    steps = x.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("step"), number.cast("int").alias("number"))
    again = steps.where("step % 10 = 0").withColumn("number", F.least(F.col("number") + 1, F.lit(DELIVERIES - 1)))
    # A last step of no user, years on, lets the watermark pass all marks.
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("key"), F.timestamp_micros(F.lit(lo + 400 * DELIVERIES * width)).alias("ts"), F.lit(0).cast("bigint").alias("step"), F.lit(DELIVERIES - 1).alias("number"))
    rows = steps.unionByName(again).unionByName(end)
    got = delivered(spark, rows, F.col("number"), lambda source: keyed.schedule(source, EVERY, ORIGIN_US, EPOCH_US, "3 hours"), "append")
    return got.where("key >= 0").select(F.col("key").alias("user_id"), "tier", "mark", "step")


GAP_HOURS, LATE_HOURS = 6, 24
# Every 20th event comes with the last delivery. Then the watermark stands LATE_HOURS before the last event of the deliveries before.
KEPT = f"""e as (select user_id, event_id, ts, value, epoch_us(ts) as us, event_id % 20 = 0 as held from events), b as (select min(us) as lo, (max(us) - min(us)) // {DELIVERIES} + 1 as width from e),
w as (select (max(us) // 1000 - {LATE_HOURS} * 3600000) * 1000 as mark from e, b where not held and (us - lo) // width < {DELIVERIES - 1}),
k as (select e.*, held and us + {GAP_HOURS} * 3600000000 <= mark as late from e, w)"""


def _islands(name: str, rows: str, which: str) -> str:
    """DuckDB's table `name`: rows with the number of their session, which rows GAP_HOURS apart begin."""
    order = "over (partition by user_id order by us, event_id)"
    return f"{name}_ as (select *, us - lag(us) {order} as step from {rows} where {which}), {name} as (select *, sum(case when step is null or step >= {GAP_HOURS} * 3600000000 then 1 else 0 end) {order} as session from {name}_)"


@register(
    "stream_sessions",
    "ST2",
    # Sessions of the first deliveries that end before the watermark are closed; rows that come later do not join them.
    f"with {KEPT}, v as (select k.*, held or (us - lo) // width >= {DELIVERIES - 1} as last from k, b where not late), {_islands('p', 'v', 'not last')}, c as (select user_id, session, max(us) + {GAP_HOURS} * 3600000000 <= (select mark from w) as closed from p group by user_id, session), "
    f"z as (select p.*, closed from p join c using (user_id, session)), o as (select user_id, event_id, us, value from z where not closed union all select user_id, event_id, us, value from v where last), {_islands('q', 'o', 'true')}, "
    f"s as (select user_id, us, value, 'closed' || session as session from z where closed union all select user_id, us, value, 'open' || session from q) "
    f"select user_id, LONG(min(us)) as begin_us, LONG(max(us) + {GAP_HOURS} * 3600000000) as end_us, LONG(count(*)) as n, round(sum(value), 4) as total from s group by user_id, session",
)
def stream_sessions(spark, sf_dir):
    """Sessions of each user, as merged by rows that come late; those behind the watermark are left out."""
    got = _sessions(spark, sf_dir)
    return got.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 4).alias("total"))


@register("stream_late_rows", "ST2", f"with {KEPT} select COUNT_IF(not late) as kept, COUNT_IF(late) as late, COUNT_IF(held and not late) as late_but_kept from k")
def stream_late_rows(spark, sf_dir):
    """How many rows the sessions hold, and how many came behind the watermark."""
    events = table(spark, sf_dir, "events").agg(F.count("*").alias("rows"), F.count_if(F.col("event_id") % 20 == 0).alias("held"))
    kept = _sessions(spark, sf_dir).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    return kept.join(events).select("kept", (F.col("rows") - F.col("kept")).alias("late"), (F.col("held") - F.col("rows") + F.col("kept")).alias("late_but_kept"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, lo, width = timed(spark, sf_dir)
    number = F.when(F.col("event_id") % 20 == 0, DELIVERIES - 1).otherwise(F.floor((F.col("us") - lo) / width)).cast("int")
    rows = x.select("user_id", "ts", "value", number.alias("number"))
    # A last event of no user, years on, ends all sessions.
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.timestamp_micros(F.lit(lo + 400 * DELIVERIES * width)).alias("ts"), F.lit(0.0).alias("value"), F.lit(DELIVERIES - 1).alias("number"))
    got = delivered(spark, rows.unionByName(end), F.col("number"), lambda source: keyed.sessions(source, "user_id", f"{GAP_HOURS} hours", f"{LATE_HOURS} hours"), "append")
    return got.where("user_id >= 0")
