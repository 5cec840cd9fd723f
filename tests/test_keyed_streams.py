"""Keyed streams: the stop machine killed in a batch and resumed, taken up from a snapshot; marks fired once; sessions and late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siftworks.operators import stopping
from siftworks.plans import catalogue, streams
from siftworks.streaming import keyed, monitor

PROBES = "user bigint, ts timestamp, id bigint, kind string, value double, epoch double, syntax double, timeout double"
START = dt.datetime(2024, 1, 1)


def probes(seed=1, users=6, each=40):
    rng, out, n = random.Random(seed), [], 0
    for k in range(each):
        for u in range(users):
            n += 1
            value = 0.4 if u == 5 else None if u == 1 and k == 25 else float("nan") if u == 2 and k == 18 else 0.02 * k + 0.001 * rng.random()
            bad = u == 4 and k == 11
            rates = (None, None) if rng.random() < 0.2 and not bad else (1 - 0.02 * rng.random() - (0.1 if u == 3 and k > 20 else 0), 0.1 if bad else None)
            out.append((u, START + dt.timedelta(minutes=n), n, rng.choice(["probe", "probe", "probe", "full"]), value, float(k // 20), *rates))
    return out


def run(spark, df, mode, write, log):
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def last(rows):
    return {r[0]: tuple(r)[1:7] for r in rows}


def test_machine_killed_in_a_batch_resumes(spark, tmp_path):
    """The second batch fails after its state is made; begun again, the stream ends with the rows of the batch fold."""
    rows = probes()
    path, log, got = f"{tmp_path}/in", f"{tmp_path}/log", {}
    tries = []

    def write(batch, i):
        rows = batch.collect()
        tries.append(i)
        if tries.count(i) == 1 and i == 1:
            raise RuntimeError("lost")
        got.update({r.user: tuple(r)[1:] for r in rows})

    third = len(rows) // 3
    with keyed.rocksdb(spark):
        for k in range(3):
            part = rows[k * third : (k + 1) * third if k < 2 else None]
            spark.createDataFrame(part + part[:7], PROBES).write.mode("append").parquet(path)
            stream = keyed.stop_stream(spark.readStream.schema(PROBES).parquet(path), "user")
            try:
                run(spark, stream, "update", write, log)
            except Exception:
                assert k == 1
                run(spark, stream, "update", write, log)
    assert tries.count(1) == 2
    want = last(stopping.fold(spark.createDataFrame(rows, PROBES), "user", ["ts", "id"]).collect())
    assert repr({u: r[:6] for u, r in sorted(got.items())}) == repr(dict(sorted(want.items())))
    assert {r[2] for r in want.values()} == {"", "bucket_missing", "nan_or_inf", "syntax_drop", "timeout_rate", "confirmed"}
    # What a machine has been told is kept, and nothing after it stopped.
    assert all(r[6] == (r[1] or r[0]) for r in got.values())


def test_setting_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with keyed.rocksdb(spark):
        assert spark.conf.get(key) != before
    assert spark.conf.get(key) == before


def test_machine_taken_up_from_a_snapshot(spark, tmp_path):
    """The histories are not restored: the first full validation after it is compared with the best probe."""
    machine = stopping.Stopping()
    for v in (0.5, 0.5, 0.5, 0.5, 0.5):
        machine.probe(v)
    machine.full(0.7, 0.0)
    machine.pending = True
    snapshot = {"user": 1} | machine.snapshot()
    snapshots = spark.createDataFrame([tuple(snapshot.values())], "user bigint, " + keyed.MACHINE)
    assert snapshot["last_full"] is None
    spark.createDataFrame([(1, START, 1, "full", 0.6, 0.0, 1.0, 0.0), (2, START, 2, "probe", 0.1, 0.0, 1.0, 0.0)], PROBES).write.parquet(f"{tmp_path}/in")
    got = {}
    with keyed.rocksdb(spark):
        stream = keyed.stop_stream(spark.readStream.schema(PROBES).parquet(f"{tmp_path}/in"), "user", snapshots)
        run(spark, stream, "update", lambda b, i: got.update({r.user: r for r in b.collect()}), f"{tmp_path}/log")
    # With the history 0.6 would not have beaten the 0.7 before it and the stop would be confirmed.
    assert (got[1].pending, got[1].reason, got[1].seen, got[1].best_full) == (False, "", 1, 0.7)
    assert got[2].best_probe == 0.1


def test_no_measurement_leaves_the_syntax_rate():
    machine = stopping.Stopping()
    machine.probe(0.5, syntax=0.94)
    machine.probe(0.5)
    assert machine.syntax == 0.94 and not machine.stopped
    machine.probe(0.5, timeout=0.01)
    assert machine.syntax == 1.0
    machine.probe(0.5, syntax=0.94)
    assert machine.reason == "syntax_drop"


@pytest.mark.parametrize("seed", [1, 2])
def test_marks_fire_once_in_any_order(spark, tmp_path, seed):
    """Steps shuffled within the watermark and delivered twice; the first of each mark is the one by time."""
    rng = random.Random(seed)
    hour, origin = 3_600_000_000, 1_704_067_200_000_000
    steps = [(u, 1 + 200 * u + k, k * hour // 2 + rng.randrange(hour // 4)) for u in range(3) for k in range(96)]
    when = [(us + rng.randrange(2 * hour), (u, START + dt.timedelta(microseconds=us), s)) for u, s, us in steps for _ in range(rng.choice([1, 1, 2]))]
    when.sort(key=lambda x: (x[0], x[1]))
    epoch = 12 * hour
    want = {}
    for u, s, us in sorted(steps, key=lambda x: (x[2], x[1])):
        for tier, mark in ((1, s if s % 10 == 0 else 0), (2, us * 4 // epoch), (3, us // epoch)):
            if mark > 0:
                want.setdefault((u, tier, mark), s)
    got, path = [], f"{tmp_path}/in"
    rows = [x[1] for x in when] + [(99, START + dt.timedelta(days=365), 0)]
    with keyed.rocksdb(spark):
        for k in range(3):
            n = len(rows) // 3
            spark.createDataFrame(rows[k * n : (k + 1) * n if k < 2 else None], "key bigint, ts timestamp, step bigint").write.mode("append").parquet(path)
            stream = keyed.schedule(spark.readStream.schema("key bigint, ts timestamp, step bigint").parquet(path), 10, origin, epoch, "3 hours")
            run(spark, stream, "append", lambda b, i: got.extend(((r.key, r.tier, r.mark), r.step) for r in b.collect()), f"{tmp_path}/log")
    got = [x for x in got if x[0][0] != 99]
    assert len(got) == len({k for k, _ in got}) and dict(got) == want


def test_late_row_joins_sessions_or_is_left_out(spark, tmp_path):
    at = lambda h, v: (1, START + dt.timedelta(hours=h), v)
    deliveries = [[at(0, 1.0), at(3, 1.0), at(20, 1.0)], [at(1.5, 1.0), at(40, 1.0)], [at(10, 9.0), at(31, 1.0), at(9000, 0.0)]]
    got = []
    for rows in deliveries:
        spark.createDataFrame(rows, "user bigint, ts timestamp, value double").write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed.sessions(spark.readStream.schema("user bigint, ts timestamp, value double").parquet(f"{tmp_path}/in"), "user", "2 hours", "24 hours")
        run(spark, stream, "append", lambda b, i: got.extend(b.select("n", "total", F.hour("begin")).collect()), f"{tmp_path}/log")
    # The row of 1:30 made one session of two; that of 10:00 came 30 hours behind the watermark's row and is lost.
    assert sorted((r[0], r[1]) for r in got) == [(1, 1.0), (1, 1.0), (1, 1.0), (3, 3.0)]


@pytest.mark.parametrize(
    "probes, fulls, epoch, nan, verdict",
    [
        ([0.9, 0.8, 0.7], [0.5, 0.4], 1, False, "confirmed"),
        ([0.9, 0.8, 0.7], [0.5, 0.5], 9, False, "unconfirmed"),
        ([0.9, 0.8, 0.7], [0.5], 9, False, "awaiting"),
        ([0.9, 0.8, 0.76], [0.5, 0.4], 1, False, ""),
        ([0.8, 0.7], [0.5, 0.4], 3, False, "max_epochs"),
        ([0.9, 0.8, 0.7], [0.5, 0.4], 1, True, "nan"),
        ([], [], None, False, ""),
    ],
)
def test_verdict_of_falling_probes(probes, fulls, epoch, nan, verdict):
    assert keyed.DropProcessor(3, 0.05, 3).verdict(probes, fulls, epoch, nan) == verdict


def test_marks_are_found_without_python(spark, tmp_path):
    """Windows of the engine, not a call for each key and mark."""
    steps = spark.readStream.schema("key bigint, ts timestamp, step bigint").parquet(str(tmp_path))
    plan = keyed.schedule(steps, 10, 1_704_067_200_000_000, 43_200_000_000, "3 hours")._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan
    with pytest.raises(ValueError):
        keyed.schedule(steps, 10, 0, 43_200_000_001, "3 hours")


def odd_rows(rng, start):
    some = [None, float("nan"), float("inf")]
    return [(rng.choice([None, 1, 2, 3, 4]), START + dt.timedelta(minutes=start + rng.randrange(40)), rng.randrange(5), rng.choice(["probe", "probe", "full"]), rng.choice(some) if rng.random() < 0.04 else rng.randrange(20) / 10, float(rng.randrange(5))) for _ in range(60)]


def test_streaks_folded_by_the_engine_are_those_of_the_processor(spark, tmp_path, monkeypatch):
    """Null keys, repeats within and between batches, values that are no number; a batch begun again counts once, and only two tables stay."""
    rng, shape = random.Random(4), "user bigint, ts timestamp, id bigint, kind string, value double, epoch double"
    states = keyed.Held(f"{tmp_path}/held", lambda batch, held: keyed.drop_states(batch, held, "user", 3))
    (tmp_path / "held").mkdir()
    told: dict = {}

    class Value:
        def __init__(self, key):
            self.key = key

        def exists(self):
            return self.key in told

        def get(self):
            return told[self.key]

        def update(self, value):
            told[self.key] = value

    processor, verdicts = keyed.DropProcessor(3, 0.05, 3), {}
    for i in range(4):
        rows = odd_rows(rng, 20 * i)
        batch = spark.createDataFrame(rows + rows[:9], shape)
        states(batch, i)
        states(batch, i)
        for user in {r[0] for r in rows}:
            processor.held = Value(user)
            us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            mine = sorted({(us(r[1]), r[2]): r for r in reversed(rows) if r[0] == user}.items())
            # Of rows with one time and id the engine tells the least; so they are made alike here.
            least = [min((r for r in rows if r[0] == user and (us(r[1]), r[2]) == k), key=lambda r: (r[3] == "full", r[4] is not None, r[4] != r[4], r[4] or 0, r[5])) for k, _ in mine]
            out = list(processor.handleInputRows((user,), iter([Row(us=us(r[1]), id=r[2], kind=r[3], value=r[4], epoch=r[5]) for r in least]), None))
            verdicts[user] = (out[0].seen, out[0].verdict)
        got = states.table(spark).select("user", "seen", keyed.drop_verdict(3, 0.05, 3).alias("verdict")).collect()
        assert {r.user: (r.seen, r.verdict) for r in got} == verdicts
    assert sorted(p.name for p in (tmp_path / "held").iterdir()) == ["2", "3"]


@pytest.mark.parametrize("probes, fulls, epoch, nan", [([0.9, 0.8, 0.7], [0.5, 0.4], 1, False), ([0.9, 0.8, 0.7], [0.5, 0.5], 9, False), ([0.9, 0.8, 0.7], [0.5], 9, False), ([0.9, 0.8, 0.76], [0.5, 0.4], 1, False), ([0.8, 0.7], [], 3, False), ([0.9], [0.5, 0.4], 1, True), ([], [], None, False)])
def test_verdict_of_the_engine(spark, probes, fulls, epoch, nan):
    x = spark.createDataFrame([(probes, fulls, epoch and float(epoch), nan)], "probes array<double>, fulls array<double>, epoch double, nan boolean")
    assert x.select(keyed.drop_verdict(3, 0.05, 3)).first()[0] == keyed.DropProcessor(3, 0.05, 3).verdict(probes, fulls, epoch, nan)


@pytest.mark.parametrize("patience, most", [(3, None), (1 << 30, None), (4, 9)])
def test_stops_folded_by_the_engine(spark, tmp_path, patience, most):
    rng, held = random.Random(5), None
    want: dict = {}
    for i in range(3):
        rows = [(k % 7 or None, 100 * i + k, v) for k in range(90) for v in [rng.choice([None, float("nan"), float("-inf")]) if rng.random() < 0.03 else rng.random() * (1 + k / 10)]]
        for user, _, v in rows:
            n, best, bad, reason = want.get(user, (0, float("-inf"), 0, ""))
            if not reason:
                number = v is not None and v == v and abs(v) != float("inf")
                better = number and v >= best + 1
                n, best, bad = n + 1, v if better else best, 0 if better else bad + number
                reason = "nan" if not number else "patience" if bad >= patience else "max" if most and n >= most else ""
            want[user] = (n, best, bad, reason)
        rng.shuffle(rows)
        monitor.stop_states(spark.createDataFrame(rows, "user bigint, ts bigint, v double"), held, "user", "v", ["ts"], patience=patience, most=most).write.parquet(f"{tmp_path}/{i}")
        held = spark.read.parquet(f"{tmp_path}/{i}")
    assert {r.user: tuple(r)[1:] for r in held.collect()} == want


@pytest.mark.parametrize("name", ["stream_nan_latch", "stream_drop_streak"])
def test_states_are_folded_without_python(spark, monkeypatch, name):
    """No call in Python for each key, no file that one task writes from the whole table."""
    plans, fold = [], keyed.folded

    def spy(*args):
        plans.append(fold(*args))
        return plans[-1]

    monkeypatch.setattr(keyed, "folded", spy)
    monkeypatch.setattr(monitor, "folded", spy)
    catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 3 and not any("Python" in p._jdf.queryExecution().executedPlan().toString() or "Pandas" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)


def test_parts_are_written_by_all_tasks(spark, tmp_path):
    """Rows without a time are in the last part."""
    rows = [(k, START + dt.timedelta(minutes=k) if k else None, k) for k in range(4000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, value bigint").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    for i in range(4):
        streams.feed(spark, str(tmp_path), f"{tmp_path}/{i}", range(i, i + 1))
    got = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(4)]
    assert sum(g.count() for g in got) == 4000 and got[3].where("ts is null").count() == 1
    assert min(len(g.inputFiles()) for g in got) > 1
