"""What fails on large tables only: ranges drawn anew, work that repeats, processes for each row."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from siftworks.functions import protocols, python_code, tokens
from siftworks.operators import sampling, simjoin
from siftworks.plans import catalogue, code_rows, shapes
from siftworks.plans import dedup as audits


def parsed(text):
    try:
        return json.loads(text)
    except ValueError:
        return None


def test_ranks_are_whole_where_ranges_rest_on_a_sample(spark):
    d = spark.range(200_000).repartition(7).select("id", F.sha2(F.col("id").cast("string"), 256).alias("draw"))
    ranked, n = sampling.ranks(d, ["draw", "id"])
    assert n == 200_000 and ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (n, 1, n)


def test_cuts_of_objects_alike_are_mended_once(spark, tmp_path, monkeypatch):
    """Calls are counted in a file, as they are made by other processes; ids of all signs and lengths, repeats and nulls give what each object on its own gives."""
    rows = [(k, "view", '{"k": 5}') for k in range(200)] + [(0, "view", '{"k": 7, "n": [1, {"a": "}"}]}'), (-3, "buy", '{"k": 5}'), (-3, "buy", "{"), (10**15, "view", '{"k": 5}'), (7, None, "{}"), (None, "view", "{}")]
    spark.createDataFrame(rows, "event_id bigint, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    calls = tmp_path / "calls"
    calls.touch()

    def counted(text):
        with open(calls, "a") as f:
            f.write("x" * len(text))
        return text.map(lambda t: None if t is None else protocols.repair_json(t))

    monkeypatch.setattr(shapes, "repaired", F.pandas_udf(counted, "string"))
    got = {r.event_id: tuple(r)[1:] for r in shapes.json_cut_repair(spark, str(tmp_path)).collect()}
    want: dict = {}
    for event, kind, props in rows:
        if event is None or kind is None:
            continue
        text = f'{{"id": {event}, "tags": ["{kind}", "a,]", {{"p": {props}}}], "note": "q\\"}}{{[", "end": true}}'
        cuts = [text[:k] for k in range(1, len(text) + 1)]
        mended = [protocols.repair_json(t) for t in cuts]
        right = [(m, parsed(m)) for m in mended if parsed(m) is not None]
        tags = [len(v["tags"]) for _, v in right if isinstance(v.get("tags"), list)]
        now = (len(cuts), sum(parsed(t) is not None for t in cuts), len(right), max((len(m) for m, _ in right), default=None), max(tags, default=None))
        old = want.get(event)
        want[event] = now if old is None else (*(a + b for a, b in zip(now[:3], old[:3])), max(now[3], old[3]), max(now[4], old[4]))
    assert got == want
    assert calls.stat().st_size < 2000


def test_samples_of_pytest_are_told_by_a_light_run(monkeypatch):
    """No report of every failure is written, and with `first` a sample ends with its first failure."""
    runs = []
    real = python_code.subprocess.run
    monkeypatch.setattr(python_code.subprocess, "run", lambda command, **more: runs.append(command) or real(command, **more))
    code, tests = "def f(x):\n    return x\n", "def test_a():\n    assert f(1) == 2\n\ndef test_b():\n    assert f(1) == 3\n\ndef test_c():\n    assert f(1) == 1\n"
    samples = [(code, tests), (code, tests[tests.index("def test_c") :]), ("def f(", tests), (code, "")]
    whole, short = python_code.pytest_many(samples), python_code.pytest_many(samples, first=True)
    assert [r["passed"] for r in whole] == [r["passed"] for r in short] == [False, True, False, False]
    assert [(r["collected"], r["failed"]) for r in whole] == [(3, 2), (1, 0), (0, 1), (0, 0)] and (short[0]["collected"], short[0]["failed"]) == (1, 1)
    assert len(runs) == 2 and all("--junitxml" not in c and "--tb=no" in c for c in runs)


def test_codes_are_dealt_to_tasks_by_their_number(spark, tmp_path):
    spark.range(400).selectExpr("id as doc_id", "concat('a b\nc d ', repeat('x', int(id))) as text", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    out = code_rows.boundary_outputs(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() == 8


def test_tokens_of_pieces_are_those_of_whole_texts():
    """Blanks of all kinds and in all numbers, contractions, digits, marks, code points beyond the first plane; known pieces are not encoded again."""
    with open(tokens.VOCABULARY, encoding="utf-8") as f:
        own = tokens.load(f.read())
    assert tokens.apart(own)
    draw = random.Random(7)
    signs = [" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u0085", "\x1c", "'s", "'", "ll", "a", "Z", "\u00e9", "\u4e2d", "\U0001f600", "1", "99", ".", "!?", "_", "<|endoftext|>", "the", "word"]
    texts = ["", " ", "a ", " a", "a  b", "it's all\n\n gone"] + ["".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(5000)]
    known: dict = {}
    assert tokens.counts(own, texts, known) == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]

    class Counted:
        pieces = 0

        def encode_batch_fast(self, x, **more):
            Counted.pieces += len(x)
            return own.encode_batch_fast(x, **more)

    assert sum(tokens.counts(Counted(), ["the word.\nword " * 500], {})) > 0 and Counted.pieces <= 7


def test_heads_that_no_other_set_has_go_no_farther(spark, monkeypatch):
    """What the join keeps grows with what sets share, not with their members."""
    kept = []
    monkeypatch.setattr(simjoin, "cut", lambda df: kept.append(df.cache().count()) or df)
    rows = [(i, [1000 * i + k for k in range(100)]) for i in range(50)] + [(90, list(range(1, 101)))]
    got = simjoin.jaccard_join(spark.createDataFrame(rows, "id bigint, members array<bigint>"), "id", "members").collect()
    assert [tuple(r)[:3] for r in got] == [(0, 90, 99)] and max(kept) <= 62


def test_sets_that_share_too_few_heads_go_no_farther(spark, monkeypatch):
    """A set that shares heads, but not as many as a pair needs, is dropped by their number; what is kept of the others has a row for a set, not for a head."""
    kept = []
    monkeypatch.setattr(simjoin, "cut", lambda df: kept.append(df.cache().count()) or df)
    rows = [(i, [10 * i + k for k in range(4)] + [10 * i + 10 + k for k in range(4)] + [simjoin.CELLS * (1000 * i + k) for k in range(1, 93)]) for i in range(60)]
    rows += [(100, list(range(5001, 5101))), (101, list(range(5001, 5100))), (102, list(range(5002, 5101)))]
    got = simjoin.jaccard_join(spark.createDataFrame(rows, "id bigint, members array<bigint>"), "id", "members").collect()
    assert sorted(tuple(r)[:3] for r in got) == [(100, 101, 99), (100, 102, 99), (101, 102, 98)] and max(kept) <= 3


def test_cells_of_many_sets_are_dealt_to_blocks(spark, monkeypatch):
    """Near copies, chance members in common, blocks of few members: all pairs, each once."""
    monkeypatch.setattr(simjoin, "MEMBERS", 300)
    monkeypatch.setattr(simjoin, "MET", 50)
    rng = random.Random(5)
    sets = [sorted({*rng.sample(range(40 * (i % 3), 40 * (i % 3) + 40), 36), *rng.sample(range(1000), 3)}) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, members array<bigint>").repartition(5)
    got = [tuple(r)[:3] for r in simjoin.jaccard_join(df, "id", "members", 70, 20).collect()]
    want = [(a, b, len({*x} & {*y})) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 100 * len({*x} & {*y}) > 70 * len({*x} | {*y})]
    assert sorted(got) == want and len(want) > 500


def test_blocked_audit_compares_hashes_of_grams(spark, tmp_path, monkeypatch):
    """Sets of numbers are joined, not of texts, and what texts of other buckets share is not met; the pairs are those of all pairs of a bucket."""
    draw, joined, own = random.Random(3), [], simjoin.jaccard_join
    monkeypatch.setattr(simjoin, "jaccard_join", lambda sets, *more: joined.append(sets) or own(sets, *more))
    common = [" ".join(draw.choices(["a", "b", "c", "d", "e"], k=40)) for _ in range(3)]
    texts = [None, "", "one two"] + [f"{common[i % 2]} w{i // 30}" for i in range(900)] + [f"  {common[0].upper()}\n w0 "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["ngram_blocked_audit"](spark, str(tmp_path)).collect()
    classes: dict = {}
    for i, t in enumerate(texts):
        if t is not None:
            classes.setdefault((" ".join(t.lower().split()), i % 3), []).append(i)
    sides = []
    for (t, split), ids in classes.items():
        words = t.split()
        sides.append((hashlib.sha256(t.encode()).hexdigest()[:2], ("train", "val", "test")[split], min(ids), len(ids), {tuple(words[k : k + 3]) for k in range(len(words) - 2)}))
    want = [(a[2], a[3], b[2], b[3], round(len(a[4] & b[4]) / len(a[4] | b[4]), 6)) for a in sides for b in sides if a[0] == b[0] and a[1] < b[1] and len(a[4] & b[4]) > 0.7 * len(a[4] | b[4]) > 0]
    assert sorted(map(tuple, got)) == sorted(want) and want
    (sets,) = joined
    assert dict(sets.dtypes)["grams"] == "array<bigint>"


def test_blocked_audit_keeps_no_grams(spark, tmp_path, monkeypatch):
    """What is kept of the texts is a row of numbers and a bucket for each; grams are made from the texts when they are read."""
    kept, own = [], code_rows.cut
    monkeypatch.setattr(audits, "cut", lambda df: kept.append(df.columns) or own(df))
    rows = [(0, "A\u00e9 b c d e f g h"), (1, "a b c d e f g H"), (2, "a\nb c d e f g h "), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    catalogue.queries()["ngram_blocked_audit"](spark, str(tmp_path)).collect()
    assert kept == [["doc", "split", "members", "bucket"]]


def test_neighbours_are_shuffled_once(spark, tmp_path):
    """Sets of numbers go once to blocks of ids, without a join; ids on the edges of blocks, gaps, repeats, nulls and texts without grams."""
    ids = [-257, -256, -1, 0, 1, 1, 2, 2, 5, 254, 255, 256, 257, 511, 512, None]
    rows = [(i, None if i == 5 else "" if i == 257 else f"a b c d e{k % 3} f g") for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.queries()["jaccard_neighbours"](spark, str(tmp_path))
    grams = lambda t: {tuple((t or "").split()[k : k + 3]) for k in range(max(0, len((t or "").split()) - 2))}
    want = [(i, round(len(grams(s) & grams(t)) / max(1, len(grams(s) | grams(t))), 6)) for i, s in rows for j, t in rows if i is not None and j == i + 1]
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 12
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Window") >= 1
