"""The pipeline's stages end to end against brute force, on tables with clashing columns, and the queries as registered."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from test_line_recall import brute_gone
from test_operators import WORD, brute_mix, brute_print

import __spark_entry__ as entry
import corpus_pipeline
from siftworks.llm import pareto_mix, queries, sp_tokenizer, toxicity_fm


def test_stages_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if k == 0:
            toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            assert docs.count() > 0.8 * n and docs.where(docs.doc_id.isin(list(toxic))).count() < 0.5 * len(toxic) + 5
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(docs.columns) and docs.where("not (round_trip and parity)").count() == 0


def small(seed=5):
    """(doc_id, text, lang, source, n_chars) with toxic words, near copies, shared and changed lines, blank and null texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(line(rng.randint(6, 25)) for _ in range(rng.randint(2, 6))) for _ in range(90)]
    shared = line(30)
    for i in range(0, 40, 4):
        texts[i] += "\n" + (shared if i % 8 else shared.replace(shared.split()[3], "other", 1))
    for i in range(0, 90, 3):
        texts[i] += "\n" + line(8) + " scum moron " + line(5)
    texts += [texts[1], texts[2] + "\n" + texts[4], "", None, "   ", texts[5].replace(texts[5].split()[2], "changed", 1)]
    return [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = small()
    labels = [(i, 1, int("scum" in (t or ""))) for i, t, *_ in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # 1: terms and pairs summed one by one
    machine = toxicity_fm.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    place = {int(k): i for i, k in enumerate(machine.known)}

    def score(text):
        at = [place[t] for t in toxicity_fm.terms(text).tolist() if t in place]
        margin = machine.bias + sum(machine.weight[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i, j in combinations(at, 2))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    clean = [r for r in rows if score(r[1]) < 0.7]
    assert 40 < len(clean) < len(rows) - 15
    # 2: all pairs of lines
    gone = brute_gone(clean)
    cut = [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone), s) for i, t, _, s, _ in clean]
    assert len(gone) > 8
    # 3: all pairs of fingerprints
    prints, up = [brute_print(t) for _, t, _ in cut], list(range(len(cut)))
    for a, b in combinations(range(len(cut)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and up[a] != up[b]:
            low, high = sorted((up[a], up[b]))
            up = [low if u == high else u for u in up]
    kept = [r for k, r in enumerate(cut) if up[k] == k]
    # 4: shares, ranks and the gap, document by document
    spark.createDataFrame([(i, t) for i, t, _ in kept], "doc_id bigint, text string").createOrReplaceTempView("kept")
    facts = {r.doc_id: r for r in spark.table("kept").select("doc_id", pareto_mix.uniform("doc_id", F.xxhash64("text")).alias("u"), F.xxhash64("text").alias("h")).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in kept}
    taken = brute_mix([(i, s, size[i], facts[i].h) for i, _, s in kept], [facts[i].u for i, *_ in kept])
    copies = {i: taken[k] // size[i] if size[i] else 1 for k, (i, *_) in enumerate(kept)}
    # 5: the other library
    own = sp_tokenizer.load(sp_tokenizer.model_bytes())[1]
    want = Counter({(i, len(own.encode(t or ""))): copies[i] for i, t, _ in kept if copies[i]})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want and all(r.round_trip and r.parity for r in got)


def test_clashing_columns_nulls_and_empty_tables(spark, docs, rows, none, labels):
    """Every query's operator and every stage on columns named as what operators use inside, and on no rows."""
    clash = docs.withColumnsRenamed({"fp": "_id", "size": "_hash", "target": "slot"}).withColumns({c: F.lit(1) for c in ("_lang", "_toxic", "toxic", "score", "held_out", "row", "u", "rank", "at", "arc", "form", "key", "n_lines", "media", "text_hash", "part", "level", "h")})
    from siftworks.llm import crossparse_lang, importance_duckdb, kn_quality, line_dedup, png_media, ring_sharding, secrets_crf, simhash_gray, spelling_wavelet

    machine = toxicity_fm.train(clash, labels)
    reports = [secrets_crf.scan_secrets, lambda d: toxicity_fm.score(d, machine), png_media.media_features, kn_quality.quality, crossparse_lang.identify, ring_sharding.assign, line_dedup.line_report, simhash_gray.near_duplicates, sp_tokenizer.token_report, pareto_mix.mix_report]
    for f in reports:
        assert f(clash).count() == len(rows) and f(clash.where("false")).count() == 0
    more = clash.withColumns({c: F.lit(1) for c in ("word", "n", "run", "id", "root", "buckets", "counts", "weight", "n_words", "n_features", "_ahead")})
    assert importance_duckdb.importance_report(more, docs).count() == len(rows) and importance_duckdb.importance_report(more.where("false"), docs).count() == 0
    assert importance_duckdb.resample(more, docs, percent=100, least_words=0).count() == len(rows)
    assert spelling_wavelet.variant_report(more).count() > 0 and spelling_wavelet.variant_report(more.where("false")).count() == 0
    for f in (secrets_crf.redact, lambda d: toxicity_fm.keep_clean(d, machine), line_dedup.dedup_lines, simhash_gray.keep_representatives, pareto_mix.mix):
        out = f(clash)
        assert out.columns == clash.columns and out.count() > 0 and f(clash.where("false")).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.queries()) <= set(names)
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert sorted(n.split("_")[0] for n in queries.oracle_sql()) == ["op11", "op12", "op13"]
