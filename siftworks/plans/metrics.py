"""Conditional rates, breakdowns, percentiles, hashes, model comparison and its statistics."""

from pyspark.sql import functions as F

from .catalogue import both, register, table

# Outcomes: a labelled document is a task result; three derived models stand for evaluated ones.
OUT = "o as (select d.doc_id, d.source as family, d.lang, case when d.lang = 'en' then 'code_generation' when d.lang = 'fr' then 'static_repair' else 'execution_repair' end as task_type, d.n_chars, d.n_chars > 40 as syntax_ok, l.quality = 1 as public_passed, l.quality = 1 and d.n_chars < 3000 as hidden_passed, d.n_chars > 100 as hidden_present, l.toxic = 1 as timed_out, d.n_chars % 7 <> 0 as format_ok, case when d.lang <> 'en' and d.n_chars % 5 > 0 then l.quality = 1 end as repaired, case when d.n_chars % 3 > 0 then l.toxic = 1 end as broke from documents d join labels l on l.doc_id = d.doc_id)"
MODELS = "m as (select 0 as ord, 'base' as model, doc_id, family, task_type, public_passed and n_chars % 3 > 0 as passed from o union all select 1, 'stage2', doc_id, family, task_type, public_passed and n_chars % 5 > 0 from o union all select 2, 'stage3', doc_id, family, task_type, hidden_passed or n_chars % 11 = 0 from o)"
PAIRS = "p as (select 'base' as a, 'stage2' as b union all select 'stage2', 'stage3' union all select 'base', 'stage3')"
FLIPS = "x as (select p.a, p.b, u.doc_id, u.family, u.task_type, u.passed as pa, v.passed as pb from p join m u on u.model = p.a join m v on v.model = p.b and v.doc_id = u.doc_id)"
BC = "c as (select a, b, COUNT_IF(pa and not pb) as lost, COUNT_IF(pb and not pa) as won, LONG(count(*)) as n from x group by a, b)"
CODE = "task_type = 'code_generation'"
REPAIR = "task_type <> 'code_generation'"

both(
    "summarize_outcomes",
    "A1 A2 A3 A4 A5 A6 B5",
    f"with {OUT} select DOUBLE(count(*)) as total, RATE(COUNT_IF({CODE} and syntax_ok and public_passed and hidden_passed and not timed_out), COUNT_IF({CODE})) as pass_at_1, RATE(COUNT_IF(syntax_ok), count(*)) as syntax_rate, RATE(COUNT_IF(format_ok), count(*)) as format_compliance, RATE(COUNT_IF(timed_out), count(*)) as timeout_rate, RATE(COUNT_IF(hidden_present and hidden_passed), COUNT_IF(hidden_present)) as hidden_pass_rate, RATE(COUNT_IF({REPAIR} and SAFE(repaired)), COUNT_IF({REPAIR})) as repair_success_rate, RATE(COUNT_IF({REPAIR} and SAFE(broke)), COUNT_IF({REPAIR})) as regression_rate, DOUBLE(COUNT_IF({CODE})) as n_code, DOUBLE(COUNT_IF({REPAIR})) as n_repair from o",
)
both("empty_outcomes", "A1", f"with {OUT} select RATE(COUNT_IF(syntax_ok), count(*)) as syntax_rate, LONG(count(*)) as n from o where doc_id < 0")
both("per_task_type", "A7 A37", f"with {OUT} select task_type, LONG(count(*)) as total, COUNT_IF(public_passed and hidden_passed) as passed, COUNT_IF(syntax_ok) as syntax, COUNT_IF(format_ok) as format from o group by task_type")
both("family_pass", "A8 A41", f"with {OUT}, f as (select family, EVERY(public_passed and hidden_passed) as ok, LONG(count(*)) as n from o group by family) select family, ok, n, round(avg(case when ok then 1.0 else 0.0 end) over (), 6) as pass_rate from f".replace("1.0 else 0.0", "DOUBLE(1) else DOUBLE(0)"))
both("family_gain_loss", "A9", f"with {OUT}, {MODELS}, {PAIRS}, {FLIPS}, f as (select a, b, family, EVERY(pa) as pa, EVERY(pb) as pb from x group by a, b, family) select a, b, COUNT_IF(pb and not pa) as gained, COUNT_IF(pa and not pb) as lost, COUNT_IF(pb and not pa) - COUNT_IF(pa and not pb) as net from f group by a, b")
both("pair_compare", "J1 J13 A10", f"with {OUT}, {MODELS}, {PAIRS}, {FLIPS} select a, b, COUNT_IF(pb and not pa) as win, COUNT_IF(pa and not pb) as loss, COUNT_IF(pa = pb) as same, JOIN(SLICE(SORTED_LIST(case when pb and not pa then lpad(TEXT(doc_id), 8, '0') end), 1, 5), ',') as won_ids from x group by a, b".replace("SORTED_LIST(case when pb and not pa then lpad(TEXT(doc_id), 8, '0') end)", "WHERE_EACH(SORTED_LIST(case when pb and not pa then lpad(TEXT(doc_id), 8, '0') else '~' end), x <> '~')"))
both("bug_type_breakdown", "A11 P7", f"with {OUT} select case when family like '%1%' then 'off_by_one' when family like '%2%' then 'index_error' else 'other' end as bug_type, LONG(count(*)) as total, COUNT_IF(SAFE(repaired)) as repaired from o where {REPAIR} group by 1")
both("oracle_router", "A12 J2", f"with {OUT}, {MODELS}, k as (select doc_id, ANY_OF(passed) as passed, count(distinct model) as models from m group by doc_id having count(distinct model) = 3) select LONG(count(*)) as n, RATE(COUNT_IF(passed), count(*)) as oracle_rate from k")
both("best_model_per_type", "A14 O4", f"with {OUT}, {MODELS}, r as (select task_type, model, ord, RATE(COUNT_IF(passed), count(*)) as rate from m group by task_type, model, ord), k as (select *, row_number() over (partition by task_type order by rate desc, ord) as rn from r) select task_type, model, rate from k where rn = 1")
both(
    "router_lift",
    "A13 J9 T6",
    f"with {OUT}, {MODELS}, r as (select task_type, model, ord, avg(case when passed then DOUBLE(1) else DOUBLE(0) end) as rate from m where doc_id % 2 = 0 group by task_type, model, ord), policy as (select task_type, model from (select *, row_number() over (partition by task_type order by rate desc, ord) as rn from r) q where rn = 1), h as (select * from m where doc_id % 2 = 1), routed as (select t.doc_id, t.task_type, SAFE(h.passed) as passed from (select distinct doc_id, task_type from h) t left join policy on policy.task_type = t.task_type left join h on h.model = policy.model and h.doc_id = t.doc_id), s as (select RATE(COUNT_IF(passed), count(*)) as routed from routed), b as (select max(rate) as best from (select model, RATE(COUNT_IF(passed), count(*)) as rate from h group by model) q), o2 as (select RATE(COUNT_IF(any_pass), count(*)) as oracle from (select doc_id, ANY_OF(passed) as any_pass from h group by doc_id) q) select routed, best, oracle, round(routed - best, 6) as lift, case when routed - best >= 0.02 then 'GO' when oracle - best >= 0.05 then 'SIGNAL' else 'NO-GO' end as verdict from s cross join b cross join o2",
)
both(
    "mcnemar",
    "T1",
    f"with {OUT}, {MODELS}, {PAIRS}, {FLIPS}, {BC}, e as (select a, b, lost, won, won + lost as n, least(won, lost) as k, i from (select a, b, lost, won, EXPLODE(RANGE(0, LONG(least(won, lost)))) as i from c) q), t as (select a, b, lost, won, n, i, sum(case when i = 0 then -n * ln(DOUBLE(2)) else ln(DOUBLE(n - i + 1) / DOUBLE(i)) end) over (partition by a, b order by i) as logp from e) select a, b, lost, won, round(least(DOUBLE(1), case when won + lost = 0 then DOUBLE(1) else 2 * sum(exp(logp)) end), 6) as p_value from t group by a, b, lost, won",
)
both("wilson_lower", "T3", f"with {OUT}, y as (select task_type, DOUBLE(count(*)) as n, DOUBLE(COUNT_IF(public_passed)) / count(*) as p from o group by task_type) select task_type, LONG(n) as n, round(case when p = 0 then DOUBLE(0) else (p + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(p * (1 - p) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n) end, 6) as lower_bound from y")
both("hard_constraint", "T7", f"with {OUT}, {MODELS}, r as (select model, ord, avg(case when passed then DOUBLE(1) else DOUBLE(0) end) as rate from m group by model, ord) select r.model, round((z.rate - r.rate) * 100, 6) as drop_pp, (z.rate - r.rate) * 100 > 3.0 as violated from r cross join (select rate from r where ord = 0) z")
both("protocol_verdict", "T8", "with r as (select role, avg(case when length(text) > 20 then DOUBLE(1) else DOUBLE(0) end) as parse, avg(case when length(text) < 2000 then DOUBLE(1) else DOUBLE(0) end) as valid from conversations group by role) select role as protocol, round((parse + valid) / 2, 6) as score, case when parse >= 0.95 and valid >= 0.9 then 'PASS' when parse >= 0.5 then 'PARTIAL' else 'FAIL' end as verdict from r")
both("comparability", "T9 J10", f"with {OUT}, u as (select doc_id from o where doc_id % 5 > 0), v as (select doc_id from o where doc_id % 7 > 0), j as (select u.doc_id as a, v.doc_id as b from u full outer join v on u.doc_id = v.doc_id) select COUNT_IF(b is null) as only_a, COUNT_IF(a is null) as only_b, COUNT_IF(a is not null and b is not null) as shared, COUNT_IF(a is null or b is null) = 0 as comparable from j")
both("delta_labels", "T10 X25", f"with {OUT}, {MODELS}, r as (select model, ord, round(avg(case when passed then DOUBLE(1) else DOUBLE(0) end), 4) as rate from m group by model, ord) select r.model, case when abs(r.rate - z.rate) < 0.001 then 'same' when r.rate > z.rate then 'up' else 'down' end as delta, concat(TEXT(LONG(round(r.rate * 1000, 0))), ' permille') as label from r cross join (select rate from r where ord = 0) z")
both("composite_score", "A36", f"with {OUT}, r as (select task_type, avg(case when public_passed then DOUBLE(1) else DOUBLE(0) end) as rate from o group by task_type) select round(sum(case task_type when 'code_generation' then 0.4 when 'static_repair' then 0.3 else 0.3 end * rate), 6) as composite, LONG(count(*)) as buckets from r".replace("0.4", "DOUBLE(0.4)").replace("0.3", "DOUBLE(0.3)"))
both("mix_report", "A15 S14", "select s.lang, s.kind, LONG(coalesce(c.n, 0)) as n from (select l.lang, k.kind from (select distinct lang from documents) l cross join (select 'short' as kind union all select 'long' union all select 'canary') k) s left join (select lang, case when n_chars < 1000 then 'short' else 'long' end as kind, count(*) as n from documents group by 1, 2) c on c.lang = s.lang and c.kind = s.kind")
both("rollup_counts", "S14 A19", "select coalesce(lang, 'ALL') as lang, coalesce(source, 'ALL') as source, LONG(count(*)) as n, LONG(sum(n_chars)) as chars from documents where lang is not null and source is not null group by rollup (lang, source)")
both("pool_stats", "A16", "with f as (select source, count(*) as n from documents group by source) select LONG(min(n)) as min_n, LONG(max(n)) as max_n, round(avg(DOUBLE(n)), 6) as mean_n, round(QUANTILE(DOUBLE(n), 0.5), 6) as median_n, LONG(count(*)) as families from f")
both("replay_ratios", "A17 X24", "select case when source in ('src0', 'src1') then 'replay_code' when source like 'src1%' then 'replay_boundary' else 'new' end as bucket, BROUND(DOUBLE(count(*)) / DOUBLE(sum(count(*)) over ()), 6) as ratio from documents group by 1")
Q5 = ", ".join(f"LONG(BROUND(QUANTILE(DOUBLE(n_chars), {q}), 0)) as p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))
both("length_percentiles", "A18 A19 B10", f"select lang, LONG(count(*)) as n, {Q5}, max(n_chars) as longest, BROUND(avg(DOUBLE(n_chars)), 2) as mean from documents group by lang")
both("nearest_rank", "A21", "with h as (select lang, n_chars, LONG(count(*)) as c from documents where n_chars is not null group by lang, n_chars), r as (select lang, n_chars, sum(c) over (partition by lang order by n_chars) as upto, sum(c) over (partition by lang) as n from h) select lang, min(case when upto >= floor(n / DOUBLE(2)) + 1 then n_chars end) as p50, min(case when upto >= case when n > 10 then floor(DOUBLE(0.9) * n) + 1 else n end then n_chars end) as p90 from r group by lang")
both("token_audit", "A22 X9", "with t as (select lang, SIZE(FIND_ALL(text, '[^ \\t\\n\\r]+')) as n from documents) select lang, LONG(sum(n)) as total, BROUND(avg(DOUBLE(n)), 4) as mean, max(n) as most, min(n) as least_n from t group by lang")
both("truncation_audit", "A20 A23 X8 X34", "with t as (select conv_id, role, greatest(LONG(1), LONG(floor(length(text) / DOUBLE(4)))) as n from conversations where text is not null), c as (select conv_id, LONG(sum(n)) as total, LONG(sum(case when role = 'assistant' then 0 else n end)) as prompt from t group by conv_id) select case when total <= 384 then 'intact' when prompt < 384 then 'partial' else 'lost' end as status, LONG(count(*)) as n, LONG(sum(least(total, 384))) as kept_tokens from c group by 1")
# A tree of hashes: rows of one of 4096 hash ranges are sorted together, then the ranges' digests.
both(
    "dataset_hash",
    "A24 A27",
    "with r as (select lang, SHA(concat(TEXT(doc_id), ':', coalesce(text, ''))) as h from documents), b as (select lang, substr(h, 1, 3) as bucket, SHA(JOIN(SORTED_LIST(h), NEWLINE())) as digest, count(*) as n from r group by lang, substr(h, 1, 3)) select lang, SHA(JOIN(SORTED_LIST(concat(bucket, digest)), NEWLINE())) as digest, LONG(sum(n)) as n from b group by lang",
)
both("reject_histogram", "A28", "select substr(coalesce(nullif(r, ''), 'unknown'), 1, 60) as reason, LONG(count(*)) as n from (select case when n_chars < 300 then 'too short' when lang = 'de' then '' when n_chars > 5000 then 'too long' end as r from documents) q group by 1")
@register("missing_ids", "A29", "with g as (select EXPLODE(RANGE(lo, hi)) as id from (select LONG(min(doc_id)) as lo, LONG(max(doc_id)) as hi from labels) q) select g.id from g left join labels l on l.doc_id = g.id where l.doc_id is null")
def missing_ids(spark, sf_dir):
    """The range of ids is made in partitions, not exploded from one row."""
    labels = table(spark, sf_dir, "labels")
    ends = labels.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    ids = spark.range(ends.lo or 0, (-1 if ends.hi is None else ends.hi) + 1) if ends.lo is not None else spark.range(0)
    return ids.join(labels, ids.id == labels.doc_id, "left_anti")

both("duplicate_ids", "A38", "select l_orderkey as id, LONG(count(*)) as n, max(case when rn = 2 then l_linenumber end) as second_line from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rn from lineitem) q group by l_orderkey having count(*) > 1")
both("trajectory_rates", "A31 A35", "select role, LONG(count(*)) as steps, RATE(COUNT_IF(length(text) > 0), count(*)) as parse_rate, RATE(COUNT_IF(text like '%?%'), count(*)) as question_rate from conversations group by role")
both("failure_taxonomy", "A32 B22", "with d as (select EXPLODE(ARRAY('FORMAT_PARSE_FAIL', 'SCHEMA_VALIDATION_FAIL', 'SAFETY_FAIL', 'TIMEOUT', 'REPEATED_ACTION_LOOP')) as class), c as (select case when length(text) < 30 then 'FORMAT_PARSE_FAIL' when text like '%?%' then 'SCHEMA_VALIDATION_FAIL' when length(text) > 3000 then 'TIMEOUT' end as class from conversations) select d.class as failure_class, LONG(count(c.class)) as n from d left join c on c.class = d.class group by d.class")
both("mean_or_sum", "A33 B24", "select round(avg(DOUBLE(l_discount)), 6) as discount_mean, LONG(sum(LONG(l_linenumber))) as lines_sum from lineitem")
both("tool_distribution", "A34", "select conv_id, JOIN(SORTED_LIST(concat(role, '=', TEXT(n))), ',') as tools, LONG(sum(n)) as actions from (select conv_id, role, count(*) as n from conversations group by conv_id, role) q group by conv_id")
both("max_family_share", "A39 B17", "with f as (select l_suppkey, count(*) as n from lineitem group by l_suppkey) select LONG(max(n)) as largest, round(DOUBLE(max(n)) / DOUBLE(sum(n)) * 100, 6) as share_pct, DOUBLE(max(n)) > DOUBLE(sum(n)) * 1 / 100 as over_cap from f")
both("unique_and_families", "A40", "select LONG(count(distinct l_orderkey)) as ids, LONG(count(distinct l_suppkey)) as families from lineitem")
