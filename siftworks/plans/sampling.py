"""Splits, stratified samples, caps and quotas. Draws are ranks by a hash of seed and key, so they are the same anywhere."""

from pyspark.sql import functions as F

from ..operators import sampling
from .catalogue import both, register, table
from .dialect import spark_sql

DRAW = "SHA(concat('42:', TEXT({})))".format
LEVEL = "case when n_chars < 200 then 0 when n_chars < 500 then 1 when n_chars < 1000 then 2 when n_chars < 2000 then 3 else 4 end"
LEVELS = f"p as (select doc_id, source, lang, n_chars, {LEVEL} as difficulty from documents)"
RANKED = f"r as (select *, row_number() over (partition by difficulty order by {DRAW('doc_id')}, doc_id) as rn, count(*) over (partition by difficulty) as pool from p)"
MIX = "m as (select 0 as difficulty, DOUBLE(0.1) as frac union all select 1, DOUBLE(0.2) union all select 2, DOUBLE(0.3) union all select 3, DOUBLE(0.25) union all select 4, DOUBLE(0.15))"
FAMILY = f"f as (select key, row_number() over (order by {DRAW('key')}, key) as rn, count(*) over () as n from (select distinct concat(lang, '_', source) as key from documents where lang is not null and source is not null) q)"
CUT = "case when rn <= BROUND(n * DOUBLE(0.7), 0) then 'train' when rn <= BROUND(n * DOUBLE(0.7), 0) + BROUND(n * DOUBLE(0.1), 0) then 'val' else 'test' end"

both("family_split_70_10_20", "G1 X24", f"with {FAMILY} select d.doc_id, f.key as family, {CUT} as split from documents d join f on f.key = concat(d.lang, '_', d.source)")
both("family_split_counts", "G2", f"with {FAMILY}, s as (select {CUT} as split from f), x as (select 'train' as split union all select 'val' union all select 'test') select x.split, LONG(count(s.split)) as families, count(s.split) = 0 as empty_warning from x left join s on s.split = x.split group by x.split")
both("partition_with_minimums", "G3", f"with {FAMILY} select key as family, case when rn <= least(n, greatest(5, BROUND(n * DOUBLE(0.1), 0))) then 'validation' when rn <= least(n, greatest(5, BROUND(n * DOUBLE(0.1), 0)) + greatest(8, BROUND(n * DOUBLE(0.15), 0))) then 'test' else 'train' end as part from f")
both("split_60_40_ceil", "G4", f"with {FAMILY} select key as family, case when rn <= ceil(DOUBLE(0.6) * n) then 'selection' else 'heldout' end as part from f")
both("stage_mix", "G5 B8", f"with {LEVELS}, {RANKED}, {MIX} select r.doc_id, r.difficulty from r join m on m.difficulty = r.difficulty where r.rn <= 200 and r.rn <= BROUND(200 * m.frac, 0)")
both("stage_shortfall", "G5", f"with {LEVELS}, {MIX}, c as (select difficulty, count(*) as n from p group by difficulty) select m.difficulty, LONG(BROUND(2000 * m.frac, 0)) as target, LONG(coalesce(c.n, 0)) as available, LONG(greatest(BROUND(2000 * m.frac, 0) - coalesce(c.n, 0), 0)) as shortfall from m left join c on c.difficulty = m.difficulty")
both("calibrated_total", "G6 B7", f"with {LEVELS}, {MIX}, c as (select difficulty, count(*) as n from p group by difficulty) select LONG(floor(min(coalesce(c.n, 0) / m.frac))) as zero_if_empty, LONG(floor(min(c.n / m.frac))) as empty_ignored from m left join c on c.difficulty = m.difficulty")
both("stage_assembly", "G7 U1", f"with {LEVELS}, {RANKED}, {MIX}, t as (select floor(min(k.n / m.frac)) as total from (select difficulty, count(*) as n from p group by difficulty) k join m on m.difficulty = k.difficulty) select r.doc_id, 'new' as origin from r join m on m.difficulty = r.difficulty cross join t where r.rn <= BROUND(t.total * m.frac, 0) union all select doc_id, 'replay' from r where difficulty = 0 and rn <= 10")
both("antiforget_mix", "G8", f"with {LEVELS}, s as (select doc_id, lang, row_number() over (partition by lang order by {DRAW('doc_id')}, doc_id) as rn from p where source <> 'src0') select doc_id, lang from s where rn <= 60 and rn <= case lang when 'en' then 60 when 'de' then 20 else 10 end")
@register("validation_slice", "G9", f"with r as (select doc_id, row_number() over (order by {DRAW('doc_id')}, doc_id) as rn, count(*) over () as n from documents) select doc_id from r where rn <= BROUND(n * DOUBLE(0.15), 0)")
def validation_slice(spark, sf_dir):
    """Ranks come from ranges of the draw, so no task orders all rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(spark_sql(DRAW("doc_id"))).alias("draw"))
    ranked, n = sampling.ranks(d, ["draw", "doc_id"])
    return ranked.where(F.col("rank") <= round(n * 0.15)).select("doc_id")


both("family_cap", "G10", "select l_orderkey, l_linenumber, l_suppkey from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem) q where rn <= 7")
both("two_stage_cap", "G11", "with a as (select *, row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey, l_linenumber) as k from lineitem), b as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as f from a where k <= 3) select l_orderkey, l_linenumber, l_suppkey, l_returnflag from b where f <= 8")
both("stratified_subsample", "G12 G13", f"with s as (select doc_id, lang, row_number() over (partition by lang order by {DRAW('doc_id')}, doc_id) as rn from documents), k as (select doc_id from s where rn <= 40) select d.doc_id, d.lang, k.doc_id is not null as selected from documents d left join k on k.doc_id = d.doc_id")
both("probe_selection", "G14 B14", f"with b as (select lang, row_number() over (order by lang) as b from (select distinct lang from documents) q), k as (select doc_id, lang, row_number() over (partition by lang order by {DRAW('doc_id')}, doc_id) as rn from documents) select k.doc_id, k.lang from k join b on b.lang = k.lang where b.b <= 4 and k.rn <= 13 and k.rn <= 12 + case when b.b <= 50 % 4 then 1 else 0 end")
both("first_k_round_robin", "G15", "with k as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from documents), f as (select doc_id, lang, rn from k where rn <= 30) select doc_id, lang from (select *, row_number() over (order by rn, lang) as pos from f) q where pos <= 30")
both("proportional_allocation", "G16 B9 O1", f"with {LEVELS}, c as (select difficulty, count(*) as n from p group by difficulty), t as (select sum(n) as total from c), q as (select difficulty, n, LONG(floor(DOUBLE(100 * n) / DOUBLE(total))) as base, row_number() over (order by n desc, difficulty) as pos from c cross join t), e as (select 100 - sum(base) as rest from q) select difficulty, LONG(n) as size, LONG(base + case when pos <= rest then 1 else 0 end) as quota from q cross join e")
both("stratified_candidates", "G17", f"with {LEVELS}, {RANKED}, q as (select difficulty, LONG(floor(DOUBLE(100 * count(*)) / DOUBLE(sum(count(*)) over ()))) as quota from p group by difficulty) select r.doc_id, r.difficulty from r join q on q.difficulty = r.difficulty where r.rn <= 100 and r.rn <= q.quota")
RATIO = "a as (select lang, count(*) as n, case lang when 'en' then DOUBLE(0.6) when 'fr' then DOUBLE(0.15) when 'de' then DOUBLE(0.15) else DOUBLE(0.1) end as r from documents where lang is not null group by lang), t as (select floor(min(n / (r - DOUBLE(0.03)))) as bound, sum(n) as total from a), b as (select least(bound, total) as t from t)"
both("ratio_feasible_max", "G18 B15", f"with {RATIO}, l as (select lang, n, r, least(n, ceil((r - DOUBLE(0.03)) * b.t)) as low, b.t as total from a cross join b), g as (select *, total - sum(low) over () as slack, coalesce(sum(n - low) over (order by r desc, lang rows between unbounded preceding and 1 preceding), 0) as before from l) select lang, LONG(n) as available, LONG(total) as feasible_total, LONG(low + greatest(least(n - low, slack - before), 0)) as chosen from g")
both("target_redistribution", "G19", f"with {RATIO}, x as (select lang, n, r, n < BROUND(1000 * r, 0) as under from a), y as (select *, sum(case when under then n else 0 end) over () as fixed, sum(case when under then 0 else r end) over () as open_r from x) select lang, LONG(case when under then n else least(n, BROUND((1000 - fixed) * r / open_r, 0)) end) as target from y")
both("family_quota_reasons", "G20 K4", "with a as (select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) as k, row_number() over (partition by source order by doc_id) as f from documents) select doc_id, case when k > 2 then 'bucket_quota' when f > 8 then 'family_quota' else 'kept' end as reason from a")
both("freeze_decision", "G21", f"with {FAMILY} select key as family, case when n >= 60 then rn <= 60 when n >= 20 then true else false end as frozen from f")
both("registry_supplement", "G22 F5", f"with u as (select source as family, SORTED_LIST(distinct lang) as usage, count(*) as n from documents group by source), r as (select family, row_number() over (order by {DRAW('family')}, family) as rn from u where not HAS(usage, 'xx') and n > 5) select family from r where rn <= 6")
both("shard_slices", "G23", "select family, LONG(floor((rn - 1) / DOUBLE(25))) as shard from (select l_suppkey as family, row_number() over (order by l_suppkey) as rn from (select distinct l_suppkey from lineitem) q) z")
both("route_split", "G25 J12", "select conv_id, turn, case when role = 'system' then 'heldout' when role = 'user' then 'validation' else 'train' end as split from conversations")
both("small_family_pick", "G26", "select doc_id, source, lang from (select *, row_number() over (partition by source, lang order by doc_id) as rn from documents) q where rn <= case lang when 'en' then 1 else 2 end")
both("pilot_steps", "G27", "select n, per_step, LONG(least(50, greatest(1, ceil(n * DOUBLE(0.25) / per_step)))) as max_steps from (select LONG(count(*)) as n, 16 as per_step from documents) q")
both("yield_projection", "T4 T3 T5", "with y as (select lang, DOUBLE(count(*)) as attempts, DOUBLE(count(*) filter (where quality = 1)) as ok from documents join labels on labels.doc_id = documents.doc_id group by lang), w as (select *, case when ok = 0 then 0.0 else (ok / attempts + 1.645 * 1.645 / (2 * attempts) - 1.645 * sqrt(ok / attempts * (1 - ok / attempts) / attempts + 1.645 * 1.645 / (4 * attempts * attempts))) / (1 + 1.645 * 1.645 / attempts) end as low from y) select lang, round(low, 6) as wilson_lower, LONG(BROUND(425 * ok / attempts, 0)) as projected, LONG(floor(425 * low)) as projected_lower, case when floor(425 * low) >= 300 then 'FULL' when floor(425 * low) >= 100 then 'PILOT_ONLY' else 'FAIL' end as verdict from w")
