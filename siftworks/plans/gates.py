"""Quality gates: one row each of name, verdict and detail, and the folds of many gates to one verdict."""

from .catalogue import both
from .sampling import FAMILY, CUT

GATES = " union all ".join(
    [
        "select 'bucket_non_empty' as gate, min(n) > 0 as passed, concat('least ', TEXT(min(n))) as detail from (select lang, count(*) as n from documents group by lang) q",
        "select 'ratio_within_tolerance', max(abs(r - t)) <= 0.05, TEXT(LONG(round(max(abs(r - t)) * 10000, 0))) from (select DOUBLE(count(*)) / sum(count(*)) over () as r, case lang when 'en' then DOUBLE(0.6) when 'fr' then DOUBLE(0.15) when 'de' then DOUBLE(0.15) else DOUBLE(0.1) end as t from documents group by lang) q",
        "select 'per_family_cap', max(n) <= 8, TEXT(max(n)) from (select source, lang, count(*) as n from documents group by source, lang) q",
        "select 'capacity', count(*) >= 2300, case when count(*) >= 2300 then 'FULL' when count(*) >= 500 then 'PILOT_ONLY' else 'FAIL' end from documents",
        "select 'silent_truncation', count(*) = 0, TEXT(count(*)) from conversations where floor(length(text) / DOUBLE(4)) >= 384",
        "select 'canary_all_fail', count(*) > 0 and coalesce(max(case when quality = 1 then 1 else 0 end), 0) = 0, TEXT(count(*)) from labels where doc_id % 100 = 0",
        "select 'labels_in_documents', count(*) = 0, TEXT(count(*)) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)",
        "select 'unique_ids', count(*) = count(distinct doc_id), TEXT(count(*) - count(distinct doc_id)) from documents",
        "select 'repair_integrity', count(*) = 0, TEXT(count(*)) from documents where text is null or trim(text) = ''",
        "select 'source_feasible', sum(quality) >= 240, TEXT(sum(quality)) from labels",
    ]
)

both("quality_gates", "Q4 Q5 Q8 Q10 Q11 Q13 Q16 Q19 Q20 Q23", f"select gate, passed, detail from ({GATES}) g")
both("verdict_fold", "Q18 B26", f"select case when COUNT_IF(not passed and gate in ('unique_ids', 'labels_in_documents')) > 0 then 'BLOCKED' when COUNT_IF(not passed and gate = 'capacity') > 0 then 'PILOT_ONLY' when COUNT_IF(not passed) > 0 then 'REVIEW' else 'READY' end as verdict, COUNT_IF(passed) as passed, COUNT_IF(not passed) as failed from ({GATES}) g")
both("family_isolation", "Q2 Q21", f"with {FAMILY}, s as (select key, {CUT} as split from f), d as (select distinct s.split, concat(d.lang, '_', d.source) as family from documents d join s on s.key = concat(d.lang, '_', d.source)) select x.split as split_a, y.split as split_b, LONG(count(*)) as shared from d x join d y on x.split < y.split group by x.split, y.split".replace("LONG(count(*)) as shared", "COUNT_IF(x.family = y.family) as shared"))
both("validation_exact_counts", "Q14", "select lang, LONG(count(*)) as n, count(*) = 45 as exact, COUNT_IF(quality = 1) as verified from documents d join labels l on l.doc_id = d.doc_id group by lang")
both("ratio_gate", "Q10 B16", "with c as (select lang, DOUBLE(count(*)) as n from documents group by lang) select lang, round(n / sum(n) over (), 6) as ratio, abs(n / sum(n) over () - 0.25) > 0.03 as violated, min(n) over () < 50 as skipped from c")
both("capacity_verdict", "Q17", "with c as (select lang, DOUBLE(count(*)) as n from documents group by lang) select LONG(floor(min(n / 0.1))) as feasible, case when min(n / 0.1) >= 2300 then 'FULL' when min(n / 0.1) >= 500 then 'PILOT_ONLY' else 'FAIL' end as verdict from c".replace("0.1)", "DOUBLE(0.1))"))
both("claim_invariants", "Q20 Q21", "with t as (select source, max(case when doc_id % 2 = 0 then 1 else 0 end) as train, max(case when doc_id % 61 = 0 then 1 else 0 end) as frozen from documents group by source) select COUNT_IF(train = 1 and frozen = 1) as both_tags, COUNT_IF(train = 0 and frozen = 0) as untagged, LONG(count(*)) as families from t")
