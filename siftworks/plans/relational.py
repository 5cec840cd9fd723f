"""Joins, set operations, ordered sequences and registries."""

from .catalogue import both

both("left_semi_families", "F1 J5", "select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
both("left_anti_frozen", "J6 F4", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and not contains(source, '13')")
both("frozen_exclusion", "F2 B18", "with fs as (select doc_id from labels where toxic = 1), ff as (select distinct source from documents where doc_id % 97 = 0) select case when fs.doc_id is not null then 'frozen_sample' when ff.source is not null then 'frozen_family' else 'kept' end as reason, LONG(count(*)) as n from documents d left join fs on fs.doc_id = d.doc_id left join ff on ff.source = d.source group by 1")
both("lookup_keep_first", "J7", "with h as (select doc_id, source, SHA(trim(text)) as code from documents), k as (select code, FIRST_BY(source, doc_id) as recovered from h where code is not null group by code) select h.doc_id, k.recovered from h left join k on k.code = h.code")
both("left_join_default", "J8", "select c_custkey, coalesce(o.n, 0) as n_orders from customer left join (select o_custkey, LONG(count(*)) as n from orders group by o_custkey) o on o.o_custkey = c_custkey")
both("outer_id_diff", "J10", "select COUNT_IF(l.doc_id is null) as only_documents, COUNT_IF(d.doc_id is null) as only_labels, COUNT_IF(l.doc_id is not null and d.doc_id is not null) as shared from documents d full outer join labels l on l.doc_id = d.doc_id")
both("registry_merge", "J11 K7 S8", "with old as (select source as family, 'train' as tag, count(*) as n from documents where doc_id % 2 = 0 group by source), new as (select source as family, 'val' as tag, count(*) as n from documents where doc_id % 3 = 0 group by source) select coalesce(old.family, new.family) as family, concat(coalesce(old.tag, ''), '+', coalesce(new.tag, '')) as usage, LONG(coalesce(old.n, 0) + coalesce(new.n, 0)) as samples from old full outer join new on old.family = new.family")
both("manifest_upsert", "K7 U1", "with old as (select lang as split, count(*) as n from documents where doc_id < 500 group by lang), new as (select lang as split, count(*) as n from documents where doc_id >= 500 and lang <> 'en' group by lang) select split, LONG(n) as n from new union all select split, LONG(n) from old where not exists (select 1 from new where new.split = old.split)")
both("order_supplier_regions", "J12", "select r.r_name, LONG(count(*)) as suppliers from supplier s join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey group by r.r_name")
both("parallel_arrays", "J14", "select conv_id, JOIN(SORTED_LIST(concat(lpad(TEXT(turn), 4, '0'), ':', role, ':', TEXT(length(text)))), '|') as zipped from conversations group by conv_id")
both("multi_key_sort_top", "O1 O2 O3", "select source, n from (select source, LONG(count(*)) as n, row_number() over (order by count(*) desc, source) as rn from documents group by source) q where rn <= 20")
both("first_examples", "O2", "select lang, JOIN(SLICE(SORTED_LIST(distinct source), 1, 5), ',') as examples from documents group by lang")
both("set_operations", "U2", "with a as (select distinct source from documents where lang = 'fr'), b as (select distinct source from documents where n_chars > 4000) select 'union' as op, LONG(count(*)) as n from (select * from a union select * from b) q union all select 'intersect', LONG(count(*)) from (select * from a intersect select * from b) q union all select 'difference', LONG(count(*)) from (select * from a except select * from b) q")
both("subset_test", "U3", "select LONG(count(*)) as outside, count(*) = 0 as is_subset from (select doc_id from labels except select doc_id from documents) q")
TAGS = "t as (select distinct source as family, 'train' as tag from documents where doc_id % 4 < 2 union all select distinct source, 'val' from documents where doc_id % 50 = 2 union all select distinct source, 'frozen' from documents where doc_id % 70 = 3)"
both("tag_disjointness", "U4 U5 F5 Q2", f"with {TAGS}, w as (select 'src3' as family), v as (select a.tag as tag_a, b.tag as tag_b, a.family from t a join t b on a.family = b.family and a.tag < b.tag where not exists (select 1 from w where w.family = a.family)) select tag_a, tag_b, LONG(count(*)) as shared, JOIN(SLICE(SORTED_LIST(family), 1, 10), ',') as examples from v group by tag_a, tag_b")
both("registry_claims", "ST7", "with e as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn, value from events) select user_id, JOIN(SORTED_LIST(event_type), ',') as claimed from e where rn = 1 and value > 50 group by user_id")
both("turn_chain_check", "W1 W2 W3", "with c as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as pos, lag(role) over (partition by conv_id order by turn) as prev, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, EVERY(turn = pos) as index_ok, EVERY(prev is null or prev <> role) as alternates, max(case when back = 1 then role end) as last_role from c group by conv_id")
both("repeat_loop", "W4", "with e as (select user_id, event_type, lag(event_type, 1) over (partition by user_id order by ts, event_id) as p1, lag(event_type, 2) over (partition by user_id order by ts, event_id) as p2 from events) select user_id, ANY_OF(SAFE(event_type = p1 and p1 = p2)) as looped from e group by user_id")
both("drop_streak", "W5 W7 ST5 B12", "with e as (select user_id, event_id, value, value - lag(value) over (partition by user_id order by ts, event_id) as delta, row_number() over (partition by user_id order by ts, event_id) as rn, ts from events), s as (select *, EVERY(delta < -0.5) over (partition by user_id order by ts, event_id rows between 1 preceding and current row) as dropping from e) select event_id, user_id from s where rn >= 3 and dropping")
both("running_best", "W6", "with e as (select user_id, event_id, value, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as best from events) select event_id, user_id from e where best is null or value > best")
both("finish_without_tests", "W8", "with e as (select user_id, event_id, event_type, max(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as tested from events) select event_type, LONG(count(*)) as n from e where tested = 0 group by event_type")
both("interval_probe", "W9 ST2", "with e as (select user_id, event_id, ts, floor(date_part('epoch', ts) / 86400) as slot from events), k as (select *, row_number() over (partition by user_id, slot order by ts, event_id) as rn from e) select user_id, event_id from k where rn = 1".replace("date_part('epoch', ts)", "EPOCH(ts)"))
both("resume_remaining", "ST6", "select l_suppkey as family, LONG(count(*)) as n from lineitem l where not exists (select 1 from supplier s where s.s_suppkey = l.l_suppkey and s.s_acctbal > 0) group by l_suppkey")
both("nan_latch", "ST1", "with e as (select user_id, event_id, ts, max(case when value > 99 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as latched from events) select user_id, LONG(sum(latched)) as latched_events from e group by user_id")
