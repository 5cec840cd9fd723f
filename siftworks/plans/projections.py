"""Row-level projections, predicates and text functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import dedup
from .catalogue import both, register, table
from .dedup import GRAMS, NORM, TOKENS

BLOCK_BITS = 8  # of neighbouring ids that meet in a group

IDS = "i as (select doc_id, concat('m_', TEXT(doc_id), case doc_id % 5 when 0 then '_sr_off_by_one' when 1 then '_er_index' when 2 then '_sr_x_er_y' when 3 then '_boundary' else '' end) as sid, text, lang, n_chars from documents)"

both("chatml_projection", "P1 P2", f"select doc_id, concat_ws(concat(NEWLINE(), NEWLINE()), case when length(text) > 0 then text end, case when lang = 'en' then concat('```python', NEWLINE(), text, NEWLINE(), '```') end, case when n_chars > 2000 then 'Fix it.' end) as user_message, case when n_chars > 1000 then LONG(3) else LONG(2) end as n_messages from documents")
both("last_user_split", "P3", "with u as (select conv_id, max(case when role = 'user' then turn end) as last_user from conversations group by conv_id) select c.conv_id, COUNT_IF(c.turn <= u.last_user) as prompt_turns, COUNT_IF(c.turn > u.last_user) as answer_turns from conversations c join u on u.conv_id = c.conv_id group by c.conv_id")
both("variant_and_bug_types", "P4 P5 P6 P7 B4", f"with {IDS} select sid, case when sid like '%boundary' then 'boundary' when sid like '%sr%' then 'static_repair' when sid like '%er%' then 'execution_repair' else 'code' end as variant, nullif(FIND(sid, '^.*_(sr|er)_(.+)$', 2), '') as greedy, case when sid like '%\\_sr\\_%' then 'a' end as marker, case when contains(sid, '_sr_') then nullif(FIND(sid, '_sr_(.+)$', 1), '') when contains(sid, '_er_') then nullif(FIND(sid, '_er_(.+)$', 1), '') end as first_marker, case when contains(sid, 'branch_deletion') then 'branch_deletion' when contains(sid, 'off_by_one') then 'off_by_one' when contains(sid, 'index') then 'index' end as ladder from i".replace("case when sid like '%\\_sr\\_%' then 'a' end as marker, ", ""))
both("difficulty_levels", "P8", "select doc_id, case when n_chars < 200 then 0 when n_chars < 500 then 1 when n_chars < 1000 then 2 when n_chars < 2000 then 3 else 4 end as difficulty, coalesce(TRY_INT(substr(source, 4)), -1) as source_number from documents")
both("skill_tags", "P9", "select doc_id, case when SIZE(k) = 0 then 'general' else JOIN(k, ',') end as tags from (select doc_id, WHERE_EACH(ARRAY('list', 'string', 'sort', 'the', 'and', 'of', 'der', 'les'), contains(lower(text), concat(' ', x, ' '))) as k from documents) q")
both("test_split", "P10", "select doc_id, JOIN(SLICE(t, 1, 2), concat(NEWLINE(), NEWLINE())) as public_tests, SIZE(t) - least(SIZE(t), LONG(2)) as hidden_tests from (select doc_id, WHERE_EACH(LINES(text), trim(x) <> '') as t from documents) q")
both("derived_keys", "P11 P12", f"with {IDS} select sid, concat('mbpp_', FIND(concat('mbpp_fam_', TEXT(doc_id)), '^mbpp_fam_(\\d+)$', 1)) as sample_id, TRY_INT(nullif(FIND(sid, '^m_(\\d+)$', 1), '')) as task_id from i")
both("code_variants", "P13", "select doc_id, variant, case variant when 'code' then n_chars when 'boundary' then n_chars + 1 else n_chars + 2 end as size from (select doc_id, n_chars, EXPLODE(ARRAY('code', 'boundary', 'repair')) as variant from documents) q")
both("augmented_instruction", "P14 X11", "with p as (select page_id, url, FIND(html, '<title>([^<]*)</title>', 1) as title from pages) select page_id, case when title = '' or contains(url, title) then url else concat(url, ' # ', title) end as instruction from p")
both("canary_rows", "P15 U1", "select concat('canary_', TEXT(doc_id)) as sample_id, 'canary' as variant, false as verified from documents where doc_id % 100 = 0 union all select concat('m_', TEXT(doc_id)), 'code', true from documents where doc_id % 100 = 1")
both("legacy_key_rename", "P16", "select case event_type when 'view' then 'page_view' else event_type end as kind, LONG(count(*)) as n from events group by 1")
both("safety_flags", "P17", "select conv_id, turn, role in ('assistant') as modifies_workspace, role = 'tool' as executes_code, false as network_required, role = 'system' as is_terminal from conversations")
both("routing_signals", "P18", "select doc_id, case when lang = 'en' then 'repairable' when n_chars > 2000 then 'long' else 'plain' end as category from documents")
both("format_pools", "F3", "select case when text like '%```%' then 'fenced' when text like '%|%' then 'table' else 'plain' end as pool, LONG(count(*)) as n from documents group by 1")
both("verified_consistency", "F6 Q9", "select d.doc_id from documents d join labels l on l.doc_id = d.doc_id where (l.quality = 1) <> (d.n_chars > 200 and l.toxic = 0)")
REJECT = "case when text is null or trim(text) = '' then 'blank' when n_chars < 100 then 'too_short' when n_chars > 20000 then 'too_long' when not contains(text, '.') then 'no_sentence' when contains(text, '$$$') then 'junk_marks' end"
both("reject_ladder", "F7 F8 K4", f"select doc_id, {REJECT} as reason from documents")
both("reject_counts", "F8 A28", f"select coalesce({REJECT}, 'accepted') as reason, LONG(count(*)) as n from documents group by 1")
both("path_reject_reason", "F9", "select page_id, case when url is null or url = '' then 'empty' when MATCHES(url, '^[a-z]+://') then 'url' when MATCHES(url, '^(/|[A-Za-z]:|\\\\\\\\)') then 'absolute' when MATCHES(url, '(^|/)\\.\\.(/|$)') then 'parent' when MATCHES(url, '\\.(pem|key)$') then 'secret' end as reason from pages")
both("failure_markers", "F10", "select conv_id, COUNT_IF(MATCHES(lower(text), 'error|assert|fail|exception|traceback')) as marked, LONG(count(*)) as turns from conversations group by conv_id")
both("text_normal_forms", "X1 X2 X3 X4 X26", f"select doc_id, SHA({NORM}) as instruction_hash, SHA(JOIN(WHERE_EACH(EACH(LINES(text), trim(x)), x <> '' and not (x like '#%')), NEWLINE())) as code_hash, SHA(replace(text, concat(chr(13), chr(10)), chr(10))) as lf_hash from documents")
both("token_features", "X5 X6 X8 X9 X10", f"with f as (select doc_id, text, {TOKENS} as t from documents), g as (select doc_id, text, t, {GRAMS} as g from f) select doc_id, SIZE(t) as tokens, SIZE(g) as grams, greatest(LONG(1), LONG(floor(length(text) / DOUBLE(4)))) as estimate, SIZE(FIND_ALL(text, '[^ \\t\\n\\r]+')) as words, LONG((length(text) - length(replace(text, 'the ', ''))) / 4) as marks from g")
@register("jaccard_neighbours", "X7", f"with f as (select doc_id, {TOKENS} as t from documents where doc_id < 400), g as (select doc_id, {GRAMS} as g from f) select a.doc_id, RATE(SIZE(COMMON(a.g, b.g)), SIZE(EITHER(a.g, b.g))) as jaccard from g a join g b on b.doc_id = a.doc_id + 1".replace(" where doc_id < 400", ""))
def jaccard_neighbours(spark, sf_dir):
    """Each document and the next by id, by 64-bit hashes of their grams. Documents meet in blocks of ids, into which each goes once, the first of a block also into the one before."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    grams = F.array_distinct(F.transform(dedup.ngrams(F.col("text")), lambda g: F.xxhash64(g)))
    own = d.select("doc_id", grams.alias("g"), F.shiftright("doc_id", BLOCK_BITS).alias("block"), F.lit(True).alias("own"))
    ahead = own.where(F.col("doc_id") % (1 << BLOCK_BITS) == 0).withColumns({"block": F.col("block") - 1, "own": F.lit(False)})
    following = F.collect_list("g").over(W.partitionBy("block").orderBy("doc_id").rangeBetween(1, 1))
    x = own.unionByName(ahead).withColumn("next", following).where("own").select("doc_id", "g", F.explode("next").alias("h"))
    shared = F.size(F.array_intersect("g", "h"))
    return x.select("doc_id", F.round(F.coalesce(F.try_divide(shared.cast("double"), (F.size("g") + F.size("h") - shared).cast("double")), F.lit(0.0)), 6).alias("jaccard"))


both("markup_extract", "X12 X14 S16", "select page_id, nullif(FIND(html, '<title>([^<]*)</title>', 1), '') as title, SIZE(FIND_ALL(html, '<p[ >]')) as paragraphs, SIZE(FIND_ALL(html, '<a [^>]*>')) as links from pages")
both("signature_names", "X11", "select event_id, FIND(props, '\"([a-z_]+)\"', 1) as first_key from events")
both("count_lines_parse", "X13", "with t as (select doc_id, WHERE_EACH(LINES(text), MATCHES(x, '[0-9]+')) as l from documents) select doc_id, SIZE(l) as lines, TRY_INT(FIND(JOIN(SLICE(l, cast(greatest(SIZE(l), LONG(1)) as int), 1), ''), '([0-9]{1,6})', 1)) as last_number from t")
both("feedback_truncation", "X15 X16", "select doc_id, case when length(text) > 3000 then concat(substr(text, 1, 3000), '...[truncated]') else text end as feedback from documents")
both("json_repair", "X18 X17", "select event_id, concat(REPLACE_ALL(concat(substr(props, 1, greatest(length(props) - 1, 0)), ',}'), ',\\s*\\}', '}'), '') as repaired from events where props is not null")
both("strict_parsing", "X22", "select doc_id, TRY_INT(substr(source, 4)) as as_int, case lower(lang) when 'en' then true when 'fr' then false end as as_bool, try_cast(concat('1.', substr(source, 4)) as double) as as_float from documents")
both("failure_class_ladder", "X23", "select conv_id, turn, case when text is null or length(text) < 20 then 'FORMAT' when role not in ('user', 'assistant', 'system') then 'TYPE' when contains(lower(text), 'password') then 'SAFETY' when not contains(text, '.') then 'ARGUMENTS' when length(text) > 4000 then 'SCHEMA' else 'OK' end as failure_class from conversations")
both("unique_patch", "X27 V11", "with c as (select doc_id, text, LONG((length(text) - length(replace(text, ' the ', ''))) / 5) as n from documents) select doc_id, case n when 0 then 'not_found' when 1 then 'ok' else 'not_unique' end as status, case n when 1 then SHA(replace(text, ' the ', ' a ')) end as patched from c")
both("indent_tests", "X28", "select doc_id, SHA(JOIN(EACH(LINES(text), concat('    ', x)), NEWLINE())) as indented from documents")
both("retention_check", "X33 Q3", "with a as (select conv_id, max(case when role = 'assistant' then text end) as answer, max(case when role = 'user' then text end) as target from conversations group by conv_id) select COUNT_IF(SAFE(contains(answer, target))) as retained, LONG(count(*)) as n from a")
both("padded_lengths", "X35", "with t as (select conv_id, turn, SIZE(FIND_ALL(text, '[^ \\t\\n\\r]+')) as n from conversations) select conv_id, turn, n, max(n) over (partition by conv_id) - n as padding from t")
both("preserved_answers", "X34", "with t as (select conv_id, role, WHERE_EACH(SPLIT(text, ' '), x <> '') as w from conversations) select conv_id, LONG(sum(case when role = 'assistant' then SIZE(SLICE(w, 1, 64)) else SIZE(SLICE(w, 1, 32)) end)) as kept from t group by conv_id")
both("bankers_rounding", "X24", "select l_orderkey, l_linenumber, BROUND(l_quantity / 4, 0) as q0, BROUND(l_discount * 10, 1) as d1 from lineitem")
both("percent_text", "X25", "select source, concat(TEXT(LONG(round(DOUBLE(count(*)) * 1000 / DOUBLE(sum(count(*)) over ()), 0))), ' permille') as share from documents group by source")
both("hash_seeds", "G24", "select doc_id, substr(SHA(concat('42:', TEXT(doc_id))), 1, 8) as seed from documents")
both("text_search", "S17", "with l as (select doc_id, EXPLODE(LINES(text)) as line from documents) select doc_id, substr(line, 1, 80) as hit from l where contains(line, 'Apache License') order by doc_id, line limit 100")
both("ranged_read", "S18 B21", "select doc_id, JOIN(SLICE(LINES(text), 2, 3), NEWLINE()) as lines_2_to_4, SIZE(LINES(text)) as n_lines from documents")
both("distinct_keys", "S10 S13", "select distinct source, lang from documents")
both("normalised_records", "S6 S12", "select conv_id as id, 'chat' as origin, LONG(count(*)) as parts from conversations group by conv_id union all select doc_id, 'sample', LONG(1) from documents")
both("shard_scan_counts", "S7", "select LONG(floor(doc_id / DOUBLE(250))) as shard, LONG(count(*)) as n, LONG(min(doc_id)) as first_id from documents group by 1")
both("sample_rules", "S1 S3 S4 S5", "select COUNT_IF(lang not in ('en', 'fr', 'de', 'es')) as bad_language, COUNT_IF(trim(text) = '') as blank, COUNT_IF(n_chars <> length(text)) as bad_length, LONG(count(*)) as n from documents")
both("option_list_scan", "S9 S2", "select distinct coalesce(nullif(lang, ''), source) as family from documents union select distinct concat('label_', TEXT(quality)) from labels")
