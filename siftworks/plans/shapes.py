"""Queries on text and JSON whose shape is told row by row: variants, damaged JSON, sections, configurations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import config, protocols
from ..operators import sections
from ..sources import records, scratch
from .catalogue import register, table


@register(
    "family_scan_shapes",
    "S6 S9 S10",
    "with s as (select s_suppkey % 6 as shape, 'f' || s_suppkey as f, 'g' || s_suppkey as g from supplier), u as (select shape, 'families' as source_key, f as id from s union all select shape, 'validation_family_ids', f from s union all select shape, 'frozen_family_ids', g from s union all select shape, 'train_family_ids', g from s) "
    "select distinct source_key, id as family_id from u where (shape = 0 and source_key = 'families') or (shape = 1 and source_key = 'validation_family_ids') or (shape = 2 and source_key in ('frozen_family_ids', 'families')) or (shape = 3 and source_key = 'train_family_ids')",
)
def family_scan_shapes(spark, sf_dir):
    """A line for each supplier, in six shapes: strings, objects with family_id or id, two keys at once, wrong types, no JSON."""
    shape, f, g = F.col("s_suppkey") % 6, F.concat(F.lit("f"), "s_suppkey"), F.concat(F.lit("g"), "s_suppkey")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    line = (
        F.when(shape == 0, F.concat(F.lit('{"families": ['), quoted(f), F.lit(', 7, null, ["x"]]}')))
        .when(shape == 1, F.concat(F.lit('{"validation_family_ids": [{"family_id": '), quoted(f), F.lit(', "id": "other"}], "families": null}')))
        .when(shape == 2, F.concat(F.lit('{"frozen_family_ids": [{"id": '), quoted(g), F.lit('}, {"id": 5}, {}], "families": ['), quoted(f), F.lit("]}")))
        .when(shape == 3, F.concat(F.lit('{"train_family_ids": ['), quoted(g), F.lit(", "), quoted(g), F.lit('], "families": "no list"}')))
        .when(shape == 4, F.concat(F.lit('{"families": ['), quoted(f)))
        .otherwise(F.concat(F.lit('{"other": ['), quoted(f), F.lit("]}")))
    )
    path = scratch.folder(spark, "families")
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    return records.read_family_ids(spark, path)


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else protocols.repair_json(t))


DAMAGED = """'{"id": ' || event_id || ', "tags": ["' || event_type || '", "a,]", {"p": ' || props || '}], "note": "q\\"}{[", "end": true}'"""


FEW_KINDS = 50_000  # that go to all tasks with their counts


@register(
    "json_cut_repair",
    "X17 X18 X21",
    # Strings that are whole are taken out; a quote that is left says that the text ends within one. Pairs of brackets go from the inside out.
    # DuckDB takes a comma before a closing bracket, Spark and Python do not.
    f"""with d as (select event_id, {DAMAGED} as t from events), c as (select event_id, k, left(t, k::int) as t from d, unnest(range(1, length(t) + 1)) r(k)),
    s as (select *, regexp_replace(t, '"([^"\\\\]|\\\\.)*"', '0', 'g') as bare from c), b as (select *, contains(bare, '"') as quoted, regexp_replace(bare, '[^{{}}\\[\\]]', '', 'g') as brackets from s),
    o as (select *, replace(replace(replace(replace(replace(replace(replace(replace(brackets, '{{}}', ''), '[]', ''), '{{}}', ''), '[]', ''), '{{}}', ''), '[]', ''), '{{}}', ''), '[]', '') as open from b),
    m as (select event_id, t, case when quoted then '' else translate(reverse(open), '{{[', '}}]') end as closing, bare from o),
    r as (select event_id, t || closing as mended, closing = '' as same, json_valid(t || closing) and not regexp_matches(bare || closing, ',\\s*[}}\\]]') as good from m)
    select event_id, LONG(count(*)) as cuts, COUNT_IF(same and good) as whole, COUNT_IF(good) as parsed, LONG(max(case when good then length(mended) end)) as longest, LONG(max(case when good then json_array_length(mended, '$.tags') end)) as tags from r group by event_id""",
)
def json_cut_repair(spark, sf_dir):
    """A nested object for each event, cut behind every character and mended: how many cuts parse, and what the fullest holds.

    An event's id stands in its object as a number only, of which parsers see the sign and how many digits there are. Events that are alike but
    for their digits have equal counts, so each kind of object is cut and mended once.
    """
    number = F.regexp_replace(F.col("event_id").cast("string"), "[0-9]", "1")
    x = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"id": '), number, F.lit(', "tags": ["'), "event_type", F.lit('", "a,]", {"p": '), "props", F.lit('}], "note": "q\\"}{[", "end": true}')).alias("kind"))
    kinds = scratch.cut(x.groupBy("kind").count().select("kind"))
    cuts = kinds.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("kind")))).select("kind", F.left("kind", F.col("k")).alias("t"))
    cuts = cuts.withColumn("mended", repaired("t")).withColumn("v", F.try_parse_json("mended"))
    right = F.col("v").isNotNull()
    tags = F.size(F.try_variant_get("v", "$.tags", "array<variant>"))
    found = cuts.groupBy("kind").agg(
        F.count("*").alias("cuts"), F.count_if(F.try_parse_json("t").isNotNull()).alias("whole"), F.count_if(right).alias("parsed"),
        F.max(F.when(right, F.length("mended"))).cast("bigint").alias("longest"), F.max(F.when(right & (tags >= 0), tags)).cast("bigint").alias("tags"),
    )
    found = scratch.cut(found)
    each = x.join(F.broadcast(found) if found.count() <= FEW_KINDS else found, "kind")
    return each.groupBy("event_id").agg(*(F.sum(c).alias(c) for c in ("cuts", "whole", "parsed")), *(F.max(c).alias(c) for c in ("longest", "tags")))


FIRST = "regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[#`~\\s]+', ' ', 'g')"


@register(
    "task_sections",
    "S16",
    f"""with d as (select doc_id, 'A ' || trim({FIRST}) || ' z' as goal, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang, coalesce(n_chars, 0) as n from documents)
    select doc_id, LONG(s) as section, case s when 1 then 1 when 4 then 3 else 2 end as level, t as title, p as path, b as body, i as items from d, lateral (values
      (1, 'Task ' || doc_id, 'Task ' || doc_id, '', ''), (2, 'Goal', 'Task ' || doc_id || ' / Goal', goal || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '~~~' || chr(10) || '```', ''),
      (3, 'Constraints', 'Task ' || doc_id || ' / Constraints', '- from ' || source || chr(10) || '* at most ' || n, 'from ' || source || '|at most ' || n),
      (4, 'Detail', 'Task ' || doc_id || ' / Constraints / Detail', lang, ''), (5, 'Hints', 'Task ' || doc_id || ' / Hints', '- read ' || lang, 'read ' || lang)) v(s, t, p, b, i)""",
)
def task_sections(spark, sf_dir):
    """Task files written from the documents, read back by their sections: a fence hides a heading and the other kind of fence."""
    first = F.regexp_replace(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1), r"[#`~\s]+", " ")
    none = lambda c: F.coalesce(c, F.lit("none"))
    text = F.concat(F.lit("# Task "), F.col("doc_id").cast("string"), F.lit("\r\n\n## Goal ##\nA "), F.trim(first), F.lit(" z\n```\n# no heading\n~~~\n```\n\n## Constraints\n- from "), none("source"), F.lit("\n* at most "), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("\n### Detail\n"), none("lang"), F.lit("\n## Hints\n\n- read "), none("lang"), F.lit("\n"))
    got = sections.sections(table(spark, sf_dir, "documents").select("doc_id", text.alias("md")), "doc_id", "md")
    return got.select("doc_id", "section", "level", "title", "path", "body", F.array_join("items", "|").alias("items"))


@register(
    "page_headings",
    "S16",
    "with h as (select page_id, regexp_extract_all(html, '<h[1-6]>[^<]*</h[1-6]>') as hs from pages), e as (select page_id, unnest(hs) as h, generate_subscripts(hs, 1) as section from h), l as (select page_id, section, h[3]::int as level, trim(regexp_replace(h, '<[^>]*>|[\\r\\n]+', ' ', 'g')) as title from e) "
    "select l.page_id, LONG(section) as section, level, title, coalesce((select arg_max(o.title, o.section) from l o where o.page_id = l.page_id and o.section < l.section and o.level < l.level), '') as parent from l",
)
def page_headings(spark, sf_dir):
    """The headings of pages as a tree, each with the one above it; markup becomes Markdown first."""
    heads = F.regexp_extract_all("html", F.lit(r"<h[1-6]>[^<]*</h[1-6]>"), F.lit(0))
    line = lambda h: F.concat(F.repeat(F.lit("#"), F.substring(h, 3, 1).cast("int")), F.lit(" "), F.trim(F.regexp_replace(h, r"<[^>]*>|[\r\n]+", " ")), F.lit(" ."))
    md = F.array_join(F.transform(heads, line), "\n")
    got = sections.sections(table(spark, sf_dir, "pages").select("page_id", md.alias("md")), "page_id", "md").where("level > 0")
    cut = lambda c: F.regexp_replace(c, r" \.$", "")
    parts = F.split("path", r" \. / ")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    return got.select("page_id", "section", "level", cut(F.col("title")).alias("title"), parent.alias("parent"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def config_errors(text: pd.Series) -> pd.Series:
    return text.map(lambda t: config.composite_errors(json.loads(t)))


@register(
    "composite_schema_gate",
    "Q12 Q15",
    "select user_id, event_id, case event_id % 8 when 0 then '' when 1 then '$.composite_score.boundary_pass_at_1: missing' when 2 then '$.composite_score.extra: unknown' when 3 then '$.composite_score.schema_version: other version' when 4 then '$.composite_score.hidden_pass_rate: outside 0 to 1|$.composite_score.static_repair_success: string is no number' when 5 then '$.composite_score.hidden_pass_rate: not finite' when 6 then '$.composite_score: weights do not sum to 1' else '$.composite_score: missing' end as errors from events",
)
def composite_schema_gate(spark, sf_dir):
    """A configuration for each event, its weights from the row and damaged in one of seven ways: all errors with their paths."""
    kind = F.col("event_id") % 8
    share = F.round(F.pmod("user_id", F.lit(80)) / 100.0, 2)
    last = F.when(kind == 4, F.lit("1.5")).when(kind == 5, F.lit("NaN")).when(kind == 6, F.lit("0.9")).otherwise((0.8 - share).cast("string"))
    pair = lambda name, v: F.concat(F.lit(f'"{name}": '), v)
    fields = F.array_compact(F.array(
        pair("code_generation_pass_at_1", share.cast("string")), F.when(kind != 1, pair("boundary_pass_at_1", F.lit("0.1"))), pair("static_repair_success", F.when(kind == 4, F.lit('"x"')).otherwise(F.lit("0.1"))),
        pair("execution_repair_success", F.lit("0")), pair("hidden_pass_rate", last), pair("hard_constraint", F.lit('{"max_drop": 3.0, "over": [1, {"deep": null}]}')),
        pair("schema_version", F.when(kind == 3, F.lit('"0.9"')).otherwise(F.lit('"1.0.0"'))), F.when(kind == 2, F.lit('"extra": 1')),
    ))
    text = F.when(kind == 7, F.lit('{"tier": 2}')).otherwise(F.concat(F.lit('{"composite_score": {'), F.array_join(fields, ", "), F.lit('}, "tier": [1]}')))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.array_join(config_errors(text), "|").alias("errors"))
