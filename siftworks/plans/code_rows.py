"""Queries on Python code that is made of all lines of a document: each line becomes a statement by its number of words, with its length as constant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import python_code
from ..sources.scratch import cut
from .catalogue import register, table

# By words modulo their number; {c} is the line's length.
STATEMENTS = (
    "    total = total + {c}",
    "    if total > {c}:\n        total = total - 1",
    "    for i in range({c}):\n        total = total + xs[0]",
    "    out.append({c})",
    "    total = max(total, {c})",
    "    out = sorted(out)",
    "    if not xs:\n        return False",
    "    out = out[::-1]",
    "    eval('{c}')",
    "    import socket",
)
START, END = "    total = 0\n    out = []", "    return total + len(out)"
BROKEN = 7  # documents whose length ends so lack a colon
WORD = r"[^ \t\r]+"


def _text(s: str) -> str:
    """A literal of DuckDB."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


_cases = " ".join(f"when {k} then " + " || l.c || ".join(_text(part) for part in s.split("{c}")) for k, s in enumerate(STATEMENTS))
# (doc_id, name, kinds of the lines, statements, broken, code) for the twins.
CODE_SQL = f"""d as (select doc_id, coalesce(text, '') as text from documents),
s as (select doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')), lambda x: {{'k': len(regexp_extract_all(x, '{WORD}')) % {len(STATEMENTS)}, 'c': length(x)}}) as ls from d),
j as (select doc_id, 'f_' || coalesce(nullif(regexp_extract(text, '[a-z]+'), ''), 'x') as name, length(text) % 10 = {BROKEN} as broken, list_transform(ls, lambda l: l.k) as kinds, list_transform(ls, lambda l: case l.k {_cases} end) as stmts from s),
code as (select *, 'def ' || name || '(xs, k=' || len(kinds) || ')' || case when broken then '' else ':' end || chr(10) || {_text(START)} || chr(10) || array_to_string(list_concat(stmts, [{_text(END)}]), chr(10)) as code from j)"""


def code_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, name, code) of every document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def statement(x):
        k, out = F.regexp_count(x, F.lit(WORD)) % len(STATEMENTS), F.lit(None)
        for i, s in enumerate(STATEMENTS):
            out = F.when(k == i, F.replace(F.lit(s), F.lit("{c}"), F.length(x).cast("string"))).otherwise(out)
        return out

    name = F.concat(F.lit("f_"), F.coalesce(F.nullif(F.regexp_extract(text, "[a-z]+", 0), F.lit("")), F.lit("x")))
    colon = F.when(F.length(text) % 10 == BROKEN, "").otherwise(":")
    x = table(spark, sf_dir, "documents").select("doc_id", "source", name.alias("name"), colon.alias("colon"), F.transform(lines, statement).alias("stmts"))
    code = F.concat(F.lit("def "), "name", F.lit("(xs, k="), F.size("stmts").cast("string"), F.lit(")"), "colon", F.lit("\n" + START + "\n"), F.array_join(F.concat("stmts", F.array(F.lit(END))), "\n"))
    return x.select("doc_id", "source", "name", code.alias("code"))


@F.pandas_udf(T.StructType([*(T.StructField(c, T.StringType()) for c in ("structural", "bare", "signature", "findings")), T.StructField("compiles", T.BooleanType())]))
def structure(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([python_code.summary(c) for c in code], columns=["structural", "bare", "signature", "findings", "compiles"])


# Trees without names and constants are equal where names of functions and kinds of lines are; code that does not parse stands for itself.
@register(
    "code_structure",
    "D6 D7 X29 X30 X31",
    f"with {CODE_SQL}, f as (select doc_id, code, broken, name, case when broken then code else name || '/' || array_to_string(kinds, ',') end as shape, array_to_string(list_filter([case when not broken and list_contains(kinds, 8) then 'call eval' end, case when not broken and list_contains(kinds, 9) then 'import socket' end, case when broken then 'syntax' end], lambda x: x is not null), ',') as findings from code) "
    "select doc_id, min(doc_id) over (partition by shape) as structural_first, LONG(count(*) over (partition by shape)) as structural_members, min(doc_id) over (partition by code) as bare_first, case when not broken then min(doc_id) over (partition by broken, name) end as signature_first, findings, not broken as compiles from f",
)
def code_structure(spark, sf_dir):
    """Classes of code by structural hash, by tree and by signature, each named by its first document; what the screen finds; whether it compiles."""
    x = code_samples(spark, sf_dir).select("doc_id", structure("code").alias("s")).select("doc_id", "s.*").withColumnRenamed("findings", "found")
    x = x.select("doc_id", "structural", "bare", "signature", F.col("found").alias("findings"), "compiles")
    x = cut(x)
    for key in ("structural", "bare", "signature"):
        first = cut(x.groupBy(key).agg(F.min("doc_id").alias(f"{key}_first"), F.count("*").alias(f"{key}_members")).where(F.col(key).isNotNull()))
        x = x.join(first, key, "left")
    return x.select("doc_id", "structural_first", "structural_members", "bare_first", "signature_first", "findings", "compiles")


@register("signature_lines", "X11", f"with {CODE_SQL} select doc_id, name as function, 'xs, k=' || len(kinds) as arguments, LONG(1) as line, broken from code")
def signature_lines(spark, sf_dir):
    """The first signature of each code by a pattern over its lines, where it parses and where it does not."""
    pattern = r"(?m)^\s*def\s+(\w+)\s*\(([^)]*)\)\s*(:?)"
    of = lambda k: F.regexp_extract("code", pattern, k)
    line = F.size(F.split(F.substring_index("code", "def ", 1), "\n"))
    return code_samples(spark, sf_dir).select("doc_id", of(1).alias("function"), of(2).alias("arguments"), line.cast("bigint").alias("line"), (of(3) == "").alias("broken"))


def _variants(rules):
    def run(batches):
        for pdf in batches:
            rows = [(d, name, new) for d, code in zip(pdf.doc_id, pdf.code) for name, new in python_code.variants(code, rules)]
            yield pd.DataFrame(rows, columns=["doc_id", "rewrite", "code"])

    return run


def _rewrites(*rules: tuple[str, str, str]) -> str:
    """Rows (doc_id, rewrite, code) of code in which the first match of a pattern is replaced, where there is one."""
    return " union all ".join(f"select doc_id, '{name}' as rewrite, regexp_replace(code, '{pattern}', '{new}') as code from code where not broken and regexp_matches(code, '{pattern}')" for name, pattern, new in rules)


BUGS_SQL = _rewrites(
    ("condition_error", "total > ", "total >= "),
    ("off_by_one", r"range\(([0-9]+)\)", r"range(\1 - 1)"),
    ("return_value_error", r"return total \+ len\(out\)", "return None"),
    ("index_error", r"xs\[0\]", "xs[1]"),
    ("initialization_error", "total = 0", "total = 1"),
    ("aggregation_error", r"max\(", "min("),
    ("branch_deletion", r"if (total > [0-9]+:\n        total = total - 1|not xs:\n        return False)", "pass"),
    ("type_error", "total = 0", "total = ''''"),
)
MUTATIONS_SQL = _rewrites(
    ("flip_comparison", "total > ", "total <= "),
    ("off_by_one_minus1", r"range\(([0-9]+)\)", r"range(\1 - 1)"),
    ("off_by_one_plus1", r"range\(([0-9]+)\)", r"range(\1 + 1)"),
    ("wrong_sort_dir", r"sorted\(out\)", "sorted(out, reverse=True)"),
    ("wrong_index_plus1", r"xs\[0\]", "xs[1]"),
    ("flip_bool_return", "return False", "return True"),
    ("remove_first_extend", r"out\.append\([0-9]+\)", "pass"),
    ("drop_guard", r"if not xs:\n        return False", "pass"),
    ("flip_slice_step", r"out\[::-1\]", "out[::1]"),
    # The first name that is read: imports read none, and what is assigned to or looped over comes before it.
    ("typo_identifier", r"(?s)^(.*?\n    out = \[\]\n(?:    import socket\n)*    (?:total = |if not |if |for i in |out = |return )?)(total|xs|range|out|max|sorted|eval)\b", r"\1\2_typo"),
) + r""" union all select doc_id, 'wrong_arithmetic', case when regexp_extract(code, 'total ([-+]) [0-9a-z]', 1) = '+' then regexp_replace(code, 'total \+ ', 'total - ') else regexp_replace(code, 'total - ', 'total + ') end from code where not broken"""


@register("bug_variants", "V5 V5a V5b V5c V5d V5e V5f V5g V5h V5i V7", f"with {CODE_SQL} {BUGS_SQL}")
def bug_variants(spark, sf_dir):
    """Each injected bug at the first place of the code that has one."""
    return code_samples(spark, sf_dir).select("doc_id", "code").mapInPandas(_variants(python_code.BUGS), "doc_id bigint, rewrite string, code string")


@register("mutation_variants", "V6 V6a V6b V6c V6d V6e V6f V6g V6h V6i V6j V6k", f"with {CODE_SQL} {MUTATIONS_SQL}")
def mutation_variants(spark, sf_dir):
    """Each mutation at the first place of the code that has one."""
    return code_samples(spark, sf_dir).select("doc_id", "code").mapInPandas(_variants(python_code.MUTATIONS), "doc_id bigint, rewrite string, code string")


@register("boundary_variants", "V8 V8a V8b V9 X32")
def boundary_variants(spark, sf_dir):
    """Edge cases of arguments that each row has: its number of characters, the lengths of its lines, its source, a share, a flag, a list of texts; dealt into three sets that share none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for d, n, lines, source in zip(pdf.doc_id, pdf.n, pdf["lengths"], pdf.source):
                arguments = [int(n), [int(x) for x in lines], source or "", n / 7, n % 2 == 0, [source or ""]]
                rows += [(d, i, len(s), repr(s)) for i, s in enumerate(python_code.boundary_sets(arguments))]
            yield pd.DataFrame(rows, columns=["doc_id", "variant", "n_cases", "cases"])

    lengths = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x))
    x = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"), lengths.alias("lengths"), "source")
    return x.mapInPandas(run, "doc_id bigint, variant int, n_cases int, cases string")


SAMPLES = 50  # that a task has at least, about
TOGETHER = 400  # that one process of pytest runs: it takes as long to begin as some 60 samples


def _tests(names: list[str], codes: list[str]) -> list[tuple[int, str | None]]:
    """For each code the number of calls at the edges of both arguments, and pytest functions of what it does on them; None where it does not run."""
    calls = [[xs, k] for xs in python_code.boundary_values([3, 1]) for k in (0, -1)]
    outputs = python_code.outputs_many([(code, name, calls) for name, code in zip(names, codes)])
    return [(len(calls), None if o is None else python_code.test_functions(name, calls, o)) for name, o in zip(names, outputs)]


# Only an empty list of numbers is indexed out of range, in a loop that runs, and before any guard returns.
@register(
    "boundary_outputs",
    "V8c V9 V8 V1 V2 V4 Q24",
    f"with {CODE_SQL} select distinct name, code, 10 as cases, not broken as ran, case when broken then 0 else 10 end as collected, not broken as passed, false as canary_passed, case when broken then 0 when regexp_matches(code, '(?s)^.*for i in range\\([1-9]') and not regexp_matches(split_part(code, 'for i in range(', 1), 'if not xs') then 2 else 0 end as raising from code",
)
def boundary_outputs(spark, sf_dir):
    """Tests made of what each distinct code does at the edges of its arguments, errors as pytest.raises: pytest passes them on the code, and fails all code whose last return is gone."""

    def run(batches):
        none = {"passed": False, "collected": 0}
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                codes = part.code.tolist()
                made = _tests(part.name.tolist(), codes)
                tried = [k for k, (_, tests) in enumerate(made) if tests is not None]
                right = dict(zip(tried, python_code.pytest_many([(codes[k], made[k][1]) for k in tried])))
                canary = dict(zip(tried, python_code.pytest_many([(codes[k].replace(END, "    return 'canary'").replace("return False", "return 'canary'"), made[k][1]) for k in tried], first=True)))
                rows = [(n, codes[k], made[k][0], made[k][1] is not None, right.get(k, none)["collected"], right.get(k, none)["passed"], canary.get(k, none)["passed"], (made[k][1] or "").count("pytest.raises")) for k, n in enumerate(part.name)]
                yield pd.DataFrame(rows, columns=["name", "code", "cases", "ran", "collected", "passed", "canary_passed", "raising"])

    # Codes are small but take long, so tasks are told by their number; by their bytes a few would have all.
    n, most = table(spark, sf_dir, "documents").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-n // SAMPLES), max(most, n // 20_000)))
    return code_samples(spark, sf_dir).select("name", "code").repartition(tasks, "name", "code").distinct().mapInPandas(run, "name string, code string, cases int, ran boolean, collected int, passed boolean, canary_passed boolean, raising int")
