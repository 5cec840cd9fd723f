"""One notation for queries that Spark SQL and DuckDB spell differently: capital calls become each engine's own."""

from __future__ import annotations

import re

# name: (Spark SQL, DuckDB); {0}, {1} are arguments, {all} all of them.
CALLS = {
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "REPLACE_ALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "FIND_ALL": ("regexp_extract_all({0}, {1}, 0)", "regexp_extract_all({0}, {1}, 0)"),
    "FIND": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "MATCHES": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "SIZE": ("cast(size({0}) as bigint)", "cast(len({0}) as bigint)"),
    "EACH": ("transform({0}, x -> {1})", "list_transform({0}, lambda x: {1})"),
    "WHERE_EACH": ("filter({0}, x -> {1})", "list_filter({0}, lambda x: {1})"),
    "BROUND": ("bround({0}, {1})", "round_even({0}, {1})"),
    "LONG": ("cast({0} as bigint)", "cast({0} as bigint)"),
    "DOUBLE": ("cast({0} as double)", "cast({0} as double)"),
    "TEXT": ("cast({0} as string)", "cast({0} as varchar)"),
    "COUNT_IF": ("cast(count_if({0}) as bigint)", "cast(count(*) filter (where {0}) as bigint)"),
    "RATE": ("round(coalesce(try_divide(cast({0} as double), cast({1} as double)), 0.0D), 6)", "round(coalesce(cast({0} as double) / nullif(cast({1} as double), 0), 0.0), 6)"),
    "FIRST_BY": ("min_by({0}, {1})", "arg_min_null({0}, {1})"),
    "QUANTILE": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "LINES": ("split({0}, '\\n', -1)", "string_split({0}, chr(10))"),
    "SPLIT": ("split({0}, {1}, -1)", "string_split({0}, {1})"),
    "JOIN": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "UNIQUE": ("array_distinct({0})", "list_distinct({0})"),
    "COMMON": ("array_intersect({0}, {1})", "list_intersect({0}, {1})"),
    "EITHER": ("array_union({0}, {1})", "list_distinct(list_concat({0}, {1}))"),
    "HAS": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "SORTED_LIST": ("sort_array(collect_list({0}))", "list_sort(list({0}))"),
    "SORTED": ("sort_array({0})", "list_sort({0})"),
    "SLICE": ("slice({0}, {1}, {2})", "list_slice({0}, {1}, {1} + {2} - 1)"),
    "ARRAY": ("array({all})", "list_value({all})"),
    "RANGE": ("sequence({0}, {1})", "generate_series({0}, {1})"),
    "EXPLODE": ("explode({0})", "unnest({0})"),
    "TRY_INT": ("try_cast({0} as int)", "try_cast({0} as int)"),
    "NEWLINE": ("'\\n'", "chr(10)"),
    "EPOCH": ("unix_timestamp(cast({0} as timestamp))", "epoch({0})"),
    "EVERY": ("bool_and({0})", "bool_and({0})"),
    "ANY_OF": ("bool_or({0})", "bool_or({0})"),
    "SAFE": ("coalesce({0}, false)", "coalesce({0}, false)"),
}
_CALL = re.compile(r"\b(" + "|".join(CALLS) + r")\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens before `at`, and where it ends."""
    depth, quoted, begin, out = 0, False, at, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            if depth == 0:
                return [*out, text[begin:i].strip()], i + 1
            depth -= 1
        elif not quoted and c == "," and depth == 0:
            out.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"unbalanced call in {text[at - 20 : at + 60]!r}")


def _render(text: str, which: int) -> str:
    while m := _CALL.search(text):
        args, end = _arguments(text, m.end())
        args = [_render(a, which) for a in args]
        form = CALLS[m[1]][which]
        body = re.sub(r"\{(\d|all)\}", lambda k: ", ".join(args) if k[1] == "all" else args[int(k[1])], form)
        text = text[: m.start()] + body + text[end:]
    return text


def spark_sql(text: str) -> str:
    """The query for Spark; literals that hold a backslash are raw but for the newline."""
    out = _render(text, 0)
    return re.sub(r"(?<![\w'])'((?:[^'\\]|\\.)*)'", lambda m: f"r'{m[1]}'" if "\\" in m[1] and m[1] != "\\n" else m[0], out)


def duck_sql(text: str) -> str:
    return _render(text, 1)
