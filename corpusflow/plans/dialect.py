"""One relational text, two dialects.

Operators are written as SQL over named inputs, `{blocks}`, in a common subset with a few macros, `$name(args)`.
`spark_sql` gives Catalyst's form; `duck_sql` gives the form that the oracle engine runs.
Patterns are raw literals, r'...', written so that both regular-expression engines read them alike.
"""

from __future__ import annotations

import re

#: macro -> (Spark, DuckDB) with positional holes.
MACROS = {
    "replace_all": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "matches": ("regexp_like({0}, {1})", "regexp_matches({0}, {1})"),
    "extract": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "count_matches": ("cast(regexp_count({0}, {1}) AS BIGINT)", "len(regexp_extract_all({0}, {1}))"),
    "all_matches": ("regexp_extract_all({0}, {1}, 0)", "regexp_extract_all({0}, {1})"),
    "starts": ("startswith({0}, {1})", "starts_with({0}, {1})"),
    "div": ("({0} div {1})", "({0} // {1})"),
    "floor": ("cast(floor({0}) AS BIGINT)", "cast(floor({0}) AS BIGINT)"),
    "sha1": ("sha1({0})", "sha1({0})"),
    "sha256": ("sha2({0}, 256)", "sha256({0})"),
    "size": ("cast(size({0}) AS BIGINT)", "len({0})"),
    "split": ("split({0}, {1}, -1)", "string_split_regex({0}, {1})"),
    "join": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "at": ("try_element_at({0}, cast({1} AS INT))", "list_extract({0}, cast({1} AS INT))"),
    "slice": ("slice({0}, {1}, {2})", "list_slice({0}, {1}, {1} + {2} - 1)"),
    "sorted": ("array_sort({0})", "list_sort({0})"),
    "distinct": ("array_distinct({0})", "list_distinct({0})"),
    "intersect": ("array_intersect({0}, {1})", "list_intersect({0}, {1})"),
    "union": ("array_union({0}, {1})", "list_distinct(list_concat({0}, {1}))"),
    "except": ("array_except({0}, {1})", "list_filter({0}, lambda z: NOT list_contains({1}, z))"),
    "has": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "list": ("sort_array(collect_list({0}))", "coalesce(list_sort(list({0}) FILTER (WHERE ({0}) IS NOT NULL)), [])"),
    "set": ("sort_array(collect_set({0}))", "coalesce(list_sort(list(DISTINCT {0}) FILTER (WHERE ({0}) IS NOT NULL)), [])"),
    "texts": ("array_join(transform(sort_array(collect_list(struct({1} AS o, {0} AS t))), x -> x.t), {2})", "coalesce(string_agg({0}, {2} ORDER BY {1}), '')"),
    "array": ("array({0})", "[{0}]"),
    "double": ("cast({0} AS DOUBLE)", "cast({0} AS DOUBLE)"),
    "long": ("cast({0} AS BIGINT)", "cast({0} AS BIGINT)"),
    "text": ("cast({0} AS STRING)", "cast({0} AS VARCHAR)"),
    "days": ("cast(datediff({0}, {1}) AS BIGINT)", "cast(date_diff('day', {1}, {0}) AS BIGINT)"),
    "date": ("to_date({0})", "cast({0} AS DATE)"),
    "range": ("sequence({0}, {1})", "generate_series({0}, {1})"),
    "chr": ("chr({0})", "chr({0})"),
    "json": ("get_json_object({0}, {1})", "json_extract_string({0}, {1})"),
    "seconds": ("unix_timestamp({0})", "cast(floor(epoch({0})) AS BIGINT)"),
    "even": ("bround({0}, {1})", "round_even({0}, {1})"),
    "hexint": ("cast(conv({0}, 16, 10) AS BIGINT)", "cast(('0x' || {0}) AS BIGINT)"),
    "explode": ("explode({0})", "unnest({0})"),
    "groups": ("regexp_extract_all({0}, {1}, {2})", "regexp_extract_all({0}, {1}, {2})"),
    "map": ("transform({0}, x -> {1})", "list_transform({0}, lambda x: {1})"),
    "keep": ("filter({0}, x -> {1})", "list_filter({0}, lambda x: {1})"),
    "stddev": ("coalesce(stddev_samp({0}), 0)", "coalesce(stddev_samp({0}), 0)"),
    "max_by": ("max_by({0}, {1})", "arg_max({0}, {1})"),
    "min_by": ("min_by({0}, {1})", "arg_min({0}, {1})"),
}


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of the call whose opening parenthesis is at start, and where it ends."""
    depth, quote, args, last, i = 0, False, [], start + 1, start
    while True:
        c = text[i]
        if c == "'":
            quote = not quote
        elif not quote:
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    args.append(text[last:i])
                    return args, i + 1
            elif c == "," and depth == 1:
                args.append(text[last:i])
                last = i + 1
        i += 1


def expand(sql: str, which: int) -> str:
    """Macros in the form of Spark (0) or the oracle (1)."""
    out, i = [], 0
    for m in iter(lambda: re.compile(r"\$([a-z_0-9]+)\(").search(sql, i), None):
        args, end = _arguments(sql, m.end() - 1)
        out.append(sql[i : m.start()])
        out.append(MACROS[m[1]][which].format(*(expand(a.strip(), which) for a in args)))
        i = end
    return "".join(out) + sql[i:]


def spark_sql(sql: str) -> str:
    return expand(sql, 0).replace("@@", "$")  # group references in replacements


def duck_sql(sql: str) -> str:
    text = re.sub(r"\br'", "'", expand(sql, 1)).replace("@@", "\\")
    return text
