"""Building blocks of the DuckDB statements that the queries are held against."""

from __future__ import annotations

import re


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(expr: str, steps: list[tuple[str, str]], ignore_case: bool = False) -> str:
    for pattern, new in steps:
        own = ignore_case or pattern.startswith("(?i)")
        expr = f"regexp_replace({expr}, {quote(pattern.removeprefix('(?i)'))}, {quote(re.sub(r'{(\d)}', r'\\\1', new))}, {quote('gi' if own else 'g')})"
    return expr


def spans(source: str, ident: str, pattern: str, expr: str = "text", shown: str | None = None) -> str:
    """(ident, text, start, end) of all matches in ``expr`` over a relation."""
    return f"""select {ident}, substr(shown, (st + 1)::int, length(m[i])) as text, st::int as start, (st + length(m[i]))::int as "end" from (
 select *, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)) as st from (
  select *, unnest(range(1, len(m) + 1)) as i from (
   select {ident}, {shown or expr} as shown, regexp_extract_all({expr}, {quote(pattern)}, 0) as m, string_split_regex({expr}, {quote(pattern)}) as g from {source})))"""


def case(expr: str, table: dict[str, str] | list[tuple[str, str]], other: str, test: str = "=") -> str:
    items = table.items() if isinstance(table, dict) else table
    when = " ".join(f"when {expr} = {quote(k)} then {quote(v)}" if test == "=" else f"when contains({expr}, {quote(k)}) then {quote(v)}" for k, v in items)
    return f"case {when} else {other} end"


def any_of(expr: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({expr}, {quote(w)})" for w in words) + ")"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(map(quote, words)) + ")"


def values(words: list[str]) -> str:
    return ", ".join(f"({quote(w)})" for w in words)
