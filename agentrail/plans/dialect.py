"""Tiny macro pass so one SQL text serves Spark and DuckDB.

Only used for the stand-in views over the driver's tables and for the
DuckDB oracles; the library itself is DataFrame code.  Macros are written
``NAME(arg, ...)`` with balanced parentheses; arguments may contain nested
calls and quoted strings.
"""

from __future__ import annotations

import re

_MACROS = {
    "spark": {
        "EPOCH_US": lambda a: f"unix_micros(CAST({a[0]} AS TIMESTAMP))",
        "ARR": lambda a: f"array({', '.join(a)})",
        "JSTR": lambda a: f"get_json_object({a[0]}, {a[1]})",
        "JQ": lambda a: f"regexp_replace(to_json(named_struct('v', {a[0]})), '^[{{]\"v\":|[}}]$', '')",
        "IDIV": lambda a: f"({a[0]} div {a[1]})",
        "STRAGG": lambda a: (f"array_join(transform(array_sort(collect_list(named_struct('o', {a[2]}, 'v', {a[0]}))), "
                             f"x -> x.v), {a[1]})"),
        "WSTRAGG": lambda a: f"array_join(collect_list({a[0]}) OVER ({a[2]}), {a[1]})",
        "TS": lambda a: f"timestamp_micros(CAST({a[0]} * 1000000 AS BIGINT))",
        "DATE_OF": lambda a: f"CAST(timestamp_micros(CAST(floor({a[0]} * 1000000) AS BIGINT)) AS DATE)",
        "SHA256": lambda a: f"sha2({a[0]}, 256)",
        "USD": lambda a: f"(CAST(floor(({a[0]} + 500000) / 1000000) AS DOUBLE) / 1000000.0)",
    },
    "duckdb": {
        "EPOCH_US": lambda a: f"epoch_us({a[0]})",
        "ARR": lambda a: f"list_value({', '.join(a)})",
        "JSTR": lambda a: f"json_extract_string({a[0]}, {a[1]})",
        "JQ": lambda a: f"CAST(to_json({a[0]}) AS VARCHAR)",
        "IDIV": lambda a: f"({a[0]} // {a[1]})",
        "STRAGG": lambda a: f"string_agg({a[0]}, {a[1]} ORDER BY {a[2]})",
        "WSTRAGG": lambda a: f"string_agg({a[0]}, {a[1]}) OVER ({a[2]})",
        "TS": lambda a: f"make_timestamp(CAST({a[0]} * 1000000 AS BIGINT))",
        "DATE_OF": lambda a: f"CAST(make_timestamp(CAST(floor({a[0]} * 1000000) AS BIGINT)) AS DATE)",
        "SHA256": lambda a: f"sha256({a[0]})",
        "USD": lambda a: f"(CAST((CAST({a[0]} AS HUGEINT) + 500000) // 1000000 AS DOUBLE) / 1000000.0)",
    },
}

_NAME = re.compile(r"\b(" + "|".join(sorted(_MACROS["spark"], key=len, reverse=True)) + r")\(")


def _split_args(body: str) -> list[str]:
    args, depth, cur, quote = [], 0, [], None
    for ch in body:
        if quote:
            cur.append(ch)
            if ch == quote:
                quote = None
            continue
        if ch in ("'", '"'):
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "," and depth == 0:
            args.append("".join(cur).strip())
            cur = []
            continue
        cur.append(ch)
    args.append("".join(cur).strip())
    return args


def render(sql: str, dialect: str) -> str:
    """Expand every macro call in ``sql`` for ``dialect`` (inside-out)."""
    macros = _MACROS[dialect]
    while True:
        m = None
        for m_ in _NAME.finditer(sql):
            m = m_  # the last match is innermost-or-later; expand it first
        if m is None:
            return sql
        start = m.end()
        depth, i, quote = 1, start, None
        while depth:
            ch = sql[i]
            if quote:
                if ch == quote:
                    quote = None
            elif ch in ("'", '"'):
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            i += 1
        args = _split_args(sql[start:i - 1])
        sql = sql[:m.start()] + macros[m.group(1)](args) + sql[i:]
