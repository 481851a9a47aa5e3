"""Pieces of DuckDB SQL that several oracles share, written apart from the Spark code they check."""

from __future__ import annotations

from ..functions.normalize import GREEK, SUBSTITUTIONS

WORD = r"[\p{L}\p{N}]+"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def upper(x: str) -> str:
    return f"replace(upper({x}), 'ẞ', 'SS')"


def rx(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"


def count(x: str, cls: str) -> str:
    return f"length({rx(x, f'[^{cls}]', '')})"


def squash(x: str) -> str:
    return f"trim({rx(x, chr(92) + 's+', ' ')})"


def _mostly(x: str) -> str:
    up, al, nu = (count(x, c) for c in (r"\p{Lu}", r"\p{L}", r"\p{N}"))
    return f"({up} >= {al} - {up} OR {nu} >= {al})"


def symbolic(x: str, cls: str | None = None) -> str:
    single = f"(instr({x}, ' ') = 0 AND (length({x}) <= 3 OR regexp_matches({x}, '(?s)^.+\\p{{Lu}}') OR regexp_matches({x}, '\\p{{N}}')))"
    default = f"({single} OR {_mostly(x)})"
    if cls == "disease":
        return f"({x} NOT IN ('flu', 'Flu', 'HIV', 'STI', 'NSCLC') AND {default})"
    if cls == "anatomy":
        return "false"
    if cls == "company":
        return f"({count(x, chr(92) + 'p{L}')} = {count(x, chr(92) + 'p{Lu}')})"
    if cls == "gene":
        parts = f"string_split_regex({x}, '[-‐\\s]+')"
        token = f"length(t) < 4 OR regexp_matches(t, '(?s)^\\p{{Ll}}.*\\p{{Lu}}') OR {_mostly('t')}"
        ends = " OR ".join(f"ends_with({x}, '{e}')" for e in ("in", "ase", "an", "gen", "gon"))
        return f"((len({parts}) = 1 AND NOT ({ends})) OR len(list_filter({parts}, lambda t: NOT ({token}))) = 0)"
    return default


def substitutions(x: str) -> str:
    for a, b in SUBSTITUTIONS:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    for h in ("-", "‐"):
        x = f"replace(replace({x}, '({h}', '(' || chr(1)), '{h})', chr(1) || ')')"
        x = f"replace(replace({x}, '{h}', ' '), chr(1), '{h}')"
    x = rx(rx(x, r"\sI\s|\sI$", " 1 "), r"\sV\s|\sV$", " 5 ")
    x = rx(f"trim({x})", r"\s*(\d+)\s*", r" \1 ")
    for a, b in GREEK.items():
        x = f"replace({x}, '{a}', ' {b.upper()} ')"
    return rx(x, r"[^\p{L}\p{N} ()+\-‐]", "")


def singular(x: str) -> str:
    cut = lambda k: f"left({x}, length({x}) - {k})"
    return f"""CASE WHEN length({x}) <= 3 OR NOT ends_with({x}, 's') OR ends_with({x}, 'sis') THEN {x}
      WHEN ends_with({x}, 'oes') THEN {cut(2)} WHEN ends_with({x}, 'ies') THEN {cut(3)} || 'y'
      WHEN regexp_matches({x}, '(xes|ses|ches|shes)$') THEN {cut(2)} ELSE {cut(1)} END"""


def initials(x: str) -> str:
    return rx(rx(x, r"\sA\s|\sA$|^A\s", " ALPHA "), r"\sB\s|\sB$|^B\s", " BETA ")


def normalized(source: str, cls: str | None = None, extra: str = "") -> str:
    """CTEs ending in ``normed(s, norm, symbolic)`` for the distinct strings s of a SELECT."""
    bare = "CASE WHEN length(s) >= 3 AND regexp_matches(s, '(?s)\\p{Lu}s$') THEN left(s, length(s) - 1) ELSE s END" if cls == "gene" else "s"
    symbol = {"gene": squash(upper(initials("g"))), "company": upper("s")}.get(cls or "", squash(upper("s")))
    return f"""src AS ({source}),
    n1 AS (SELECT s, {substitutions('s')} AS c, {substitutions(f'({bare})') if cls == 'gene' else 's'} AS g, {symbolic('s', cls)} AS symbolic FROM src),
    n2 AS (SELECT s, g, symbolic, {singular('c')} AS c FROM n1),
    normed AS (SELECT s, symbolic, CASE WHEN symbolic THEN {symbol} ELSE {squash(upper(initials('c')))} END AS norm FROM n2)"""


def tokens(table: str = "documents", key: str = "doc_id", column: str = "text", name: str = "tok") -> str:
    """CTEs ending in tok(key, i, s, e, w, and the two pieces after it): tokens with offsets."""
    pieces = f"string_split(regexp_replace({column}, '({WORD})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"""{name}_p AS (SELECT {key}, unnest({pieces}) AS w, generate_subscripts({pieces}, 1) AS i FROM {table}),
    {name}_q AS (SELECT {key}, i, w, CAST(coalesce(sum(length(w)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s,
        lead(w, 1) OVER (PARTITION BY {key} ORDER BY i) AS gap, lead(w, 2) OVER (PARTITION BY {key} ORDER BY i) AS w2 FROM {name}_p),
    {name} AS (SELECT {key}, i, s, CAST(s + length(w) AS INTEGER) AS e, w, gap, w2 FROM {name}_q WHERE i % 2 = 0)"""
