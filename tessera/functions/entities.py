"""HTML character references as a column expression: all named ones of HTML5 and numeric ones, with or without a semicolon.

The name table comes from the standard library's ``html.entities``; which numbers stand for another character (or none) is
asked of ``html.unescape`` number by number. ``&amp;`` is decoded once, like every other reference.
"""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = {"&" + n: c for n, c in sorted(html5.items(), key=lambda x: (x[0].endswith(";"), x[0])) if n.endswith(";")}
# names that also count without a semicolon, so with anything after them
BARE = {"&" + n: c for n, c in html5.items() if not n.endswith(";")}
BARE_PATTERN = "^(?:" + "|".join(sorted(BARE, key=lambda n: (-len(n), n))) + ")"
PIECES = "&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
# numbers below 256 and non-characters that do not stand for their own code point
ODD = {n: html.unescape(f"&#{n};") for n in [*range(256), *range(0xFDD0, 0xFDF0), *(p * 0x10000 + x for p in range(17) for x in (0xFFFE, 0xFFFF)),
                                             0x0B] if html.unescape(f"&#{n};") != chr(n)}
REPLACED = "�"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _char(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric(p: Column) -> Column:
    hexa = p.rlike("^&#[xX]")
    digits = F.regexp_replace(p, "^&#[xX]?0*|;$", "")
    value = F.when(digits == "", F.lit(0).cast("bigint")).when(F.length(digits) > 8, F.lit(1 << 30).cast("bigint")).otherwise(
        F.when(hexa, F.conv(digits, 16, 10)).otherwise(F.regexp_extract(digits, "^[0-9]+", 0)).try_cast("bigint"))
    odd = _map(ODD)[value.cast("int")]
    return (F.when((value > 0x10FFFF) | ((value >= 0xD800) & (value < 0xE000)), F.lit(REPLACED))
            .otherwise(F.coalesce(odd, _char(value))))


def _named(p: Column) -> Column:
    bare = F.regexp_extract(p, BARE_PATTERN, 0)
    rest = F.substring(p, F.length(bare) + 1, F.length(p))
    return F.coalesce(_map(NAMED)[p], F.when(bare != "", F.concat(_map(BARE)[bare], rest)), p)


def decode_references(c: Column) -> Column:
    """``html.unescape`` of a text column."""
    parts = F.transform(F.regexp_extract_all(c, F.lit(PIECES), F.lit(0)), lambda p: (
        F.when(~p.startswith("&") | (p == "&"), p).when(p.startswith("&#"), _numeric(p)).otherwise(_named(p))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def sql_decode_references(expr: str) -> str:
    """The same in DuckDB."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"

    def table(pairs):
        return "MAP {" + ", ".join(f"{q(a) if isinstance(a, str) else a}: {q(b) if b != chr(0) else 'chr(0)'}" for a, b in pairs.items()) + "}"
    digits = "regexp_replace(p, '^&#[xX]?0*|;$', '', 'g')"
    value = (f"CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) > 8 THEN 1073741824 WHEN regexp_matches(p, '^&#[xX]') "
             f"THEN CAST('0x' || {digits} AS BIGINT) ELSE CAST({digits} AS BIGINT) END")
    bare = f"regexp_extract(p, {q(BARE_PATTERN)})"
    numeric = (f"CASE WHEN {value} > 1114111 OR ({value} >= 55296 AND {value} < 57344) THEN chr(65533) "
               f"ELSE coalesce({table(ODD)}[{value}], chr(CAST({value} AS INTEGER))) END")
    named = f"coalesce({table(NAMED)}[p], CASE WHEN {bare} <> '' THEN {table(BARE)}[{bare}] || substring(p, length({bare}) + 1) END, p)"
    return (f"CASE WHEN contains({expr}, '&') THEN array_to_string(list_transform(regexp_extract_all({expr}, {q(PIECES)}), lambda p: "
            f"CASE WHEN p = '&' OR NOT starts_with(p, '&') THEN p WHEN starts_with(p, '&#') THEN {numeric} ELSE {named} END), '') "
            f"ELSE {expr} END")
