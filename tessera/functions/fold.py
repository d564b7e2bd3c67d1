"""Accent folding as a pure SQL expression: Unicode NFKD, then every non-ASCII character dropped.

For the Latin-1 Supplement and Latin Extended-A blocks (U+00A0..U+017F) this is a ``translate`` (one letter to one letter)
and a few ``replace`` calls (characters that decompose to several). Texts with characters beyond them are cut into runs
and single characters, and each character whose decomposition has an ASCII part is looked up in a map; whatever is left outside
ASCII is then dropped. Both tables are derived by rule from ``unicodedata`` over all code points. ``fold_exact`` does the same in
a vectorised Python function.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FOLD_RANGE = (0x00A0, 0x017F)
NON_ASCII = "[^\\x00-\\x7F]"


def _ascii_of(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")


def _build_tables():
    src, dst, multi = [], [], []
    for cp in range(FOLD_RANGE[0], FOLD_RANGE[1] + 1):
        ch = chr(cp)
        a = _ascii_of(ch)
        if len(a) == 1:
            src.append(ch)
            dst.append(a)
        elif len(a) > 1:
            multi.append((ch, a))
    return "".join(src), "".join(dst), multi


TRANSLATE_FROM, TRANSLATE_TO, MULTI = _build_tables()


def _beyond() -> dict[str, str]:
    """Characters after the Latin blocks whose decomposition has an ASCII part, with that part."""
    out = {}
    for cp in range(FOLD_RANGE[1] + 1, sys.maxunicode + 1):
        if not 0xD800 <= cp < 0xE000 and (a := _ascii_of(chr(cp))):
            out[chr(cp)] = a
    return out


def _ranges(chars) -> str:
    """Regular-expression class body for a set of characters (same syntax in Java and RE2)."""
    out, cps = [], sorted(map(ord, chars))
    start = prev = cps[0]
    for cp in [*cps[1:], -1]:
        if cp != prev + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{prev:X}}}")
            start = cp
        prev = cp
    return "".join(out)


BEYOND = _beyond()
BEYOND_CLASS = _ranges(BEYOND)
BEYOND_LATIN = f"[^\\x00-\\x{{{FOLD_RANGE[1]:X}}}]"
BEYOND_PIECES = f"[{BEYOND_CLASS}]|[^{BEYOND_CLASS}]+"


def fold_ascii(c) -> Column:
    """NFKD, then drop non-ASCII (e.g. ``ß`` is dropped)."""
    c = F.col(c) if isinstance(c, str) else c
    names = F.create_map(*[F.lit(x) for pair in BEYOND.items() for x in pair])
    pieces = F.transform(F.regexp_extract_all(c, F.lit(BEYOND_PIECES), F.lit(0)), lambda p: F.coalesce(names[p], p))
    # the plain range first: no character of the map lies in the Latin blocks, and the range is one comparison a character
    c = F.when(c.rlike(BEYOND_LATIN), F.array_join(pieces, "")).otherwise(c)
    for ch, rep in MULTI:
        c = F.replace(c, F.lit(ch), F.lit(rep))
    c = F.translate(c, TRANSLATE_FROM, TRANSLATE_TO)
    return F.regexp_replace(c, NON_ASCII, "")


def sql_fold_ascii(expr: str, beyond: bool = False) -> str:
    """The same expression in DuckDB SQL (used by the oracle). ``beyond``: with the characters after the Latin blocks, which
    the driver's tables do not hold."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    names = f"MAP {{{', '.join(f'{q(a)}: {q(b)}' for a, b in BEYOND.items())}}}"
    expr = (f"CASE WHEN regexp_matches({expr}, '[{BEYOND_CLASS}]') THEN array_to_string(list_transform(regexp_extract_all({expr}, "
            f"'{BEYOND_PIECES}'), lambda p: coalesce({names}[p], p)), '') ELSE {expr} END") if beyond else expr
    for ch, rep in MULTI:
        expr = f"replace({expr}, {q(ch)}, {q(rep)})"
    expr = f"translate({expr}, {q(TRANSLATE_FROM)}, {q(TRANSLATE_TO)})"
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', '', 'g')"


def _fold_series(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else
                 unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


def fold_exact(c) -> Column:
    """Full-Unicode NFKD fold (Arrow-batched pandas UDF). Use only for scripts outside the Latin blocks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.pandas_udf(_fold_series, StringType())(c)
