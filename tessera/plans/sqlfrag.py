"""DuckDB SQL fragments that mirror the Spark column expressions, for oracle texts."""

from __future__ import annotations

from ..functions.fold import sql_fold_ascii
from ..functions.text import WORD_PATTERN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def word_count(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {lit(WORD_PATTERN)})) AS BIGINT)"


def letters_lower(expr: str) -> str:
    return f"lower(regexp_replace({sql_fold_ascii(expr)}, '[^a-zA-Z]', ' ', 'g'))"


def token_string(expr: str) -> str:
    """Space-separated tokens (trimmed, single spaces); split with string_split(., ' ')."""
    return f"trim(regexp_replace({letters_lower(expr)}, ' +', ' ', 'g'))"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def md5_key(id_expr: str, seed) -> str:
    return f"md5(CAST({id_expr} AS VARCHAR) || {lit(str(seed))})"
