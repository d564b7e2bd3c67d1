"""Suffix stemming as an ordered rule table applied with SQL CASE expressions (STR-06, re-aimed).

The reference stems every token of every document with a per-row library stemmer. Here the rules run
once per **distinct** token (a vocabulary job) and the result is joined back, so the expensive part
scales with the vocabulary, not with the corpus. The rules are a compact light stemmer for accent-folded
Portuguese in the published step order (plural, adverb, feminine, augmentative/diminutive, noun, verb,
final vowel); it does not claim parity with the reference's stemmer.

Each step applies the first rule (in order) whose suffix ends the word and leaves at least ``min_stem``
letters; a rule is (suffix, min_stem, replacement).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stemming rule table (suffix, minimum stem length, replacement), grouped by step.
STEPS: list[list[tuple[str, int, str]]] = [
    # plural
    [("ns", 1, "m"), ("oes", 3, "ao"), ("aes", 1, "ao"), ("ais", 1, "al"), ("eis", 2, "el"), ("ois", 1, "ol"),
     ("is", 2, "il"), ("les", 3, "l"), ("res", 3, "r"), ("s", 2, "")],
    # adverb
    [("mente", 4, "")],
    # feminine
    [("ona", 3, "ao"), ("ora", 3, "or"), ("na", 4, "no"), ("inha", 3, "inho"), ("esa", 3, "es"), ("osa", 3, "oso"),
     ("iva", 3, "ivo"), ("ada", 2, "ado"), ("ida", 3, "ido"), ("ama", 3, "amo"), ("eira", 3, "eiro")],
    # augmentative / diminutive
    [("issimo", 3, ""), ("issima", 3, ""), ("zinho", 2, ""), ("zinha", 2, ""), ("inho", 3, ""), ("inha", 3, ""),
     ("alhao", 4, ""), ("zao", 2, ""), ("ao", 3, "")],
    # noun
    [("amento", 3, ""), ("imento", 3, ""), ("mento", 6, ""), ("acao", 3, ""), ("icao", 3, ""), ("ucao", 3, ""),
     ("idade", 4, ""), ("ismo", 3, ""), ("ista", 4, ""), ("avel", 2, ""), ("ivel", 2, ""), ("ante", 2, ""),
     ("ente", 4, ""), ("eza", 3, ""), ("oso", 3, ""), ("ico", 4, ""), ("ivo", 4, ""), ("ado", 2, ""), ("ido", 3, "")],
    # verb
    [("ariamos", 2, ""), ("eriamos", 2, ""), ("iriamos", 3, ""), ("assemos", 2, ""), ("essemos", 2, ""),
     ("issemos", 3, ""), ("aremos", 2, ""), ("eremos", 2, ""), ("iremos", 3, ""), ("avamos", 2, ""),
     ("arao", 2, ""), ("erao", 2, ""), ("irao", 3, ""), ("ando", 2, ""), ("endo", 3, ""), ("indo", 3, ""),
     ("ava", 2, ""), ("iam", 3, ""), ("ar", 2, ""), ("er", 2, ""), ("ir", 3, ""), ("ou", 3, ""), ("eu", 3, ""),
     ("iu", 3, "")],
    # final vowel
    [("a", 3, ""), ("e", 3, ""), ("o", 3, "")],
]


def _step(c: Column, rules) -> Column:
    expr = None
    for suffix, min_stem, rep in rules:
        cond = c.endswith(suffix) & (F.length(c) - F.lit(len(suffix)) >= F.lit(min_stem))
        val = F.concat(c.substr(F.lit(1), F.length(c) - F.lit(len(suffix))), F.lit(rep))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(c)


def stem_column(df: DataFrame, in_col: str, out_col: str = "stem") -> DataFrame:
    """Add ``out_col`` = stem of ``in_col``. One projection per step, so each step refers to the previous
    step's column instead of inlining it (the nested expression would grow exponentially)."""
    df = df.withColumn(out_col, F.col(in_col))
    for rules in STEPS:
        df = df.withColumn(out_col, _step(F.col(out_col), rules))
    return df


def sql_stem_step(col: str, rules) -> str:
    """One step as a DuckDB CASE over the column ``col``."""
    parts = []
    for suffix, min_stem, rep in rules:
        parts.append(f"WHEN suffix({col}, '{suffix}') AND length({col}) - {len(suffix)} >= {min_stem} "
                     f"THEN substr({col}, 1, length({col}) - {len(suffix)}) || '{rep}'")
    return "CASE " + " ".join(parts) + f" ELSE {col} END"


def sql_stem_ctes(source: str, token_col: str, prefix: str = "st") -> tuple[str, str]:
    """CTE chain ``prefix0..prefixN`` over ``source`` ending with columns (token_col, stem).
    Returns (cte_text, last_cte_name)."""
    ctes = [f"{prefix}0 AS (SELECT {token_col}, {token_col} AS stem FROM {source})"]
    for i, rules in enumerate(STEPS, start=1):
        ctes.append(f"{prefix}{i} AS (SELECT {token_col}, {sql_stem_step('stem', rules)} AS stem FROM {prefix}{i-1})")
    return ",\n".join(ctes), f"{prefix}{len(STEPS)}"
