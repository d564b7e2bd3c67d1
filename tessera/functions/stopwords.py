"""Stop-word lists.

The language lists are Apache Spark's own (what ``StopWordsRemover.loadDefaultStopWords`` returns), shipped
as fixed text files in ``stoplists/`` so that importing the queries needs neither a JVM nor a jar.
"""

from __future__ import annotations

import functools
from importlib import resources

from .fold import _ascii_of

# The domain stop words the reference adds to the Portuguese list before counting words
# for its per-subject word clouds (order as written there; "trabalho" and "trabalhista" appear twice).
DOMAIN_STOPWORDS = [
    "trabalho", "juiz", "vara", "recurso", "ordinario", "reclamada", "reclamante", "reclamado", "recorrente",
    "trabalho", "empregado", "empregada", "art", "processo", "trabalhista", "tribunal", "regional", "regiao",
    "autor", "reu", "turma", "trt", "advogado", "advogada", "oab", "ser", "tst", "sentenca", "pagamento",
    "direito", "trabalhista", "assim", "autos", "justica", "lei", "clt", "decisao", "empresa", "contratante",
    "contratada", "contratado", "recorrido", "recorrida", "conforme",
]


@functools.lru_cache(maxsize=None)
def spark_default(language: str) -> tuple[str, ...]:
    """Spark's default stop-word list for ``language`` (same content as ``loadDefaultStopWords``)."""
    txt = (resources.files(__package__) / "stoplists" / f"{language}.txt").read_text(encoding="utf-8")
    return tuple(w for w in txt.splitlines() if w)


def folded(words) -> list[str]:
    """Accent-fold a word list the way the documents are folded (NFKD, ASCII only), keeping order."""
    return [_ascii_of(w) for w in words]


def folded_set(*languages: str, extra=()) -> list[str]:
    """Sorted distinct folded words of several languages plus extra words (for set membership)."""
    out = set()
    for lang in languages:
        out.update(folded(spark_default(lang)))
    out.update(folded(extra))
    out.discard("")
    return sorted(out)
