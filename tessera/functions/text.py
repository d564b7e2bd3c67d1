"""Text normalisation as Spark column expressions.

Everything here compiles to JVM expressions (``regexp_replace``, ``translate``, higher-order array
functions), so it stays inside whole-stage codegen and runs per partition with no Python worker; ``ascii_words`` alone is
plain Python, for tasks that count words in Arrow batches.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import decode_references
from .fold import fold_ascii

# Whitespace as Python's str.split() sees it for ASCII text; written out so Java and RE2 agree.
WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"
WORD_PATTERN = "[^ \\t\\n\\r\\f\\x0B]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c) -> Column:
    """Number of whitespace-separated words (STR-09)."""
    return F.regexp_count(_c(c), F.lit(WORD_PATTERN)).cast("long")


def letters_lower(c) -> Column:
    """Fold accents, turn every non-letter into a space, lower-case (STR-02 + STR-03 / STR-07)."""
    return F.lower(F.regexp_replace(fold_ascii(_c(c)), "[^a-zA-Z]", " "))


def token_string(c) -> Column:
    """Folded, lower-case letters separated by single spaces, trimmed (one regex pass for the separators)."""
    return F.trim(F.lower(F.regexp_replace(fold_ascii(_c(c)), "[^a-zA-Z]+", " ")))


# ASCII letters to lower case, every other byte to a space.
_LETTERS = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalpha() else 32 for i in range(256))


def ascii_words(text: bytes | None) -> list[str]:
    """The words of ``token_string`` for one text in UTF-8, inside a task; none for a null."""
    if text is None:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.decode("utf-8", "replace")).encode("ascii", "ignore")
    return text.translate(_LETTERS).decode("ascii").split()


def tokens(c) -> Column:
    """Whitespace tokens of ``letters_lower`` (array<string>, order kept, repeats kept)."""
    return F.filter(F.split(token_string(c), " "), lambda t: t != "")


def drop_stopwords(arr, stopwords) -> Column:
    """Remove every occurrence of a stop word, keeping order and repeats of the others (STR-04).

    ``array_except`` would also de-duplicate, so a higher-order ``filter`` is used. The literal list
    becomes a hash-set membership test (``InSet``), so the cost per token does not grow with the list.
    """
    if not stopwords:
        return _c(arr)
    sw = list(stopwords)
    return F.filter(_c(arr), lambda t: ~t.isin(sw))


def min_length(arr, longer_than: int) -> Column:
    """Keep tokens strictly longer than ``longer_than`` characters (STR-05: ``len > 3``)."""
    return F.filter(_c(arr), lambda t: F.length(t) > longer_than)


def processed_tokens(c, stopwords, longer_than: int = 3) -> Column:
    """The reference's normalisation before stemming: fold, letters, lower, split, stop words, ``len > 3``
    (one array pass: the length test runs first, then the hash-set stop-word test)."""
    sw = list(stopwords or [])
    raw = F.split(token_string(c), " ")       # the length test also removes the empty token of an empty text
    if not sw:
        return F.filter(raw, lambda t: F.length(t) > max(longer_than, 0))
    return F.filter(raw, lambda t: (F.length(t) > max(longer_than, 0)) & ~t.isin(sw))


def join_tokens(arr) -> Column:
    return F.array_join(_c(arr), " ")


# -- HTML ---------------------------------------------------------------------------------------------------
def html_to_text(c) -> Column:
    """HTML -> visible text (STR-01).

    Newlines and tabs become spaces; script/style blocks and comments are dropped; every tag becomes a
    separator; all character references are decoded; runs of blanks (the no-break one too) collapse to one space and the ends are trimmed.
    """
    s = F.regexp_replace(_c(c), "[\\n\\t]", " ")
    s = F.regexp_replace(s, "(?is)<script\\b.*?</script\\s*>", " ")
    s = F.regexp_replace(s, "(?is)<style\\b.*?</style\\s*>", " ")
    s = F.regexp_replace(s, "(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, "<[^>]*>", " ")
    s = decode_references(s)
    s = F.regexp_replace(s, "[ \\t\\n\\r\\f\\x0B\\xA0]+", " ")
    return F.trim(s)


# -- embedding-corpus cleaning (STR-08) ---------------------------------------------------------------------
# The punctuation that is parted from words, the quote signs, and the patterns whose matches are replaced.
PUNCT = "!\"#%'()*+,./:;<=>?@[\\]^_`{|}~"
QUOTES = "\u2018\u2019\u2032`\u201c\u201d"
SPANS = [("\\{[^\\n]*\\}", ""),                                    # greedy, within a line
         ("<[/\\\\]?[^\\n]+?>", " "),
         ("(?U)\\d", "0"),                                            # before addresses: they keep their zeroed digits
         ("(?U)https?://[^\\s]+", "URL"),
         ("(?U)(?<!\\S)[^\\s]+@[^\\s]+", "EMAIL")]                    # from the start of a run: none is tried from inside
# What (?U)\\s matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean_for_embeddings(c) -> Column:
    """Cleaning for word-vector corpora (STR-08): lower case; typographic blanks, dashes and ellipses to ASCII ones, ellipses
    dropped; braces, tags, digits, addresses as in ``SPANS``; quotes dropped, an apostrophe only where it does not stand
    between word characters; repeated marks before a comma and a lone double full stop reduced; a hyphen before a word and
    punctuation at a word's edge parted from it; blank runs to one, both ends trimmed of all white space.
    """
    c, p = _c(c), "".join("\\" + ch if ch in "[]\\^-&" else ch for ch in PUNCT)
    s = F.replace(F.replace(F.lower(c), F.lit("\u00a0"), F.lit(" ")), F.lit("\u2013"), F.lit("-"))
    s = F.replace(F.replace(s, F.lit("..."), F.lit("")), F.lit("\u2026"), F.lit(""))
    for pattern, new in SPANS[:-1]:
        s = F.regexp_replace(s, pattern, new)
    s = F.when(c.contains("@"), F.regexp_replace(s, *map(F.lit, SPANS[-1]))).otherwise(s)        # no step before brings one in
    # one pass for every quote that ends up dropped: a quote sign anywhere, an apostrophe at a word's edge
    s = F.regexp_replace(s, f"(?U)[{QUOTES}\"'](?:(?<!')|(?<!\\w')|(?!\\w))", "")
    s = F.regexp_replace(s, "\\.\\.(?<!\\.\\.\\.)(?!\\.)", ".")
    s = F.regexp_replace(s, "[,;:]([,;:]),", "$1")
    s = F.regexp_replace(s, "(?U) -(?=[^\\W\\d_])", " - ")
    s = F.regexp_replace(s, f"(?U)(\\w)([{p}])(?=[ {p}]|$)", "$1 $2 ")
    s = F.regexp_replace(s, f"(?U)([ {p}])([{p}])(?=\\w)", "$1 $2 ")
    return F.btrim(F.regexp_replace(s, "  +", " "), F.lit(WHITE_SPACE))


# -- identifiers --------------------------------------------------------------------------------------------
def case_number(seq, digit, year, justice, court, origin) -> Column:
    """``NNNNNNN-DD.AAAA.J.TR.OOOO`` from its numeric parts, zero padded (STR-10)."""
    def pad(x, n):
        return F.lpad(_c(x).cast("string"), n, "0")
    return F.concat(pad(seq, 7), F.lit("-"), pad(digit, 2), F.lit("."), pad(year, 4), F.lit("."),
                    _c(justice).cast("string"), F.lit("."), pad(court, 2), F.lit("."), pad(origin, 4))


def region_code(n) -> Column:
    """Two-digit region code (STR-12)."""
    return F.lpad(_c(n).cast("string"), 2, "0")


def path_string(*levels) -> Column:
    """Slash path of hierarchy levels (STR-13)."""
    return F.concat_ws("/", *[_c(x).cast("string") for x in levels])
