"""License scans by diagonal voting.

The words of every text are ASCII letters and digits (A-Z lower-cased) and all characters beyond ASCII. Rolling hashes of
every ``k`` consecutive words are joined with the places of the same hashes in the templates. Each hit votes for its
offset diagonal (place in the text minus place in the template); votes are counted per document, template and
diagonal before their shuffle. Neighbouring diagonals, up to ``slack`` words apart, are merged, so that a notice with
words added or left out still collects its votes. Spans with enough votes are verified on the words: phrases must
stand there exactly; notices are aligned, and their score is 1 - edits / words.

Phrases (the base) are templates like the others, with k = 2, no slack and all votes needed. Notices use k = 3.

The template table is broadcast: it has one row per template word, and more than ``MOST_ROWS`` rows are joined without
the hint. Texts are joined with candidate spans only.

Edge cases: a null or empty text has no words and no spans; repeated rows are each returned; a null id is
kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B
from .decontamination import PLAIN
from .member_filter import maybe_among, member_filter

BASE = 0x9E3779B97F4A7C15
MOST_ROWS = 100_000
SHORT, LONG = 2, 3
# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening or characteristic words of public licence notices and the labels they stand for.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
]
SCANNED = "doc long, tkey long, n_words long"
FOUND = "doc long, tkey long, spans array<struct<base:boolean,label:string,first:int,words:int,score:double>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    return B.mix(B.rolling(h, k, BASE) ^ B.U(k)).view(np.int64)


class Template:
    def __init__(self, label: str, text: str, base: bool):
        self.label, self.base, self.words = label, base, text.encode().split()
        self.k = SHORT if base else LONG
        self.votes = len(self.words) - self.k + 1


def edits(a: list[bytes], b: list[bytes]) -> tuple[int, int, int]:
    """Fewest word edits of ``a`` against any part of ``b``, and that part's begin and end."""
    row = [(0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [(i + 1, 0)]
        for j, y in enumerate(b):
            new.append(min((row[j][0] + (x != y), row[j][1]), (row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1])))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], row[end][1], end


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, slack: int = 3,
         share: float = 0.5, least_score: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words`` and its verified ``spans`` (base or notice, label, first word, number
    of words, score)."""
    spark = docs.sparkSession
    templates = [Template(label, text, True) for text, label in phrases.items()] + [Template(x, t, False) for x, t in notices]
    if any(t.votes < 1 for t in templates):
        raise ValueError(f"a phrase needs {SHORT} words and a notice {LONG}")
    rows = [(int(h), i, at) for i, t in enumerate(templates) for at, h in enumerate(gram_hashes(B.hash_words(t.words), t.k))]
    grams = spark.createDataFrame(rows, "h long, template int, at int")
    if len(rows) <= MOST_ROWS:
        grams = F.broadcast(grams)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def hashes(batches):
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1).cast(pa.large_binary()).to_pylist()):
                h = B.hash_words(words_of(text))
                for k in (SHORT, LONG):
                    g = gram_hashes(h, k)
                    if len(g):
                        yield pa.record_batch([pa.repeat(doc, len(g)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)],
                                              names=["doc", "place", "h"])

    votes = (own.mapInArrow(_joined(hashes), "doc long, place int, h long").join(grams, "h")
             .groupBy("doc", "template", (F.col("place") - F.col("at")).alias("diagonal"))
             .agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("lo"), F.max("place").alias("hi")))
    per = Window.partitionBy("doc", "template").orderBy("diagonal")            # within one document
    exact = F.col("template") < len(phrases)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(per) > F.when(exact, 0).otherwise(slack), F.lit(True))
    needed = F.element_at(F.array(*[F.lit(t.votes if t.base else max(1, int(share * t.votes))) for t in templates]),
                          F.col("template") + 1)
    spans = (votes.withColumn("new", apart.cast("int"))
             .withColumn("run", F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("doc", "template", "run").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .filter(F.col("votes") >= needed))
    candidates = cut_lineage(spans.groupBy("doc").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("candidates")),
                             "license-spans")

    def verify(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist()):
                words, kept = words_of(text), set()
                for c in found:
                    t = templates[c["template"]]
                    n = len(t.words)
                    if t.base:
                        kept |= {(True, t.label, i, n, 1.0) for i in range(c["lo"], c["hi"] + t.k - n + 1) if words[i:i + n] == t.words}
                    else:
                        at = max(0, c["lo"] - n)
                        cost, s, e = edits(t.words, words[at:c["hi"] + n + slack])
                        if 1 - cost / n >= least_score:
                            kept.add((False, t.label, at + s, e - s, 1 - cost / n))
                out.append([dict(zip(("base", "label", "first", "words", "score"), x)) for x in sorted(kept)])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct(
                [("base", pa.bool_()), ("label", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("score", pa.float64())])))],
                names=["doc", "tkey", "spans"])

    def count(batches):
        for b in batches:
            n = [len(words_of(t)) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc", "tkey", "n_words"])

    # a row is named by its id and its text, so that rows with one id keep their own spans
    keyed = own.select("doc", F.xxhash64("text").alias("tkey"), "text")
    checked = (_near(keyed, candidates).alias("d").join(candidates.hint("merge").alias("c"), F.col("d.doc").eqNullSafe(F.col("c.doc")))
               .select("d.doc", "tkey", "text", "candidates").mapInArrow(verify, FOUND)
               .filter(F.size("spans") > 0).dropDuplicates(["doc", "tkey"]))
    counted = keyed.mapInArrow(count, SCANNED)
    return (counted.alias("n").join(checked.alias("s"), F.col("n.doc").eqNullSafe(F.col("s.doc")) & (F.col("n.tkey") == F.col("s.tkey")), "left")
            .select(F.col("n.doc").alias("doc_id"), "n_words",
                    F.coalesce("spans", F.array().cast(checked.schema["spans"].dataType)).alias("spans")))


def _near(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows whose id may have candidates, and those without an id."""
    return maybe_among(rows, "doc", member_filter(candidates.select("doc"))).unionByName(rows.filter(F.col("doc").isNull()))


def _joined(rows, most: int = 500_000):
    """Small batches of one generator put together, so that a batch holds some hundred thousand rows at most."""
    def run(batches):
        held, size = [], 0
        for b in rows(batches):
            held.append(b)
            size += b.num_rows
            if size >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def digest(found: DataFrame) -> DataFrame:
    """Columns of the ``op2`` query from ``scan``."""
    base = F.filter("spans", lambda s: s.base)
    starts = F.transform(base, lambda s: s.first.cast("long"))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s.label))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"),
                        names(F.col("spans")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"))
