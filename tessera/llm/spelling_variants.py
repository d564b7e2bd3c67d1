"""Spelling variant grouping by PartEnum signatures of letter multisets.

1. *Words.* The maximal runs of letters of all texts are counted. Those of at least ``min_chars`` code points that occur
   ``min_count`` times or more are the words.
2. *Vectors.* A word's letters, numbered by occurrence (first e, second e, ...), are a binary vector. Words with one code point
   inserted, deleted or replaced have vectors at a Hamming distance of 1 or 2. Anagrams have one vector: a *class*.
3. *PartEnum.* The dimensions are dealt to ``PARTS`` parts of about equal weight. Two vectors that differ in at most two places
   agree wholly in at least ``PARTS - 2`` of them, so each class has one signature for every choice of ``PARTS - 2`` parts, and classes
   in reach of each other share one for certain. Classes are equi-joined by signature and their distance is verified.
4. *Words of near classes.* A verified pair of classes names the one letter in which they differ. Each word of the two classes then
   shows what is left when that letter is masked at one of its places (replaced) or taken out (inserted, deleted); words
   that leave the same are near, and others are not. What is left is grouped, never a pair of words: such a group has at most as many
   words as the alphabet has letters, times the places where one fits in.
5. A word's form is its near word of largest count, where that is at least ``ratio`` times its own; roots follow forms by
   doubling steps until none moves.

Only the number of classes that hold each letter of the alphabet reaches the driver. Anagrams of the whole vocabulary
in one class are no single task's work: a class is joined with its words by an equi-join and its words never meet.

Edge cases: null or empty texts have no words; a null id counts as an empty text in the places that the id decides; repeated rows
count as often as they occur; ties go to the smaller word in code-point order; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")         # [a-zÀ-ÿ]+ in UTF-8
PARTS, DISTANCE = 7, 2
CHOICES = tuple(itertools.combinations(range(PARTS), PARTS - DISTANCE))
#: Entries a task counts before it hands them on (a buffer, not a limit).
HELD = 400_000
MASK = "\0"


def runs_of(doc, text: bytes, every: int | None) -> Counter:
    """The runs of a text with their counts. A run whose crc32 with the document's id is a multiple of ``every`` loses one code point."""
    found = Counter(RUN.findall(text.lower()))
    if not every:
        return found
    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    out = Counter()
    for run, n in found.items():
        h = zlib.crc32(run, start)
        if h % every == 0:
            s = run.decode()
            at = h % len(s)
            run = (s[:at] + s[at + 1:]).encode()
        out[run] += n
    return out


def count_words(docs: DataFrame, min_chars: int = 6, min_count: int = 5, every: int | None = 199, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): counted in the tasks first, so a frequent word is one row of each."""
    def count(batches):
        held = Counter()

        def out():
            words = [w for w in held if len(w) >= min_chars and len(w.decode()) >= min_chars]
            return pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())],
                                   names=["word", "n"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    held.update(runs_of(doc, text, every))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def dimensions(letters: str) -> list[str]:
    """The places of a letter multiset's vector that are set: each letter with the number of its occurrence."""
    seen, out = Counter(), []
    for c in letters:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def deal_parts(weights: list[tuple[str, int]]) -> dict[str, int]:
    """Dimensions to parts, heaviest first, each to the part that is lightest so far."""
    load, part = [0] * PARTS, {}
    for d, n in sorted(weights, key=lambda x: (-x[1], x[0])):
        part[d] = min(range(PARTS), key=load.__getitem__)
        load[part[d]] += n
    return part


def signatures(letters: str, part: dict[str, int]) -> np.ndarray:
    """One 64-bit signature for each choice of parts: sums of the hashes of the dimensions in them, mixed with the choice."""
    sums = [0] * PARTS
    for d in dimensions(letters):
        h = xxhash.xxh3_64_intdigest(d)
        sums[part.get(d, h % PARTS)] += h
    return np.array([xxhash.xxh3_64_intdigest((sum(sums[p] for p in c) % 2**64).to_bytes(8, "big"), seed=i)
                     for i, c in enumerate(CHOICES)], dtype=np.uint64).view(np.int64)


def near_classes(classes: DataFrame) -> DataFrame:
    """(letters, letter, kind): the letters of each class that a verified neighbour replaces ('r'), that one lacks ('d'), or
    none with kind 'i' where a neighbour has one letter more. ``classes``: (letters), sorted multisets."""
    single = classes.select(F.explode(F.array_distinct(F.split("letters", ""))).alias("letter")).filter("letter <> ''")
    heavy = single.groupBy("letter").count().collect()                       # one row a letter of the alphabet
    part = deal_parts([(f"{r['letter']}1", r["count"]) for r in heavy])

    def sign(batches):
        for b in batches:
            letters = b.column(0).to_pylist()
            sigs = [signatures(x, part) for x in letters]
            flat = np.concatenate(sigs) if sigs else np.empty(0, dtype=np.int64)
            row = np.repeat(np.arange(len(letters)), len(CHOICES))
            yield pa.record_batch([pa.array(flat, pa.int64()), b.column(0).take(pa.array(row))], names=["sig", "letters"])

    signed = classes.select("letters").mapInArrow(sign, "sig long, letters string").withColumn("size", F.length("letters"))
    x, y = signed.alias("x"), signed.alias("y")
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.letters") < F.col("y.letters"))
                 & (F.abs(F.col("x.size") - F.col("y.size")) <= 1)).select(F.col("x.letters").alias("a"), F.col("y.letters").alias("b"))

    def verify(batches):
        for b in batches:
            out = set()
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.update(differing(s, t))
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*out) if out else ([], [], []))], names=["letters", "letter", "kind"])

    return met.mapInArrow(verify, "letters string, letter string, kind string").distinct()


def differing(s: str, t: str) -> list[tuple[str, str, str]]:
    """What two sorted multisets have apart, if their vectors are at most two places apart and one edit can lead from one to the other."""
    i = j = 0
    more, less = [], []
    while i < len(s) or j < len(t):
        if j == len(t) or i < len(s) and s[i] < t[j]:
            more.append(s[i])
            i += 1
        elif i == len(s) or t[j] < s[i]:
            less.append(t[j])
            j += 1
        else:
            i, j = i + 1, j + 1
        if len(more) + len(less) > DISTANCE:
            return []
    if len(more) == len(less) == 1:
        return [(s, more[0], "r"), (t, less[0], "r")]
    if len(more) + len(less) == 1:
        short, long, letter = (t, s, more[0]) if more else (s, t, less[0])
        return [(short, "", "i"), (long, letter, "d")]
    return []


def left_over(word: str, letter: str, kind: str) -> set[str]:
    """The word with one of its places of that letter masked, or taken out, or (kind 'i') the word itself."""
    if kind == "i":
        return {word}
    put = MASK if kind == "r" else ""
    return {word[:i] + put + word[i + 1:] for i, c in enumerate(word) if c == letter}


def near_words(words: DataFrame, classes: DataFrame) -> DataFrame:
    """(word, n_near, best struct<n, word>): how many words are near each, and the most frequent of them. ``words``: (word, n, letters)."""
    asked = cut_lineage(near_classes(classes), "near-classes")

    def show(batches):
        for b in batches:
            rest, word, n, whole = [], [], [], []
            for w, k, letter, kind in zip(*(b.column(i).to_pylist() for i in range(4))):
                for r in left_over(w, letter, kind):
                    rest.append(r), word.append(w), n.append(k), whole.append(kind == "i")
            yield pa.record_batch([pa.array(rest, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64()),
                                   pa.array(whole, pa.bool_())], names=["rest", "word", "n", "whole"])

    shown = (words.join(asked, "letters").select("word", "n", "letter", "kind")
             .mapInArrow(show, "rest string, word string, n long, whole boolean"))
    # at most one word a letter of the alphabet (masked), or one a letter and place (taken out), leaves the same
    groups = shown.groupBy("rest").agg(F.collect_list(F.struct("n", "word", "whole")).alias("g")).filter(F.size("g") > 1)

    def meet(batches):
        for b in batches:
            word, near, best_n, best = [], [], [], []

            def add(x, others):
                m = min(others, key=lambda o: (-o["n"], o["word"]))
                word.append(x["word"]), near.append(len(others)), best_n.append(m["n"]), best.append(m["word"])
            for rest, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if MASK in rest:
                    ranked = sorted(g, key=lambda o: (-o["n"], o["word"]))
                    for k, x in enumerate(ranked):
                        other = ranked[1 if k == 0 else 0]
                        word.append(x["word"]), near.append(len(g) - 1), best_n.append(other["n"]), best.append(other["word"])
                else:
                    whole, longer = [x for x in g if x["whole"]], [x for x in g if not x["whole"]]
                    for x in whole if longer else ():
                        add(x, longer)
                    for x in longer if whole else ():
                        add(x, whole)
            yield pa.record_batch([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()),
                                   pa.array(best, pa.string())], names=["word", "near", "best_n", "best"])

    met = groups.mapInArrow(meet, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("b")).select(
        "word", "n_near", F.struct((-F.col("b.minus_n")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form: where following forms ends. Each round doubles the steps taken."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.alias("x").join(at.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        at_next = cut_lineage(step.select(F.col("x.word").alias("word"), F.coalesce("y.root", "x.root").alias("root"),
                                          F.col("y.root").isNotNull().alias("moved")), "roots")
        moved = at_next.filter("moved").limit(1).count()
        at = at_next.select("word", "root")
        if not moved:
            return at


def variant_groups(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, every: int | None = 199,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``every``: with it, runs whose crc32 of ``<id>:<run>`` it divides lose a code point before they are counted; None leaves runs as they are.
    """
    counted = count_words(docs, min_chars, min_count, every, id_col, text_col)
    words = cut_lineage(counted.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), "")), "words")
    near = near_words(words, words.select("letters").distinct())
    formed = cut_lineage(words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best")), "forms")
    to = roots(formed.filter("best is not null").select("word", F.col("best.word").alias("form")))
    return formed.join(to, "word", "left").select(
        "word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("best.n").alias("form_n"))
