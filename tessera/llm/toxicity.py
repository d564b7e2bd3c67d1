"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney word bigram models, one of toxic and one of ordinary documents, share their lowest order: the
continuation counts (before how many words of both classes together a word was seen). With c the counts of
one class, D the discount and N the tokens of the class:

    P(w | v) = max(c(v w) - D, 0) / c(v .) + rest(v) * P(w)
    P(w)     = max(c(w) - D, 0) / N + rest * S(w),   S(w) = (|{v: v w}| + 1) / (|{v w}| + words + 1)

where rest is what the discounts leave, so that each sums to one. Words seen ``rare`` times and word pairs seen ``rare_pairs`` times
or fewer in both classes together have no counts of their own: rare expressions are left to the shared counts, which say
nothing for either class. The log-likelihood difference of a text, normalised by its length, is the first feature; the same for its
best ``SPANS`` consecutive words and its ``TOP`` single words tells a long text with a few such expressions from an
ordinary one. A logistic curve, fitted on training documents that were not counted, turns the features into a score.

Labels are learned from a bounded sample: of each class, ``sample_rows`` training rows are drawn by a hash of the id
(all, if there are fewer), and the classes are weighted back. So the label table that is broadcast, the model and what
reaches the driver are bounded by that parameter; texts are not shuffled. Every document is scored on its whole text.

Words are runs of ASCII letters and digits, A-Z lower-cased, and characters beyond ASCII.

Edge cases: a null or empty text gets the score of no evidence (all features zero); without training rows of both classes
every score is the share of toxic ones (0 if there are none); a label other than 0 or 1 is ignored; repeated rows count
and are returned each time; an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import blocks as B
from .license_scan import words_of

BEGIN = 0x452821E638D01377
BASE = 0x9E3779B97F4A7C15
SPANS = (5, 30)
TOP = (1, 3, 8)
FEATURES = 1 + len(SPANS) + len(TOP)


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Keys of (word before, word), the first word after BEGIN."""
    before = np.concatenate((np.array([BEGIN], dtype=np.uint64), h[:-1]))
    return B.mix(before * B.U(BASE) + h)


@dataclass
class Model:
    """Log-likelihood differences (toxic minus ordinary) by sorted key."""
    words: np.ndarray          # word hashes
    word: np.ndarray           # of the word after a state that does not know it
    leave: np.ndarray          # of leaving the state of this word
    pairs: np.ndarray          # keys of word pairs
    pair: np.ndarray
    unknown: float
    weights: np.ndarray        # of the features, the constant last

    def differences(self, h: np.ndarray) -> np.ndarray:
        def at(keys, values, x, other):
            if not len(keys):
                return np.full(len(x), other)
            i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            return np.where(keys[i] == x, values[i], other)

        before = np.concatenate((np.array([BEGIN], dtype=np.uint64), h[:-1]))
        back = at(self.words, self.leave, before, 0.0) + at(self.words, self.word, h, self.unknown)
        return at(self.pairs, self.pair, pair_keys(h), back) if len(self.pairs) else back

    def features(self, text: bytes) -> np.ndarray:
        h = B.hash_words(words_of(text))
        n = len(h)
        if not n:
            return np.zeros(FEATURES)
        x = self.differences(h)
        total = np.concatenate(([0.0], np.cumsum(x)))
        spans = [(total[min(k, n):] - total[:-min(k, n)]).max() / k for k in SPANS]
        most = np.sort(np.partition(x, n - min(n, TOP[-1]))[-min(n, TOP[-1]):])[::-1]
        return np.array([total[-1] / n, *spans, *(np.maximum(most[:k], 0).sum() / k for k in TOP)])

    def score(self, text: bytes) -> float:
        x = float(self.features(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + np.exp(-x)) if x >= 0 else np.exp(x) / (1 + np.exp(x))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression (last: constant) by Newton steps with a small ridge."""
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.column_stack((x / scale, np.ones(len(x))))
    b = np.zeros(z.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + keep, z.T @ (weight * (y - p)) - keep @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    b[:-1] /= scale
    return b


def _pairs(batches):
    """(before, word, c0, c1) of a batch of (text, label), each pair once a batch."""
    for batch in batches:
        before, word, label = [], [], []
        for text, toxic in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("label").to_pylist()):
            h = B.hash_words(words_of(text or b""))
            if len(h):
                before.append(np.concatenate((np.array([BEGIN], dtype=np.uint64), h[:-1])))
                word.append(h), label.append(np.full(len(h), toxic, dtype=np.int64))
        if not word:
            continue
        v, w, y = np.concatenate(before), np.concatenate(word), np.concatenate(label)
        _, first, group = np.unique(B.mix(v * B.U(BASE) + w), return_index=True, return_inverse=True)
        ones = np.bincount(group, weights=y).astype(np.int64)
        yield pa.record_batch([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)),
                               pa.array(np.bincount(group) - ones), pa.array(ones)], names=["v", "w", "c0", "c1"])


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded table on the driver: hashes as they are, counts in 32 bits."""
    t = df.select(*[F.col(c) if c in "hvw" else F.col(c).cast("int") for c in df.columns]).toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = 12_000, discount: float = 0.75,
        rare: int = 5, rare_pairs: int = 30, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 17) -> Model:
    """Learn from labelled rows where ``held_out`` (a condition on the id column) is not true."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & ~F.coalesce(held_out, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    size = {r.label: r.n for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    none = np.empty(0, dtype=np.uint64)
    if not n0 or not n1:
        share = np.clip(n1 / max(1, n0 + n1), 1e-9, 1 - 1e-9)
        return Model(none, np.empty(0), np.empty(0), none, np.empty(0), 0.0, np.append(np.zeros(FEATURES), np.log(share / (1 - share))))
    draw = [min(1.0, sample_rows / n) for n in (n0, n1)]
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("__id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = marked.filter(place < F.when(F.col("label") == 1, draw[1]).otherwise(draw[0]))       # about 2 * sample_rows at most
    rows = cut_lineage(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
                       .join(F.broadcast(drawn), "__id")
                       .withColumn("tune", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__id")), F.lit(4)) == 0), "labelled")
    pairs = cut_lineage(rows.filter(~F.col("tune")).select("text", "label").mapInArrow(_pairs, "v long, w long, c0 long, c1 long")
                        .groupBy("v", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "pairs")
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("c0").alias("n0"), F.sum("c1").alias("n1")).first()
    seen = pairs.groupBy(F.col("w").alias("h")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count(F.lit(1)).alias("kinds"))
    after = pairs.groupBy(F.col("v").alias("h")).agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    kinds = seen.count()
    least = min(rare, rare_pairs)
    word = _columns(seen.join(after, "h", "full").na.fill(0)
                    .filter((F.col("c0") + F.col("c1") > least) | (F.col("t0") + F.col("t1") > least)))
    pair = _columns(pairs.filter(F.col("c0") + F.col("c1") > rare_pairs))

    words = word["h"].view(np.uint64)
    order = np.argsort(words)
    words, word = words[order], {c: x[order] for c, x in word.items()}
    tokens, places = (total.n0 or 0, total.n1 or 0), (total.n or 0) + kinds + 1.0
    shared, one = (word["kinds"] + 1.0) / places, 1.0 / places
    often = word["c0"] + word["c1"] > rare
    v, w = pair["v"].view(np.uint64), pair["w"].view(np.uint64)
    at_v, at_w = np.searchsorted(words, v), np.searchsorted(words, w)     # both words of such a pair are in the table
    p, unseen, leave, both = [], [], [], []
    for k in (0, 1):
        own = np.where(often, np.maximum(word[f"c{k}"] - discount, 0) / max(1, tokens[k]), 0.0)
        back = max(1.0 - own.sum(), 1e-9)                                   # what discounts and rare words leave
        p.append(own + back * shared), unseen.append(back * one)
        arc = np.maximum(pair[f"c{k}"] - discount, 0) / np.maximum(word[f"t{k}"][at_v], 1)
        rest = np.maximum(1.0 - np.bincount(at_v, arc, minlength=len(words)), 1e-9)
        leave.append(rest), both.append(arc + rest[at_v] * p[k][at_w])
    keys = B.mix(v * B.U(BASE) + w)
    order = np.argsort(keys)
    model = Model(words, np.log(p[1]) - np.log(p[0]), np.log(leave[1]) - np.log(leave[0]), keys[order],
                  (np.log(both[1]) - np.log(both[0]))[order], float(np.log(unseen[1]) - np.log(unseen[0])), np.zeros(FEATURES + 1))

    shown = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for b in batches:
            x = [shown.value.features(t or b"") for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "features"])

    tune = rows.filter("tune").select("text", "label").mapInArrow(features, "label int, features array<double>").toArrow()
    x, y = np.array(tune.column("features").to_pylist()).reshape(-1, FEATURES), tune.column("label").to_numpy()
    model.weights = logistic(x, y, np.where(y == 1, 1 / draw[1], 1 / draw[0]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score of every text, 0 to 1."""
    shown = docs.sparkSession.sparkContext.broadcast(model)
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for b in batches:
            s = [shown.value.score(t or b"") for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    return rows.mapInArrow(run, schema).select("row.*", F.col("score").alias(score_col))
