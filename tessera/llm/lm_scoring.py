"""Language-model scores by a weighted backoff automaton.

The model is a smoothed word n-gram model learned from all training documents. Its automaton has a state for
every word sequence of up to ``order - 1`` words seen in training, the longest known suffix of what was
read; a state has an arc for every word seen after it, and a failure arc to the state of the next
shorter suffix. With C the training counts, and P' the probability given the shorter suffix,

    seen word:     P(w | s) = (C(s w) + prior * P'(w)) / (C(s) + prior)
    failure arc:   prior / (C(s) + prior), and the word is tried again from the shorter suffix
    empty state:   P(w) = (C(w) + 1) / (N + V + 1), N training tokens and V distinct ones,

which sums to one over the vocabulary and one unknown word. One traversal from left to right carries the state
and adds up log10 of the weights on its way, the end of the text included. As a state is just the last
words read, a block of documents steps through its arcs as arrays.

Counts never meet in one place: blocks send their distinct n-grams with their counts to key buckets
and get the totals of exactly those n-grams back (``blocks``), so the shuffle grows with the corpus and no
model is broadcast; only N and V, two numbers, are. N-grams are told apart by 64-bit hashes.

Edge cases: a null or empty text is the end token alone; a null id counts as training; an empty table gives an
empty result and a table without training documents scores every token 1 / 1; repeated rows count each
time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BASE = 0x9E3779B97F4A7C15
BEGIN, END = 0x243F6A8885A308D3, 0x13198A2E03707344   # no word hashes to these but by 64-bit chance
SENT = "bucket int, block int, level int, keys binary, counts binary"
TOLD = "block int, bucket int, level int, totals binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


class Grams:
    """The n-grams of one block's documents: for each level its distinct keys and the key of every token."""

    def __init__(self, table: pa.Table, order: int):
        self.docs = table.column("doc").to_pylist()
        self.held = np.array(table.column("held").to_pylist(), dtype=bool)
        pad = np.full(max(order - 1, 1), BEGIN, dtype=np.uint64)
        end = np.array([END], dtype=np.uint64)
        parts, n = [], []
        for t in B.texts_of(table):
            words = t.lower().split()       # bytes.lower: A-Z alone
            parts += [pad, B.hash_words(words), end]
            n.append(len(words) + 1)
        self.n = np.array(n, dtype=np.int64)
        seq = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        first = np.cumsum(self.n + len(pad)) - self.n             # place of each text's first token
        self.first = np.cumsum(self.n) - self.n                    # the same among tokens only
        tokens = np.repeat(first - self.first, self.n) + np.arange(self.n.sum())
        train = np.repeat(~self.held, self.n)
        self.keys, self.counts, self.arc, self.state = [], [], [], []
        for k in range(1, order + 1):
            rolled = B.mix(B.rolling(seq, k, BASE) ^ B.U(k))
            at = tokens - (k - 1)
            here = rolled[at]
            if k < order:                    # a text's first state counts as a place too
                here = np.concatenate((here, rolled[first - k]))
            keys, inverse = np.unique(here, return_inverse=True)
            weight = np.concatenate((train, ~self.held)) if k < order else train
            self.keys.append(keys)
            self.counts.append(np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.uint32))
            self.arc.append(inverse[:len(tokens)])
            if k < order:                    # the state before each token
                before = np.empty(len(tokens), dtype=np.int64)
                before[1:] = inverse[:len(tokens) - 1]
                before[self.first] = inverse[len(tokens):]
                self.state.append(before)


def _begin_key() -> int:
    return int(B.mix(np.array([BEGIN], dtype=np.uint64) ^ B.U(1))[0])


def _merge(table: pa.Table):
    """For each level: the block rows, their sizes, the group of every key, group totals and group keys."""
    level = table.column("level").to_numpy()
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        own = [B.unpack_keys(keys[i]) for i in rows]
        distinct, group = np.unique(np.concatenate(own), return_inverse=True)
        c = np.frombuffer(b"".join(counts[i] for i in rows), dtype=np.uint32)
        yield k, rows, [len(x) for x in own], group, np.bincount(group, weights=c, minlength=len(distinct)), distinct


def _totals(table: pa.Table) -> pa.Table:
    block, bucket = table.column("block").to_numpy(), table.column("bucket")[0].as_py()
    out = []
    for k, rows, sizes, group, totals, _ in _merge(table):
        answer = totals[group].astype(np.uint64)
        cut = np.cumsum([0, *sizes])
        for i, s, e in zip(rows, cut[:-1], cut[1:]):
            a = answer[s:e]
            wide = np.uint64 if len(a) and a.max() >= 2**32 else np.uint32
            out.append((int(block[i]), bucket, int(k), a.astype(wide).tobytes()))
    cols = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["block", "bucket", "level", "totals"])


def _vocabulary(table: pa.Table) -> pa.Table:
    """Training tokens and distinct ones among a bucket's words."""
    one = table.filter(pc.equal(table.column("level"), 1))
    n = v = 0
    for _, _, _, _, totals, distinct in _merge(one):
        words = distinct != B.U(_begin_key())
        n, v = n + int(totals[words].sum()), v + int((totals[words] > 0).sum())
    return pa.table({"train_tokens": pa.array([n], pa.int64()), "types": pa.array([v], pa.int64())})


def walk(grams: Grams, totals: list[np.ndarray], n: int, v: int, prior: float) -> np.ndarray:
    """log10 weight that the traversal adds at each token."""
    p = (totals[0][grams.arc[0]] + 1.0) / (n + v + 1.0)             # the empty state knows every word
    for k in range(1, len(totals)):
        state = totals[k - 1][grams.state[k - 1]].astype(np.float64)
        arc = totals[k][grams.arc[k]].astype(np.float64)
        failure = prior / (state + prior)
        p = np.where(state > 0, np.where(arc > 0, arc / (state + prior) + failure * p, failure * p), p)
    return np.log10(p)


def score(docs: DataFrame, held_out: Column, order: int = 2, prior: float = 64.0, id_col: str = "doc_id",
          text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Score every document with the model of those where ``held_out`` is not true.

    ``order``: words of the longest n-grams; ``prior``: how many observations the shorter suffix is worth.
    """
    n = B.block_count(docs, text_col, block_bytes)
    texts = B.in_blocks(docs, n, id_col, text_col, (F.coalesce(held_out, F.lit(False)).alias("held"),))

    def index(t: pa.Table) -> pa.Table:
        block, g, rows = t.column("block")[0].as_py(), Grams(B.unpack(t), order), []
        for k in range(order):
            b = B.bounds(g.keys[k], n)
            rows += [(i, block, k + 1, B.pack_keys(g.keys[k][s:e]), g.counts[k][s:e].tobytes())
                     for i, (s, e) in enumerate(zip(b[:-1], b[1:])) if e > s]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                        names=["bucket", "block", "level", "keys", "counts"])

    def traverse(t: pa.Table, told: pa.Table) -> pa.Table:
        g = Grams(B.unpack(t), order)
        totals = [np.zeros(len(k), dtype=np.uint64) for k in g.keys]
        cuts = [B.bounds(k, n) for k in g.keys]
        size, types = 0, 0
        if told.num_rows:
            size, types = told.column("train_tokens")[0].as_py() or 0, told.column("types")[0].as_py() or 0
        for k, i, x in zip(*(told.column(c).to_pylist() for c in ("level", "bucket", "totals"))):
            s, e = cuts[k - 1][i], cuts[k - 1][i + 1]
            totals[k - 1][s:e] = np.frombuffer(x, dtype=np.uint64 if len(x) == 8 * (e - s) else np.uint32)
        known = totals[0][g.arc[0]]
        add = lambda x: np.add.reduceat(x, g.first) if len(g.first) else np.empty(0)
        m = len(g.docs)
        return pa.table({
            "doc_id": pa.array(g.docs, pa.int64()), "held_out": pa.array(g.held, pa.bool_()),
            "n_tokens": pa.array(g.n, pa.int64()), "n_known": pa.array(add((known > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([size] * m, pa.int64()),
            "base_score": pa.array(add(np.log10((known + 1.0) / (size + types + 1.0))), pa.float64()),
            "score": pa.array(add(walk(g, totals, size, types, prior)), pa.float64())})

    sent = texts.groupBy("block").applyInArrow(index, SENT)
    numbers = (sent.groupBy("bucket").applyInArrow(_vocabulary, "train_tokens long, types long")
               .agg(F.sum("train_tokens").alias("train_tokens"), F.sum("types").alias("types")))   # one row
    told = sent.groupBy("bucket").applyInArrow(_totals, TOLD).crossJoin(F.broadcast(numbers))
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(traverse, SCORES)


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)
