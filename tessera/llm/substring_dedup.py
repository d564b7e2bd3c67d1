"""Substring dedup by windows looked up in all reference blocks.

Every block of documents is a reference block. Its index entries are the minimizers of its windows: of each
``window`` consecutive words, the ``gram``-word piece with the least hash. Equal windows have equal
minimizers at the same place, so a document can only copy from a block at a minimizer it shares with it.

1. *Candidates.* Blocks send their distinct minimizers to key buckets; a bucket answers which of them occur
   again, and the first block that holds them. Every window whose minimizer occurs again is a candidate.
2. *Check.* Each candidate window is asked of all blocks at once by a 96-bit fingerprint. Words of confirmed
   windows form the duplicate spans.

No greedy left-to-right factor parse decides what is cut: a factor ends where its one reference ends, while a window
counts wherever it occurs. ``reference_blocks`` names for each span the first block that holds the minimizer of its first
window, which need not hold the whole span.

The whole text takes part, and windows are judged on the input. Windows equal by 96-bit fingerprint are
taken to be equal (expected false pairs at 10**13 windows: below 0.001).

Edge cases: null or empty text has no words; a text shorter than the window has no span and is kept whole;
repeated rows with one id are each parsed, and their words count as other places; an empty table gives an empty
result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPANS = "doc_id long, n_words long, starts array<int>, ends array<int>, reference_blocks array<int>, kept binary"


class Parsed:
    """Words of the documents of one block, their windows and minimizers."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.docs = table.column("doc").to_pylist()
        self.texts = B.texts_of(table)
        self.n = np.empty(len(self.texts), dtype=np.int64)
        parts = []
        for i, t in enumerate(self.texts):
            words = t.split()               # bytes.split: runs of 0x20 and 0x09-0x0D
            self.n[i] = len(words)
            parts.append(B.hash_words(words))
        self.h = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        self.end = np.repeat(np.cumsum(self.n), self.n)
        self.window, n = window, len(self.h)
        starts = np.arange(n, dtype=np.int64)
        self.valid = np.flatnonzero(starts + window <= self.end)      # windows inside one document
        span = window - gram + 1
        if not len(self.valid):
            self.least = np.empty(0, dtype=np.uint64)
            self.key_of = np.empty(0, dtype=np.int64)
            self.keys, self.again = self.least, np.empty(0, dtype=bool)
            return
        g = B.mix(B.rolling(self.h, gram, BASE1)) | B.U(1)
        least = B.sliding(g, span, np.minimum)
        self.least = least[self.valid]
        inside = np.zeros(len(least), dtype=np.uint64)
        inside[self.valid] = self.least
        padded = np.concatenate((np.zeros(span - 1, np.uint64), inside, np.zeros(span - 1, np.uint64)))
        chosen = g[B.sliding(padded, span, np.maximum) == g]          # a minimizer of some window over it
        # keys: the distinct minimizers, spread evenly; again: chosen at more than one place in this block
        self.keys, counts = np.unique(B.mix(chosen), return_counts=True)
        self.again = counts > 1
        self.key_of = np.searchsorted(self.keys, B.mix(self.least))

    def windows(self, repeated: np.ndarray):
        """Distinct fingerprints of the candidate windows: order, first keys, second keys, group of each window."""
        at = self.valid[repeated[self.key_of]] if len(self.valid) else self.valid
        if not len(at):
            e = np.empty(0, dtype=np.uint64)
            return at, e, e.astype(np.uint32), e.astype(np.int64), e.astype(bool)
        k1 = B.mix(B.rolling(self.h, self.window, BASE1)[at])
        k2 = (B.mix(B.rolling(self.h, self.window, BASE2)[at]) >> B.U(32)).astype(np.uint32)
        order = np.argsort(k1, kind="stable")
        s1, s2 = k1[order], k2[order]
        new = np.ones(len(s1), dtype=bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        first = np.flatnonzero(new)
        group = np.empty(len(at), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        many = np.diff(np.append(first, len(s1))) > 1
        return at, s1[first], s2[first], group, many


def duplicate_spans(docs: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: its duplicate word spans ``[start, end)``, the reference block of each, and the
    text that is left (words outside the spans joined by one space, UTF-8 bytes)."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    n = B.block_count(docs, text_col, block_bytes)
    texts = B.in_blocks(docs, n, id_col, text_col)

    def index(t: pa.Table) -> pa.Table:
        p = Parsed(B.unpack(t), window, gram)
        return B.send(t.column("block")[0].as_py(), p.keys, None, p.again, n)

    def fingerprints(t: pa.Table, told: pa.Table) -> pa.Table:
        p = Parsed(B.unpack(t), window, gram)
        _, k1, k2, _, many = p.windows(B.answers(told, 0, p.keys, n))
        return B.send(t.column("block")[0].as_py() if t.num_rows else -1, k1, k2, many, n)

    def spans(t: pa.Table, told: pa.Table) -> pa.Table:
        p = Parsed(B.unpack(t), window, gram)
        at, k1, _, group, _ = p.windows(B.answers(told, 0, p.keys, n))
        dup = np.zeros(len(p.h) + 1, dtype=np.int64)
        found = at[B.answers(told, 1, k1, n)[group]] if len(at) else at
        np.add.at(dup, found, 1)
        np.add.at(dup, found + window, -1)
        covered = np.cumsum(dup[:-1]) > 0 if len(p.h) else np.empty(0, dtype=bool)
        ref = np.full(len(p.h) + 1, -1, dtype=np.int32)
        if len(p.valid):
            ref[p.valid] = B.references(told, p.keys, n)[p.key_of]
        return _rows(p, covered, ref)

    def _rows(p: Parsed, covered: np.ndarray, ref: np.ndarray) -> pa.Table:
        starts, ends, refs, kept = [], [], [], []
        begin = 0
        for text, size in zip(p.texts, p.n.tolist()):
            c = covered[begin:begin + size]
            if c.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0]))))
                s, e = edge[::2], edge[1::2]
                words = text.split()
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~c)]))
                starts.append(s.astype(np.int32)), ends.append(e.astype(np.int32))
                refs.append(ref[begin + s])
            else:
                kept.append(b" ".join(text.split()))
                empty = np.empty(0, dtype=np.int32)
                starts.append(empty), ends.append(empty), refs.append(empty)
            begin += size
        return pa.table({"doc_id": pa.array(p.docs, pa.int64()), "n_words": pa.array(p.n, pa.int64()),
                         "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32())),
                         "reference_blocks": pa.array(refs, pa.list_(pa.int32())), "kept": pa.array(kept, pa.binary())})

    told = texts.groupBy("block").applyInArrow(index, B.SENT).groupBy("bucket").applyInArrow(B.merge(0), B.TOLD)
    again = (texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(fingerprints, B.SENT)
             .groupBy("bucket").applyInArrow(B.merge(1), B.TOLD))
    return texts.groupBy("block").cogroup(told.unionByName(again).groupBy("block")).applyInArrow(spans, SPANS)


def digest(spans: DataFrame) -> DataFrame:
    """Columns of the ``op4`` query from ``duplicate_spans``."""
    from pyspark.sql import functions as F
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"),
                          lambda a, x: a + x)
    return spans.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"),
                        F.size("starts").alias("n_spans"))


