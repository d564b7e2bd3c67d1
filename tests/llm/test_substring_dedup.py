import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import blocks as B
from tessera.llm.substring_dedup import digest, duplicate_spans


def brute(rows, k=35):
    count = Counter()
    docs = [(d, t.encode().split()) for d, t in rows]
    for _, w in docs:
        count.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for d, w in docs:
        cut = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i:i + k])] > 1:
                cut.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in cut)
        out[d] = (len(w), len(cut), hashlib.sha256(kept).hexdigest())
    return out


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digest(duplicate_spans(docs, block_bytes=4000)).collect()}
    assert got == brute(rows)


def test_random_small_alphabet(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, gram in ((6, 3), (9, 9), (5, 1)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
               for r in digest(duplicate_spans(df, window=k, gram=gram, block_bytes=500)).collect()}
        assert got == brute(rows, k)


def test_empty(no_docs):
    assert digest(duplicate_spans(no_docs)).count() == 0


def test_spans_name_words(docs, rows):
    text = dict(rows)
    for r in duplicate_spans(docs, block_bytes=9000).collect():
        words, cut = text[r.doc_id].encode().split(), set()
        for s, e in zip(r.starts, r.ends):
            assert e - s >= 35
            cut.update(range(s, e))
        assert bytes(r.kept) == b" ".join(w for i, w in enumerate(words) if i not in cut)
        assert len(r.reference_blocks) == len(r.starts) and all(x >= 0 for x in r.reference_blocks)


def test_rolling_sliding_and_keys():
    h = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    for k in (1, 2, 3, 5, 8, 35, 200):
        want = [sum(int(x) * pow(base, k - 1 - j, 2**64) for j, x in enumerate(h[i:i + k])) % 2**64
                for i in range(len(h) - k + 1)]
        assert B.rolling(h, k, base).tolist() == want
        assert B.sliding(h, k, np.minimum).tolist() == [h[i:i + k].min() for i in range(len(h) - k + 1)]
    for keys in (h[:0], h[:1], np.sort(h), np.sort(h % np.uint64(1000))):
        assert B.unpack_keys(B.pack_keys(keys)).tolist() == keys.tolist()
