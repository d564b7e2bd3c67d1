import math
import zlib
from collections import Counter

import pytest

from tessera.llm.lm_scoring import crc_remainder, score


def brute(rows, order, prior):
    tokens = {d: [w.decode() for w in t.encode().lower().split()] + ["</s>"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = [Counter() for _ in range(order + 1)]
    for d, w in tokens.items():
        if held[d]:
            continue
        s = ["<s>"] * (order - 1) + w
        for k in range(1, order + 1):
            for i in range(order - 1, len(s)):
                count[k][tuple(s[i - k + 1:i + 1])] += 1
            if k < order:
                count[k][tuple(s[order - 1 - k:order - 1])] += 1
    words = {k[0]: v for k, v in count[1].items() if k[0] != "<s>"}
    n, v = sum(words.values()), len(words)

    def p(context, w):
        if not context:
            return (words.get(w, 0) + 1) / (n + v + 1)
        low, c = p(context[1:], w), count[len(context)][context]
        return low if not c else (count[len(context) + 1][context + (w,)] + prior * low) / (c + prior)

    out = {}
    for d, w in tokens.items():
        s = ["<s>"] * (order - 1) + w
        out[d] = (held[d], len(w), sum(x in words for x in w), n,
                  sum(math.log10((words.get(x, 0) + 1) / (n + v + 1)) for x in w),
                  sum(math.log10(p(tuple(s[i:i + order - 1]), s[i + order - 1])) for i in range(len(w))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(docs, rows, order):
    got = {r.doc_id: tuple(r)[1:] for r in score(docs, crc_remainder("doc_id", 7) == 2, order, 2.0, block_bytes=4000).collect()}
    want = brute(rows, order, 2.0)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], rel=1e-9)


def test_empty_and_nothing_to_learn_from(spark, docs, no_docs):
    from pyspark.sql import functions as F
    assert score(no_docs, F.lit(False)).count() == 0
    assert {r.train_tokens for r in score(docs, F.lit(True)).collect()} == {0}
