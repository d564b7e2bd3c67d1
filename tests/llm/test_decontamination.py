import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.decontamination import Index, align, budget, find, leaks, normalise


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(items, text, window=80, step=40, rate=0.1, min_bytes=32):
    out, t = {}, normalise(text.encode())
    for i, item in items:
        p = normalise(item.encode())
        if len(p) < min_bytes:
            continue
        last = max(0, len(p) - window)
        found = sum(edits(p[s:s + window], t) <= budget(len(p[s:s + window]), rate)[0]
                    for s in sorted({*range(0, last, step), last}))
        if found:
            out[i] = found
    return out


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(n))


def test_against_brute_force():
    rnd = random.Random(2)
    items = [(i, words(rnd, rnd.choice((3, 9, 16, 40)))) for i in range(12)] + [(90, "the of"), (91, "")]
    items.append((92, items[3][1]))
    index = Index([(i, t.encode()) for i, t in items], 80, 40, 0.1, 32)
    texts = []
    for _ in range(60):
        t = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(0, 12)):
            if t:
                at = rnd.randrange(len(t))
                t[at:at + rnd.randrange(2)] = rnd.choice(("", "x", " ", "Q", "é"))
        texts.append(words(rnd, rnd.randrange(12)) + " " + "".join(t).upper() + " " + words(rnd, rnd.randrange(12)))
    texts += ["", " ", "a" * 500, items[2][1], items[2][1][:60]]
    found = find(index, [t.encode() for t in texts])
    for t, x in zip(texts, found):
        assert {y[0]: y[1] for y in x} == brute(items, t)


def test_align_is_semi_global():
    rnd = random.Random(4)
    cases = [("".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 20))), "".join(rnd.choice("ab") for _ in range(rnd.randrange(20, 40))))
             for _ in range(100)]
    got = align([p.encode() for p, _ in cases], [b"\xff" * 20 + t.encode() + b"\xff" * 20 for _, t in cases])
    assert got.tolist() == [edits(p, t) for p, t in cases]


@pytest.mark.parametrize("block_bytes", [10**6, 300])
def test_frames(spark, docs, no_docs, block_bytes):
    rnd = random.Random(9)
    items = spark.createDataFrame([(i, words(rnd, 30)) for i in range(6)] + [(8, None), (None, words(rnd, 30)), (9, "short")],
                                  "item_id long, text string")
    third = items.filter("item_id = 3").first().text
    more = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" " + third.encode().upper().decode())))
                           .otherwise(F.col("text")))
    out = leaks(more, items, block_bytes=block_bytes)
    assert out.columns == docs.columns + ["leaks"] and out.count() == docs.count()
    for r in out.collect():
        assert [x.item_id for x in r.leaks] == ([3] if r.doc_id % 2 == 0 else [])
        if r.leaks:
            assert r.leaks[0].edits == 0 and r.leaks[0].n_windows == r.leaks[0].of_windows
    assert leaks(no_docs, items).count() == 0
    assert {len(r.leaks) for r in leaks(docs, items.limit(0)).collect()} == {0}


def test_normalise():
    assert normalise(b"  A,b--C\t\n9  ") == b"a b c 9"
    assert normalise("Été, à".encode()) == "Été à".encode()
    assert np.array_equal(np.frombuffer(normalise(b"a.b"), np.uint8), np.frombuffer(b"a b", np.uint8))


def test_fragments_at_every_alignment(spark):
    """No window is shared with the operator: a verbatim run of 72 bytes counts wherever it begins, one of 71 does not."""
    rnd = random.Random(12)
    item = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(260))
    around = "".join(rnd.choice("0123456789") for _ in range(300))
    rows = [(size * 1000 + s, around + item[s:s + size] + around) for size in (71, 72, 78, 90) for s in range(len(item) - size + 1)]
    rows += [(72_900_000 + s, item[s:s + 72]) for s in range(0, 189, 9)]                # nothing around
    found = {r.doc_id: r.leaks for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        [(1, item)], "item_id long, text string")).collect()}
    assert all(bool(x) == (d // 1000 != 71) for d, x in found.items())
    assert {len(x) for x in found.values()} == {0, 1}


def test_every_start_against_brute_force():
    rnd = random.Random(13)
    items = [(i, words(rnd, 36)) for i in range(3)]
    index = Index([(i, t.encode()) for i, t in items], 80, 1, 0.1, 32)
    for n in range(6):
        t = list(items[n % 3][1][n * 7:n * 7 + 95])
        for _ in range(n):
            t[rnd.randrange(len(t))] = rnd.choice(("", "x", "xy"))
        text = words(rnd, 6) + "".join(t) + words(rnd, 6)
        assert {y[0]: y[1] for y in find(index, [text.encode()])[0]} == brute([items[n % 3]], text, step=1)


def test_short_items_as_whole_words(spark):
    items = spark.createDataFrame([(1, "The answer: 42!"), (2, "yes"), (3, "the ANSWER 42"), (4, ""), (5, None), (6, " ?! "), (7, "été à la mer")],
                                  "item_id long, text string")
    texts = ["so the answer 42 it is", "The answer is 42", "eyes yesterday", "Yes", "oh, yes.", None, "", "the answer 421", "en été, à la mer",
             "a" * 400_000 + " yes the answer 42", "y " * 200_000 + "yes", "the", "answer 42"]
    want = [{1, 3}, set(), set(), {2}, {2}, set(), set(), set(), {7}, {1, 2, 3}, {2}, set(), set()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_bytes in (10**6, 20):
        got = {r.doc_id: r.leaks for r in leaks(docs, items, block_bytes=block_bytes).collect()}
        assert [{x.item_id for x in got[i]} for i in range(len(texts))] == want
        assert [(x.n_windows, x.of_windows, x.edits, x.first_byte, x.last_byte) for x in got[4]] == [(1, 1, 0, 3, 6)]


def test_items_of_16_to_31_bytes_with_edits(spark):
    """From 16 bytes on an item is found with the edits of its budget; shorter ones only unchanged."""
    rnd = random.Random(21)
    items = [(n, "".join(rnd.choice("abcdefghij") for _ in range(n))) for n in range(12, 40)]
    texts = []
    for n, item in items:
        for changes in range(4):
            t = list(item)
            for at in rnd.sample(range(n), changes):
                t[at] = rnd.choice(("", "x", "xy"))
            texts.append(words(rnd, 4) + " " + "".join(t) + " " + words(rnd, 4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    long = [(i, t) for i, t in items if len(t) >= 16]
    for i, t in enumerate(texts):
        assert {x for x in got[i] if x >= 16} == set(brute(long, t, min_bytes=16))
    assert all(got[4 * j] >= {n} and not got[4 * j + 1] & {n} for j, (n, _) in enumerate(items) if n < 16)


def test_repeated_places_do_not_fill_a_band():
    """Text of one short pattern hits every diagonal; places count once and results stay those of brute force."""
    rnd = random.Random(22)
    items = [(0, "ab" * 50), (1, words(rnd, 30)), (2, "abcabcab " * 12)]
    index = Index([(i, t.encode()) for i, t in items], 80, 1, 0.1, 16)
    texts = ["ab" * 200, "ab" * 36, "ab" * 35, "abab x " * 40, "abcabcab " * 8, "abcab " * 40, items[1][1][5:90], "ba" * 37 + "cc" + "ab" * 9]
    assert [{y[0]: y[1] for y in x} for x in find(index, [t.encode() for t in texts])] == [brute(items, t, step=1) for t in texts]


def test_index_of_a_full_block_is_bounded():
    rnd = np.random.default_rng(3)
    items = [(i, bytes(rnd.integers(97, 123, 20_000, dtype=np.uint8))) for i in range(50)]
    index = Index(items, 80, 1, 0.1, 16)
    arrays = (index.codes, index.first, index.owner, index.at, index.maybe)
    assert sum(a.nbytes for a in arrays) < 64 * 1_000_000
    assert find(index, [b"x " + items[7][1][300:420] + b" y"])[0][0][:2] == (7, 57)
