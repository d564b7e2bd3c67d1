import random

import pytest

from tessera.llm.components import connected_components
from tessera.llm.ngram_jaccard import jaccard_components


def brute(rows, width, percent):
    sets = []
    for d, t in rows:
        w = t.encode().lower().split()
        k = min(width, len(w))
        sets.append((d, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def got(df, *a):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, *a).collect()}


def test_against_brute_force(docs, rows):
    assert got(docs) == brute(rows, 3, 90)


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_chains_of_near_copies(spark, seed, width, percent):
    rnd = random.Random(seed)
    rows, texts = [], []
    for i in range(120):
        if texts and rnd.random() < 0.8:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(30)}"
            if rnd.random() < 0.2:
                w += w[:3]
        else:
            w = [f"v{rnd.randrange(30)}" for _ in range(rnd.choice((1, 2, 5, 60, 90)))]
        texts.append(" ".join(w))
        rows.append((1000 - i, texts[-1]))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), width, percent) == brute(rows, width, percent)


def test_empty(no_docs):
    assert jaccard_components(no_docs).count() == 0


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (103, 100), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 105: 100, 103: 100, 201: 200}


def test_rows_of_one_id_in_any_order(spark):
    """Links of every text count, whatever row of a repeated id comes first."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = a[:59] + ["other"]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near)), (3, " ".join(b)), (None, " ".join(a)), (5, " ".join(a)), (9, None), (9, "")]
    for order in (rows, rows[::-1]):
        out = jaccard_components(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out)
        assert got == sorted([("5", 58, 5), ("5", 58, 5), ("5", 58, 3), ("7", 58, 5), ("3", 58, 3), ("None", 58, 5), ("9", 0, 9), ("9", 0, 9)])
        assert len({r.component for r in out if r.n_shingles}) == 2


def test_block_sizes_do_not_change_the_result(spark, docs, rows):
    out = jaccard_components(docs, block_bytes=3_000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(rows, 3, 90)
