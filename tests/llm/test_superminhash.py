import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import superminhash as sm
from tessera.llm.queries import QUERIES

from .test_ngram_jaccard import brute


def got(df, **a):
    out = {}
    for r in sm.near_duplicates(df, **a).collect():
        assert r.kept == (r.doc_id == r.component_id)
        out[r.doc_id] = (r.n_shingles, r.component_id)
    return out


def test_signature_of_a_set_is_the_least_over_its_elements():
    rnd = np.random.default_rng(1)
    elements = rnd.integers(0, 2**63, 40).astype(np.uint64)
    alone = np.array([sm.superminhash([elements[i:i + 1]], 16)[0] for i in range(40)])
    for k in range(16):                                   # an element deals every step once
        assert sorted(alone[3] >> 32) == list(range(16)) and alone.shape == (40, 16)
    assert (sm.superminhash([elements], 16)[0] == alone.min(axis=0)).all()
    both = sm.superminhash([elements[:7], elements[7:9], elements], 16)
    assert (both[0] == alone[:7].min(axis=0)).all() and (both[1] == alone[7:9].min(axis=0)).all() and (both[2] == alone.min(axis=0)).all()


def test_estimates_are_unbiased_and_vary_less_than_independent_hashes():
    rnd = np.random.default_rng(2)
    errors = []
    for _ in range(300):
        x = rnd.integers(0, 2**63, 60).astype(np.uint64)
        a, b = sm.superminhash([x[:45], x[15:]])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.25 / sm.PLACES


def test_pieces_do_not_change_signatures(monkeypatch):
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 30, 500, 4000, 3)]
    whole = sm.signature_bytes(sets)
    monkeypatch.setattr(sm, "AT_ONCE", 40)
    assert sm.signature_bytes(sets) == whole


def test_against_brute_force(docs, rows):
    assert got(docs, width=4) == brute(rows, 4, 80)


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 80), (3, 3, 90)])
def test_chains_of_near_copies(spark, seed, width, percent):
    rnd = random.Random(seed)
    rows, texts = [], []
    for i in range(150):
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
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent) == brute(rows, width, percent)


def test_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " end"), (8, b + " end"), (5, b), (None, b + " tail"), (None, "alone of all documents here"), (9, None)]
    for order in (rows, rows[::-1]):
        out = sm.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(out) == len(rows)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in out
                      if r.component_id is not None) == sorted([(5, 56, 5), (5, 56, 5), (5, 56, 5), (7, 57, 5), (8, 57, 5), (-1, 57, 5), (9, 0, 9)])
        assert [r.n_shingles for r in out if r.component_id is None] == [1]


def test_empty_and_clashing_columns(spark, no_docs, docs, rows):
    assert sm.near_duplicates(no_docs).count() == 0
    extra = docs.withColumns({c: F.lit(1) for c in ("node", "mark", "doc", "key", "g", "sig", "n", "__row")})
    assert got(extra, width=4) == brute(rows, 4, 80)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op12_superminhash"](spark, sf)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()} == brute(rows, 4, 80)


def test_crowded_buckets_in_small_tiles(spark, monkeypatch):
    """Many texts around one shared passage, of which only some link: buckets hold several groups and are searched tile by tile."""
    monkeypatch.setattr(sm, "TILE", 3)
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(140):
        w = list(passage)
        for _ in range(rnd.choice((1, 2, 3, 4, 5))):
            w[rnd.randrange(90)] = f"x{rnd.randrange(12)}"
        rows.append((i, " ".join(w + [f"own{i // 2}-{k}" for k in range(rnd.choice((0, 4, 15)))])))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), width=4) == brute(rows, 4, 80)
