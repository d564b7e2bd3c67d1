"""Searches and fits run over their whole grids, in parts that keep disk and memory in line with the input."""

import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blockmatrix as bm, features as fe, metrics as me, mlp, models as mo, ovr, stages as st
from tessera.plans import ml_plans as mp


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = np.random.default_rng(5)
    label, fold = rnd.integers(0, 2, 60), rnd.integers(-1, 2, 60)
    x = rnd.random((60, 10)) * (rnd.random((60, 10)) < 0.4)
    x[np.arange(60), label] += 0.5
    docs = spark.createDataFrame([(i, float(label[i]), int(fold[i])) for i in range(60)], "doc_id long, label double, fold int").cache()
    w = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc_id long, term_index long, weight double").cache()
    return w, docs


def test_svm_search_takes_its_whole_grid(spark, corpus, monkeypatch):
    """every combination is a candidate."""
    asked = {}

    def search(w, docs, algorithm, grid, n=None, **_):
        asked.update(grid=grid, n=n)
        found = [{"candidate": i, "bags": b, "fraction": f, "C": c, "mean": 0.5, "std": 0.0} for i, (b, f, c) in enumerate(ovr.candidates(grid, n, 1))]
        return found[0], found, None
    monkeypatch.setattr(mp, "labelled_weights", lambda *_: corpus[::-1])
    monkeypatch.setattr(ovr, "search", search)
    rows = mp.svm_search(spark, "").collect()
    assert len({(r.bags, r.fraction, r.value) for r in rows}) == len(rows) == np.prod([len(v) for v in mp.SVM_GRID.values()]) == 16


def test_values_of_an_svm_search_are_fitted_in_turns(corpus, monkeypatch):
    """Where the weights of all values are many, only one value's are kept at a time, and the predictions are the same."""
    w, docs = corpus
    kept, dropped, real, gone = [], [], ovr.cut_lineage, ovr.drop_table
    monkeypatch.setattr(ovr, "cut_lineage", lambda df, name="t": (kept.append((name, len(dropped))), real(df, name))[1])
    monkeypatch.setattr(ovr, "drop_table", lambda df: (dropped.append(df.columns), gone(df))[1])
    grid, out = {"bags": [1], "fraction": [0.8], "value": [0.1, 2.0]}, []
    for most in (10**8, 1):
        monkeypatch.setattr(ovr, "BAG_WEIGHTS", most)
        kept.clear()
        _, records, pred = ovr.search(w, docs, "SVM", grid, folds=2, max_iter=3)
        out.append(([(r["C"], round(r["mean"], 9)) for r in records], sorted((r.doc_id, r.y_pred, np.round(r.probs, 9).tolist()) for r in pred.collect())))
        assert sum(name == "svm-weights" for name, _ in kept) == (2 if most == 1 else 1)
    assert out[0] == out[1] and len(out[0][0]) == 2
    ends = [c for c in dropped if "margin" in c and "ids" in c]
    assert len(ends) == 3                                   # each was deleted once it had been scored


def test_written_tables_leave_no_shuffle_files(tmp_path):
    """Files of a shuffle go when the table that it led to is written."""
    import subprocess
    import sys
    code = f"""
import glob, time
from tessera.session import build_session, cut_lineage
s = build_session("local[2]", 4, extra={{"spark.local.dir": "{tmp_path}/local", "spark.checkpoint.dir": "{tmp_path}/kept"}})
t = cut_lineage(s.range(1000).repartition(4, "id").groupBy("id").count())
for _ in range(50):
    left = glob.glob("{tmp_path}/local/**/shuffle_*", recursive=True)
    if not left:
        break
    time.sleep(0.1)
print(t.count(), len(left))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout
    assert out.split() == ["1000", "0"]


def test_networks_of_one_shape_take_the_steps_of_each_alone():
    rnd = np.random.default_rng(2)
    layers = mlp.shapes(6, (5, 3), 3)
    thetas, x, label = rnd.normal(size=(4, mlp.start(layers, "tanh", 1).size)), rnd.normal(size=(9, 6)), rnd.integers(0, 3, 9)
    for activation in mlp.ACTIVATIONS:
        loss, g = mlp.gradients(thetas, layers, activation, x, label)
        for t, a, b, p in zip(thetas, loss, g, mlp.forwards(thetas, layers, activation, x)[-1]):
            want = mlp.gradient(t, layers, activation, x, label)
            assert np.isclose(a, want[0]) and np.allclose(b, want[1]) and np.allclose(p, mlp.forward(t, layers, activation, x)[-1])


def test_every_network_of_the_grid_runs_its_own_epochs(spark, monkeypatch):
    """no number of epochs but the candidate's own, and all candidates of the grid."""
    x = np.random.default_rng(4).normal(size=(40, 2))
    label = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(label[i]), i % 4 == 0) for i in range(40)], "doc_id long, x array<double>, label int, held boolean").cache()
    grid = [{"hidden": (3,), "activation": "tanh", "solver": s, "alpha": 0.0, "learning_rate": "constant", "max_iter": e} for s, e in (("adam", 3), ("sgd", 6))]
    cands = mlp.train(rows, grid, 2, 2, epochs=None, batches=1, patience=100, rate=0.05)
    assert [c.steps for c in cands] == [3, 6] and all(c.best_score >= 0 for c in cands)
    got = {(r.candidate, r.y_true, r.y_pred): r.n for r in mlp.confusions(rows, cands).collect()}
    for k, c in enumerate(cands):
        said = {r.doc_id: r.y_pred for r in mlp.predict(rows, c).collect()}
        want = {}
        for i in range(40):
            want[k, int(label[i]), said[i]] = want.get((k, int(label[i]), said[i]), 0) + 1
        assert {a: n for a, n in got.items() if a[0] == k} == want
        pairs = spark.createDataFrame([(int(label[i]), said[i]) for i in range(40)], "y_true int, y_pred int")
        one = me.summary_by(pairs.groupBy(F.lit(k).alias("k"), "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")), ["k"]).drop("k")
        assert np.allclose(list(one.first().asDict().values()), [me.summary(pairs).first()[n] for n in one.columns])
    assert inspect.signature(mp.mlp_fit).parameters["n"].default is None and "epochs" not in inspect.signature(mp.mlp_fit).parameters
    assert len(mlp.sample_grid(mp.MLP_GRID, None, 1)) == 864


@pytest.mark.parametrize("docs, terms", [(14, 30), (40, 12)])
def test_narrow_passes_give_the_same_decomposition(spark, monkeypatch, docs, terms):
    """Where the rows of a pass are many, columns take turns; the tables that a round replaces are deleted."""
    rnd = np.random.default_rng(docs)
    x = rnd.random((docs, terms)) * (rnd.random((docs, terms)) < 0.5)
    w = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc_id long, term_index long, weight double").cache()
    d = spark.range(docs + 1).withColumnRenamed("id", "doc_id")
    out, widths, real = [], [], bm.BlockMatrix._pass
    monkeypatch.setattr(bm.BlockMatrix, "_pass", lambda self, v, k, *a: (widths.append(k), real(self, v, k, *a))[1])
    for sent in (10**9, 0):
        monkeypatch.setattr(bm, "SENT", sent)
        monkeypatch.setattr(bm, "NARROW", 4)
        widths.clear()
        found, v, s = bm.decompose(w, d, 5, 4)
        out.append(({(r.doc_id, r.component): r.value for r in found.collect()}, {r.term: r.v for r in v.collect()}, s))
        assert max(widths) == (4 if not sent else 9)
    (a, va, sa), (b, vb, sb) = out
    assert np.allclose(sa, sb) and set(a) == set(b) and len(a) == 5 * (docs + 1) and all(abs(a[k] - b[k]) < 1e-7 for k in a)
    assert set(va) == set(vb) and all(np.allclose(va[k], vb[k], atol=1e-7) for k in va)


def test_stages_behind_a_stage_read_its_rows(spark):
    """what a fitted stage gives is worked out once, not by every read of the stages behind it."""
    d = spark.createDataFrame([(i, ["a", "b", "c"][: 1 + i % 3], i % 2) for i in range(12)], "doc_id long, tokens array<string>, label int")
    weights = st.TextWeights(minDF=1, maxDF=1.0).fit(d).transform(d)
    scored = st.Lsa(k=1).fit(weights).transform(weights)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan and "Aggregate" not in plan
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == 12 and all(len(r.weights) == len(r.tokens) and len(r.components) == 1 for r in rows.values())


def test_blocks_are_packed_without_entries_of_no_document(spark):
    """Entries are taken over in order, those of unknown and of null documents left out."""
    w = spark.createDataFrame([(2, 7, 1.0), (1, 9, 2.0), (9, 7, 5.0), (None, 7, 6.0), (1, 7, 3.0), (2, 7, 4.0)], "doc_id long, term_index long, weight double")
    docs = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.0)], "doc_id long, label double")
    for parts, part in ((1, None), (2, lambda about: about["label"].astype(int))):
        m = bm.BlockMatrix.build(w, docs, 2, meta=("label",), parts=parts, part=part)
        got = {}
        for r in m.blocks.collect():
            b = bm.Block(r.asDict(), m.meta)
            assert list(b.terms) == sorted(set(b.terms))
            got |= {i: sorted(zip(b.terms[b.col[s:e]].tolist(), b.val[s:e].tolist())) for i, s, e in zip(b.ids, b.start[:-1], b.start[1:])}
        assert got == {1: [(7, 3.0), (9, 2.0)], 2: [(7, 1.0), (7, 4.0)], 3: []}


def test_word_vectors_meet_blocks_of_two_million_entries(spark, monkeypatch):
    """A block is packed in a fraction of a worker's memory."""
    shares, real = [], bm.block_rows
    monkeypatch.setattr(bm, "block_rows", lambda terms, entries, columns, share=40: (shares.append(share), real(terms, entries, columns, share))[1])
    tf = spark.createDataFrame([(1, "a", 2), (2, "a", 3)], "doc_id long, term string, tf long")
    tv = spark.createDataFrame([("a", 0, [0.5, 1.0])], "term string, rank long, embedding array<float>")
    assert len(fe.pooled_vectors_wide(tf, tv, 2, "sum").collect()) == 4 and bm.WORK // shares[0] <= 2_000_000


def test_bags_are_predicted_before_the_next_is_fitted(spark):
    """the driver holds one model at a time, and the probabilities are those of all models together."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors
    rnd = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, float(i % 2), Vectors.dense((rnd.random(4) + [i % 2, 0, 0, 1 - i % 2]).tolist())) for i in range(40)], ["doc_id", "label", "features"]).cache()
    alive, most = set(), [0]

    class Model:
        def __init__(self, m):
            self.m = m
            alive.add(id(self))
            most[0] = max(most[0], len(alive))

        def transform(self, df):
            return self.m.transform(df)

        def __del__(self):
            alive.discard(id(self))

    class Factory:
        def fit(self, df):
            return Model(NaiveBayes(smoothing=1.0).fit(df))
    how = dict(label_col="label", n_bags=2, fraction=0.7, seed=1, balanced=False)
    one = mo.predict_ovr(mo.each_ovr_bag(rows, [0.0, 1.0], Factory, **how), rows)
    assert most[0] <= 2 and not alive                       # the next one is there a moment before the last name goes
    every = mo.predict_ovr(mo.fit_ovr_bagging(rows, [0.0, 1.0], NaiveBayes, **how), rows)
    a, b = ({(r.doc_id, r["class"]): r.prob for r in d.collect()} for d in (one, every))
    assert len(a) == 80 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
