"""Distributed products and truncated SVD against dense linear algebra on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blockmatrix as bm


def frame(spark, x):
    entries = [(int(i) * 3, int(j) * 2 + 1, float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    w = spark.createDataFrame(entries, "doc_id long, term_index long, weight double")
    docs = spark.createDataFrame([(int(i) * 3, float(i % 4)) for i in range(len(x))], "doc_id long, label double")
    return w, docs


@pytest.fixture(scope="module")
def x():
    rnd = np.random.default_rng(1)
    low = rnd.normal(size=(60, 6)) @ rnd.normal(size=(6, 45)) * (rnd.random((60, 45)) < 0.4)
    low[7] = 0                                              # a document without entries
    low[:, 9] = 0                                           # a term without entries
    return low


@pytest.fixture(params=[50_000_000, 900])
def matrix(request, spark, x, monkeypatch):
    monkeypatch.setattr(bm, "WORK", request.param)          # one block, or many
    w, docs = frame(spark, x)
    m = bm.BlockMatrix.build(w, docs, 5, meta=("label",))
    assert (m.blocks.count() > 3) == (request.param == 900)
    return m


def dense(term_table, terms, k):
    out = np.zeros((terms, k))
    for r in term_table.collect():
        out[(r.term - 1) // 2] = r.v
    return out


def test_products(spark, matrix, x, monkeypatch):
    monkeypatch.setattr(bm, "CHUNK", 7)
    d = np.random.default_rng(2).normal(size=(45, 3))
    v = spark.createDataFrame([(2 * j + 1, [float(y) for y in d[j]]) for j in range(45)], "term long, v array<double>")
    got = {r.doc_id: r.value for r in bm.project(matrix, v, 3).filter("component = 1").collect()}
    assert len(got) == 60 and np.allclose([got[3 * i] for i in range(60)], x @ d[:, 1])
    back = matrix.back(v, 3, lambda block, y: y * (block.meta["label"] == 2)[:, None], 3)
    keep = np.diag([float(i % 4 == 2) for i in range(60)])
    assert np.allclose(dense(back, 45, 3), x.T @ keep @ x @ d)


def test_svd_against_dense(matrix, x):
    v, s = bm.truncated_svd(matrix, 8, max_iter=30, tol=1e-9)
    _, exact, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, exact[:8], rtol=1e-4)
    got = dense(v, 45, 8)
    assert np.allclose(got.T @ got, np.eye(8), atol=1e-10)
    assert np.allclose(np.abs(np.diag(got[:, :4].T @ vt[:4].T)), 1, atol=1e-4)
    assert (got[np.abs(got).argmax(axis=0), range(8)] > 0).all()
    best = np.linalg.norm(x - (x @ vt[:8].T) @ vt[:8])
    assert np.linalg.norm(x - x @ got @ got.T) <= 1.0001 * best


def test_more_components_than_rank(spark):
    x = np.outer(np.arange(1, 6.0), np.ones(4)) + np.eye(5, 4)
    w, docs = frame(spark, x)
    v, s = bm.truncated_svd(bm.BlockMatrix.build(w, docs, 10), 10)
    assert len(s) == 4 and np.allclose(s, np.linalg.svd(x)[1], rtol=1e-6)


def test_empty_matrix(spark):
    w, docs = frame(spark, np.zeros((3, 3)))
    m = bm.BlockMatrix.build(w, docs, 4)
    v, s = bm.truncated_svd(m, 2)
    assert s == [] and v.count() == 0


def test_sums_carry_over_batches(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("term"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.term: r.v for r in bm.sum_by_term(rows, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {t: [float(sum(1 for i in range(5000) if i % 7 == t)), float(sum(i for i in range(5000) if i % 7 == t))] for t in range(7)}
    assert got == want


def test_iteration_on_documents_gives_the_same(spark, x, monkeypatch):
    w, docs = frame(spark, x)
    monkeypatch.setattr(bm, "WORK", 4_000)                  # several blocks
    m = bm.BlockMatrix.build(w, docs, 8)
    v, s = bm.truncated_svd(m, 4, 4)
    want = {(r.doc_id, r.component): r.value for r in bm.project(m, v, len(s)).collect()}
    xs, vt, st = bm.transposed_svd(w, docs, 4, 4)
    got = {(r.doc_id, r.component): r.value for r in xs.collect()}
    assert np.allclose(s, st) and got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    assert np.allclose(bm.gram(vt, 4), np.eye(4), atol=1e-9)


def test_size_of_blocks_follows_term_rows(spark, monkeypatch):
    """A few terms that every document has: the rows that travel are few, so blocks are as large as their entries allow."""
    df = spark.createDataFrame([(i, 400) for i in range(10)], "term long, df long")
    monkeypatch.setattr(bm, "WORK", 200_000)
    n, rows = bm.block_rows(df, 4_000, 1_000)
    assert n == 1 and rows == 10
    n, rows = bm.block_rows(spark.range(4_000).selectExpr("id", "1L as df"), 4_000, 1_000)
    assert n >= 80 and abs(rows - 4_000) < 1


def test_blocks_of_one_part(spark, x):
    w, docs = frame(spark, x)
    m = bm.BlockMatrix.build(w, docs, 5, meta=("label",), parts=4, part=lambda about: about["label"].astype(int))
    rows = [bm.Block(r.asDict(), m.meta) for r in m.blocks.collect()]
    numbers = [r.block for r in m.blocks.collect()]
    assert all((b.meta["label"] == n % 4).all() for b, n in zip(rows, numbers)) and sorted(i for b in rows for i in b.ids) == [3 * i for i in range(60)]
    found = {i: t for b in rows for i, t in zip(b.ids, b.times(np.ones((len(b.terms), 1)))[:, 0])}
    assert np.allclose([found[3 * i] for i in range(60)], x.sum(axis=1))
