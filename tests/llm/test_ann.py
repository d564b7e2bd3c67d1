import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.ann import Tables, budgets, distance, nearest

from ..conftest import SF_SMALL


def brute(rows, ask, k=5):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    n = np.linalg.norm(x, axis=1)
    out = {}
    for i in range(len(ids)):
        if ask(ids[i]):
            s = x @ x[i] / (n * n[i])
            other = np.flatnonzero(ids != ids[i])
            order = other[np.lexsort((ids[other], -np.round(s[other], 12)))][:k]
            out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 50 == 0)
    got = collect(nearest(df, F.col("vec_id") % 50 == 0))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q in got:
        exact = dict(brute([(r.vec_id, r.embedding) for r in df.filter(F.col("vec_id").isin(q, *[a for a, _ in got[q]])).collect()],
                           lambda i: i == q)[q])
        for a, s in got[q]:
            assert s == pytest.approx(exact[a], abs=1e-12)


def test_clusters_ties_and_unusable_vectors(spark):
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.05 * rnd.normal(size=16)).tolist()) for i in range(150)]
    rows += [(200 + i, centres[0].tolist()) for i in range(40)]                    # one vector many times
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [1.0, 2.0]),
             (506, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("clash"))
    for block in (8192, 7):
        got = collect(nearest(df, F.col("vec_id") % 10 == 0, query_block=block))
        want = brute([r for r in rows if r[1] and len(r[1]) == 16], lambda i: i % 10 == 0)
        assert got.keys() == want.keys()
        hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
        assert hits >= 0.95 * 5 * len(want)
        assert [a for a, _ in got[230]] == [a for a, _ in want[230]] == [200, 201, 202, 203, 204]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = collect(nearest(df, F.col("vec_id") == 0))
    assert [a for a, _ in got[0]] == [2, 1]
    assert nearest(df.limit(0), F.lit(True)).count() == 0 and nearest(df, F.lit(False)).count() == 0


def test_pigeonhole_finds_every_code_in_the_radius():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 256, (400, 4), dtype=np.uint8)
    tables = Tables(codes)
    for r in (0, 1, 2, 5, 11, 14, 32):
        assert sum(x + 1 for x in budgets(r, 4)) == r + 1
        for q in codes[:20]:
            assert tables.within(q, r, 0).tolist() == np.flatnonzero(distance(codes, q) <= r).tolist()
