import math

from pyspark.sql import functions as F

from tessera.operators import bm25 as bm, features as fe


def docs(spark):
    # three documents of lengths 4, 5, 6 holding 1, 2, 3 distinct terms
    rows = [(0, ["a", "a", "a", "a"]), (1, ["a", "b", "b", "b", "b"]), (2, ["a", "b", "c", "c", "c", "c"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_bm25_micro_example(spark):
    d = docs(spark)
    tf = fe.term_frequencies(d)
    n = fe.count_documents(d)
    idf, stats = fe.fit_bm25(tf, n)
    w = {(r.doc_id, r.term): r.weight for r in fe.apply_bm25(tf, idf, stats).collect()}
    k1, b, avgdl = 2.0, 0.75, 5.0
    dfs = {"a": 3, "b": 2, "c": 1}
    for (doc, term, x, dl) in [(0, "a", 4, 4), (1, "b", 4, 5), (2, "c", 4, 6), (2, "a", 1, 6)]:
        idf_v = math.log((3 - dfs[term] + 0.5) / (dfs[term] + 0.5))
        exp = x * (k1 + 1) / (x + k1 * (1 - b + b * dl / avgdl)) * idf_v
        assert abs(w[(doc, term)] - exp) < 1e-12
    assert w[(0, "a")] < 0                     # Q6: terms in most documents get a negative idf


def test_bm25_estimator_matches_functions(spark, tmpdir_path):
    d = docs(spark)
    model = bm.BM25(inputCol="tokens", idCol="doc_id").fit(d)
    a = {(r.doc_id, r.term): round(r.weight, 12) for r in model.transform(d).collect()}
    tf = fe.term_frequencies(d)
    idf, stats = fe.fit_bm25(tf, fe.count_documents(d))
    b = {(r.doc_id, r.term): round(r.weight, 12) for r in fe.apply_bm25(tf, idf, stats).collect()}
    assert a == b
    model.save(tmpdir_path + "/bm25")
    again = bm.BM25Model.load(spark, tmpdir_path + "/bm25")
    c = {(r.doc_id, r.term): round(r.weight, 12) for r in again.transform(d).collect()}
    assert c == a


def test_tfidf_unit_norm_and_smooth_idf(spark):
    d = docs(spark)
    w = fe.tfidf(d, min_df=1, max_df=1.0)
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)
    # doc 2: a (tf 1, df 3), b (tf 1, df 2), c (tf 4, df 1)
    raw = {t: tf * (math.log(4 / (1 + df)) + 1) for t, tf, df in [("a", 1, 3), ("b", 1, 2), ("c", 4, 1)]}
    nrm = math.sqrt(sum(v * v for v in raw.values()))
    got = {r.term: r.weight for r in w.filter("doc_id = 2").collect()}
    for t, v in raw.items():
        assert abs(got[t] - v / nrm) < 1e-12


def test_vocabulary_bounds(spark):
    d = docs(spark)
    tf = fe.term_frequencies(d)
    v = {r.term for r in fe.vocabulary(tf, fe.count_documents(d), min_df=2, max_df=0.8).collect()}
    assert v == {"b"}                           # a: df 3 > 0.8*3; c: df 1 < 2


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],)], "tokens array<string>")
    out = [sorted(r.g) for r in df.select(fe.ngrams("tokens", 1, 3).alias("g")).collect()]
    assert out[0] == sorted(["a", "b", "c", "a b", "b c", "a b c"])
    assert out[1] == ["x"]


def test_pooled_vectors_with_nulls_and_several_vectors(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (2, "x", 9), (None, "a", 1)], "doc_id long, term string, tf long")
    tv = spark.createDataFrame([("a", 0, [1.0, None]), ("a", 0, [3.0, None]), ("b", 1, [5.0, 6.0])], "term string, rank long, embedding array<float>")
    got = {(r.doc_id, r.dim): r.value for r in fe.pooled_vectors_wide(tf, tv, 2, "mean").collect()}
    assert got == {(1, 0): 13 / 5, (1, 1): 6 / 5, (2, 0): 5.0, (2, 1): 6.0, (None, 0): 2.0, (None, 1): None}
    assert fe.pooled_vectors_wide(tf, tv, 2, "sum").filter("doc_id = 1 and dim = 0").first().value == 13.0


def test_pooling_keeps_vectors_out_of_the_entries(spark):
    """The rows joined with the entries are ids and counts: vectors reach the documents by blocks."""
    from unittest import mock

    from tessera.operators import blockmatrix
    tf = spark.createDataFrame([(1, "a", 2)], "doc_id long, term string, tf long")
    tv = spark.createDataFrame([("a", 0, [1.0, 2.0])], "term string, rank long, embedding array<float>")
    with mock.patch.object(blockmatrix.BlockMatrix, "build", wraps=blockmatrix.BlockMatrix.build) as build:
        fe.pooled_vectors_wide(tf, tv, 2)
    assert build.call_args.args[0].columns == ["doc_id", "term_index", "tf"]
