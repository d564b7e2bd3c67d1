"""Forms that keep disk, time and memory of the findings still open in round 3 in line with the input."""

import random

from pyspark.sql import functions as F

from tessera import session
from tessera.functions import text as tx
from tessera.operators import features as fe


def test_ngrams_are_spelled_out_only_if_they_may_stay(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["casa", "Straße", "ação", "the", "of", "livro", "mesa", "porta"]) for _ in range(rnd.randrange(40))) + f" only{chr(97 + i)}word"
             for i in range(20)] + [None, "", "casa"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, cut = {}, session.cut_lineage

    def kept(df, name="t"):
        written[name] = cut(df, name)
        return written[name]
    monkeypatch.setattr(session, "cut_lineage", kept)
    cases = [(d, (3, 0.8, 12)), (d.withColumn("doc_id", F.when(F.col("doc_id") > 4, F.col("doc_id"))), (0.2, 20, 30))]
    for frame, bounds in cases:
        written.clear()
        got = fe.text_ngram_tfidf(frame, "text", ["the"], 3, 3, *bounds).select("doc_id", "term", F.round("weight", 9).alias("w")).collect()
        assert not any("only" in r.term for r in written["tf"].collect())        # seen once or twice: never written
        plain = frame.select("doc_id", tx.processed_tokens("text", ["the"], 3).alias("t")).select("doc_id", fe.ngrams("t", 1, 3).alias("tokens"))
        written.clear()
        want = fe.tfidf(plain, min_df=bounds[0], max_df=bounds[1], max_features=bounds[2]).select("doc_id", "term", F.round("weight", 9).alias("w")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_ngrams_with_keys_in_common_are_counted_by_their_words(spark, monkeypatch):
    """Keys that stand for several n-grams overstate their counts; the rows stay those of the exact counts."""
    words = ["aaaa", "bbbb", "cccc", "dddd", "eeee", "ffff"]
    rows = [(i, " ".join(words[:1 + i % 6] * (1 + i % 3))) for i in range(24)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plain = d.select("doc_id", tx.processed_tokens("text", [], 3).alias("t")).select("doc_id", fe.ngrams("t", 1, 3).alias("tokens"))
    want = fe.tfidf(plain, min_df=2, max_df=0.9, max_features=6).select("doc_id", "term", F.round("weight", 9).alias("w")).collect()

    def few(slim, stop, longer_than, n_max, real=fe._key_counts):
        return real(slim, stop, longer_than, n_max).withColumn("cf", F.col("cf") + 50)      # every count overstated: the first round finds too few
    monkeypatch.setattr(fe, "_key_counts", few)
    got = fe.text_ngram_tfidf(d, "text", [], 3, 3, 2, 0.9, 6).select("doc_id", "term", F.round("weight", 9).alias("w")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def sent(monkeypatch) -> list:
    """Types of the term rows that passes over block matrices send; None: none."""
    from tessera.operators.blockmatrix import BlockMatrix
    seen, real = [], BlockMatrix._pass
    monkeypatch.setattr(BlockMatrix, "_pass", lambda self, v, *a: (seen.append(None if v is None else v.schema["v"].dataType.simpleString()), real(self, v, *a))[1])
    return seen


def test_random_rows_are_drawn_where_they_are_needed(spark, monkeypatch):
    import numpy as np

    from tessera.operators import blockmatrix as bm, kernel
    w = spark.createDataFrame([(i, j, 0.1 * (i + j) + 0.1) for i in range(6) for j in range(i % 3 + 1)], "doc_id long, term_index long, weight double")
    matrix = bm.BlockMatrix.build(w, spark.range(7).withColumnRenamed("id", "doc_id"), 1)
    seen = sent(monkeypatch)
    monkeypatch.setattr(kernel, "COLUMNS_AT_ONCE", 12)          # a few columns at a time
    got = {r.doc_id: r.z for r in kernel.fourier_features(matrix, 50, 0.5, 42).collect()}
    assert seen == [None]
    x = np.zeros((7, 3))
    for r in w.collect():
        x[r.doc_id, r.term_index] = r.weight
    shift = np.random.default_rng(42).uniform(0, 2 * np.pi, 50)
    want = np.sqrt(2.0 / 50) * np.cos(x @ bm.normal_numbers(np.arange(3), 50, 42) + shift)
    assert len(got) == 7 and all(np.allclose(got[i], want[i]) for i in got)


def test_vectors_stored_as_floats_are_sent_as_floats(spark, monkeypatch):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3)], "doc_id long, term string, tf long")
    seen = sent(monkeypatch)
    for value, kind in ((0.1, "float"), (0.1, "double")):
        tv = spark.createDataFrame([("a", 0, [value, 1.0]), ("b", 1, [3.0, -1.0])], f"term string, rank long, embedding array<{kind}>")
        stored = tv.first().embedding[0]
        got = {(r.doc_id, r.dim): r.value for r in fe.pooled_vectors_wide(tf, tv, 2, "sum").collect()}
        assert got == {(1, 0): 2 * stored + 3.0, (1, 1): 1.0, (2, 0): 9.0, (2, 1): -3.0}
    assert seen == ["array<float>", "array<double>"]


def test_entries_are_not_sorted_by_term_for_their_weights(spark):
    tf = spark.createDataFrame([(1, "a", 2, "x"), (1, "b", 1, "x"), (2, "b", 3, "y")], "doc_id long, term string, tf long, lang string")
    docs = spark.range(4)
    model = fe.fit_tfidf(tf, fe.count_documents(docs), 1, 1.0)
    for df in (fe.tfidf_log2(docs, tf=tf), fe.apply_tfidf(tf, model, keep=("lang",), hashed=True)):
        assert "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    plain = fe.apply_tfidf(tf, model, keep=("lang",))
    assert sorted(map(str, plain.collect())) == sorted(map(str, fe.apply_tfidf(tf, model, keep=("lang",), hashed=True).collect()))
