import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.lm_scoring import crc_remainder
from tessera.llm.toxicity import fit, logistic, score


def labelled(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{int(rnd.paretovariate(0.5)) % 400}" for _ in range(rnd.randrange(5, 200))]
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randrange(3, 7)):
                w.insert(rnd.randrange(len(w)), rnd.choice(("vile", "Nasty,", "foul")))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    held = crc_remainder("doc_id", 5) == 0
    model = fit(docs, labels, held)
    out = score(docs, model).withColumn("held", held).join(labels, "doc_id").filter("held").collect()
    assert len(out) > 60
    assert np.mean([(r.toxicity >= 0.5) == (r.toxic == 1) for r in out]) > 0.93
    assert all(0 <= r.toxicity <= 1 for r in out)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark, 200)
    held = crc_remainder("doc_id", 5) == 0
    a = fit(docs, labels, held)
    b = fit(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))), held)
    assert np.array_equal(a.pair, b.pair) and np.allclose(a.weights, b.weights)


def test_differences_are_finite(spark):
    docs, labels = labelled(spark, 60)
    model = fit(docs, labels, F.lit(False), rare=0)
    assert len(model.words) and len(model.pairs) and np.isfinite(model.pair).all() and np.isfinite(model.word).all()


def test_awkward_tables(spark, docs, no_docs):
    few = spark.createDataFrame([(1, 1), (4, 0), (7, None), (10, 3), (None, 1)], "doc_id long, toxic int")
    for labels in (few, few.limit(0), few.filter("toxic = 1")):
        model = fit(docs, labels, F.lit(False))
        out = score(docs, model)
        assert out.columns == docs.columns + ["toxicity"]
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r.toxicity <= 1 for r in got)
        assert score(no_docs, model).count() == 0


def test_logistic():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 2))
    y = rnd.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    assert np.allclose(logistic(x, y.astype(float), np.ones(4000)), [2, -1, 0.5], atol=0.2)
