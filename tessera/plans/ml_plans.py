"""Learning queries (rows-only checks: fitted models have no SQL oracle). Label = ``lang`` (4 uneven
classes), text features from the same normalisation as the text layer (ML-02..12, ML-19, ML-22, FEA-07/10)."""

from __future__ import annotations

import functools
import time
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import (blockmatrix as bm, common, features as fe, kernel, metrics as me, mlp, models as mo, ovr,
                         records as rec, sampling as sa, stages, vectors as ve)
from ..session import cut_lineage, ensure_checkpoint_dir
from .registry import query
from ..sources.tables import table
from .text_plans import MAX_DF, MIN_DF, STOP, doc_term_counts, processed_docs

SEED = 42


def corpus(spark, sf, fit_on: str = "all"):
    """Documents with label, split and fold, plus TF-IDF weights with a dense term index.

    ``fit_on='all'`` fits the vocabulary and idf on train and test together, as the reference does (Q9);
    ``'train'`` fits on the training rows only."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").filter(F.col("lang").isNotNull())
    ids = docs.select("doc_id", "lang")
    labels = common.dense_index(table(spark, sf, "documents").select("lang").distinct(), "lang", "label", prefix_len=1)      # a null class takes a number
    d = sa.split_train_test(ids, "lang", "doc_id", 0.8, SEED).join(labels, "lang")
    d = cut_lineage(d.withColumn("label", F.col("label").cast("double")), "split")
    tf = cut_lineage(fe.text_term_counts(docs, "text", STOP, 3), "tf")
    fit_docs = d if fit_on == "all" else d.filter(F.col("split") == "train")
    tf_fit = tf.filter(F.col("doc_id").isNotNull()) if fit_on == "all" else tf.join(fit_docs.select("doc_id"), "doc_id", "left_semi")
    model = fe.fit_tfidf(tf_fit, fe.count_documents(fit_docs), MIN_DF, MAX_DF)
    model = cut_lineage(common.dense_index(model, "term", "term_index"), "vocabulary")
    w = fe.apply_tfidf(tf, model, model_cols=("term_index",))
    return d, tf, w, model


def vector_table(spark, sf, built=None):
    """(train, test, number of terms) with sparse vectors; ``built``: a ``corpus`` that is there already."""
    d, _, w, model = built or corpus(spark, sf)
    size = model.count()
    vec = cut_lineage(ve.long_to_sparse(w, "doc_id", "term_index", "weight", size), "vectors")
    known = cut_lineage(d.join(vec.select("doc_id"), "doc_id"), "known")      # split and folds on ids alone, vectors joined last
    train = cut_lineage(sa.assign_folds(known.filter(F.col("split") == "train"), "lang", "doc_id", 5, SEED).join(vec, "doc_id"), "train")
    test = cut_lineage(known.filter(F.col("split") == "test").join(vec, "doc_id"), "test")
    return train, test, size


def _summary_with(pred, **labels):
    s = me.summary(pred)
    s = s.select(*[F.round(c, 6).alias(c) for c in s.columns])
    for k, v in reversed(list(labels.items())):
        s = s.select(F.lit(v).alias(k), *s.columns)
    return s


def _native_predictions(model, test):
    out = model.transform(test).select("doc_id", F.col("label").cast("int").alias("y_true"),
                                       F.col("prediction").cast("int").alias("y_pred"))
    return out


def labelled_weights(spark, sf, bm25: bool = False, built=None):
    """((doc_id, label, fold) with fold -1 for test rows, (doc_id, term_index, weight)): TF-IDF, or BM25 with negative weights clipped (Q6). ``built``: a
    ``corpus`` that is there already."""
    d, tf, w, model = built or corpus(spark, sf)
    train = sa.assign_folds(d.filter(F.col("split") == "train"), "lang", "doc_id", 5, SEED).select("doc_id", "label", F.col("fold").cast("int"))
    docs = cut_lineage(train.unionByName(d.filter(F.col("split") == "test").select("doc_id", "label", F.lit(-1).alias("fold"))), "labelled")
    if bm25:
        idf, stats = fe.fit_bm25(tf, fe.count_documents(d), model)
        w = fe.apply_bm25(tf, idf.join(model.select("term", "term_index"), "term"), stats, model_cols=("term_index",))
        w = w.withColumn("weight", F.greatest(F.col("weight"), F.lit(0.0)))
    return docs, cut_lineage(w.select("doc_id", "term_index", "weight"), "weights")


def _test_rows(pred):
    return pred.filter("fold < 0").select("doc_id", F.col("label").alias("y_true"), "y_pred")


# The search grids of bags, sample fractions and model parameters.
NB_GRID = {"bags": [3, 5], "fraction": [0.8, 0.5], "value": [0.0001, 0.001, 0.01, 0.1, 0.5, 1.0]}
SVM_GRID = {"bags": [3, 5], "fraction": [0.8, 0.5], "value": [0.01, 0.1, 1.0, 10.0]}


def _records(spark, algorithm, records, best):
    rows = [(algorithm, "TFIDF", r["bags"], r["fraction"], float(r["alpha" if algorithm == "NB" else "C"]), round(r["mean"], 6), round(r["std"], 6),
             r["candidate"] == best["candidate"]) for r in records]
    return spark.createDataFrame(rows, "algorithm string, feature string, bags int, fraction double, value double, cv_mean double, "
                                       "cv_std double, winner boolean")


@query("nb_search", None, ops=("ML-02", "ML-03", "ML-05", "ML-10", "WIN-07"))
def nb_search(spark, sf):
    """The whole grid for one-vs-rest balanced bags of multinomial NB on five stratified folds, from one training pass a sample fraction."""
    docs, w = labelled_weights(spark, sf)
    best, records, _ = ovr.search(w, docs, "NB", NB_GRID, seed=SEED)
    return _records(spark, "NB", records, best)


@query("svm_search", None, ops=("ML-02", "ML-03", "ML-06", "ML-10"))
def svm_search(spark, sf, n=None):
    """The whole grid (or ``n`` drawn candidates) for one-vs-rest balanced bags of calibrated linear SVMs on five stratified folds."""
    docs, w = labelled_weights(spark, sf)
    best, records, _ = ovr.search(w, docs, "SVM", SVM_GRID, n, seed=SEED, max_iter=10)
    return _records(spark, "SVM", records, best)


@query("svm_calibrated", None, ops=("ML-06", "ML-02", "ML-03", "ML-14"))
def svm_calibrated(spark, sf):
    """One-vs-rest balanced bagging of linear SVMs, each with sigmoids fitted on margins of five held-out inner folds."""
    docs, w = labelled_weights(spark, sf)
    _, _, pred = ovr.search(w, docs, "SVM", {"bags": [3], "fraction": [0.6], "value": [1.0]}, folds=0, seed=SEED, max_iter=15)
    return _summary_with(_test_rows(pred), algorithm="SVM", feature="TFIDF")


@query("balanced_bagging", None, ops=("ML-02", "ML-03", "ML-11"))
def balanced_bagging(spark, sf):
    """Untuned training: one-vs-rest balanced bagging of multinomial NB (3 bags, 60 % of rows)."""
    docs, w = labelled_weights(spark, sf)
    _, _, pred = ovr.search(w, docs, "NB", {"bags": [3], "fraction": [0.6], "value": [1.0]}, folds=0, seed=SEED)
    return _summary_with(_test_rows(pred), algorithm="NB", feature="TFIDF")


@query("plain_bagging", None, ops=("ML-04", "ML-12", "SNK-04", "JN-13"))
def plain_bagging(spark, sf):
    """Plain (unbalanced) bagging of one-vs-rest NB; the table of one probability per class and document is written, read
    back and joined with the documents by id."""
    train, test, _ = vector_table(spark, sf)
    classes = sorted(r.label for r in train.select("label").distinct().collect())
    factory = lambda: NaiveBayes(modelType="multinomial", smoothing=1.0, featuresCol="features", labelCol="label")
    models = mo.each_ovr_bag(train, classes, factory, label_col="label", n_bags=3, fraction=0.6, seed=SEED, balanced=False)
    probs = cut_lineage(mo.predict_ovr(models, test), "probabilities")
    return probs.join(test.select("doc_id", "label"), "doc_id").select(
        "doc_id", F.col("label").cast("int").alias("y_true"), F.col("class").cast("int").alias("class"), F.round("prob", 6).alias("prob"))


@query("svm_baseline", None, ops=("ML-09", "ML-02"))
def svm_baseline(spark, sf, dimensions: int = 500):
    """Untuned one-vs-rest SVMs: linear, and rbf by a linear SVM on random Fourier features (kernel width from the variance of the weights)."""
    d, tf, w, terms = corpus(spark, sf)                     # one for both kernels
    docs, w = labelled_weights(spark, sf, built=(d, tf, w, terms))
    train, test, size = vector_table(spark, sf, built=(d, tf, w, terms))
    model = OneVsRest(classifier=LinearSVC(maxIter=20), featuresCol="features", labelCol="label").fit(train)
    out = _summary_with(_native_predictions(model, test), algorithm="SVC", kernel="linear")
    gamma = kernel.scale_gamma(w, docs.count(), size)
    matrix = bm.BlockMatrix.build(w, docs.select("doc_id"), 1)          # no term rows travel: blocks as large as their entries allow
    z = cut_lineage(kernel.fourier_features(matrix, dimensions, gamma, SEED).select("doc_id", array_to_vector("z").alias("features"))
                    .join(docs, "doc_id"), "fourier")
    model = OneVsRest(classifier=LinearSVC(maxIter=20), featuresCol="features", labelCol="label").fit(z.filter("fold >= 0"))
    return out.unionByName(_summary_with(_native_predictions(model, z.filter("fold < 0")), algorithm="SVC", kernel="rbf"))


# The forest, from the grid of the survey (100 to 300 trees, depth 30 and more, of which MLlib takes 30).
FOREST = {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "0.3", "minWeightFractionPerNode": 0.0}


@query("rf_fit", None, ops=("ML-07",))
def rf_fit(spark, sf):
    """Random forest of 100 trees as deep as MLlib allows (30; feature fraction 0.3; weight fraction per node)."""
    train, test, _ = vector_table(spark, sf)
    rf = RandomForestClassifier(**FOREST, seed=SEED, featuresCol="features", labelCol="label")
    return _summary_with(_native_predictions(rf.fit(train), test), algorithm="RF", feature="TFIDF")


def lsa(spark, sf, k: int = 100):
    """LSA: TF-IDF over the whole vocabulary, truncated SVD to ``k`` components (100, 250, 500 in use) -> (documents X V, V, singular values)."""
    tf, docs = doc_term_counts(spark, sf)
    model = common.dense_index(fe.fit_tfidf(tf, fe.count_documents(docs), MIN_DF, MAX_DF), "term", "term_index")
    w = fe.apply_tfidf(tf, cut_lineage(model, "vocabulary"), model_cols=("term_index",))
    return _decomposed(w, docs, k)


def _decomposed(w, docs, k: int):
    return bm.decompose(cut_lineage(w.select("doc_id", "term_index", "weight"), "weights"), docs.select("doc_id"), k, seed=SEED)


@query("lsa_topics", None, ops=("FEA-07",))
def lsa_topics(spark, sf, k: int = 100):
    x, _, _ = lsa(spark, sf, k)
    return x.select("doc_id", "component", F.round("value", 6).alias("value"))


@query("lsa_topics_250", None, ops=("FEA-07",))
def lsa_topics_250(spark, sf):
    return lsa_topics(spark, sf, 250)


@query("lsi_topics", None, ops=("FEA-10", "FEA-09"))
def lsi_topics(spark, sf, k: int = 200):
    """LSI: truncated SVD of the log2 TF-IDF matrix over the whole vocabulary to ``k`` topics (200, 300, 350 in use)."""
    tf, docs = doc_term_counts(spark, sf)
    w = cut_lineage(fe.tfidf_log2(docs, tf=tf), "weights")
    index = cut_lineage(common.dense_index(w.select("term").distinct(), "term", "term_index"), "terms")
    x, _, _ = _decomposed(w.join(index, "term"), docs, k)
    return x.select("doc_id", "component", F.round("value", 6).alias("value"))


@query("lsa_gram", None, ops=("FEA-07",))
def lsa_gram(spark, sf, k: int = 100):
    """V'V over the fitted components (identity up to rounding): a sign-free check of the SVD."""
    _, v, s = lsa(spark, sf, k)
    g = bm.gram(v, len(s))
    rows = [(i, j, round(float(g[i, j]), 6) + 0.0) for i in range(len(s)) for j in range(len(s))]
    return spark.createDataFrame(rows, "i int, j int, value double")


# The grid of the perceptron search.
MLP_GRID = {"hidden": [(10, 10), (10, 5, 10)], "activation": ["identity", "logistic", "tanh", "relu"], "solver": ["sgd", "adam", "lbfgs"],
            "alpha": [0.001, 0.01, 0.05, 0.1], "learning_rate": ["constant", "adaptive", "invscaling"], "max_iter": [200, 300, 400]}


@query("mlp_fit", None, ops=("ML-08", "FEA-11"))
def mlp_fit(spark, sf, n=None):
    """The whole grid (or ``n`` drawn candidates) of perceptrons, each for its own number of epochs unless it stops early on a held-out fold, on min-max scaled LSA
    features of 100 components; the metrics of every candidate on the test rows."""
    x, _, s = lsa(spark, sf)
    dense = (fe.minmax_scale(x, "component").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("component", "value"))).alias("e"))
             .select("doc_id", F.col("e.value").alias("x")))
    docs, _ = labelled_weights(spark, sf)
    rows = cut_lineage(docs.join(dense, "doc_id").withColumn("held", F.col("fold") == 4), "perceptron-rows")
    grid = mlp.sample_grid(MLP_GRID, n, SEED)
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    cands = mlp.train(rows.filter("fold >= 0"), grid, len(s), classes, epochs=None, batches=2, rate=0.01, seed=SEED)
    found = me.summary_by(mlp.confusions(rows.filter("fold < 0"), cands), ["candidate"])
    about = spark.createDataFrame([(i, ", ".join(f"{k}={v}" for k, v in c.params.items()), round(float(c.best_score), 6)) for i, c in enumerate(cands)],
                                  "candidate int, params string, validation double")
    metrics = [c for c in found.columns if c != "candidate"]
    return found.join(about, "candidate").select(F.lit("MLP").alias("algorithm"), F.lit("LSA").alias("feature"), "params",
                                                 *[F.round(c, 6).alias(c) for c in metrics], "validation")


@query("transfer_best", None, ops=("ML-19", "ML-18", "FEA-06"))
def transfer_best(spark, sf):
    """Bags, sample fraction and smoothing of the best NB on TF-IDF, carried to BM25 weights (negative ones clipped, Q6)."""
    docs, w = labelled_weights(spark, sf)
    best, _, pred = ovr.search(w, docs, "NB", NB_GRID, seed=SEED)
    out = _summary_with(_test_rows(pred), algorithm="NB", feature="TFIDF")
    docs, w = labelled_weights(spark, sf, bm25=True)
    grid = {"bags": [best["bags"]], "fraction": [best["fraction"]], "value": [best["alpha"]]}
    _, _, pred = ovr.search(w, docs, "NB", grid, folds=0, seed=SEED)
    return out.unionByName(_summary_with(_test_rows(pred), algorithm="NB", feature="BM25"))


@query("sample_size_study", None, ops=("ML-22", "AGG-19", "WIN-02"))
def sample_size_study(spark, sf):
    """Learning curve: n documents per class -> split -> NB -> metrics, one row per n, ordered by n."""
    _, _, w, model = corpus(spark, sf)
    size = model.count()
    w = cut_lineage(w.select("doc_id", "term_index", "weight"), "weights")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = common.dense_index(docs.select("lang").distinct(), "lang", "label", prefix_len=1)
    base = docs.join(labels, "lang").withColumn("label", F.col("label").cast("double"))
    base = cut_lineage(base.join(w.select("doc_id").distinct(), "doc_id"), "known")      # samples are drawn on ids, vectors built for them alone
    out = None
    for n in (25, 50, 100):
        s = cut_lineage(sa.split_train_test(sa.stratified_sample(base, "lang", "doc_id", n, SEED), "lang", "doc_id", 0.8, SEED), "sample")
        vec = ve.long_to_sparse(w.join(F.broadcast(s.select("doc_id")), "doc_id", "left_semi"), "doc_id", "term_index", "weight", size)
        s = cut_lineage(s.join(vec, "doc_id"), "sample").coalesce(1)          # at most n rows a class
        m = NaiveBayes(modelType="multinomial", featuresCol="features", labelCol="label").fit(s.filter(F.col("split") == "train"))
        pred = _native_predictions(m, s.filter(F.col("split") == "test"))
        r = _summary_with(pred, algorithm="NB", feature="TFIDF").withColumn("n_per_class", F.lit(n))
        out = r if out is None else out.unionByName(r)
    return out.orderBy("n_per_class")


@query("stored_pipeline", None, ops=("SNK-06", "UDF-02", "FEA-02", "FEA-07", "ML-03", "ML-12"))
def stored_pipeline(spark, sf):
    """TF-IDF, LSA and a one-vs-rest bag fitted as one pipeline, stored, loaded again and applied to the test rows by the loaded one."""
    docs = processed_docs(spark, sf, materialize=True).select("doc_id", "lang", "tokens")
    labels = common.dense_index(docs.select("lang").distinct(), "lang", "label", prefix_len=1)
    d = cut_lineage(sa.split_train_test(docs, "lang", "doc_id", 0.8, SEED).join(labels, "lang"), "split")
    pipeline = Pipeline(stages=[stages.TextWeights(minDF=MIN_DF, maxDF=MAX_DF), stages.Lsa(k=20), stages.BaggedNaiveBayes()])
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    pipeline.fit(d.filter(F.col("split") == "train")).write().save(path)
    out = PipelineModel.load(path).transform(d.filter(F.col("split") == "test"))
    return out.select("doc_id", F.col("label").cast("int").alias("y_true"), F.col("prediction").alias("y_pred"),
                      F.round(F.array_max("probabilities"), 6).alias("prob"), F.size("components").alias("n_components"))


def feature_weights(spark, sf, feature: str):
    """(documents with label and fold, entries) of a feature: TFIDF, BM25, or LSA / LSI with a number of components, min-max scaled to [0, 1]."""
    if feature in ("TFIDF", "BM25"):
        return labelled_weights(spark, sf, bm25=feature == "BM25")
    docs, _ = labelled_weights(spark, sf)
    x = (lsa(spark, sf, int(feature[3:]))[0] if feature.startswith("LSA") else lsi_topics(spark, sf, int(feature[3:])))
    x = fe.minmax_scale(x.select("doc_id", "component", "value"), "component")
    return docs, cut_lineage(x.filter("value <> 0").select("doc_id", F.col("component").alias("term_index"), F.col("value").alias("weight")), "weights")


def plan_records(spark, sf, algorithms: tuple = ("NB",)):
    """Each algorithm searched on TF-IDF, its best parameters carried to BM25, LSA100 and LSI250. ``algorithms`` may hold SVM too, whose search draws
    one candidate."""
    searches = [s for s in (("NB", "TFIDF", NB_GRID, None), ("SVM", "TFIDF", SVM_GRID, 1)) if s[0] in algorithms]
    data = functools.cache(lambda feature: feature_weights(spark, sf, feature))
    return cut_lineage(rec.run_plan(spark, searches, ["BM25", "LSA100", "LSI250"], data, uuid.uuid4().hex, time.strftime("%d/%m/%Y %H:%M:%S"), SEED,
                                    max_iter=10), "records")


@query("model_records", None, ops=("ML-18", "ML-19", "ML-23", "ML-10"))
def model_records(spark, sf):
    """The 22-field record of every model of the plan, with the metrics it wins."""
    records = plan_records(spark, sf)
    won = rec.winners(records).groupBy("nome").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("wins"))
    return records.join(won, "nome", "left").select(*rec.FIELDS, F.coalesce("wins", F.lit("")).alias("wins"))
