"""Analysis, sampling and evaluation queries (AGG-10..18, WIN-01..07, ML-01, ML-13..18, ML-20/21, LIM-02/03).

Predictions stand-in (SURVEY 7.1): a deterministic hashed score per (document, class) with 20 classes (the
document sources), biased towards the true source, so every metric is oracle-checkable without a model.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analysis as an, metrics as me, sampling as sa
from ..sources.tables import table
from . import sqlfrag as q
from .registry import query

# The class labels of the stand-in classifier and the models compared.
CLASSES = [f"src{i}" for i in range(20)]
MODELS = ["m1", "m2", "m3"]
SEED = 42
TRUE_BONUS = 0.6


def _class_scores():
    """Column: one (class, score) a class, from doc_id, model and y_true alone."""
    def of(c):
        h = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), c, F.col("model")))
        s = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)
             + F.when(c == F.col("y_true"), TRUE_BONUS).otherwise(0.0))
        return F.struct(c.alias("class"), s.alias("score"))
    return F.transform(F.array(*[F.lit(c) for c in CLASSES]), of)


def score_lists(spark, sf, models=("m1",)):
    """(doc_id, y_true, model, list of (class, prob)). A document's sum is a window over rows of a document and model that carry no class
    list: the scores are worked out again behind it."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("y_true"))
    d = d.select("doc_id", "y_true", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    own = F.aggregate(_class_scores(), F.lit(0.0), lambda a, x: a + x["score"])
    d = d.withColumn("_own", own).withColumn("_all", F.sum("_own").over(Window.partitionBy("doc_id", "model")))
    return d.select("doc_id", "y_true", "model", F.transform(_class_scores(), lambda x: F.struct(
        x["class"].alias("class"), (x["score"] / F.col("_all")).alias("prob"))).alias("probs"))


def scores(spark, sf, models=("m1",)):
    """(doc_id, y_true, model, class, prob): each model's probabilities, normalised to sum 1 per document."""
    return score_lists(spark, sf, models).select("doc_id", "y_true", "model", F.inline("probs"))


def predictions(spark, sf, models=("m1",)):
    """(doc_id, model, y_true, y_pred): argmax class per document, of each row's list and then of a document's rows."""
    best = F.array_max(F.transform("probs", lambda x: F.struct(x["prob"].alias("prob"), x["class"].alias("class"))))
    p = score_lists(spark, sf, models).select("doc_id", "model", "y_true", best.alias("best"))
    return p.groupBy("doc_id", "model", "y_true").agg(F.max("best").alias("best")).select(
        "doc_id", "model", "y_true", F.col("best.class").alias("y_pred"))


def _sql_values(vals):
    return ", ".join(f"('{v}')" for v in vals)


def sql_pred(models=("m1",)):
    return f"""
cls(class) AS (VALUES {_sql_values(CLASSES)}),
mdl(model) AS (VALUES {_sql_values(models)}),
sc AS (SELECT doc_id, source AS y_true, model, class,
       CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || class || '|' || model), 1, 8)) AS BIGINT) / 4294967295.0
       + CASE WHEN class = source THEN {TRUE_BONUS} ELSE 0.0 END AS score FROM documents, mdl, cls),
pr AS (SELECT doc_id, y_true, model, class, score / sum(score) OVER (PARTITION BY doc_id, model) AS prob FROM sc),
pred AS (SELECT doc_id, model, y_true, arg_max(class, prob) AS y_pred FROM pr GROUP BY doc_id, model, y_true)"""


SQL_PER_CLASS = """
t AS (SELECT y_true AS label, count(*) AS support, CAST(count_if(y_true = y_pred) AS BIGINT) AS tp FROM pred GROUP BY y_true),
p AS (SELECT y_pred AS label, count(*) AS predicted FROM pred GROUP BY y_pred),
pc0 AS (SELECT coalesce(t.label, p.label) AS label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
               coalesce(predicted, 0) AS predicted FROM t FULL OUTER JOIN p ON t.label = p.label),
pc1 AS (SELECT *, predicted - tp AS fp, support - tp AS fn,
        CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc1)"""


def _r(c, n=6):
    return F.round(c, n).alias(c if isinstance(c, str) else None)


@query("metrics_summary", f"""
WITH {sql_pred()}, {SQL_PER_CLASS}
SELECT round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM pred), 6) AS accuracy,
       round((SELECT avg(recall) FROM pc WHERE support > 0), 6) AS balanced_accuracy,
       round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       round(CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END, 6) AS weighted_precision,
       round(CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END, 6) AS weighted_recall,
       round(CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END, 6) AS weighted_f1
FROM pc WHERE predicted > 0
""", ops=("ML-13", "ML-14", "ML-12", "ML-23"))
def metrics_summary(spark, sf):
    s = me.summary(predictions(spark, sf))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("class_report", f"""
WITH {sql_pred()}, {SQL_PER_CLASS},
rep AS (
  SELECT label, precision, recall, f1, support FROM pc
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM pc
  UNION ALL SELECT 'accuracy', avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END),
                   avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), count(*) FROM pred)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep
""", ops=("ML-15",))
def class_report(spark, sf):
    r = me.report(predictions(spark, sf))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long"))


@query("binary_confusions", f"""
WITH {sql_pred()}, {SQL_PER_CLASS}
SELECT label, (SELECT count(*) FROM pred) - tp - fp - fn AS tn, fp, fn, tp FROM pc
""", ops=("ML-16",))
def binary_confusions(spark, sf):
    return me.binary_confusions(predictions(spark, sf))


@query("confusion_normalized", f"""
WITH {sql_pred()}
, l AS (SELECT y_true AS label FROM pred UNION SELECT y_pred FROM pred),
c AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY y_true, y_pred)
SELECT a.label AS y_true, b.label AS y_pred, coalesce(n, 0) AS n,
       coalesce(round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY a.label), 0), 6), 0.0) AS share
FROM l a CROSS JOIN l b LEFT JOIN c ON c.y_true = a.label AND c.y_pred = b.label
""", ops=("ML-17",))
def confusion_normalized(spark, sf):
    c = me.confusion_normalized(predictions(spark, sf))
    return c.select("y_true", "y_pred", "n", F.round("share", 6).alias("share"))


@query("winner", f"""
WITH {sql_pred(tuple(MODELS))},
acc AS (SELECT model, 'accuracy' AS metric, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS value FROM pred GROUP BY model),
rk AS (SELECT metric, model, value, row_number() OVER (PARTITION BY metric ORDER BY round(value, 9) DESC, model) AS r FROM acc)
SELECT metric, model AS best_model, round(value, 6) AS best_value FROM rk WHERE r = 1
""", ops=("LIM-03", "ML-18", "SRT-01"))
def winner(spark, sf):
    acc = predictions(spark, sf, tuple(MODELS)).groupBy("model").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("value"))
    acc = acc.withColumn("metric", F.lit("accuracy"))
    best = acc.groupBy("metric").agg(F.min(F.struct((-F.round("value", 9)).alias("k"), F.col("model"),
                                                    F.col("value"))).alias("b"))
    return best.select("metric", F.col("b.model").alias("best_model"), F.round("b.value", 6).alias("best_value"))


@query("topk_classes", f"""
WITH {sql_pred()}
SELECT doc_id, class, round(prob, 6) AS prob, CAST(rank AS INTEGER) AS rank FROM
  (SELECT doc_id, class, prob, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, class) AS rank FROM pr)
WHERE rank <= 5
""", ops=("WIN-05", "ML-12"))
def topk_classes(spark, sf):
    t = an.top_k(scores(spark, sf), "doc_id", "class", "prob", 5)
    return t.select("doc_id", "class", F.round("prob", 6).alias("prob"), F.col("rank").cast("int"))


# The in-scope subject list for the restricted top-k recall.
SCOPE = [f"src{i}" for i in range(10)]


def case_subjects(spark, sf):
    """Stand-in 'all subjects of a case': the sources of every copy of the same text (case = md5(text))."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("case_id"), "source")
    subj = d.select("case_id", F.col("source").alias("subject")).distinct()
    return d.select("doc_id", "case_id"), subj


SQL_SUBJ = """
dc AS (SELECT doc_id, md5(text) AS case_id FROM documents),
subj AS (SELECT DISTINCT md5(text) AS case_id, source AS subject FROM documents),
ds AS (SELECT doc_id, subject FROM dc JOIN subj USING (case_id))"""


@query("topk_recall", f"""
WITH {sql_pred()}, {SQL_SUBJ},
tk AS (SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, class) AS rank FROM pr),
j AS (SELECT ds.doc_id, ds.subject, tk.rank FROM ds LEFT JOIN tk ON tk.doc_id = ds.doc_id AND tk.class = ds.subject AND tk.rank <= 10),
g AS (SELECT doc_id, count(*) AS n_subjects, CAST(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS hits5,
             CAST(sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS hits10,
             CAST(sum(CASE WHEN subject IN {q.in_list(SCOPE)} THEN 1 ELSE 0 END) AS BIGINT) AS n_scope,
             CAST(sum(CASE WHEN subject IN {q.in_list(SCOPE)} AND rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS scope_hits5,
             CAST(sum(CASE WHEN subject IN {q.in_list(SCOPE)} AND rank <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS scope_hits10
      FROM j GROUP BY doc_id)
SELECT doc_id, n_subjects, hits5, hits10, round(hits5 / n_subjects, 6) AS recall5, round(hits10 / n_subjects, 6) AS recall10,
       n_scope, round(CASE WHEN n_scope > 0 THEN scope_hits5 / n_scope ELSE 0.0 END, 6) AS scope_recall5,
       round(CASE WHEN n_scope > 0 THEN scope_hits10 / n_scope ELSE 0.0 END, 6) AS scope_recall10 FROM g
""", ops=("ML-21", "WIN-05", "SET-04", "ARR-01", "NUM-02", "JN-14"))
def topk_recall(spark, sf):
    """Top-5/top-10 recall over all subjects of the case and over in-scope subjects (0 when none, Q14).
    Set intersections are counted through joins, never by collecting a case's subjects."""
    tk = an.top_k(scores(spark, sf), "doc_id", "class", "prob", 10).select("doc_id", F.col("class").alias("subject"), "rank")
    dc, subj = case_subjects(spark, sf)
    ds = dc.join(subj, "case_id").select("doc_id", "subject")
    j = ds.join(tk, ["doc_id", "subject"], "left")
    sc = F.col("subject").isin(SCOPE)
    g = j.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_subjects"), F.count_if(F.col("rank") <= 5).alias("hits5"),
        F.count_if(F.col("rank") <= 10).alias("hits10"), F.count_if(sc).alias("n_scope"),
        F.count_if(sc & (F.col("rank") <= 5)).alias("_s5"), F.count_if(sc & (F.col("rank") <= 10)).alias("_s10"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return g.select("doc_id", "n_subjects", "hits5", "hits10", ratio("hits5", "n_subjects").alias("recall5"),
                    ratio("hits10", "n_subjects").alias("recall10"), "n_scope",
                    ratio("_s5", "n_scope").alias("scope_recall5"), ratio("_s10", "n_scope").alias("scope_recall10"))


@query("any_hit", f"""
WITH {sql_pred()}, {SQL_SUBJ}
SELECT pred.doc_id, CAST(y_pred = y_true AS INTEGER) AS main_hit,
       CAST(EXISTS (SELECT 1 FROM ds WHERE ds.doc_id = pred.doc_id AND ds.subject = pred.y_pred) AS INTEGER) AS any_hit
FROM pred
""", ops=("ML-20", "NUM-03", "JN-14"))
def any_hit(spark, sf):
    p = predictions(spark, sf)
    dc, subj = case_subjects(spark, sf)
    ds = dc.join(subj, "case_id").select("doc_id", F.col("subject").alias("y_pred"), F.lit(1).alias("_hit"))
    j = p.join(ds, ["doc_id", "y_pred"], "left")
    return j.select("doc_id", (F.col("y_pred") == F.col("y_true")).cast("int").alias("main_hit"),
                    F.coalesce("_hit", F.lit(0)).cast("int").alias("any_hit"))


# -- distributions -------------------------------------------------------------------------------------------
@query("class_balance", "SELECT lang, count(*) AS n FROM documents GROUP BY lang", ops=("AGG-10", "AGG-18"))
def class_balance(spark, sf):
    return an.class_balance(table(spark, sf, "documents"), "lang")


@query("cumulative_share", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n, round(n / sum(n) OVER (), 6) AS share,
       round(sum(n) OVER (ORDER BY n DESC, lang ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0 / sum(n) OVER (), 6) AS cum_pct
FROM c
""", ops=("WIN-01", "NUM-02", "SRT-01"))
def cumulative_share(spark, sf):
    c = an.cumulative_share(an.class_balance(table(spark, sf, "documents"), "lang"), "lang")
    return c.select("lang", "n", F.round("share", 6).alias("share"), F.round("cum_pct", 6).alias("cum_pct"))


@query("crosstab_share", """
SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share
FROM documents GROUP BY source, lang
""", ops=("AGG-15",))
def crosstab_share(spark, sf):
    c = an.crosstab_share(table(spark, sf, "documents"), "source", "lang")
    return c.select("source", "lang", "n", F.round("share", 6).alias("share"))


WC_SQL = f"(SELECT lang, {q.word_count('text')} AS wc FROM documents)"


@query("boxplot_words", f"""
WITH w AS {WC_SQL},
qs AS (SELECT lang, quantile_cont(wc, 0.25) AS q25, quantile_cont(wc, 0.5) AS q50, quantile_cont(wc, 0.75) AS q75
       FROM w GROUP BY lang)
SELECT lang, q25, q50, q75,
       min(CASE WHEN wc >= q25 - 1.5 * (q75 - q25) AND wc <= q75 + 1.5 * (q75 - q25) THEN wc END) AS whisker_lo,
       max(CASE WHEN wc >= q25 - 1.5 * (q75 - q25) AND wc <= q75 + 1.5 * (q75 - q25) THEN wc END) AS whisker_hi,
       CAST(count_if(NOT (wc >= q25 - 1.5 * (q75 - q25) AND wc <= q75 + 1.5 * (q75 - q25))) AS BIGINT) AS n_outliers, count(*) AS n
FROM w JOIN qs USING (lang) GROUP BY lang, q25, q50, q75
""", ops=("AGG-12", "STR-09"))
def boxplot_words(spark, sf):
    w = table(spark, sf, "documents").select("lang", tx.word_count("text").alias("wc"))
    return an.boxplot_stats(w, "lang", "wc")


@query("mean_words_by_class", f"""
WITH w AS {WC_SQL}
SELECT lang, round(avg(wc), 6) AS mean_words, count(*) AS n FROM w GROUP BY lang
UNION ALL SELECT '*', round(avg(wc), 6), count(*) FROM w
""", ops=("AGG-11",))
def mean_words_by_class(spark, sf):
    w = table(spark, sf, "documents").select("lang", tx.word_count("text").alias("wc"))
    per = w.groupBy("lang").agg(F.round(F.avg("wc"), 6).alias("mean_words"), F.count(F.lit(1)).alias("n"))
    allr = w.agg(F.lit("*").alias("lang"), F.round(F.avg("wc"), 6).alias("mean_words"), F.count(F.lit(1)).alias("n"))
    return per.unionByName(allr)


@query("chi_square_drift", """
WITH d AS (SELECT lang, CAST(substr(source, 4) AS INTEGER) >= 10 AS late FROM documents),
e AS (SELECT lang, count(*) AS expected FROM d WHERE NOT late GROUP BY lang),
o AS (SELECT lang, count(*) AS observed FROM d WHERE late GROUP BY lang)
SELECT round(sum((coalesce(observed, 0) - expected) * (coalesce(observed, 0) - expected) / expected), 6) AS statistic,
       count(*) - 1 AS dof
FROM o FULL JOIN e USING (lang)
""", ops=("AGG-16", "NUM-01"))
def chi_square_drift(spark, sf):
    """Class distribution of the later half of the sources against the earlier half, not rescaled."""
    d = table(spark, sf, "documents").select("lang", (F.substring("source", 4, 10).try_cast("int") >= 10).alias("late"))
    e = d.filter(~F.col("late")).groupBy("lang").agg(F.count(F.lit(1)).alias("expected"))
    o = d.filter(F.col("late")).groupBy("lang").agg(F.count(F.lit(1)).alias("observed"))
    r = an.chi_square(o.join(e, "lang", "full"))
    return r.select(F.round("statistic", 6).alias("statistic"), F.col("dof").cast("long"))


@query("chi_square_test", """
WITH d AS (SELECT lang, CAST(substr(source, 4) AS INTEGER) >= 10 AS late FROM documents),
e AS (SELECT lang, count(*) AS expected FROM d WHERE NOT late GROUP BY lang),
o AS (SELECT lang, count(*) AS observed FROM d WHERE late GROUP BY lang),
j AS (SELECT coalesce(observed, 0) AS obs, expected FROM o FULL JOIN e USING (lang)),
s AS (SELECT coalesce(sum((obs - expected) * (obs - expected) / expected) FILTER (WHERE expected > 0), 0) AS x2, count(*) - 1 AS dof,
             count(*) FILTER (WHERE coalesce(expected, 0) = 0) AS n_without_expected FROM j)
SELECT round(x2, 6) AS statistic, dof, n_without_expected,
       CASE WHEN x2 <= 0 THEN 1 ELSE round(greatest(0, 1 - list_sum(list_transform(range(0, CAST(x2 AS BIGINT) + 400),
            lambda n: exp((dof / 2 + n) * ln(x2 / 2) - x2 / 2 - lgamma(dof / 2 + n + 1))))), 9) END AS p_value
FROM s
""", ops=("AGG-16", "NUM-01"))
def chi_square_test(spark, sf):
    """The drift test with its p-value and the number of classes that no expected value is known for."""
    d = table(spark, sf, "documents").select("lang", (F.substring("source", 4, 10).try_cast("int") >= 10).alias("late"))
    both = d.groupBy("lang").agg(F.count_if(~F.col("late")).alias("expected"), F.count_if("late").alias("observed"))
    missing = both.agg(F.count_if(F.col("expected") == 0).alias("n_without_expected"))
    r = an.chi_square(both).crossJoin(missing).withColumn("x2", F.coalesce("statistic", F.lit(0.0)))
    return r.select(F.round("x2", 6).alias("statistic"), F.col("dof").cast("long"), "n_without_expected",
                    F.round(an.chi2_p_value("x2", "dof"), 9).alias("p_value"))


@query("distinct_sources", "SELECT DISTINCT source FROM documents", ops=("AGG-18", "SET-02"))
def distinct_sources(spark, sf):
    return table(spark, sf, "documents").select("source").distinct()


@query("rank_slice", """
SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 150
""", ops=("LIM-02", "SRT-01"))
def rank_slice(spark, sf):
    """Rows 150-159 of the length ranking (the slice is the feature; planned as a per-partition top-160)."""
    return (table(spark, sf, "documents").select("doc_id", "n_chars")
            .orderBy(F.col("n_chars").desc(), "doc_id").offset(150).limit(10))


# -- sampling (WIN-02..04, WIN-07, ML-01) -----------------------------------------------------------------
SQL_RANK = f"""r AS (SELECT doc_id, source, lang,
   row_number() OVER (PARTITION BY {{part}} ORDER BY {q.md5_key('doc_id', SEED)}, doc_id) AS rk,
   count(*) OVER (PARTITION BY {{part}}) AS cn FROM documents)"""


@query("stratified_sample", f"""
WITH {SQL_RANK.format(part='source, lang')}
SELECT doc_id, source, lang FROM r WHERE rk <= 5
""", ops=("WIN-02", "SRC-02"))
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return sa.stratified_sample(d, ["source", "lang"], "doc_id", 5, SEED).select("doc_id", "source", "lang")


@query("oversample_min", f"""
WITH {SQL_RANK.format(part='lang')},
t AS (SELECT *, greatest(least(cn, 150), 120) AS target FROM r),
x AS (SELECT doc_id, lang, rk, cn, target, unnest(range(1, CAST(ceil(target / cn) AS BIGINT) + 1)) AS copy FROM t)
SELECT doc_id, lang, CAST(copy AS INTEGER) AS copy FROM x WHERE (copy - 1) * cn + rk <= target
""", ops=("WIN-03",))
def oversample_min(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.oversample_min(d, "lang", "doc_id", 150, 120, SEED).select("doc_id", "lang", "copy")


@query("oversample_max", f"""
WITH {SQL_RANK.format(part='lang')},
t AS (SELECT *, max(cn) OVER () AS target FROM r),
x AS (SELECT doc_id, lang, rk, cn, target, unnest(range(1, CAST(ceil(target / cn) AS BIGINT) + 1)) AS copy FROM t)
SELECT doc_id, lang, CAST(copy AS INTEGER) AS copy FROM x WHERE (copy - 1) * cn + rk <= target
""", ops=("WIN-04",))
def oversample_max(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.oversample_to_largest(d, "lang", "doc_id", SEED).select("doc_id", "lang", "copy")


@query("split_80_20", f"""
WITH {SQL_RANK.format(part='lang')}
SELECT doc_id, lang, CASE WHEN rk <= floor(cn * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM r
""", ops=("ML-01",))
def split_80_20(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.split_train_test(d, "lang", "doc_id", 0.8, SEED).select("doc_id", "lang", "split")


@query("folds", f"""
WITH {SQL_RANK.format(part='lang')}
SELECT doc_id, lang, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r
""", ops=("WIN-07",))
def folds(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sa.assign_folds(d, "lang", "doc_id", 5, SEED).select("doc_id", "lang", "fold")


@query("head_per_class", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
WHERE r <= 100
""", ops=("WIN-06",))
def head_per_class(spark, sf):
    """First n rows per class in key order (the per-class cap is the operator), via a two-stage top-k."""
    from ..operators.common import top_k_per_group
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return top_k_per_group(d, "lang", [F.col("doc_id")], 100, salt_col="doc_id").select("doc_id", "lang")
