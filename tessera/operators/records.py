"""Records of trained models and their winners (ML-18, ML-19, ML-23).

A plan is a table of (algorithm, feature, parameters); ``run_plan`` fits every row of it and keeps one record of 22 fields a model: what it was
trained on and how, the metrics of its test rows, their confusion matrix and per-class report. ``winners`` names the best model by each metric with
the features that belong to it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as me, ovr

# The fields of a record, in order, and the metrics that winners are named for.
METRICS = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_fscore", "micro_precision", "micro_recall", "micro_fscore")
FIELDS = ("nome", "feature_type", "tempo_processamento", "best_params", "best_estimator", "grid_scores", *METRICS, "confusion_matrix", "num_estimators",
          "max_samples", "tamanho_conjunto_treinamento", "id_execucao", "data", "classification_report", "grid_cv_results")
RENAMED = {"macro_f1": "macro_fscore", "weighted_precision": "micro_precision", "weighted_recall": "micro_recall", "weighted_f1": "micro_fscore"}


def cv_text(records: list[dict], parameter: str) -> str:
    """One line a candidate: mean, twice the deviation, parameters."""
    return "\n".join(f"{r['mean']:.3f} (+/-{2 * r['std']:.3f}) for bags={r['bags']}, fraction={r['fraction']}, {parameter}={r[parameter]}" for r in records)


def record(pred: DataFrame, name: str, feature: str, best: dict, records: list[dict], parameter: str, seconds: float, train_rows: int,
           run_id: str, date: str) -> DataFrame:
    """The one-row record of a model from its test rows (y_true, y_pred). Matrix and report are JSON, bounded by the classes."""
    as_json = lambda df, cols: df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*cols)))).alias("j"))
    s = me.summary(pred).withColumnsRenamed(RENAMED).select(*[F.round(m, 6).alias(m) for m in METRICS])
    matrix = as_json(pred.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")), ["y_true", "y_pred", "n"]).withColumnRenamed("j", "confusion_matrix")
    report = me.report(pred).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
    report = as_json(report, report.columns).withColumnRenamed("j", "classification_report")
    params = {k: best[k] for k in ("bags", "fraction", parameter)}
    fixed = {"nome": f"{feature}_{name}", "feature_type": feature, "tempo_processamento": round(seconds, 3), "best_params": json.dumps(params),
             "best_estimator": f"OneVsRest({name}, {', '.join(f'{k}={v}' for k, v in params.items())})",
             "grid_scores": json.dumps([r["mean"] for r in records]), "num_estimators": best["bags"], "max_samples": float(best["fraction"]),
             "tamanho_conjunto_treinamento": train_rows, "id_execucao": run_id, "data": date, "grid_cv_results": cv_text(records, parameter)}
    out = s.crossJoin(matrix).crossJoin(report)             # one-row frames
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()}).select(*FIELDS)


def run_plan(spark: SparkSession, searches: list[tuple], transfers: list[str], data: Callable, run_id: str, date: str, seed=42, max_iter: int = 30) -> DataFrame:
    """Records of a plan.

    ``searches``: (algorithm, feature, grid, number of candidates); the parameters that win each search are carried to every feature in
    ``transfers`` without another search. ``data(feature)`` gives (documents with label and fold, weights) of a feature.
    """
    out = None

    def fit(algorithm, feature, grid, n, folds):
        nonlocal out
        parameter = ovr.NaiveBayes.parameter if algorithm == "NB" else ovr.LinearSVM.parameter
        docs, weights = data(feature)
        began = time.time()
        best, records, pred = ovr.search(weights, docs, algorithm, grid, n, folds=folds, seed=seed, max_iter=max_iter)
        took = time.time() - began
        test = pred.filter("fold < 0").select(F.col("label").alias("y_true"), "y_pred")
        row = record(test, algorithm, feature, best, records, parameter, took, docs.filter("fold >= 0").count(), run_id, date)
        out = row if out is None else out.unionByName(row)
        return {"bags": [best["bags"]], "fraction": [best["fraction"]], "value": [best[parameter]]}

    for algorithm, feature, grid, n in searches:
        carried = fit(algorithm, feature, grid, n, 5)
        for other in transfers:
            fit(algorithm, other, carried, None, 0)
    return out


def winners(records: DataFrame) -> DataFrame:
    """(metric, nome, feature_type, value): the best record by each metric, ties by name."""
    long = records.select("nome", "feature_type", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
                          .alias("m")).select("nome", "feature_type", "m.*")
    best = F.min_by(F.struct("nome", "feature_type", "value"), F.struct((-F.col("value")).alias("v"), "nome"))
    return long.groupBy("metric").agg(best.alias("b")).select("metric", "b.*")
