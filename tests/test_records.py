import json

from tessera.operators import records as rec


def test_plan_carries_the_best_parameters_and_records_22_fields(spark):
    rows, weights = [], []
    for i in range(90):
        rows.append((i, float(i % 3), -1 if i % 6 == 5 else i % 5))
        weights += [(i, (i % 3) * 2 + i % 2, 1.0), (i, 6 + i % 4, 0.5)] + ([(i, (i * 7) % 6, 0.8)] if i % 4 == 0 else [])
    docs = spark.createDataFrame(rows, "doc_id long, label double, fold int")
    w = spark.createDataFrame(weights, "doc_id long, term_index long, weight double")
    asked = []

    def data(feature):
        asked.append(feature)
        return docs, w
    grid = {"bags": [1, 2], "fraction": [0.9], "value": [0.1, 1.0]}
    got = rec.run_plan(spark, [("NB", "TFIDF", grid, None)], ["BM25", "LSA100"], data, "run", "01/02/2020 03:04:05")
    assert got.columns == list(rec.FIELDS) and len(rec.FIELDS) == 22 and asked == ["TFIDF", "BM25", "LSA100"]
    first, *carried = got.collect()
    assert len(json.loads(first.grid_scores)) == 4 and first.grid_cv_results.count("\n") == 3 and first.tamanho_conjunto_treinamento == 75
    assert all(r.best_params == first.best_params and r.grid_cv_results == "" for r in carried)
    cells = json.loads(first.confusion_matrix)
    assert sum(c["n"] for c in cells) == 15
    assert abs(first.accuracy - sum(c["n"] for c in cells if c["y_true"] == c["y_pred"]) / 15) < 1e-6
    best = {r.metric: r for r in rec.winners(got).collect()}
    assert set(best) == set(rec.METRICS) and all(best[m].value == max(r[m] for r in (first, *carried)) for m in rec.METRICS)
    assert best["accuracy"].nome == min(r.nome for r in (first, *carried) if r.accuracy == best["accuracy"].value)
