"""Rows-only learning queries on the smallest scale: they run, and their outputs have the right shape."""

import __spark_entry__ as entry

from .conftest import SF_SMALL

QS = entry.queries()


def test_balanced_bagging_metrics_in_range(spark):
    r = QS["balanced_bagging"](spark, SF_SMALL).first()
    assert 0.0 <= r.accuracy <= 1.0 and 0.0 <= r.weighted_precision <= 1.0


def test_lsa_components_orthonormal(spark):
    g = QS["lsa_gram"](spark, SF_SMALL).collect()
    for r in g:
        assert abs(r.value - (1.0 if r.i == r.j else 0.0)) < 1e-6


def test_search_candidates(spark):
    rows = QS["nb_search"](spark, SF_SMALL).collect()
    assert len(rows) == 24 and all(0.0 <= r.cv_mean <= 1.0 for r in rows) and sum(r.winner for r in rows) == 1
    assert next(r for r in rows if r.winner).cv_mean == max(r.cv_mean for r in rows)


def test_calibrated_svm_classifies(spark):
    assert QS["svm_calibrated"](spark, SF_SMALL).first().accuracy > 0.8
