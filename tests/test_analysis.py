import os

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import analysis as an
from tessera.sources import corpus

FIX = os.path.join(os.path.dirname(__file__), "fixtures")

# Golden statistics and p-values of the three drift tests (37 classes each).
GOLDEN = {"chi_a.csv": (29.63399139503627, 0.764171604286429),
          "chi_b.csv": (107.05153616069705, 5.615716058144861e-09),
          "chi_c.csv": (49.08150558237491, 0.07170722181749253)}


def test_chi_square_golden(spark):
    for name, (stat, p) in GOLDEN.items():
        df = corpus.read_semicolon(spark, os.path.join(FIX, name), corpus.CHI_SCHEMA)   # chi_b has a ragged ';'
        assert df.count() == 37
        r = an.chi_square(df, "Observado", "Esperado").first()
        assert abs(r.statistic - stat) < 1e-9
        assert r.dof == 36
        assert abs(an.chi2_sf(r.statistic, r.dof) - p) < 1e-9 * max(1.0, p * 1e3)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = [(g, int(v)) for g in ("a", "b") for v in rng.integers(0, 50, 101 if g == "a" else 40)]
    df = spark.createDataFrame(vals, "g string, v long")
    got = {r.g: (r.q25, r.q50, r.q75) for r in an.exact_quantiles(df, "g", "v").collect()}
    for g in ("a", "b"):
        x = np.array([v for gg, v in vals if gg == g])
        assert np.allclose(got[g], np.percentile(x, [25, 50, 75]))


def test_boxplot_whiskers(spark):
    vals = [("a", v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]]
    r = an.boxplot_stats(spark.createDataFrame(vals, "g string, v long"), "g", "v").first()
    assert (r.q25, r.q50, r.q75) == (3.0, 5.0, 7.0)
    assert r.whisker_lo == 1 and r.whisker_hi == 8 and r.n_outliers == 1


def test_cumulative_share_and_crosstab(spark):
    df = spark.createDataFrame([("x",)] * 6 + [("y",)] * 3 + [("z",)] * 1, "c string")
    cs = {r.c: (r.share, r.cum_pct) for r in an.cumulative_share(an.class_balance(df, "c"), "c").collect()}
    assert cs["x"] == (0.6, 60.0) and abs(cs["y"][1] - 90.0) < 1e-9 and abs(cs["z"][1] - 100.0) < 1e-9
    ct = an.crosstab_share(df.withColumn("r", F.lit("r1")), "r", "c").collect()
    assert all(abs(r.share - 1.0) < 1e-12 for r in ct)


def test_top_k(spark):
    rows = [(1, c, p) for c, p in [("a", .1), ("b", .5), ("c", .4)]]
    t = an.top_k(spark.createDataFrame(rows, "id long, class string, prob double"), "id", "class", "prob", 2)
    assert [r["class"] for r in t.orderBy("rank").collect()] == ["b", "c"]


def test_p_values_of_the_published_tests(spark):
    """Statistics and p-values of three published comparisons of 37 classes, and the textbook tail for other degrees."""
    rows = [(107.0515, 36), (29.6340, 36), (49.0815, 36), (3.841458820694124, 1), (0.0, 4), (5000.0, 3), (2.0, 0)]
    got = [r.p for r in spark.createDataFrame(rows, "x double, k int").select(an.chi2_p_value("x", "k").alias("p")).collect()]
    assert abs(got[0] - 5.6e-9) < 1e-10 and abs(got[1] - 0.764) < 1e-3 and abs(got[2] - 0.0717) < 1e-4
    assert abs(got[3] - 0.05) < 1e-12 and got[4] == 1.0 and got[5] == 0.0 and got[6] is None
    for x in (0.3, 2.0, 11.0, 40.0):
        for k in (1, 2, 3, 8, 25):
            p = spark.createDataFrame([(x, k)], "x double, k int").select(an.chi2_p_value("x", "k")).first()[0]
            assert abs(p - an.chi2_sf(x, k)) < 1e-12
