"""Descriptive analysis: class balance, cumulative share, cross-tabs, exact box-plot statistics,
chi-square goodness of fit, top-k hit rates (AGG-10..16, WIN-01, WIN-05, ML-20, ML-21)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_balance(df: DataFrame, class_col: str) -> DataFrame:
    """value_counts: (class, n) (AGG-10)."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))


def cumulative_share(counts: DataFrame, key: str, n_col: str = "n") -> DataFrame:
    """Share and cumulative percentage in descending count order, ties by key (WIN-01, Q17).

    Runs on the aggregated class table (one row per class), so the ordered window sees only as many
    rows as there are classes.
    """
    w = Window.orderBy(F.col(n_col).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    tot = counts.agg(F.sum(n_col).alias("_tot"))       # one row
    return (counts.crossJoin(tot)
            .select(key, n_col, (F.col(n_col) / F.col("_tot")).alias("share"),
                    (F.sum(n_col).over(w) * 100.0 / F.col("_tot")).alias("cum_pct")))


def crosstab_share(df: DataFrame, row_col: str, class_col: str) -> DataFrame:
    """Counts per (row, class) normalised within each class (AGG-15)."""
    c = df.groupBy(row_col, class_col).agg(F.count(F.lit(1)).alias("n"))
    tot = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_tot"))
    return c.join(tot, class_col).withColumn("share", F.col("n") / F.col("_tot")).drop("_tot")


def exact_quantiles(df: DataFrame, group_col: str, value_col: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear-interpolation quantiles per group (``quantile_cont``), from a value histogram.

    The histogram (group, value, count) is a partial aggregate; quantile positions are found by a
    running count over the histogram of each group, so no group's raw values are ever buffered in one
    task (``percentile`` would hold them all).
    """
    h = df.groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(group_col).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    n = h.groupBy(group_col).agg(F.max("_hi").alias("_n"))
    out = n
    for p in probs:
        pos = (F.col("_n") - 1) * F.lit(p)
        name = f"q{int(round(p * 100)):02d}"
        idx = n.select(group_col, F.floor(pos).cast("long").alias("_i0"), F.ceil(pos).cast("long").alias("_i1"),
                       (pos - F.floor(pos)).alias("_fr"))
        # value at 0-based sorted index i: the histogram row with _lo <= i < _hi
        v0 = h.join(idx, group_col).filter((F.col("_lo") <= F.col("_i0")) & (F.col("_i0") < F.col("_hi")))
        v0 = v0.select(group_col, F.col(value_col).alias("_v0"), "_fr")
        v1 = h.join(idx, group_col).filter((F.col("_lo") <= F.col("_i1")) & (F.col("_i1") < F.col("_hi")))
        v1 = v1.select(group_col, F.col(value_col).alias("_v1"))
        q = v0.join(v1, group_col).select(
            group_col, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_fr")).cast("double").alias(name))
        out = out.join(q, group_col)
    return out.drop("_n")


def boxplot_stats(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Q1, median, Q3, 1.5 IQR whisker ends (most extreme data inside the fences) and outlier count (AGG-12)."""
    q = exact_quantiles(df, group_col, value_col)
    iqr = F.col("q75") - F.col("q25")
    lo_f, hi_f = F.col("q25") - 1.5 * iqr, F.col("q75") + 1.5 * iqr
    j = df.select(group_col, value_col).join(q, group_col)
    inside = (F.col(value_col) >= lo_f) & (F.col(value_col) <= hi_f)
    return j.groupBy(group_col, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col(value_col))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value_col))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


def chi_square(observed_expected: DataFrame, obs_col: str = "observed", exp_col: str = "expected") -> DataFrame:
    """Goodness of fit Σ (o − e)² / e with the given expected values, not rescaled (AGG-16); dof = k − 1.

    A class without observations counts as 0 observed. A class without an expected value has no finite term: it
    counts in dof and adds nothing to the statistic.
    """
    o, e = F.coalesce(F.col(obs_col), F.lit(0)), F.nullif(F.col(exp_col), F.lit(0))
    return observed_expected.agg(F.sum((o - e) * (o - e) / e).alias("statistic"),
                                 (F.count(F.lit(1)) - 1).alias("dof"))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution (regularised upper incomplete gamma Q(k/2, x/2)),
    for the one-row result of ``chi_square``."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:                                    # series for P, then Q = 1 - P
        term = s = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= z / ap
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b = z + 1 - a                                     # continued fraction for Q (Lentz)
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def chi2_p_value(statistic, dof) -> Column:
    """Upper tail of the chi-square distribution as a column, for whole ``dof`` >= 1 (null otherwise): one minus the power series of the regularised lower
    incomplete gamma function P(dof/2, statistic/2), so exact to about 1e-15 in absolute terms. The gamma function of a half number is a product."""
    z, k = F.col(statistic).cast("double") / 2, F.col(dof).cast("int")
    a = k / F.lit(2.0)
    logs = lambda first, last, plus: F.when(last >= first, F.aggregate(
        F.sequence(F.greatest(F.lit(0), first), F.greatest(last, first)), F.lit(0.0), lambda s, i: s + F.log(i + F.lit(plus)))).otherwise(0.0)
    half = F.floor(k / 2).cast("int")
    log_gamma = F.when(k % 2 == 0, logs(F.lit(1), half, 0.0)).otherwise(F.lit(0.5 * math.log(math.pi)) + logs(F.lit(0), half, 0.5))
    log_first = a * F.log(z) - z - log_gamma
    first = F.exp(log_first)
    terms = F.sequence(F.lit(1), F.ceil(z + 12 * F.sqrt(z + 1) + 100).cast("int"))
    series = F.aggregate(terms, F.struct(first.alias("t"), first.alias("s")), lambda x, i: F.struct(
        (x.t * z / (a + i)).alias("t"), (x.s + x.t * z / (a + i)).alias("s")), lambda x: x.s)
    p = F.when(z <= 0, 1.0).when(log_first < -700, F.when(z > a, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - series))
    return F.when(k >= 1, p)


def top_k(probs: DataFrame, id_col: str, class_col: str, prob_col: str, k: int) -> DataFrame:
    """Top-k classes per row by probability, ties by class (WIN-05). A row's group holds one entry per
    class, so the window per id is bounded by the number of classes."""
    w = Window.partitionBy(id_col).orderBy(F.col(prob_col).desc(), F.col(class_col))
    return probs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
