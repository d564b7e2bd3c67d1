"""Deterministic sampling, splitting and folds (WIN-02..04, WIN-07, ML-01).

Every operator orders rows inside a class by ``md5(id || seed)`` then id, through ``common.class_rank``,
which salts the class by hash prefix; no class is ever sorted inside one task, and the result does not
depend on partitioning or input order (``rand()``/``sampleBy`` would).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_rank

COPY_BLOCK = 10_000


def stratified_sample(df: DataFrame, class_cols, id_col: str, n: int, seed=42) -> DataFrame:
    """At most ``n`` rows per class (all rows of smaller classes), without replacement."""
    r = class_rank(df, class_cols, id_col, seed, max_rank=n)
    return r.filter(F.col("_rank") <= n).drop("_rank", "_class_n", "_h")


def _replicate(ranked: DataFrame, target) -> DataFrame:
    """Replicate each class to ``target`` rows: copies = ceil(target / size); the row order is
    (copy, hash, id), i.e. every row once before any row twice."""
    copies = F.greatest(F.ceil(target / F.col("_class_n")).cast("long"), F.lit(1))
    block = F.lit(COPY_BLOCK)
    # copies are dealt out in blocks, spread over the cluster, and each block is then unfolded: no row holds an array of
    # all its copies and a class of one row is not one task's work
    out = ranked.withColumn("_copies", copies).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / block))))
    out = out.repartition(F.col("_block"), F.col("_h")).withColumn(
        "copy", F.explode(F.sequence(F.col("_block") * block + 1, F.least((F.col("_block") + 1) * block, F.col("_copies")))))
    out = out.drop("_copies", "_block")
    out = out.withColumn("_final", (F.col("copy") - 1) * F.col("_class_n") + F.col("_rank"))
    return out.filter(F.col("_final") <= target).drop("_rank", "_class_n", "_h", "_final")


def oversample_min(df: DataFrame, class_cols, id_col: str, n: int, min_accepted: int, seed=42) -> DataFrame:
    """``min(size, n)`` rows per class, but at least ``min_accepted``: classes at or below ``min_accepted``
    are resampled with replacement (by whole-class replication) up to it (WIN-03)."""
    r = class_rank(df, class_cols, id_col, seed)
    target = F.greatest(F.least(F.col("_class_n"), F.lit(n)), F.lit(min_accepted))
    return _replicate(r, target)


def oversample_to_largest(df: DataFrame, class_cols, id_col: str, seed=42) -> DataFrame:
    """Every class replicated up to the size of the largest class (WIN-04)."""
    r = class_rank(df, class_cols, id_col, seed)
    mx = r.select("_class_n").agg(F.max("_class_n").alias("_mx"))     # one row
    return _replicate(r.crossJoin(mx), F.col("_mx")).drop("_mx")


def split_train_test(df: DataFrame, class_cols, id_col: str, train_fraction: float = 0.8, seed=42) -> DataFrame:
    """Stratified split: the first ``round(fraction * size)`` rows of each class (half up) are 'train'."""
    r = class_rank(df, class_cols, id_col, seed)
    n_train = F.floor(F.col("_class_n") * F.lit(train_fraction) + F.lit(0.5))
    return (r.withColumn("split", F.when(F.col("_rank") <= n_train, "train").otherwise("test"))
            .drop("_rank", "_class_n", "_h"))


def assign_folds(df: DataFrame, class_cols, id_col: str, k: int = 5, seed=42) -> DataFrame:
    """Stratified folds: fold = (rank - 1) mod k inside each class, so class sizes per fold differ by <= 1."""
    r = class_rank(df, class_cols, id_col, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_class_n", "_h")
