"""Bagging of any Spark ML classifier, one fit a class and bag, and prediction tables (ML-04, ML-12). Searches are in ``ovr``.

Fits are Spark jobs over distributed feature tables; the driver only orchestrates (a small thread pool
submits independent fits, as ``CrossValidator(parallelism=...)`` does).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import hash_key


def balanced_weights(df: DataFrame, label_col: str, out_col: str = "weight") -> DataFrame:
    """n / (k * n_class) per row (class_weight='balanced')."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))     # one row
    return (df.join(c, label_col).crossJoin(tot)
            .withColumn(out_col, F.col("_n") / (F.col("_k") * F.col("_nc"))).drop("_nc", "_n", "_k"))


def positive_probability(model_out: DataFrame, kind: str) -> F.Column:
    """P(class) from a binary model's output: the probability column, or the sigmoid of the SVM margin."""
    if kind == "margin":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
    return vector_to_array("probability")[1]


def bag_members(train: DataFrame, id_col: str, label_col: str, positive, bag: int, fraction: float, seed,
                balanced: bool = True) -> DataFrame:
    """One bag for class ``positive``: a ``fraction`` of the rows without replacement (hash threshold); if ``balanced``,
    then the majority side undersampled to the minority side's size (hash order)."""
    h = hash_key(id_col, f"{seed}:{bag}")
    b = train.withColumn("_h", h).withColumn("_u", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") / 4294967296.0)
    b = b.filter(F.col("_u") < fraction).withColumn("label", (F.col(label_col) == F.lit(positive)).cast("double"))
    if not balanced:
        return b.drop("_h", "_u")
    sizes = b.groupBy("label").agg(F.count(F.lit(1)).alias("_sz"))
    m = sizes.agg(F.min("_sz").alias("_min"))      # one row
    from .common import class_rank
    r = class_rank(b.drop("_h", "_u"), "label", id_col, f"{seed}:{bag}:u")
    return r.crossJoin(m).filter(F.col("_rank") <= F.col("_min")).drop("_rank", "_class_n", "_h", "_min")


def fit_ovr_bagging(train: DataFrame, classes, base_factory, id_col: str = "doc_id", label_col: str = "label_str",
                    n_bags: int = 3, fraction: float = 0.6, seed=42, parallelism: int = 4, balanced: bool = True):
    """Fit one binary base model per (class, bag); returns [(class, bag, model)] (ML-02, ML-03, ML-11)."""
    jobs = [(c, b) for c in classes for b in range(n_bags)]

    def fit(job):
        c, b = job
        return c, b, base_factory().fit(bag_members(train, id_col, label_col, c, b, fraction, seed, balanced))
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(fit, jobs))


def each_ovr_bag(train: DataFrame, classes, base_factory, id_col: str = "doc_id", label_col: str = "label_str", n_bags: int = 3, fraction: float = 0.6,
                 seed=42, balanced: bool = True):
    """The models of ``fit_ovr_bagging`` one after the other, for readers that keep none: a model is as large as the vocabulary, and all of them
    do not fit the driver."""
    for c in classes:
        for b in range(n_bags):
            yield c, b, base_factory().fit(bag_members(train, id_col, label_col, c, b, fraction, seed, balanced))


def predict_ovr(models, test: DataFrame, id_col: str = "doc_id", kind: str = "probability") -> DataFrame:
    """(id, class, prob): mean positive probability over bags, normalised to sum 1 over classes (ML-12). Of models that come one by one (no list) the
    predictions are written before the next is fitted."""
    parts, keep = None, isinstance(models, (list, tuple))
    for c, b, m in models:
        p = m.transform(test).select(id_col, F.lit(c).alias("class"), positive_probability(None, kind).alias("_p"))
        if not keep:
            p = cut_lineage(p, "bag")
        del m
        parts = p if parts is None else parts.unionByName(p)
    avg = parts.groupBy(id_col, "class").agg(F.avg("_p").alias("_p"))
    tot = avg.groupBy(id_col).agg(F.sum("_p").alias("_t"))
    return avg.join(tot, id_col).select(id_col, "class", F.when(F.col("_t") > 0, F.col("_p") / F.col("_t"))
                                        .otherwise(F.lit(0.0)).alias("prob"))


def argmax(probs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return probs.groupBy(id_col).agg(F.max_by("class", F.struct("prob", F.col("class"))).alias("y_pred"))
