"""Case curation: eligibility, set comparison between instances, flags, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys_with_count(bridge: DataFrame, key: str, op: str = "==", n: int = 1) -> DataFrame:
    """Keys whose row count satisfies ``count op n`` (FLT-08: HAVING count = 1 / > 1)."""
    c = bridge.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    cond = {"==": F.col("n_rows") == n, ">": F.col("n_rows") > n, ">=": F.col("n_rows") >= n,
            "<": F.col("n_rows") < n}[op]
    return c.filter(cond)


def set_difference_counts(a: DataFrame, b: DataFrame, key: str, member: str) -> DataFrame:
    """Per key present on both sides: members only in ``a``, only in ``b``, and in both (AGG-13).

    Sets are compared without collecting them: distinct (key, member) pairs are full-outer-joined and
    counted, so a key with millions of members is spread over many tasks.
    """
    da = a.select(key, member).distinct().withColumn("_a", F.lit(1))
    db = b.select(key, member).distinct().withColumn("_b", F.lit(1))
    both_keys = da.select(key).distinct().join(db.select(key).distinct(), key)
    j = da.join(db, [key, member], "full").join(both_keys, key, "left_semi")
    return j.groupBy(key).agg(
        F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).cast("long").alias("only_a"),
        F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).cast("long").alias("only_b"),
        F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).cast("long").alias("in_both"))


def flag_exists(left: DataFrame, right_keys: DataFrame, key: str, flag: str, yes="S", no="N") -> DataFrame:
    """``coalesce((select yes where exists ...), no)`` as a left join to distinct keys (JN-09)."""
    k = right_keys.select(key).distinct().withColumn("_hit", F.lit(yes))
    return left.join(k, key, "left").withColumn(flag, F.coalesce(F.col("_hit"), F.lit(no))).drop("_hit")


def one_hot_members(left: DataFrame, bridge: DataFrame, key: str, member: str, members: dict) -> DataFrame:
    """One 0/1 column per member value: does the key have that member (JN-10). ``members``: name -> value."""
    aggs = [F.max(F.when(F.col(member) == v, 1).otherwise(0)).alias(n) for n, v in members.items()]
    hot = bridge.filter(F.col(member).isin(list(members.values()))).groupBy(key).agg(*aggs)
    out = left.join(hot, key, "left")
    for n in members:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0)).cast("int"))
    return out


def labelled_counts(parts: list[tuple[str, DataFrame]], label_col: str = "label", count_col: str = "n") -> DataFrame:
    """UNION ALL of labelled one-row counts (AGG-06 funnel)."""
    out = None
    for label, df in parts:
        row = df.agg(F.count(F.lit(1)).alias(count_col)).select(F.lit(label).alias(label_col), count_col)
        out = row if out is None else out.unionByName(row)
    return out
