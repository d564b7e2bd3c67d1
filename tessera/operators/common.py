"""Scale-safe building blocks shared by the operators.

Windows partitioned only by a class or group key put a whole class into one task; with one class
holding a third of the rows that task would sort a third of the data. The helpers here split such
groups by a hash prefix ("salt"), work per (group, salt) and combine with small count tables, and give
exactly the same answer as the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(id_col, seed) -> Column:
    """Deterministic, partition-independent ordering key: md5 of ``id || seed`` (hex text).

    DuckDB's ``md5`` gives the same text, so the oracle reproduces every sample exactly.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(str(seed))))


def class_rank(df: DataFrame, class_cols, id_col: str, seed, salt_hex: int = 4,
               rank_col: str = "_rank", size_col: str = "_class_n", order_col: str = "_h",
               max_rank: int | None = None) -> DataFrame:
    """Add the 1-based rank of each row inside its class, ordered by ``hash_key(id, seed)`` then id,
    and the class size.

    Equal to ``row_number() over (partition by class order by h, id)``, computed without putting a class
    into one task: rows are split by the first ``salt_hex`` hex digits of the hash (16**salt_hex buckets
    per class); a (class, bucket) count table gives each bucket its offset and the row number is taken
    inside the bucket only. With ``max_rank`` buckets that start beyond it are dropped before the window.
    """
    class_cols = [class_cols] if isinstance(class_cols, str) else list(class_cols)
    d = df.withColumn(order_col, hash_key(id_col, seed)).withColumn("_b", F.substring(order_col, 1, salt_hex))
    counts = d.groupBy(*class_cols, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wcum = Window.partitionBy(*class_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*class_cols)
    # counts has at most 16**salt_hex rows per class, so this window is small per class.
    offsets = counts.select(*class_cols, "_b",
                            F.coalesce(F.sum("_bn").over(wcum), F.lit(0)).alias("_off"),
                            F.sum("_bn").over(wall).alias(size_col))
    if max_rank is not None:
        offsets = offsets.filter(F.col("_off") < max_rank)
    joined = d.join(offsets, on=[*class_cols, "_b"], how="inner")
    w = Window.partitionBy(*class_cols, "_b").orderBy(order_col, id_col)
    out = joined.withColumn(rank_col, (F.col("_off") + F.row_number().over(w)).cast("long"))
    return out.drop("_b", "_off")


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, salt_col=None, salt_buckets: int = 64,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked ``1..k`` per group by ``order_cols`` (a list of Columns, ties must be broken by them).

    Two stages: first the top k inside (group, salt) pieces, then the top k of at most
    ``salt_buckets * k`` survivors per group. Exact, because a global top-k row is a top-k row of its piece.
    """
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    salt = (F.col(salt_col) if isinstance(salt_col, str) else salt_col) if salt_col is not None else None
    if salt is None:
        raise ValueError("salt_col is required (a column that spreads rows of a group)")
    d = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    stage1 = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)


def dense_index(df: DataFrame, key_col: str, index_col: str = "term_index", prefix_len: int = 2,
                order=None, buckets=None, max_index: int | None = None) -> DataFrame:
    """0-based dense index in sorted order (``row_number() over (order by ...) - 1``) without a global window.

    Rows are grouped into buckets that are a coarsening of the order (by default the first ``prefix_len``
    characters of ``key_col``); a per-bucket count table -- bounded by the number of buckets -- gives each
    bucket its offset, and rows are numbered inside their bucket only, so no task sorts the whole table.
    ``order`` / ``buckets`` are lists of (Column, ascending) pairs for other orders; each bucket column must
    be constant over a run of the order.
    """
    if order is None:
        order = [(F.col(key_col), True)]
        buckets = [(F.substring(key_col, 1, prefix_len), True)]
    names = [f"_bk{i}" for i in range(len(buckets))]
    d = df
    for n, (c, _) in zip(names, buckets):
        d = d.withColumn(n, c)
    counts = d.groupBy(*names).agg(F.count(F.lit(1)).alias("_pn"))
    border = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, buckets)]
    wcum = Window.orderBy(*border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, F.coalesce(F.sum("_pn").over(wcum), F.lit(0)).alias("_off"))
    if max_index is not None:
        # top-N use: buckets that start at or after N are dropped before any row is numbered
        offsets = offsets.filter(F.col("_off") < max_index)
    w = Window.partitionBy(*names).orderBy(*[c.asc() if asc else c.desc() for c, asc in order])
    out = (d.join(offsets, names)
           .withColumn(index_col, (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
           .drop(*names, "_off"))
    return out.filter(F.col(index_col) < max_index) if max_index is not None else out


def scalar(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """One-row aggregate, to be attached with ``crossJoin`` (a single row: a proven broadcast bound)."""
    return df.agg(expr.alias(name))
