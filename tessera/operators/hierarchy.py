"""Subject hierarchy: parent-pointer tree -> level columns, ancestor lookup, descendants, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(nodes: DataFrame, depth: int, id_col: str = "id", parent_col: str = "parent_id",
            code_col: str = "code") -> DataFrame:
    """Ancestor walk by ``depth - 1`` left self-joins (JN-08).

    Returns (id, code, depth, level_1 .. level_<depth>) with level_1 the root's code; levels below the
    node's own depth are NULL. Each step is an equi-join on the parent key, planned by Catalyst/AQE.
    """
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("p1"), F.col(code_col).alias("c0"))
    cur = base
    parents = nodes.select(F.col(id_col), F.col(parent_col), F.col(code_col))
    for k in range(1, depth):
        p = parents.select(F.col(id_col).alias(f"p{k}"), F.col(parent_col).alias(f"p{k + 1}"),
                           F.col(code_col).alias(f"c{k}"))
        cur = cur.join(p, f"p{k}", "left")
    codes = [F.col(f"c{k}") for k in range(depth)]            # own code first, then ancestors
    path = F.reverse(F.filter(F.array(*codes), lambda x: x.isNotNull()))   # root first
    out = cur.select("id", F.col("c0").alias("code"), F.size(path).alias("depth"), path.alias("_path"))
    return out.select("id", "code", "depth",
                      *[F.try_element_at("_path", F.lit(i)).alias(f"level_{i}") for i in range(1, depth + 1)])


def ancestor_at(flat: DataFrame, level: int) -> DataFrame:
    """Each node's ancestor code at ``level`` (itself when it sits at that level); NULL above it (JN-16, Q13)."""
    return flat.select("id", "code", F.col(f"level_{level}").alias("ancestor"))


def descendants_of(flat: DataFrame, level: int, codes) -> DataFrame:
    """Nodes whose ancestor at ``level`` is one of ``codes`` (JN-17), the ancestors themselves excluded."""
    return flat.filter(F.col(f"level_{level}").isin(list(codes)) & (F.col("depth") > level))


def drop_with_descendants(flat: DataFrame, small_codes: DataFrame, depth: int) -> DataFrame:
    """Remove nodes whose code, or any ancestor code, is in ``small_codes(code)`` (FLT-10).

    The closure is the level columns themselves: one semi-join per level, no recursion needed.
    """
    keep = flat
    for i in range(1, depth + 1):
        keep = keep.join(small_codes.select(F.col("code").alias(f"level_{i}")), f"level_{i}", "left_anti")
    return keep
