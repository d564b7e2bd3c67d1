"""Relational layer: hierarchy, eligibility, instance comparison, funnels, joins, scans (JN-*, FLT-*, AGG-01..09,
SRC-04..06, SET-*). Stand-ins per SURVEY 7.1: order = case, lineitem = case-subject bridge, part = subject,
odd/even line numbers = first/second instance, region > nation > customer > order = subject tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import common, curation as cu, hierarchy as hi
from ..sources.tables import table
from .registry import query

DEPTH = 4


# -- subject tree --------------------------------------------------------------------------------------------
def nodes(spark, sf):
    """Parent-pointer tree; ids are ``key * 8 + level`` so they stay unique across levels at any scale."""
    def nid(k, lvl):
        return (F.col(k).cast("long") * 8 + lvl)
    r = table(spark, sf, "region").select(nid("r_regionkey", 1).alias("id"), F.lit(None).cast("long").alias("parent_id"),
                                          F.concat(F.lit("R"), F.col("r_regionkey")).alias("code"))
    n = table(spark, sf, "nation").select(nid("n_nationkey", 2).alias("id"), nid("n_regionkey", 1).alias("parent_id"),
                                          F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"))
    c = table(spark, sf, "customer").select(nid("c_custkey", 3).alias("id"), nid("c_nationkey", 2).alias("parent_id"),
                                            F.concat(F.lit("C"), F.col("c_custkey")).alias("code"))
    o = table(spark, sf, "orders").select(nid("o_orderkey", 4).alias("id"), nid("o_custkey", 3).alias("parent_id"),
                                          F.concat(F.lit("O"), F.col("o_orderkey")).alias("code"))
    return r.unionByName(n).unionByName(c).unionByName(o)


SQL_NODES = """
nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) * 8 + 1 AS id, CAST(NULL AS BIGINT) AS parent_id, 'R' || r_regionkey AS code FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 2, CAST(n_regionkey AS BIGINT) * 8 + 1, 'N' || n_nationkey FROM nation
  UNION ALL SELECT CAST(c_custkey AS BIGINT) * 8 + 3, CAST(c_nationkey AS BIGINT) * 8 + 2, 'C' || c_custkey FROM customer
  UNION ALL SELECT CAST(o_orderkey AS BIGINT) * 8 + 4, CAST(o_custkey AS BIGINT) * 8 + 3, 'O' || o_orderkey FROM orders),
walk AS (
  SELECT n0.id, n0.code, list_reverse(list_filter([n0.code, n1.code, n2.code, n3.code], lambda x: x IS NOT NULL)) AS path
  FROM nodes n0 LEFT JOIN nodes n1 ON n1.id = n0.parent_id LEFT JOIN nodes n2 ON n2.id = n1.parent_id
  LEFT JOIN nodes n3 ON n3.id = n2.parent_id),
flat AS (SELECT id, code, CAST(len(path) AS INTEGER) AS depth, path[1] AS level_1, path[2] AS level_2,
                path[3] AS level_3, path[4] AS level_4 FROM walk)
"""


def flat_tree(spark, sf):
    return hi.flatten(nodes(spark, sf), DEPTH)


@query("hierarchy_levels", f"""
WITH {SQL_NODES}
SELECT id, code, depth, level_1, level_2, level_3, level_4, concat_ws('/', level_1, level_2, level_3, level_4) AS path
FROM flat
""", ops=("JN-08", "STR-13", "PRJ-06"))
def hierarchy_levels(spark, sf):
    f = flat_tree(spark, sf)
    return f.withColumn("path", F.concat_ws("/", *[F.col(f"level_{i}") for i in range(1, DEPTH + 1)]))


@query("level_lookup", f"""
WITH {SQL_NODES}
SELECT id, code, coalesce(level_3, '0') AS level3_code FROM flat
""", ops=("JN-16",))
def level_lookup(spark, sf):
    f = hi.ancestor_at(flat_tree(spark, sf), 3)
    return f.select("id", "code", F.coalesce("ancestor", F.lit("0")).alias("level3_code"))


@query("descendants", f"""
WITH {SQL_NODES}
SELECT id, code, depth FROM flat WHERE level_1 IN ('R1', 'R3') AND depth > 1
""", ops=("JN-17",))
def descendants(spark, sf):
    return hi.descendants_of(flat_tree(spark, sf), 1, ["R1", "R3"]).select("id", "code", "depth")


@query("root_counts", f"""
WITH {SQL_NODES}
SELECT level_1, count(*) AS n_nodes, count(DISTINCT level_3) AS n_level3 FROM flat GROUP BY level_1
""", ops=("AGG-07", "AGG-03"))
def root_counts(spark, sf):
    return flat_tree(spark, sf).groupBy("level_1").agg(F.count(F.lit(1)).alias("n_nodes"),
                                                       F.countDistinct("level_3").alias("n_level3"))


SMALL_CLASS = 10


@query("small_class_closure", f"""
WITH {SQL_NODES},
small AS (SELECT level_3 AS code FROM flat WHERE depth = 4 GROUP BY level_3 HAVING count(*) < {SMALL_CLASS}
          UNION SELECT code FROM flat WHERE depth = 3 AND code NOT IN (SELECT level_3 FROM flat WHERE depth = 4))
SELECT id, code, depth FROM flat
WHERE coalesce(level_1, '') NOT IN (SELECT code FROM small) AND coalesce(level_2, '') NOT IN (SELECT code FROM small)
  AND coalesce(level_3, '') NOT IN (SELECT code FROM small) AND coalesce(level_4, '') NOT IN (SELECT code FROM small)
""", ops=("FLT-10", "FLT-09", "JN-12"))
def small_class_closure(spark, sf):
    """Drop level-3 classes with fewer than SMALL_CLASS children (none counts) together with their subtrees."""
    f = flat_tree(spark, sf)
    kids = f.filter(F.col("depth") == 4).groupBy(F.col("level_3").alias("code")).agg(F.count(F.lit(1)).alias("k"))
    small = (f.filter(F.col("depth") == 3).select("code").join(kids, "code", "left")
             .filter(F.coalesce(F.col("k"), F.lit(0)) < SMALL_CLASS).select("code"))
    return hi.drop_with_descendants(f, small, DEPTH).select("id", "code", "depth")


# -- fixed code lists (PRJ-04..06) ------------------------------------------------------------------------
# Stand-in code lists. Brands 1-5 are level 1, 6-10 level 2, 11-15 level 3, 16-20 level 4,
# 21-24 level 5; any other brand is "not identified" (Q21).
LEVEL_LISTS = {1: [f"Brand#{i}" for i in range(1, 6)], 2: [f"Brand#{i}" for i in range(6, 11)],
               3: [f"Brand#{i}" for i in range(11, 16)], 4: [f"Brand#{i}" for i in range(16, 21)],
               5: [f"Brand#{i}" for i in range(21, 25)]}


def _sql_level_values():
    return ", ".join(f"('{c}', '{lvl}')" for lvl, cs in LEVEL_LISTS.items() for c in cs)


@query("code_level", f"""
WITH lv(code, level) AS (VALUES {_sql_level_values()})
SELECT p_partkey, p_brand, coalesce(level, 'not identified') AS level FROM part LEFT JOIN lv ON lv.code = p_brand
""", ops=("PRJ-06", "NUL-01"))
def code_level(spark, sf):
    lv = spark.createDataFrame([(c, str(lvl)) for lvl, cs in LEVEL_LISTS.items() for c in cs], "code string, level string")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    # The code list has a fixed size (24 rows), so broadcasting it is bounded.
    j = p.join(F.broadcast(lv), p.p_brand == lv.code, "left")
    return j.select("p_partkey", "p_brand", F.coalesce("level", F.lit("not identified")).alias("level"))


@query("class_merge", """
WITH m1 AS (SELECT p_partkey, p_type, CASE WHEN p_brand = 'Brand#25' THEN 'Brand#24' ELSE p_brand END AS cls FROM part)
SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND cls = 'Brand#24' THEN 'Brand#23' ELSE cls END AS class FROM m1
""", ops=("PRJ-04",))
def class_merge(spark, sf):
    """Two chained merges, order matters: Brand#25 -> Brand#24, then PROMO rows of Brand#24 -> Brand#23."""
    p = table(spark, sf, "part")
    c1 = F.when(F.col("p_brand") == "Brand#25", "Brand#24").otherwise(F.col("p_brand"))
    p = p.select("p_partkey", "p_type", c1.alias("cls"))
    c2 = F.when((F.col("p_type") == "PROMO") & (F.col("cls") == "Brand#24"), "Brand#23").otherwise(F.col("cls"))
    return p.select("p_partkey", c2.alias("class"))


@query("code_label", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'economy line' WHEN 'PROMO' THEN 'promotion'
       WHEN 'STANDARD' THEN 'standard line' ELSE 'other' END AS label FROM part
""", ops=("PRJ-05",))
def code_label(spark, sf):
    t = F.col("p_type")
    lab = (F.when(t == "ECONOMY", "economy line").when(t == "PROMO", "promotion")
           .when(t == "STANDARD", "standard line").otherwise("other"))
    return table(spark, sf, "part").select("p_partkey", lab.alias("label"))


# -- eligibility ---------------------------------------------------------------------------------------------
def line_counts(spark, sf):
    return cu.keys_with_count(table(spark, sf, "lineitem"), "l_orderkey", ">=", 1)


@query("single_line_cases", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1)
""", ops=("FLT-08", "JN-04"))
def single_line_cases(spark, sf):
    one = cu.keys_with_count(table(spark, sf, "lineitem"), "l_orderkey", "==", 1)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.join(one, o.o_orderkey == one.l_orderkey, "left_semi")


@query("one_vs_many_share", """
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
t AS (SELECT count(*) AS total FROM c)
SELECT CASE WHEN n = 1 THEN 'one subject' ELSE 'many subjects' END AS label, count(*) AS n_cases,
       round(count(*) / max(total), 2) AS share
FROM c, t GROUP BY 1
""", ops=("AGG-05", "FLT-08", "NUM-02"))
def one_vs_many_share(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.count(F.lit(1)).alias("total"))   # one row
    lab = F.when(F.col("n") == 1, "one subject").otherwise("many subjects")
    g = c.groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n_cases"))
    return g.crossJoin(total).select("label", "n_cases", F.round(F.col("n_cases") / F.col("total"), 2).alias("share"))


def rectified_customers(spark, sf):
    return (table(spark, sf, "events").filter(F.col("event_type").ilike("%err%"))
            .select(F.col("user_id").alias("o_custkey")).distinct())


SQL_RECT = "(SELECT DISTINCT user_id FROM events WHERE event_type ILIKE '%err%')"


@query("funnel", f"""
SELECT 'total' AS label, count(*) AS n FROM orders
UNION ALL SELECT 'rectified', count(*) FROM orders WHERE o_custkey IN {SQL_RECT}
UNION ALL SELECT 'eligible', count(*) FROM orders WHERE o_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1)
UNION ALL SELECT 'eligible_and_rectified', count(*) FROM orders WHERE o_custkey IN {SQL_RECT} AND o_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1)
""", ops=("AGG-06", "SET-01", "JN-04", "FLT-05", "AGG-03"))
def funnel(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rect = o.join(rectified_customers(spark, sf), "o_custkey", "left_semi")
    one = cu.keys_with_count(table(spark, sf, "lineitem"), "l_orderkey", "==", 1).select(
        F.col("l_orderkey").alias("o_orderkey"))
    elig = o.join(one, "o_orderkey", "left_semi")
    both = rect.join(one, "o_orderkey", "left_semi")
    return cu.labelled_counts([("total", o), ("rectified", rect), ("eligible", elig),
                               ("eligible_and_rectified", both)])


@query("rectified_flag", f"""
SELECT o_orderkey, CASE WHEN o_custkey IN {SQL_RECT} THEN 'S' ELSE 'N' END AS rectified FROM orders
""", ops=("JN-09", "NUL-01"))
def rectified_flag(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return cu.flag_exists(o, rectified_customers(spark, sf), "o_custkey", "rectified").select("o_orderkey", "rectified")


HOT = {"in_brand1": "Brand#1", "in_brand2": "Brand#2", "in_brand3": "Brand#3"}


def main_lines(spark, sf):
    """Main subject per case: the line with the smallest (line number, part, supplier, quantity, price).
    A ``min(struct)`` aggregate (partial + final) rather than a window, so a hot case is split map-side."""
    li = table(spark, sf, "lineitem")
    m = li.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                    "l_extendedprice")).alias("m"))
    return m.select("l_orderkey", F.col("m.l_partkey").alias("l_partkey"))


SQL_MAIN = """main AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS l_partkey
               FROM lineitem GROUP BY l_orderkey)"""


@query("one_hot_subjects", f"""
WITH {SQL_MAIN},
lb AS (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
mb AS (SELECT l_orderkey, p_brand FROM main JOIN part ON p_partkey = l_partkey),
a AS (SELECT l_orderkey, max(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS in_brand1,
             max(CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END) AS in_brand2,
             max(CASE WHEN p_brand = 'Brand#3' THEN 1 ELSE 0 END) AS in_brand3 FROM lb GROUP BY l_orderkey),
m AS (SELECT l_orderkey, max(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS main_brand1,
             max(CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END) AS main_brand2,
             max(CASE WHEN p_brand = 'Brand#3' THEN 1 ELSE 0 END) AS main_brand3 FROM mb GROUP BY l_orderkey)
SELECT o_orderkey, CAST(coalesce(in_brand1, 0) AS INTEGER) AS in_brand1, CAST(coalesce(in_brand2, 0) AS INTEGER) AS in_brand2,
       CAST(coalesce(in_brand3, 0) AS INTEGER) AS in_brand3, CAST(coalesce(main_brand1, 0) AS INTEGER) AS main_brand1,
       CAST(coalesce(main_brand2, 0) AS INTEGER) AS main_brand2, CAST(coalesce(main_brand3, 0) AS INTEGER) AS main_brand3
FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey
""", ops=("JN-10", "JN-06", "NUL-01"))
def one_hot_subjects(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lb = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    mb = main_lines(spark, sf).join(part, "l_partkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = cu.one_hot_members(o, lb, "l_orderkey", "p_brand", HOT)
    out = cu.one_hot_members(out, mb, "l_orderkey", "p_brand", {k.replace("in_", "main_"): v for k, v in HOT.items()})
    return out.withColumnRenamed("l_orderkey", "o_orderkey")


# -- instance comparison (AGG-13, AGG-14, SET-03, JN-07, JN-05) ------------------------------------------------
def instances(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    first = li.filter(F.col("l_linenumber") % 2 == 1)
    second = li.filter(F.col("l_linenumber") % 2 == 0)
    return first, second


SQL_INST = """
a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 1),
b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 0),
k AS (SELECT DISTINCT l_orderkey FROM a INTERSECT SELECT DISTINCT l_orderkey FROM b),
j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.l_partkey AS pa, b.l_partkey AS pb
      FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey),
diff AS (SELECT l_orderkey, CAST(sum(CASE WHEN pb IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a,
                CAST(sum(CASE WHEN pa IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b,
                CAST(sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS in_both
         FROM j WHERE l_orderkey IN (SELECT l_orderkey FROM k) GROUP BY l_orderkey)
"""


def set_diff(spark, sf):
    first, second = instances(spark, sf)
    return cu.set_difference_counts(first, second, "l_orderkey", "l_partkey")


@query("subject_set_diff", f"""
WITH {SQL_INST}
SELECT l_orderkey, only_a AS only_first, only_b AS only_second, in_both, only_a + only_b > 0 AS differ FROM diff
""", ops=("AGG-13", "SET-03", "ARR-01"))
def subject_set_diff(spark, sf):
    d = set_diff(spark, sf)
    return d.select("l_orderkey", F.col("only_a").alias("only_first"), F.col("only_b").alias("only_second"),
                    "in_both", ((F.col("only_a") + F.col("only_b")) > 0).alias("differ"))


@query("curation_funnel", f"""
WITH {SQL_INST},
ck AS (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
one AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1)
SELECT c_nationkey, count(*) AS initial,
       CAST(sum(CASE WHEN l_orderkey IN (SELECT l_orderkey FROM one) THEN 1 ELSE 0 END) AS BIGINT) AS removed_one_subject,
       CAST(sum(CASE WHEN only_a + only_b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS removed_equal_sets
FROM diff JOIN ck ON o_orderkey = l_orderkey GROUP BY c_nationkey
""", ops=("AGG-14", "AGG-13"))
def curation_funnel(spark, sf):
    d = set_diff(spark, sf)
    one = (table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("_np"))
           .filter(F.col("_np") == 1).select("l_orderkey", F.lit(1).alias("_one")))
    ck = (table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
          .join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"))
    j = d.join(ck, "l_orderkey").join(one, "l_orderkey", "left")
    return j.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("initial"),
        F.count_if(F.col("_one").isNotNull()).alias("removed_one_subject"),
        F.count_if((F.col("only_a") + F.col("only_b")) == 0).alias("removed_equal_sets"))


@query("keylist_join", f"""
WITH {SQL_INST},
keys AS (SELECT DISTINCT l_orderkey FROM diff WHERE only_a + only_b > 0)
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty
FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM keys) GROUP BY l_orderkey
""", ops=("JN-07", "JN-11"))
def keylist_join(spark, sf):
    keys = set_diff(spark, sf).filter((F.col("only_a") + F.col("only_b")) > 0).select("l_orderkey").distinct()
    li = table(spark, sf, "lineitem").join(keys, "l_orderkey", "inner")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("exists_semi", """
SELECT o_orderkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = 0)
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = 1)
""", ops=("JN-05", "JN-11"))
def exists_semi(spark, sf):
    first, second = instances(spark, sf)
    o = table(spark, sf, "orders").select("o_orderkey")
    o = o.join(second, o.o_orderkey == second.l_orderkey, "left_semi")
    return o.join(first, o.o_orderkey == first.l_orderkey, "left_semi")


# -- joins ---------------------------------------------------------------------------------------------------
@query("star_join", """
SELECT r_name, p_type, o_orderstatus, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
GROUP BY r_name, p_type, o_orderstatus
""", ops=("JN-01", "AGG-01", "SRC-07"))
def star_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = (t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
         .join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
         .join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
         .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
         .join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
         .join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")))
    return j.groupBy("r_name", "p_type", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))


@query("left_dims", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'
""", ops=("JN-02", "JN-03"))
def left_dims(spark, sf):
    """Left dimension joins; the WHERE on the right side turns them inner (Catalyst's EliminateOuterJoin)."""
    t = lambda n: table(spark, sf, n)
    j = (t("orders").select("o_orderkey", "o_custkey")
         .join(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
         .join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
         .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left"))
    return j.filter(F.col("r_name") == "EUROPE").select("o_orderkey", "c_name", "n_name", "r_name")


@query("anti_unprocessed", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""", ops=("JN-12", "STM-01"))
def anti_unprocessed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("parent_lookup", """
SELECT n.n_nationkey, n.n_name, r.r_name AS region_name, c.n_name AS region_first_nation
FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey) c ON c.n_regionkey = n.n_regionkey
""", ops=("JN-15",))
def parent_lookup(spark, sf):
    """Lookups by unique key in the select list become left joins on that key (self-join included)."""
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region_name"))
    first = n.groupBy(F.col("n_regionkey").alias("_rk")).agg(F.min("n_name").alias("region_first_nation"))
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left").join(first, F.col("_rk") == F.col("n_regionkey"), "left")
            .select("n_nationkey", "n_name", "region_name", "region_first_nation"))


# -- aggregates (AGG-01..04, AGG-08, AGG-09) ----------------------------------------------------------------
@query("type_counts", """
SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type
""", ops=("AGG-01", "AGG-03"))
def type_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


@query("region_partial_sum", """
SELECT lang, CAST(sum(n) AS BIGINT) AS n_docs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)
GROUP BY lang
""", ops=("AGG-02",))
def region_partial_sum(spark, sf):
    """Per-region partial counts then a sum across regions; Catalyst keeps both as partial/final aggregates."""
    part = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return part.groupBy("lang").agg(F.sum("n").alias("n_docs"))


@query("cond_counts", """
SELECT source, CAST(count_if(text ILIKE '%http%') AS BIGINT) AS n_with_link,
       CAST(count_if(NOT (text ILIKE '%http%')) AS BIGINT) AS n_without_link
FROM documents GROUP BY source
""", ops=("AGG-09",))
def cond_counts(spark, sf):
    link = F.col("text").ilike("%http%")
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count_if(link).alias("n_with_link"), F.count_if(~link).alias("n_without_link"))


@query("distinct_agg", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(*) AS n_orders FROM orders GROUP BY o_orderstatus
""", ops=("AGG-03", "SET-02"))
def distinct_agg(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.countDistinct("o_custkey").alias("n_customers"), F.count(F.lit(1)).alias("n_orders"))


@query("signers_concat", """
SELECT l_orderkey, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS signers
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey
""", ops=("AGG-08",))
def signers_concat(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("s_name")), ", ").alias("signers"))


@query("log_span", """
SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
  CAST((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate))
   - CASE WHEN day(max(o_orderdate)) < day(min(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS months
FROM orders GROUP BY o_custkey
""", ops=("AGG-04", "DT-01"))
def log_span(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"),
                                                           F.max("o_orderdate").alias("last_date"))
    mx, mn = F.col("last_date"), F.col("first_date")
    months = ((F.year(mx) - F.year(mn)) * 12 + F.month(mx) - F.month(mn)
              - F.when(F.dayofmonth(mx) < F.dayofmonth(mn), 1).otherwise(0))
    return g.withColumn("months", months.cast("int"))


# -- filters (FLT-01, 02, 05, 06, 07, 11, 12) ------------------------------------------------------------------
@query("ilike_filter", """
SELECT event_id, event_type FROM events WHERE event_type ILIKE '%ERR%' OR event_type ILIKE 'cl_ck'
""", ops=("FLT-05",))
def ilike_filter(spark, sf):
    return table(spark, sf, "events").filter(F.expr("event_type ILIKE ANY ('%ERR%', 'cl_ck')")).select("event_id", "event_type")


@query("predicate_mix", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE ((o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW'))
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority IS NOT NULL AND o_orderpriority <> ''
  AND o_custkey NOT IN (1, 2, 3)
""", ops=("FLT-01", "FLT-02", "FLT-04", "FLT-06", "FLT-07", "DT-01"))
def predicate_mix(spark, sf):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    cond = (((s == "F") & p.isin("1-URGENT", "2-HIGH")) | ((s == "O") & (p == "5-LOW")))
    cond = (cond & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & p.isNotNull() & (p != "")
            & ~F.col("o_custkey").isin(1, 2, 3))
    return table(spark, sf, "orders").filter(cond).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("latest_orders", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)
""", ops=("FLT-11",))
def latest_orders(spark, sf):
    o = table(spark, sf, "orders")
    mx = o.agg(F.max("o_orderdate").alias("_mx"))     # one row
    return o.crossJoin(mx).filter(F.col("o_orderdate") == F.col("_mx")).select("o_orderkey", "o_orderdate")


@query("expr_filter", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' GROUP BY o_orderpriority
""", ops=("FLT-12",))
def expr_filter(spark, sf):
    return (table(spark, sf, "orders").filter("o_totalprice > 1000 and o_orderstatus = 'F'")
            .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))


@query("big_classes", """
SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) > 120)
""", ops=("FLT-09",))
def big_classes(spark, sf):
    """Keep classes with more than N rows: aggregate + semi-join (no window holding a class in one task)."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    big = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 120)
    return d.join(big, "lang", "left_semi").select("doc_id", "lang")


# -- scans (SRC-04..06) ------------------------------------------------------------------------------------
CHUNK = 1000
# The expected region list of the federated scan (24 regional sources).
EXPECTED_SOURCES = [f"src{i}" for i in range(24)]


@query("range_chunk_counts", f"""
SELECT CAST(floor(o_orderkey / {CHUNK}) AS BIGINT) AS chunk, count(*) AS n_rows, min(o_orderkey) AS min_key,
       max(o_orderkey) AS max_key FROM orders GROUP BY 1
""", ops=("SRC-04",))
def range_chunk_counts(spark, sf):
    """Half-open id windows [k*size, (k+1)*size): every id lands in exactly one chunk (Q10)."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.floor(F.col("o_orderkey") / CHUNK).cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))


PAGE = 500


@query("ordered_page", f"""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // {PAGE} AS BIGINT) AS page FROM orders
""", ops=("SRC-05",))
def ordered_page(spark, sf):
    """Every row's page under key order (pages of PAGE rows), via the bucketed dense index."""
    o = table(spark, sf, "orders").select("o_orderkey")
    ix = common.dense_index(o, "o_orderkey", "_ix", order=[(F.col("o_orderkey"), True)],
                            buckets=[(F.floor(F.col("o_orderkey") / 4096), True)])
    return ix.select("o_orderkey", (F.col("_ix") / PAGE).cast("long").alias("page"))


@query("first_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25", ops=("LIM-01", "SRT-01"))
def first_orders(spark, sf):
    """LIMIT n under key order (the limit is the feature; a per-partition top-25)."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(25)


@query("run_date_text", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%d/%m/%Y %H:%M:%S') AS run_date FROM orders
""", ops=("DT-01",))
def run_date_text(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy HH:mm:ss").alias("run_date"))


@query("drop_null_rows", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.doc_id IS NOT NULL AND d.lang IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL
""", ops=("FLT-02", "JN-02"))
def drop_null_rows(spark, sf):
    """Null-row removal on any column, after an outer join that leaves nulls."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic").dropna("any")


@query("region_scan_status", f"""
WITH exp(source) AS (VALUES {", ".join(f"('{s}')" for s in EXPECTED_SOURCES)}),
got AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)
SELECT coalesce(exp.source, got.source) AS source, coalesce(n_docs, 0) AS n_docs,
       CASE WHEN n_docs IS NULL THEN 'missing' WHEN exp.source IS NULL THEN 'unexpected' ELSE 'ok' END AS status
FROM exp FULL OUTER JOIN got ON exp.source = got.source
""", ops=("SRC-02", "SRC-06", "SET-01"))
def region_scan_status(spark, sf):
    """Federated scan: one grouped scan over all sources, matched to the expected list with a status."""
    exp = spark.createDataFrame([(s,) for s in EXPECTED_SOURCES], "source string")
    got = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    j = exp.withColumn("_e", F.lit(1)).join(got, "source", "full")
    status = (F.when(F.col("n_docs").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("ok"))
    return j.select("source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), status.alias("status"))
