from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import common, sampling as sa


def classes(spark):
    rows = [(i, "one") for i in range(1)] + [(100 + i, "five") for i in range(5)] + [(200 + i, "fifty") for i in range(50)]
    return spark.createDataFrame(rows, "id long, c string")


def test_class_rank_equals_window(spark):
    d = classes(spark)
    got = {r.id: r._rank for r in common.class_rank(d, "c", "id", 7, salt_hex=1).collect()}
    w = Window.partitionBy("c").orderBy(common.hash_key("id", 7), "id")
    exp = {r.id: r.rn for r in d.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp


def test_stratified_sample_sizes(spark):
    s = sa.stratified_sample(classes(spark), "c", "id", 10, 42)
    n = {r.c: r["count"] for r in s.groupBy("c").count().collect()}
    assert n == {"one": 1, "five": 5, "fifty": 10}


def test_split_and_folds(spark):
    sp = sa.split_train_test(classes(spark), "c", "id", 0.8, 42)
    n = {(r.c, r.split): r["count"] for r in sp.groupBy("c", "split").count().collect()}
    assert n[("fifty", "train")] == 40 and n[("fifty", "test")] == 10 and n[("five", "train")] == 4
    f = sa.assign_folds(classes(spark), "c", "id", 5, 42)
    sizes = {r.fold: r["count"] for r in f.filter("c = 'fifty'").groupBy("fold").count().collect()}
    assert set(sizes.values()) == {10}
    five = sorted(r.fold for r in f.filter("c = 'five'").collect())
    assert five == [0, 1, 2, 3, 4]


def test_oversampling(spark):
    o = sa.oversample_min(classes(spark), "c", "id", 20, 8, 42)
    n = {r.c: r["count"] for r in o.groupBy("c").count().collect()}
    assert n == {"one": 8, "five": 8, "fifty": 20}
    # every row of a small class appears before any row appears twice
    five = o.filter("c = 'five'").groupBy("id").count().collect()
    assert sorted(r["count"] for r in five) == [1, 1, 2, 2, 2]
    m = sa.oversample_to_largest(classes(spark), "c", "id", 42)
    assert {r["count"] for r in m.groupBy("c").count().collect()} == {50}


def test_metamorphic_partitions_and_order(spark):
    d = classes(spark)
    a = sorted((r.id, r.split) for r in sa.split_train_test(d, "c", "id", 0.8, 1).collect())
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = sorted((r.id, r.split) for r in sa.split_train_test(d.orderBy(F.desc("id")).repartition(5), "c", "id", 0.8, 1).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert a == b
