from pyspark.sql import functions as F

from tessera.operators import common, curation as cu, hierarchy as hi


def tree(spark):
    # five levels: 1 > 2 > 3 > 4 > 5, a second branch 1 > 6 > 7, an inactive node 8 under 2
    rows = [(1, None, "A"), (2, 1, "B"), (3, 2, "C"), (4, 3, "D"), (5, 4, "E"), (6, 1, "F"), (7, 6, "G"), (8, 2, "H")]
    return spark.createDataFrame(rows, "id long, parent_id long, code string")


def test_flatten_levels(spark):
    f = {r.id: r for r in hi.flatten(tree(spark), 5).collect()}
    assert (f[5].level_1, f[5].level_2, f[5].level_3, f[5].level_4, f[5].level_5, f[5].depth) == ("A", "B", "C", "D", "E", 5)
    assert (f[7].level_1, f[7].level_2, f[7].level_3, f[7].level_4) == ("A", "F", "G", None)
    assert f[1].depth == 1 and f[1].level_2 is None


def test_ancestor_descendants_closure(spark):
    f = hi.flatten(tree(spark), 5)
    anc = {r.id: r.ancestor for r in hi.ancestor_at(f, 3).collect()}
    assert anc[5] == "C" and anc[2] is None                # a level-2 node has no level-3 ancestor (Q13)
    assert {r.code for r in hi.descendants_of(f, 2, ["F"]).collect()} == {"G"}
    small = spark.createDataFrame([("C",)], "code string")
    kept = {r.code for r in hi.drop_with_descendants(f, small, 5).collect()}
    assert kept == {"A", "B", "F", "G", "H"}


def test_set_difference(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 10)], "k long, m long")
    b = spark.createDataFrame([(1, 11), (1, 10), (2, 10), (2, 13), (4, 1)], "k long, m long")
    d = {r.k: (r.only_a, r.only_b, r.in_both) for r in cu.set_difference_counts(a, b, "k", "m").collect()}
    assert d == {1: (0, 0, 2), 2: (1, 1, 1)}               # keys 3 and 4 are on one side only


def test_eligibility_and_flags(spark):
    bridge = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "z")], "k long, s string")
    assert {r.k for r in cu.keys_with_count(bridge, "k", "==", 1).collect()} == {1, 3}
    left = spark.createDataFrame([(1,), (2,), (5,)], "k long")
    fl = {r.k: r.f for r in cu.flag_exists(left, bridge.filter("s = 'x'"), "k", "f").collect()}
    assert fl == {1: "S", 2: "S", 5: "N"}
    oh = {r.k: (r.hx, r.hy) for r in cu.one_hot_members(left, bridge, "k", "s", {"hx": "x", "hy": "y"}).collect()}
    assert oh == {1: (1, 0), 2: (1, 1), 5: (0, 0)}


def test_dense_index_equals_global_row_number(spark):
    words = spark.createDataFrame([(w,) for w in ["b", "ab", "aa", "c", "abc", "ba", "zz", "z"]], "term string")
    ix = {r.term: r.term_index for r in common.dense_index(words, "term").collect()}
    assert ix == {t: i for i, t in enumerate(sorted(ix))}


def test_top_k_per_group_exact(spark):
    rows = [("g1" if i % 3 else "g2", f"w{i:03d}", i % 17) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, w string, n long")
    got = common.top_k_per_group(df, "g", [F.col("n").desc(), F.col("w")], 7, salt_col="w", salt_buckets=8)
    exp = {}
    for g in ("g1", "g2"):
        exp[g] = [w for _, w, _ in sorted([(-n, w, g) for gg, w, n in rows if gg == g])[:7]]
    for g in ("g1", "g2"):
        assert [r.w for r in got.filter(F.col("g") == g).orderBy("rank").collect()] == exp[g]
