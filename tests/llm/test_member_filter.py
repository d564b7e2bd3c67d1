from tessera.llm.member_filter import maybe_among, maybe_repeated, member_filter, repeated_filter


def test_repeated_values_pass(spark):
    import numpy as np
    rows = [([i, -i, 10 ** 15 + i // 2],) for i in range(3000)]
    bits = repeated_filter(spark.createDataFrame(rows, "a array<long>").repartition(5)).value
    assert maybe_repeated(np.array([0] + [10 ** 15 + i for i in range(1500)]), bits).all()
    assert maybe_repeated(np.arange(1, 3000), bits).sum() < 30


def test_keeps_members_and_few_others(spark):
    df = spark.range(20000).selectExpr("id", "cast(id as string) as text", "id as row")
    ids = df.filter("id % 97 = 0").select("id")
    out = maybe_among(df, "id", member_filter(ids))
    assert out.columns == df.columns
    got = {r.id for r in out.collect()}
    assert {i for i in range(20000) if i % 97 == 0} <= got and len(got) < 250
    assert maybe_among(df, "id", member_filter(ids.limit(0))).count() == 0
    assert maybe_among(spark.createDataFrame([(None,), (97,)], "id long"), "id", member_filter(ids)).count() == 1
