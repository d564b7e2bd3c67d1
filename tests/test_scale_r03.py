"""Forms of the plans that keep time, disk and memory in line with the input, with the same rows as the plain form."""

import contextlib
import io

from pyspark.sql import functions as F

from tessera.functions import text as tx


def plan(df) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_embedding_cleaning_tries_addresses_once_a_run(spark):
    texts = ["'a' rock'n'roll ’x '", "a..b ...c ....d …e…..", "x@y @z w@ a.b@c.d,e", "  　lead 'tail' \x85", "a –b  c d -e", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = d.select("id", tx.clean_for_embeddings("text").alias("c"))
    assert "contains(text" in plan(out).lower()             # a text without the sign is not searched for addresses
    got = [r.c for r in out.orderBy("id").collect()]
    assert got == ["a rock'n'roll x", "a.b c . d e .", "EMAIL @ z w @ EMAIL", "lead tail", "a - b c d - e", None, ""]


ODD = ["Ação ﬁne word word", "word Word, ｗｏｒｄ ＡＢＣＤ naïveté", None, "", "the of to", "x" * 30 + " Straße"]


def test_term_counts_need_no_shuffle_of_entries(spark):
    from tessera.operators import features as fe
    d = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for frame in (d, d.union(d), d.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))):
        counts = fe.text_term_counts(frame, "text", ["word"], 3)
        plain = fe.term_frequencies(frame.select("doc_id", tx.processed_tokens("text", ["word"], 3).alias("tokens")))
        assert sorted(map(str, counts.collect())) == sorted(map(str, plain.select(*counts.columns).collect()))
    once = plan(fe.text_term_counts(d, "text", ["word"], 3))
    assert "Aggregate" not in once and "regexp" not in once and "Aggregate" in plan(fe.text_term_counts(d.union(d), "text", ["word"], 3))


def test_predictions_carry_no_class_rows(spark, tmpdir_path):
    from tessera.plans import analysis_plans as ap
    rows = [(1, "src1"), (2, "src2"), (2, "src2"), (2, "src3"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    pred = ap.predictions(spark, tmpdir_path, ("m1", "m2"))
    assert plan(pred).count("Generate") == 1                # models, not classes
    long = ap.scores(spark, tmpdir_path, ("m1", "m2"))
    assert long.count() == 5 * 2 * len(ap.CLASSES)
    sums = long.groupBy("doc_id", "model").agg(F.sum("prob").alias("s")).collect()
    assert len(sums) == 6 and all(abs(r.s - 1) < 1e-9 for r in sums)
    plain = long.groupBy("doc_id", "model", "y_true").agg(F.max_by("class", "prob").alias("y_pred"))
    assert sorted(map(str, pred.collect())) == sorted(map(str, plain.collect()))


def test_stemmed_band_shuffles_entries_once_before_the_band(spark, tmpdir_path, monkeypatch):
    from tessera.plans import text_plans as tp
    text = " ".join(["meninos", "casa", "livremente"] * 200)
    rows = [(i, "a", "s", text + f" extra{chr(97 + i)}word") for i in range(6)] + [(8, "a", "s", "meninos"), (None, "a", "s", text)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    written, cut = [], tp.cut_lineage
    monkeypatch.setattr(tp, "cut_lineage", lambda df, name="t": (written.append(name), cut(df, name))[1])
    monkeypatch.setattr(tp, "MAX_DF", 1.0)
    got = tp.stemmed_band_tfidf(spark, tmpdir_path).collect()
    assert written == ["tf", "stemmed-words", "stems"]        # the band is no table of its own, joined with the entries again
    assert {r.doc_id for r in got} == set(range(6)) and len({r.term for r in got}) == 3
