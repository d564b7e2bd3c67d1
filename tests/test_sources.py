import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.sources import corpus, sinks
from tessera.streaming import incremental as inc


def _raw_line(i, html):
    vals = [str(i), "0000123-04.2019.5.01.0027", str(1000 + i), "", "", "2", "1", "9", html, "u1", "u7",
            "org", "col", "2019-01-02 10:00:00"]
    return ",".join('"' + v.replace('"', '""') + '"' for v in vals)


def test_regional_corpus_scan(spark, tmpdir_path):
    for r, html in [(1, "<p>Olá\nmundo</p>"), (3, '<p class="x">dois</p>')]:
        with open(os.path.join(tmpdir_path, f"TRT_{r:02d}_documentosSelecionados.csv"), "w") as f:
            f.write(_raw_line(r, html) + "\n")
    df = corpus.read_regional_corpus(spark, tmpdir_path, regions=[1, 2, 3])     # region 2 is missing: skipped
    rows = {r.sigla_trt: r for r in df.collect()}
    assert set(rows) == {"TRT01", "TRT03"}
    assert rows["TRT01"].tx_conteudo_documento == "<p>Olá\nmundo</p>"
    assert rows["TRT01"].cd_assunto_nivel_5 is None and rows["TRT01"].cd_assunto_nivel_1 == 9


def test_hierarchy_lookup_nan_to_zero(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "h.csv")
    with open(p, "w") as f:
        f.write("cd_assunto_nivel_1,cd_assunto_nivel_2,cd_assunto_nivel_3,cd_assunto_nivel_4,cd_assunto_nivel_5\n9,864,,,\n")
    r = corpus.read_hierarchy_lookup(spark, p).first()
    assert (r.cd_assunto_nivel_1, r.cd_assunto_nivel_3, r.cd_assunto_nivel_5) == (9, 0, 0)


def test_sinks_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("a b", 1.5, "r1"), ("c", 2.25, "r2")], "`col one` string, v double, region string")
    clean = sinks.clean_columns(df)
    assert clean.columns == ["col_one", "v", "region"]
    out = os.path.join(tmpdir_path, "o")
    sinks.write_overwrite(clean, out, ("region",))
    sinks.write_overwrite(clean.filter("region = 'r1'"), out, ("region",))     # overwrite replaces
    assert spark.read.parquet(out).count() == 1
    sinks.append(clean, out + "_m")
    sinks.append(clean, out + "_m")
    assert spark.read.parquet(out + "_m").count() == 4
    loc = {r.v for r in sinks.with_decimal_comma(clean).collect()}
    assert loc == {"1,5", "2,25"}
    sinks.write_locale_csv(clean, out + "_csv")
    back = spark.read.option("header", True).option("sep", "#").csv(out + "_csv")
    assert {r.v for r in back.collect()} == {"1,5", "2,25"}


def test_keyset_batches_and_write_back(spark):
    df = spark.range(0, 2500).withColumnRenamed("id", "k").withColumn("flag", F.lit("N"))
    b = corpus.keyset_batches(df, "k", F.col("k") >= 100, ["k", "flag"], batch_size=1000)
    n = {r.batch: r["count"] for r in b.groupBy("batch").count().collect()}
    assert n == {0: 1000, 1: 1000, 2: 400}
    ids = spark.createDataFrame([(5,), (7,)], "k long")
    wb = corpus.flag_write_back(df, ids, "k", "flag", "S")
    assert wb.filter("flag = 'S'").count() == 2 and wb.count() == 2500


def test_incremental_feed_idempotent(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    schema = "doc_id long, text string, source string"
    spark.createDataFrame([(1, "Primeiro texto aqui", "s1"), (2, "<p>segundo documento</p>", "s2")], schema) \
        .coalesce(1).write.parquet(os.path.join(src, "b1"))
    paths = inc.feed_paths(spark)
    sch = spark.read.parquet(os.path.join(src, "b1")).schema
    inc.run_feed(spark, os.path.join(src, "b1"), sch, paths, [])
    # a second file repeats doc 2 and adds doc 3: only doc 3 is new
    spark.createDataFrame([(2, "<p>segundo documento</p>", "s2"), (3, "terceiro texto", "s3")], schema) \
        .coalesce(1).write.mode("append").parquet(os.path.join(src, "b1"))
    inc.run_feed(spark, os.path.join(src, "b1"), sch, paths, [])
    out = spark.read.parquet(paths["out"])
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
    log = spark.read.parquet(paths["log"])
    assert log.count() == 3 and {r.cd_tipo_documento for r in log.collect()} <= set(inc.LOG_TYPES)


def test_replay_of_a_half_written_batch(spark, tmpdir_path):
    """A batch that crashed after its output was written leaves no second copy when it is tried again."""
    paths = {k: os.path.join(tmpdir_path, k) for k in ("out", "status", "log", "checkpoint")}
    df = spark.createDataFrame([(1, "some words here", "a"), (2, None, "a"), (3, "<p>more</p>", "b")], "doc_id long, text string, source string")
    inc.process_batch(df, 0, paths, [])
    first = spark.read.parquet(paths["out"]).count()
    import shutil
    shutil.rmtree(paths["status"])                              # as if the crash came before the status
    inc.process_batch(df, 0, paths, [])
    assert spark.read.parquet(paths["out"]).count() == first == 2
    inc.process_batch(df, 1, paths, [])
    assert spark.read.parquet(paths["out"]).filter("batch_id = 1").count() == 0
    log = {(r.doc_id, r.batch_id): r for r in spark.read.parquet(paths["log"]).collect()}
    assert log[2, 0].in_sucesso == "N" and log[2, 0].ds_erro and log[1, 0].in_sucesso == "S" and log[1, 0].duration_us > 0


def test_no_machine_local_scratch_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from tessera.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(spark)


def test_a_failing_region_gets_a_status_row(spark, tmpdir_path):
    for r in ("a", "b"):
        spark.range(3 if r == "a" else 0).write.parquet(f"{tmpdir_path}/{r}")
    os.makedirs(f"{tmpdir_path}/c")
    with open(f"{tmpdir_path}/c/part.parquet", "w") as f:
        f.write("not a table")
    tried = []

    def flaky(s):
        tried.append(1)
        if len(tried) == 1:
            raise OSError("connection lost\nand more")
        return s.range(2)
    readers = {r: (lambda s, r=r: s.read.schema("id long").parquet(f"{tmpdir_path}/{r}")) for r in ("a", "b", "c", "missing")} | {"flaky": flaky}
    rows, status = corpus.read_regions(spark, readers, retries=1)
    got = {r.region: r for r in status.collect()}
    assert {k: (v.outcome, v.n_rows, v.attempts) for k, v in got.items()} == {
        "a": ("ok", 3, 1), "b": ("empty", 0, 1), "c": ("failed", 0, 2), "missing": ("failed", 0, 2), "flaky": ("ok", 2, 2)}
    assert got["c"].error and got["missing"].error and got["a"].error is None and all(r.seconds >= 0 for r in got.values())
    assert sorted((r.region, r.id) for r in rows.collect()) == [("a", 0), ("a", 1), ("a", 2), ("flaky", 0), ("flaky", 1)]


def test_a_repeated_run_leaves_one_copy(spark, tmpdir_path):
    out = f"{tmpdir_path}/log"
    first, second = (spark.createDataFrame(x, "model string, score double") for x in ([("nb, \"x\"", 0.5), ("", 1.0)], [("svm", 0.25)]))
    for df, run in ((first, "1"), (second, "2"), (first, "1")):
        sinks.append_run(df, out, run)
    rows = sinks.read_runs(spark, out, "score double, model string")
    assert sorted((r.run, r.model or "", r.score) for r in rows.collect()) == [("1", "", 1.0), ("1", "nb, \"x\"", 0.5), ("2", "svm", 0.25)]
    assert spark.read.text(f"{out}/header").count() == 1


def test_feed_queries_read_a_table_of_several_files(spark, tmpdir_path):
    """The documents table may be one file or a folder of files."""
    import __spark_entry__ as entry
    rows = [(i, None if i == 3 else f"words of document {i}", "s") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    out = entry.queries()["extraction_log"](spark, tmpdir_path).collect()
    assert {r.doc_id for r in out} == set(range(6)) and [r.doc_id for r in out if r.in_sucesso == "N"] == [3] and all(r.valid for r in out)
