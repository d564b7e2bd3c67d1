"""Sink -> source round trips over data derived from the driver tables (SNK-01/04/05/07, SRC-03, PRJ-02).

Outputs go to a fresh folder under the shared ``spark.checkpoint.dir`` (never a machine-local folder)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as tx
from ..session import ensure_checkpoint_dir
from ..sources import corpus, sinks
from ..sources.tables import table
from . import sqlfrag as q
from .registry import query
from .text_plans import STOP, _sql_stop_list


def _out(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


PROCESSED_SCHEMA = StructType([StructField("id_processo_documento", LongType()), StructField("texto_processado", StringType()),
                               StructField("n_tokens", LongType())])


@query("processed_corpus_roundtrip", f"""
SELECT doc_id, source AS sigla_trt, array_to_string(list_filter(string_split({q.token_string('text')}, ' '),
       lambda x: length(x) > 3 AND NOT list_contains({_sql_stop_list(STOP)}, x)), ' ') AS texto_processado
FROM documents
""", ops=("SNK-01", "SRC-03", "PRJ-02", "SRC-02"))
def processed_corpus_roundtrip(spark, sf):
    """Normalise, write as '#' separated quoted CSV partitioned by region, read back by name."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id_processo_documento"), F.col("source").alias("sigla_trt"),
        tx.join_tokens(tx.processed_tokens("text", STOP, 3)).alias("texto_processado"),
        F.lit(0).cast("long").alias("n_tokens"))
    path = _out(spark, "processed")
    sinks.write_overwrite(d, path, ("sigla_trt",), "csv", header=True, sep="#", quoteAll=True, emptyValue="")
    back = corpus.read_processed_corpus(spark, path, PROCESSED_SCHEMA)
    back = back.withColumn("sigla_trt", F.regexp_extract(F.col("_metadata.file_path"), "sigla_trt=([^/]+)", 1))
    return (back.withColumnRenamed("id_processo_documento", "doc_id")
            .select("doc_id", "sigla_trt", F.coalesce("texto_processado", F.lit("")).alias("texto_processado")))


@query("locale_summary_roundtrip", """
SELECT lang, replace(CAST(round(avg(n_chars), 2) AS VARCHAR), '.', ',') AS mean_chars, count(*) AS n
FROM documents GROUP BY lang
""", ops=("SNK-05",))
def locale_summary_roundtrip(spark, sf):
    s = table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 2).alias("mean_chars"),
                                                          F.count(F.lit(1)).alias("n"))
    path = _out(spark, "summary")
    sinks.write_locale_csv(s, path, sep="#")
    back = spark.read.schema("lang string, mean_chars string, n long").option("header", True).option("sep", "#").csv(path)
    return back


@query("prediction_sink_roundtrip", """
SELECT doc_id, source AS y_true, 'hash' AS modelo FROM documents
""", ops=("SNK-04",))
def prediction_sink_roundtrip(spark, sf):
    """Prediction rows written one folder per model and read back; ids and labels travel with the rows."""
    p = table(spark, sf, "documents").select("doc_id", F.col("source").alias("y_true"), F.lit("hash").alias("modelo"))
    path = _out(spark, "pred")
    sinks.write_predictions(p, path)
    return spark.read.parquet(path).select("doc_id", "y_true", "modelo")


@query("regional_corpus_roundtrip", """
SELECT doc_id AS id_processo_documento,
       'TRT' || lpad(CAST(CAST(substr(source, 4) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS sigla_trt,
       CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5, CAST(doc_id % 13 AS INTEGER) AS cd_assunto_nivel_3
FROM documents WHERE CAST(substr(source, 4) AS INTEGER) + 1 <= 24
""", ops=("SRC-01", "SRC-02", "SNK-01", "STR-12"))
def regional_corpus_roundtrip(spark, sf):
    """Documents written in the raw 14-column quoted layout, one file set per region, then scanned back
    with the region taken from the file name; multi-line texts and quotes must survive."""
    d = table(spark, sf, "documents")
    raw = d.select(
        F.col("doc_id").alias("index"), F.concat(F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit("-00.2020.5.01.0001")).alias("nr_processo"),
        F.col("doc_id").alias("id_processo_documento"), F.lit(None).cast("int").alias("cd_assunto_nivel_5"),
        F.lit(None).cast("int").alias("cd_assunto_nivel_4"), (F.col("doc_id") % 13).cast("int").alias("cd_assunto_nivel_3"),
        (F.col("doc_id") % 7).cast("int").alias("cd_assunto_nivel_2"), F.lit(9).alias("cd_assunto_nivel_1"),
        F.col("text").alias("tx_conteudo_documento"), F.md5("text").alias("ds_identificador_unico"),
        F.right(F.md5("text"), F.lit(7)).alias("ds_identificador_unico_simplificado"), F.col("source").alias("ds_orgao_julgador"),
        F.col("lang").alias("ds_orgao_julgador_colegiado"), F.lit(None).cast("timestamp").alias("dt_juntada"),
        (F.substring("source", 4, 10).try_cast("int") + 1).alias("region"))
    base = _out(spark, "raw")
    corpus.write_regional_corpus(raw, base)
    back = corpus.read_regional_corpus(spark, base, range(1, 25), pattern="file=" + corpus.RAW_PATTERN)
    return back.select("id_processo_documento", "sigla_trt", F.length("tx_conteudo_documento").alias("n_chars"),
                       F.md5("tx_conteudo_documento").alias("text_md5"), "cd_assunto_nivel_3")


@query("keyset_batches", """
SELECT doc_id, lang, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS batch
FROM documents WHERE lang <> 'en'
""", ops=("SRC-11", "SRC-05"))
def keyset_batches(spark, sf):
    """Cursor read with predicate and field list, numbered in key order in batches of 100."""
    d = table(spark, sf, "documents")
    return corpus.keyset_batches(d, "doc_id", F.col("lang") != "en", ["doc_id", "lang"], 100)


@query("flag_write_back", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'S' ELSE 'N' END AS selected
FROM documents
""", ops=("SRC-12", "JN-02"))
def flag_write_back(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("N").alias("selected"))
    ids = table(spark, sf, "labels").filter(F.col("quality") == 1).select("doc_id")
    return corpus.flag_write_back(d, ids, "doc_id", "selected", "S")


@query("selection_sheet", """
SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_type = 'PROMO'
""", ops=("SRC-10",))
def selection_sheet(spark, sf):
    p = table(spark, sf, "part")
    return corpus.selection_sheet(p, ["p_partkey", "p_name", "p_brand", "p_size", "p_type"], "p_type", "PROMO",
                                  "p_partkey").drop("p_type")


@query("federated_scan", """
SELECT source AS region, 'ok' AS outcome, count(*) AS n_rows FROM documents GROUP BY source
UNION ALL SELECT 'broken', 'failed', 0 UNION ALL SELECT 'nowhere', 'failed', 0
""", ops=("SRC-06", "SRC-02", "SET-01"))
def federated_scan(spark, sf):
    """One store a region, of which one holds a file that is no table and one is absent: each is read by itself, the status says what became of it."""
    path = _out(spark, "regions")
    table(spark, sf, "documents").write.partitionBy("source").parquet(path)
    spark.range(1).select(F.lit("no table").alias("x")).write.text(f"{path}/source=broken")
    regions = [r.source for r in table(spark, sf, "documents").select("source").distinct().collect()]
    _, status = corpus.read_regions(spark, {r: (lambda s, r=r: s.read.parquet(f"{path}/source={r}")) for r in [*regions, "broken", "nowhere"]})
    return status.select("region", "outcome", "n_rows")


@query("report_append", """
SELECT run, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents, (VALUES ('r1'), ('r2')) AS t(run) GROUP BY run, lang
""", ops=("SNK-02", "AGG-01"))
def report_append(spark, sf):
    """The per-class report appended by two runs, the first of which is repeated as after a crash: one copy of each."""
    report = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    path = _out(spark, "report")
    for run in ("r1", "r2", "r1"):
        sinks.append_run(report, path, run)
    return sinks.read_runs(spark, path, "lang string, n long, chars long")


@query("hierarchy_lookup", """
SELECT c_nationkey AS cd_assunto_nivel_1, c_custkey AS cd_assunto_nivel_2, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS cd_assunto_nivel_3,
       0 AS cd_assunto_nivel_4, 0 AS cd_assunto_nivel_5 FROM customer
""", ops=("SRC-08",))
def hierarchy_lookup(spark, sf):
    """The lookup table of five levels read from CSV: levels that a code does not have become 0."""
    c = table(spark, sf, "customer")
    none = F.lit(None).cast("long")
    levels = [F.col("c_nationkey"), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")), none, none]
    path = _out(spark, "hierarchy")
    c.select(*[x.alias(f"cd_assunto_nivel_{i + 1}") for i, x in enumerate(levels)]).write.option("header", True).csv(path)
    return corpus.read_hierarchy_lookup(spark, path)


@query("table_load", """
SELECT o_orderkey AS "order_key", o_orderstatus AS "status_of_order", CAST(o_totalprice AS DOUBLE) AS "total_price" FROM orders
""", ops=("SNK-03", "PRJ-02"))
def table_load(spark, sf):
    """Orders under names with blanks loaded twice into a new table, which then holds them once under clean names."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order key"), F.col("o_orderstatus").alias("status of order"),
                                          F.col("o_totalprice").cast("double").alias("total price"))
    name = f"load_{uuid.uuid4().hex}"
    path = _out(spark, name)
    for _ in range(2):
        sinks.load_table(o, name, path)
    return spark.table(name)


@query("summary_sink", """
SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY source
""", ops=("SNK-07", "AGG-01"))
def summary_sink(spark, sf):
    """A summary by source written as one CSV file with a header and read back."""
    s = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    path = _out(spark, "summary")
    sinks.write_summary(s, path)
    return spark.read.option("header", True).schema("source string, n long, mean_chars double").csv(path)
