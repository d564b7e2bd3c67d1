"""The ``opN_<name>`` queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, conversation_repair, decontamination, license_scan, line_dedup, lm_scoring, ngram_jaccard, pii,
               spelling_variants, substring_dedup, superminhash, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op4_substring_dedup")
def op4(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.duplicate_spans(table(spark, sf_dir, "documents")))


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"), lm_scoring.crc_remainder("doc_id", 7) == 2)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH lines AS (
    SELECT doc_id, n, line, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE c.k IS NOT NULL AND doc_id <> last_doc) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.k IS NULL OR doc_id = last_doc), ''))
           AS kept_sha256
FROM lines LEFT JOIN common c USING (k) GROUP BY doc_id"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_ngram_jaccard")
def op6(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


@query("op7_bpe")
def op7(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op1_decontamination")
def op1(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), lm_scoring.crc_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held)
    return toxicity.score(docs, model, score_col="score").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_ann")
def op5(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_pii")
def op9(spark, sf_dir):
    """The key is a parameter of the operator; the query uses a fixed one so that its result can be repeated."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), b"op9 query key")
    kinds = F.transform("found", lambda x: x.kind)
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"),
                      F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"),
                      F.array_join(F.transform("found", lambda x: x.pseudonym), "\n").alias("pseudonyms"),
                      F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"), F.col("clean_text").alias("text"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents"))


@query("op12_superminhash")
def op12(spark, sf_dir):
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))
