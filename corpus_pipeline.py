"""Training-corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Part of the ``llm`` subpackage, which it needs. The stages keep the columns of ``documents``; the last returns tokens.
SQL cannot express the first, third, fourth and last stage, so ``ORACLE_SQL`` is None and the tests hold the stages against
brute-force versions.

Awkward rows: null texts pass as null up to the last stage, where they have no tokens; empty tables give empty results;
rows with a null id are never near duplicates; of rows that repeat both id and text the near-duplicate stage keeps one, and
rows of one id with different texts are different documents to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, line_dedup, ngram_jaccard, toxicity
from tessera.llm.lm_scoring import crc_remainder
from tessera.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more by the class-conditional models go."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) == 0)
    return toxicity.score(docs, model, score_col="__score").filter("__score < 0.5").select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters that 5 or more documents hold stay in the last of them alone."""
    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word shingle similarity of 0.8 or more, the one with the least id stays."""
    groups = ngram_jaccard.jaccard_components(docs, width=5, percent=80).filter("doc_id = component_id")
    alone = F.when(F.col("component").isNull(), F.col("text_hash"))          # texts without words link with nothing
    stays = groups.groupBy("component", "doc_id", alone.alias("alone")).agg(F.min("text_hash").alias("__text_hash"))
    one = (docs.withColumn("__text_hash", F.xxhash64("text"))
           .join(stays.select("doc_id", "__text_hash").hint("merge"), ["doc_id", "__text_hash"], "left_semi")
           .dropDuplicates(["doc_id", "__text_hash"]))
    return one.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item, up to its edit budget, go."""
    found = decontamination.leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text left, and digests of them and of the decoded text."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                                   F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
