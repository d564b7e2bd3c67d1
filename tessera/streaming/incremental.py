"""Incremental document feed (STM-01) with an extraction log (STM-02).

A file-source stream of new documents is processed in micro-batches with ``foreachBatch``: documents
whose id is already in the status table are skipped (left anti join), the rest are normalised and
appended to the output, their ids are appended to the status table with the processing time, and one
log row per document records outcome, type and duration. ``Trigger.AvailableNow`` drains what is there
and stops; the checkpoint makes the feed restartable (a lost executor or driver resumes from the last
committed batch, every batch overwrites its own folder, and the anti join skips what other batches processed).
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import ensure_checkpoint_dir

LOG_TYPES = ("HTML", "PDF", "PDF ESCANEADO")


def feed_paths(spark: SparkSession, name: str | None = None) -> dict:
    """Output, status, log and checkpoint folders under the shared ``spark.checkpoint.dir``."""
    root = os.path.join(ensure_checkpoint_dir(spark), "incremental", name or uuid.uuid4().hex)
    return {k: os.path.join(root, k) for k in ("out", "status", "log", "checkpoint")}


def _table_or_empty(spark, path, schema):
    """The table, or an empty one where nothing was written yet; any other failure is raised."""
    try:
        return spark.read.schema(schema + ", batch_id long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema + ", batch_id long")


def process_batch(batch: DataFrame, batch_id: int, paths: dict, stopwords, id_col: str = "doc_id") -> None:
    """Process the rows of a batch that no other batch has processed.

    Output, status and log are each written under the batch's own id in overwrite mode, and the batch's earlier attempts are
    not looked at, so a retry after a crash between two of the writes replaces what it left.
    """
    spark, began = batch.sparkSession, time.time()
    status = _table_or_empty(spark, paths["status"], f"{id_col} long, cd_status string, dh_processamento timestamp")
    status = status.filter(F.col("batch_id") != batch_id)
    new = batch.dropDuplicates([id_col]).join(status.select(id_col), id_col, "left_anti")
    ok = F.col("text").isNotNull()
    done = new.select(id_col, "source", tx.processed_tokens("text", stopwords, 3).alias("tokens"), ok.alias("ok"),
                      F.when(F.col("text").contains("<"), "HTML").otherwise("PDF").alias("doc_type"))
    done = done.withColumn("n_tokens", F.size("tokens")).withColumn("processed", tx.join_tokens("tokens")).drop("tokens")

    def write(df, name):
        df.write.mode("overwrite").parquet(os.path.join(paths[name], f"batch_id={batch_id}"))

    write(done.filter("ok").drop("ok"), "out")
    took = (time.time() - began) * 1e6                       # of the batch: reading, processing and writing its output
    now = F.current_timestamp()
    # extraction log: outcome S or N, the reason of a failure, a known type
    write(done.select(id_col, F.when(F.col("ok"), "S").otherwise("N").alias("in_sucesso"),
                      F.when(~F.col("ok"), "no text").alias("ds_erro"), F.col("doc_type").alias("cd_tipo_documento"),
                      now.alias("dh_processamento"), F.lit(took).alias("duration_us"))
          .filter(F.col("in_sucesso").isin("S", "N") & F.col("cd_tipo_documento").isin(*LOG_TYPES)), "log")
    # last: a row counts as processed when its output and log are complete; a failed one is tried again
    write(done.filter("ok").select(id_col, F.lit("I").alias("cd_status"), now.alias("dh_processamento")), "status")


def run_feed(spark: SparkSession, source_dir: str, schema, paths: dict, stopwords, glob: str = "*.parquet",
             max_files_per_trigger: int = 1) -> None:
    """Drain the source folder once (AvailableNow) and stop."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    q = (stream.writeStream.foreachBatch(lambda df, bid: process_batch(df, bid, paths, stopwords))
         .option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True).start())
    q.awaitTermination()


def checked_log(log: DataFrame) -> DataFrame:
    """The log with ``valid``: outcome S or N, an error exactly where it is N, a known type, a time and a duration that is not negative."""
    ok = (F.col("in_sucesso").isin("S", "N") & ((F.col("in_sucesso") == "N") == F.col("ds_erro").isNotNull())
          & F.col("cd_tipo_documento").isin(*LOG_TYPES) & F.col("dh_processamento").isNotNull() & (F.col("duration_us") >= 0))
    return log.withColumn("valid", F.coalesce(ok, F.lit(False)))
