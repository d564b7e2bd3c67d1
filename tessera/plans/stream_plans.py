"""Incremental feed query (STM-01/02): the streamed, de-duplicated, normalised output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import incremental as inc
from . import sqlfrag as q
from .registry import query
from .text_plans import STOP, _sql_stop_list


def _documents(sf: str) -> str:
    """The table's file or folder of files: as a pattern, since a stream takes no plain path of one file."""
    return f"{sf.rstrip('/')}/{{documents.parquet}}"


@query("incremental_feed", f"""
SELECT doc_id, source, CAST(len(list_filter(string_split({q.token_string('text')}, ' '),
       lambda x: length(x) > 3 AND NOT list_contains({_sql_stop_list(STOP)}, x))) AS INTEGER) AS n_tokens
FROM documents
""", ops=("STM-01", "STM-02", "JN-12"))
def incremental_feed(spark, sf):
    """Stream the documents file through the feed twice; the second run must add nothing."""
    schema = table(spark, sf, "documents").schema
    paths = inc.feed_paths(spark)
    for _ in range(2):
        inc.run_feed(spark, _documents(sf), schema, paths, STOP)
    return spark.read.parquet(paths["out"]).select("doc_id", "source", "n_tokens")


@query("extraction_log", """
SELECT doc_id, CASE WHEN text IS NULL THEN 'N' ELSE 'S' END AS in_sucesso, CASE WHEN text IS NULL THEN 'no text' END AS ds_erro,
       CASE WHEN contains(coalesce(text, ''), '<') THEN 'HTML' ELSE 'PDF' END AS cd_tipo_documento, true AS valid
FROM documents
""", ops=("STM-02",))
def extraction_log(spark, sf):
    """The feed's log after a run and a repeated one: outcome, error and type of every document, and whether the row keeps the log's rules."""
    paths = inc.feed_paths(spark)
    for _ in range(2):
        inc.run_feed(spark, _documents(sf), table(spark, sf, "documents").schema, paths, STOP)
    return inc.checked_log(spark.read.parquet(paths["log"])).select("doc_id", "in_sucesso", "ds_erro", "cd_tipo_documento", "valid")
