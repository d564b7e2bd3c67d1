"""Sinks (SNK-01..07): partitioned overwrite, append, table load, prediction and locale CSV writers,
model persistence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType


def write_overwrite(df: DataFrame, path: str, partition_by=("region",), fmt: str = "parquet", **opts) -> None:
    """Replace the output (SNK-01). With ``partitionOverwriteMode=dynamic`` only touched partitions change."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).options(**opts).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet", **opts) -> None:
    """Append rows without a key; a retry appends them again, which ``append_run`` does not."""
    df.write.mode("append").format(fmt).options(**opts).save(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Append the rows of one run (SNK-02): CSV in a folder of the run's own, which a retry replaces, so a run is never there twice. The
    column names are written once, in ``header``."""
    df.write.mode("overwrite").option("header", False).option("quoteAll", True).option("emptyValue", "").csv(f"{path.rstrip('/')}/rows/run={run}")
    names = df.sparkSession.createDataFrame([(",".join(df.columns),)], "names string")
    names.coalesce(1).write.mode("ignore").text(f"{path.rstrip('/')}/header")


def read_runs(spark, path: str, schema: str) -> DataFrame:
    """All runs with their key, columns bound in the order of the header."""
    names = spark.read.text(f"{path.rstrip('/')}/header").first()[0].split(",")
    fields = {f.name: f for f in StructType.fromDDL(schema)}
    return spark.read.schema(StructType([*[fields[n] for n in names], StructField("run", StringType())])).csv(f"{path.rstrip('/')}/rows")


def clean_columns(df: DataFrame) -> DataFrame:
    """Spaces (and other non-identifier characters) in column names become '_' (SNK-03)."""
    return df.toDF(*[re.sub(r"\W", "_", c.strip()) for c in df.columns])


def load_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Drop-and-create table load (SNK-03), in the warehouse or under ``path``."""
    w = clean_columns(df).write.mode("overwrite")
    (w.option("path", path) if path else w).saveAsTable(name)


def write_predictions(df: DataFrame, path: str, model_col: str = "modelo") -> None:
    """One prediction set per model (SNK-04)."""
    df.write.mode("overwrite").partitionBy(model_col).parquet(path)


def with_decimal_comma(df: DataFrame) -> DataFrame:
    """Floating columns rendered with a decimal comma (SNK-05)."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out = out.withColumn(f.name, F.translate(F.col(f.name).cast("string"), ".", ","))
    return out


def write_locale_csv(df: DataFrame, path: str, sep: str = "#") -> None:
    with_decimal_comma(df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Summary tables (SNK-07); one file, since a summary has few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_model(model, path: str) -> None:
    """Fitted MLlib pipelines/models and BM25 models (SNK-06)."""
    model.write().overwrite().save(path)
