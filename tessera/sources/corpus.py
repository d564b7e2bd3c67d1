"""File sources of the reference's corpora (SRC-01..03, SRC-08..12).

All readers are lazy DataFrame readers with explicit schemas (no inference pass over the data) and
bind columns by name after reading.
"""

from __future__ import annotations

import functools
import time
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

# The positional layout of a raw regional corpus file (14 columns, no header).
RAW_COLUMNS = [
    ("index", LongType()), ("nr_processo", StringType()), ("id_processo_documento", LongType()),
    ("cd_assunto_nivel_5", IntegerType()), ("cd_assunto_nivel_4", IntegerType()), ("cd_assunto_nivel_3", IntegerType()),
    ("cd_assunto_nivel_2", IntegerType()), ("cd_assunto_nivel_1", IntegerType()), ("tx_conteudo_documento", StringType()),
    ("ds_identificador_unico", StringType()), ("ds_identificador_unico_simplificado", StringType()),
    ("ds_orgao_julgador", StringType()), ("ds_orgao_julgador_colegiado", StringType()), ("dt_juntada", TimestampType()),
]
RAW_SCHEMA = StructType([StructField(n, t, True) for n, t in RAW_COLUMNS])
RAW_PATTERN = "TRT_{region}_documentosSelecionados.csv"
REGION_REGEX = r"TRT_(\d{2})_"


def region_glob(base: str, regions, pattern: str = RAW_PATTERN) -> str:
    """Hadoop glob over the requested regions only (``{01,02,...}``); absent files simply do not match,
    so a missing region is skipped rather than an error (SRC-02)."""
    codes = ",".join(f"{int(r):02d}" for r in regions)
    return f"{base.rstrip('/')}/" + pattern.format(region="{" + codes + "}")


def read_regional_corpus(spark: SparkSession, base: str, regions=range(1, 25), pattern: str = RAW_PATTERN) -> DataFrame:
    """Raw regional corpus: positional 14-column CSV, all fields quoted, multi-line HTML bodies (SRC-01).

    Adds ``sigla_trt`` ('TRT' + two digits) from the file name.
    """
    df = (spark.read.schema(RAW_SCHEMA).option("header", False).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .csv(region_glob(base, regions, pattern)))
    code = F.regexp_extract(F.col("_metadata.file_path"), REGION_REGEX, 1)
    return df.withColumn("sigla_trt", F.concat(F.lit("TRT"), code))


def read_processed_corpus(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Processed corpus: '#' separated, quoted, with header (SRC-03)."""
    r = spark.read.option("header", True).option("sep", "#").option("quote", '"').option("escape", '"') \
        .option("multiLine", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(path)


def write_regional_corpus(df: DataFrame, base: str, region_col: str = "region") -> None:
    """Write rows in the raw positional layout, one folder per region named like the reference's
    ``TRT_XX_documentosSelecionados.csv`` files (inverse of ``read_regional_corpus``)."""
    folder = F.concat(F.lit("TRT_"), F.lpad(F.col(region_col).cast("string"), 2, "0"), F.lit("_documentosSelecionados.csv"))
    out = df.select(*[F.col(n).cast(t) for n, t in RAW_COLUMNS], folder.alias("file"))
    (out.write.mode("overwrite").partitionBy("file").option("header", False).option("quoteAll", True)
     .option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(base))


def read_semicolon(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """';' separated file with header; a ragged trailing separator yields an extra empty field that the
    explicit schema leaves out (SRC-09)."""
    return (spark.read.schema(schema).option("header", True).option("sep", ";").option("mode", "PERMISSIVE")
            .option("enforceSchema", False).csv(path))


CHI_SCHEMA = StructType([StructField("Esperado", DoubleType()), StructField("Observado", DoubleType())])


def read_hierarchy_lookup(spark: SparkSession, path: str, levels: int = 5) -> DataFrame:
    """Hierarchy lookup table ``cd_assunto_nivel_1..5``; missing levels become 0 (SRC-08)."""
    schema = StructType([StructField(f"cd_assunto_nivel_{i}", LongType()) for i in range(1, levels + 1)])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.fillna(0)


def selection_sheet(df: DataFrame, columns, flag_col: str, flag_value, order_col: str) -> DataFrame:
    """Project the sheet's columns, keep the selected rows, sort by code (SRC-10)."""
    return df.select(*columns).filter(F.col(flag_col) == flag_value).orderBy(order_col)


def keyset_batches(df: DataFrame, key: str, predicate=None, fields=None, batch_size: int = 1000) -> DataFrame:
    """Cursor read as keyset batches: filter, project, and number the batches in key order (SRC-05, SRC-11).

    The batch number comes from a bucketed dense rank (``common.dense_index``), never a single-task sort."""
    from ..operators.common import dense_index
    d = df.filter(predicate) if predicate is not None else df
    if fields:
        d = d.select(*fields)
    ix = dense_index(d, key, "_ix", order=[(F.col(key), True)],
                     buckets=[(F.floor(F.col(key) / F.lit(max(batch_size, 1) * 8)), True)])
    return ix.withColumn("batch", (F.col("_ix") / batch_size).cast("long")).drop("_ix")


def flag_write_back(base: DataFrame, ids: DataFrame, key: str, field: str, flag) -> DataFrame:
    """Set ``field`` = ``flag`` for the listed ids, keep the rest (SRC-12): a new version, not an in-place update."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    j = base.join(hit, key, "left")
    return j.withColumn(field, F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col(field))).drop("_hit")


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int,
                     num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Range-partitioned relational scan (SRC-04): Spark issues one half-open id window per partition,
    in parallel, instead of the reference's sequential windows."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


STATUS = "region string, outcome string, n_rows long, attempts int, error string, seconds double"


def read_regions(spark: SparkSession, readers: dict, retries: int = 1, parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """Federated scan that survives its sources (SRC-06): (rows of all good regions with their region, one status row a region).

    ``readers``: region -> function of the session that gives its DataFrame. Each region is read to the end in an action of its own, into the shared folder; an
    error is caught and tried ``retries`` times more. The status is ok, empty, or failed with the error's first line; a failing region
    does not stop the others.
    """
    from ..session import cut_lineage

    def read(item):
        region, reader = item
        began, error = time.time(), None
        for attempt in range(1, retries + 2):
            try:
                df = cut_lineage(reader(spark).withColumn("region", F.lit(region)), "region")
                n = df.count()
                return df, (region, "ok" if n else "empty", n, attempt, None, time.time() - began)
            except (PySparkException, Py4JError, OSError) as e:
                error = str(e).strip().split("\n")[0][:500]
        return None, (region, "failed", 0, retries + 1, error, time.time() - began)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        found = list(pool.map(read, readers.items()))
    good = [df for df, _ in found if df is not None]
    rows = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), good) if good else None
    return rows, spark.createDataFrame([status for _, status in found], STATUS)
