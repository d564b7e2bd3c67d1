"""Session construction and lineage cutting.

On a cluster the session is created by the platform; these helpers only fill in settings that are
unset, so a cluster-provided ``spark.checkpoint.dir`` (a shared folder) is always respected.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that make the plans in this package behave well at scale: adaptive execution re-plans joins
# from runtime sizes, splits skewed shuffle partitions, and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the scale settings above.

    ``master`` and ``shuffle_partitions`` are only applied when given, so a cluster launcher keeps control.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's value always wins. Only when the setting is absent in local mode (tests) is a fresh scratch
    folder created and recorded in the session; elsewhere each executor would write to its own disk, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete an intermediate table when the driver ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)


#: Has Spark delete the shuffle files of a query that has ended; otherwise they stay until the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """What is run inside leaves no shuffle files. For a DataFrame that is run once: a second run would have to shuffle again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, name: str = "t") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One write job (no recomputation, unlike an RDD checkpoint of an unpersisted plan); the result survives
    executor loss, has a short lineage, and later scans still prune columns and push filters. Shuffle files of the job go with its end.
    """
    import uuid
    root = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex}")
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete an intermediate table that ``cut_lineage`` wrote and nothing reads any more."""
    files = df.inputFiles()
    root = os.path.join(ensure_checkpoint_dir(df.sparkSession), "tables").removeprefix("file://")
    if files and root.lstrip("/") in files[0]:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        where.getFileSystem(conf).delete(where, True)
