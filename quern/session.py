"""Session helpers: what a job needs from the cluster it runs on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it was not installed or shipped."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches than Spark's default, as rows hold whole texts: less memory in executors and workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on this
    machine, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quern-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def staged(df: DataFrame, release: bool = True) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here and survives lost executors. release:
    let go of the shuffle files of ended jobs before and after, which small tables need not wait for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern-{uuid.uuid4().hex}"
    if release:
        release_shuffles(spark)
    df.write.parquet(path)
    if release:
        release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete staged tables. Only for those that no later step reads: what came of them is staged itself."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
