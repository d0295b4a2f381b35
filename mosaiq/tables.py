"""Reading given tables, and intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir: one that driver and executors share. Where it is unset
    and all run in one process (tests), a local one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and spark.sparkContext.master.split("[")[0] == "local":
        conf = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    if not conf:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    return conf.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The path as Hadoop has it, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: later jobs survive a lost executor without redoing df.

    The table is removed when the application ends, or by freed()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Removes tables of written() that no later job reads."""
    for t in tables:
        where, files = _path(t.sparkSession, t.written_at)
        files.delete(where, True)
