"""Where iterative plans are cut: tables in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on a local master, where none is set, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicgrove-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "held") -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.append(path)
    return path


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read again, so that plans do not double with each round."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` held in a bucketed table, so that a join on ``keys`` shuffles its other side alone, however often it is made."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "dealt")
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"dealt_{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def clean_up(spark: SparkSession) -> None:
    """Delete what this process has held; results that read it must have been saved before."""
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for table in spark.catalog.listTables():
        if table.name.startswith("dealt_"):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
