"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rivergraph.errors import RiverGraphError


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RiverGraphError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rivergraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/rivergraph-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet and read it back: cuts the lineage, and every later reader sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_tables(spark: SparkSession) -> set[str]:
    """Names of what the scratch folder holds now."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(x.getPath().getName()) for x in folder.listStatus(path)} if folder.exists(path) else set()


def drop_scratch(spark: SparkSession, names: set[str]) -> None:
    """Delete these tables. Call it when no result still reads from them."""
    for name in names:
        _deleted(spark, f"{shared_dir(spark)}/{name}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what stored() wrote in this application. Call it when no result still reads from there."""
    _deleted(spark, shared_dir(spark))
