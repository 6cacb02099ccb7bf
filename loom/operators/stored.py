"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where that is unset and the session runs on this machine alone (tests, a
    laptop), a folder is made and set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under shared_dir, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path)


def dropped(*tables: DataFrame | str) -> None:
    """Deletes tables that `written` gave, or folders of `fresh_path`, before the session ends. Only for what nothing still reads: a
    round's tables once the next round's are written."""
    for t in tables:
        path = t
        if not isinstance(t, str):
            files = t.inputFiles()
            path = files[0].rsplit("/", 1)[0] if files else None
        if path and "/loom-" in path:
            sc = (SparkSession.active() if isinstance(t, str) else t.sparkSession).sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
