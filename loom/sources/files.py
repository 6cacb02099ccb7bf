"""Files and folders by any path that pyarrow's file systems or Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(path: str):
    """(file system, path in it), for file:, hdfs:, s3:, gs: and plain paths."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file to read and seek in."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rel, size) of all files below a folder, rel being the path from there; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = jvm.Path(folder)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return found.select("path", F.substr(plain(F.col("path")), F.length(plain(F.lit(top))) + 1).alias("rel"), F.col("length").alias("size"))
