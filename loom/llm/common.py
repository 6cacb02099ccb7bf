"""What the operators of this subpackage share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.operators.stored import fresh_path, shared_dir, written  # noqa: F401

#: The white space of the contracts: space, \t, \n, \v, \f, \r.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a character class for Java and RE2 patterns.
WHITE_CLASS = r"\x20\x09-\x0D"


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of [^ \\t-\\r]+ runs: each word with the white space after it becomes one character."""
    return F.length(F.regexp_replace(F.ltrim(text, F.lit(WHITE)), f"[^{WHITE_CLASS}]+[{WHITE_CLASS}]*", "x")).cast("long")


def named(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Fewer keys than this are sent to all executors because many rows have them.
OFTEN = 65_536


def met(rows: DataFrame, groups: DataFrame, on, count: str, total: int, often: int = OFTEN) -> DataFrame:
    """rows joined with `groups`, which has one row for each key and the number of its rows in `count`, `total` together.
    Keys of more than total / often rows, which are fewer than `often` at any size, are broadcast, so that none of them is
    one task's join; the others, none of which has a larger share, meet by a shuffle."""
    most = max(1, total // max(1, often))
    hot = F.broadcast(groups.filter(F.col(count) > most))
    cold = groups.filter(F.col(count) <= most)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on))


def ranges(column, most: int = 1 << 20):
    """Index ranges of a string or binary Arrow array whose values are about `most` bytes together (one longer value alone)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def slices(batches, column: int = -1, most: int = 2 << 20):
    """Arrow batches cut into slices by the bytes of one column, so that no more than `most` (or one longer value)
    becomes Python objects at a time."""
    import pyarrow as pa

    for b in batches:
        for a, z in ranges(b.column(column if column >= 0 else b.num_columns + column), most):
            yield b.slice(a, z - a)
        del b
        pa.default_memory_pool().release_unused()


def texts_of(column) -> list[bytes]:
    """The values of a string column in UTF-8; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def parts_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """How many partitions so many bytes are dealt into: the session's number, or more where they would be over `each`."""
    return max(parts(spark), -(-int(size) // each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single_thread() -> None:
    """Executors give each task one core; numeric libraries must not take more."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with column `name`: the position from 0 in that order. No task gets all rows: rows are
    range-partitioned and written, partitions are counted, and positions are numbered inside each."""
    from pyspark.sql import Window

    n = parts(df.sparkSession)
    t = written(df.repartitionByRange(n, *order).withColumn("__gi_part", F.spark_partition_id()), "index")
    base = (
        t.groupBy("__gi_part").agg(F.count(F.lit(1)).alias("__gi_n"))
        .withColumn("__gi_base", F.sum("__gi_n").over(Window.orderBy("__gi_part")) - F.col("__gi_n"))
        .drop("__gi_n")
    )
    at = F.row_number().over(Window.partitionBy("__gi_part").orderBy(*order)) - 1
    return t.join(base, "__gi_part").withColumn(name, (F.col("__gi_base") + at).cast("long")).drop("__gi_part", "__gi_base")
