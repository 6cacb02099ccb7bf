"""Positions in a total order without a task that gets all rows.

Rows are dealt into ranges of the order, whose bounds Spark samples from the rows themselves, sorted there, and written once
with their places in the range. Ranges are counted, the counts summed up, and a row's position is its place and the rows
before its range; nothing is sorted or scanned a second time, and no group or gap of ids makes a range larger."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loom.operators.stored import written

#: The place in the partition, in Spark's increasing ids.
_PLACE = (1 << 33) - 1


def shuffle_key(seed: int, c: Column) -> Column:
    """Stands in for a seeded random permutation: the order of md5(seed:value)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def uniform_number(seed: int, value) -> float:
    """[0, 1) from the first 13 hexadecimal digits of the same md5."""
    return int(hashlib.md5(f"{seed}:{value}".encode()).hexdigest()[:13], 16) / (1 << 52)


def positions(df: DataFrame, name: str, order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `name` (long): the position from 0 in `order` within each group of the columns `by`."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*map(F.col, by), *order]
    row = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"__range": F.shiftright(row, 33), "__place": row.bitwiseAND(F.lit(_PLACE))})
    rows = written(rows, "positions")
    counts = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__range") if by else Window.orderBy("__range")  # a row for each group and range
    base = (F.sum("__n").over(before) - F.col("__n") - F.col("__first")).alias("__base")
    base = counts.select(*[F.col(k).alias(f"__o_{k}") for k in by], F.col("__range").alias("__o_range"), base)
    on = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in by] + [F.col("__range") == F.col("__o_range")]
    return rows.join(base, on).select(*df.columns, (F.col("__place") + F.col("__base")).cast("long").alias(name))


def shuffled(df: DataFrame, name: str, seed: int, id_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    return positions(df, name, [shuffle_key(seed, F.col(id_col)), F.col(id_col)], by)


def in_order(df: DataFrame, name: str, id_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    return positions(df, name, [F.col(id_col)], by)


#: Distinct values up to so many are numbered in one task.
FEW = 100_000


def numbered(values: DataFrame, name: str, order: list) -> DataFrame:
    """values, which are distinct, with `name` (int): their position from 0 in `order`. A few in one task, more by ranges."""
    if values.limit(FEW + 1).count() <= FEW:
        return values.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    return positions(values, name, [F.col(c) if isinstance(c, str) else c for c in order]).withColumn(name, F.col(name).cast("int"))
