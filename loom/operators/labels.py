"""Labelled-sample catalogs: class encoding, selection, splits and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.operators.ordering import in_order, numbered, shuffled

UNLABELED = -1


def class_index(df: DataFrame, class_col: str, name: str = "target", classes: list[str] | None = None) -> DataFrame:
    """df with the place of its class among the sorted distinct classes, or in the list given (rows of other
    classes are dropped then). Distinct classes are sorted; more than a few by ranges, in many tasks."""
    if classes is None:
        found = numbered(df.select(class_col).distinct(), name, [class_col])
    else:
        found = df.sparkSession.createDataFrame(list(zip(classes, range(len(classes)))), f"{class_col} string, {name} int")
    return df.join(found, class_col)


def path_of(url: Column) -> Column:
    """A URL without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")


def parent_name(path: Column) -> Column:
    """The name of the directory a path lies in: its class."""
    return F.element_at(F.split(path, "/"), -2)


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Case-insensitive suffix test."""
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [F.endswith(low, F.lit(e.lower())) for e in extensions])


def scan(paths: DataFrame, extensions: list[str], keep: Column | None = None, domain: int | None = None) -> DataFrame:
    """(path, class[, domain]) of listed paths with one of the extensions; `keep` is a further predicate."""
    out = paths.filter(has_extension(F.col("path"), extensions))
    if keep is not None:
        out = out.filter(keep)
    out = out.withColumn("class", parent_name(F.col("path")))
    return out if domain is None else out.withColumn("domain", F.lit(domain))


def listed(df: DataFrame, names: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose value stands in the list."""
    return df.join(names.select(F.col(right).alias("__listed")), F.col(left) == F.col("__listed"), "left_semi")


def looked_up(df: DataFrame, annotations: DataFrame, left: str, right: str) -> DataFrame:
    """Inner lookup that must match: raises ValueError if a row of df has no annotation."""
    lost = df.join(annotations, F.col(left) == F.col(right), "left_anti").limit(1).count()
    if lost:
        raise ValueError(f"rows of {left} have no annotation")
    return df.join(annotations, F.col(left) == F.col(right))


def taken(df: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """Rows by a list (pos, id), with their new positions."""
    return wanted.join(df, id_col)


def ratio_split(df: DataFrame, id_col: str, ratio: float, seed: int = 0) -> DataFrame:
    """df with `train`: whether a row is among the first floor(rows * ratio) of the seeded permutation."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio lies between 0 and 1")
    return shuffled(df, "__pos", seed, id_col).withColumn("train", F.col("__pos") < int(df.count() * ratio)).drop("__pos")


def every_nth(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """df with `holdout`: every n-th row in the order of ids."""
    return in_order(df, "__pos", id_col).withColumn("holdout", F.col("__pos") % n == n - 1).drop("__pos")


def union_domains(parts: list[DataFrame]) -> DataFrame:
    """One after the other, each with its number as `domain`."""
    return reduce(DataFrame.unionByName, [p.withColumn("domain", F.lit(i)) for i, p in enumerate(parts)])


def union_offsets(parts: list[DataFrame], target: str = "target") -> DataFrame:
    """One after the other, targets moved up by the numbers of classes before."""
    out, offset = [], 0
    for i, p in enumerate(parts):
        out.append(p.withColumn(target, (F.col(target) + offset).cast("int")).withColumn("part", F.lit(i)))
        offset += (p.agg(F.max(target)).first()[0] or 0) + 1 if i < len(parts) - 1 else 0
    return reduce(DataFrame.unionByName, out)


def numeric_first(names: DataFrame, col: str) -> DataFrame:
    """Distinct names with their place: digits in numeric order, then the others by code point."""
    digits = F.col(col).rlike("^[0-9]+$")
    order = [F.when(digits, 0).otherwise(1), F.when(digits, F.expr(f"try_cast({col} AS BIGINT)")), F.col(col)]
    return numbered(names.select(col).distinct(), "pos", order)


def name_list(lines: DataFrame) -> DataFrame:
    """(name) of a text list (spark.read.text): one per line, blank lines dropped."""
    return lines.select(F.trim("value").alias("name")).filter("name <> ''")


def first_fields(lines: DataFrame, sep: str = " ") -> DataFrame:
    """(name): the first field of every line."""
    return name_list(lines.select(F.split(F.col("value"), sep)[0].alias("value")))


def annotations(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """(name, label): the first two fields of every line."""
    parts = F.split(F.col("value"), sep)
    return lines.filter(F.trim("value") != "").select(parts[0].alias("name"), F.trim(parts[1]).alias("label"))
