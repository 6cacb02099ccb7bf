"""Logical views that the queries share, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: vectors scaled by 1 + vec_id % 5: unit vectors can't tell cosine from Lp.
V_SQL = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 5)) AS v, label FROM embeddings)"
#: one centroid of each label
C_SQL = """c AS (SELECT label AS cid, list(m ORDER BY p) AS c FROM (
    SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM v) GROUP BY label, p) GROUP BY label)"""
CENTROID_DIGITS = 12


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, scaled: bool = True) -> DataFrame:
    """(id, v array<double>, label)"""
    by = (1 + F.col("vec_id") % 5) if scaled else F.lit(1)
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * by).alias("v"), "label")


def centroids(v: DataFrame) -> DataFrame:
    """(cid, c): the mean vector of each label"""
    parts = v.select("label", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("m"))
    return parts.groupBy(F.col("label").cast("long").alias("cid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c"))


def r(c, digits: int = 6):
    """Rounded, with -0.0 as 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, quality, toxic), -1 where a document has no label"""
    d, l = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return d.select(F.col("doc_id").alias("idx")).join(l, F.col("idx") == F.col("doc_id"), "left").select("idx", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def order_key(seed: int, c):
    """Deterministic permutation key: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def uniform(seed: int, c):
    """[0, 1) from the first 13 hex digits of the same md5."""
    return F.conv(F.substring(order_key(seed, c), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def uniform_sql(seed: int, c: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || CAST({c} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)"
