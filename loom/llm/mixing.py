"""Mixing sources to target weights, DataFrame functions only.

Every document gets a hash-random key. Within its source, documents stand in the order of that key;
word counts are summed up along it in two steps (totals of key ranges, then running sums inside each
range), and the source is cut at its exact budget, going round a second time where the budget is more
than the source has. The key ranges hold a few thousand rows whatever the source, so a source with a
third of all rows is as many tasks' work as its size asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loom.llm.common import WHITE_CLASS, global_index, named, text_of, word_count, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
ROWS_PER_RANGE, MOST_RANGES = 1024, 65_536


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(mx_key, mx_source, source_size) with `target` (double).

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; a target
    above `most` times its source is held there and the excess goes round again by weight. Only two sums
    a round come to the driver; the sources stay distributed."""
    w = F.lit(weights[-1])
    for i, x in reversed(list(enumerate(weights[:-1]))):
        w = F.when(F.col("mx_at") % len(weights) == i, x).otherwise(w)
    ranked = written(global_index(sizes, [F.col("mx_source").asc_nulls_last()], "mx_at").withColumn("mx_w", w.cast("double")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level, held = 0.0, None
    while True:
        full = cap <= F.lit(level) * F.col("mx_w") if held is not None else F.lit(False)
        got = ranked.agg(F.sum(F.when(full, F.col("source_size"))).alias("c"), F.sum(F.when(~full, F.col("mx_w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if got["w"] is None or got["n"] == held:
            break
        held = got["n"]
        level = (share * total - most * (got["c"] or 0)) / got["w"]
    target = F.least(cap, F.lit(level) * F.col("mx_w"))
    return ranked.select("mx_key", "mx_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=0, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per document: the id, size, source_size, target (double) and taken (long).

    taken counts words, repeats included: a document wholly inside both rounds has twice its size, the
    documents at a cut have part of it, the rest 0. The taken words of a source are its target without
    its fraction. The key is md5 of seed, id and text, so runs agree whatever the partitions.

    Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last;
    an empty table gives an empty one; rows equal in id and text have equal keys and are interchangeable;
    other columns play no part.
    """
    rows = _mix(docs, [id_col], id_col, text_col, source_col, seed, weights, share, most)
    return rows.select(F.col("mx_c0").alias(id_col), F.col("mx_size").alias("size"), F.col("source_size"), F.col("target"), F.col("mx_taken").alias("taken"))


def _mix(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str, seed, weights, share, most) -> DataFrame:
    """mx_c0, mx_c1, ... (the columns `carry`, the id first), mx_size, source_size, target, mx_taken."""
    text = text_of(text_col)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), named(id_col).cast("string"), text))
    size = word_count(text)
    source = named(source_col).cast("string")
    made = [F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("mx_key"), source.alias("mx_source"), size.alias("mx_size"), key.alias("mx_hash")]
    rows = docs.select(*[named(c).alias(f"mx_c{i}") for i, c in enumerate(carry)], *made)
    slim = text_col not in carry
    if slim:  # texts stay behind: one pass over them, then both uses read a few bytes a row
        rows = written(rows, "sizes")
    n = (rows if slim else docs).count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    part = F.shiftright(F.conv(F.substring("mx_hash", 1, 8), 16, 10).cast("long") * ranges, 32)
    rows = rows.withColumn("mx_part", part)
    totals = written(rows.groupBy("mx_key", "mx_source", "mx_part").agg(F.sum("mx_size").alias("mx_sum")), "totals")
    targets = source_targets(totals.groupBy("mx_key", "mx_source").agg(F.sum("mx_sum").alias("source_size")), weights, share, most)
    offsets = totals.withColumn("mx_off", F.sum("mx_sum").over(Window.partitionBy("mx_key").orderBy("mx_part")) - F.col("mx_sum"))
    offsets = written(offsets.select("mx_key", "mx_part", "mx_off").join(targets.drop("mx_source"), "mx_key"), "offsets")
    inside = Window.partitionBy("mx_key", "mx_part").orderBy("mx_hash", "mx_c0").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mx_run", F.sum("mx_size").over(inside) - F.col("mx_size")).join(offsets, ["mx_key", "mx_part"])
    at = F.col("mx_off") + F.col("mx_run")
    budget = F.floor("target")
    part_of = lambda left: F.greatest(F.lit(0).cast("long"), F.least(F.col("mx_size"), left))
    taken = part_of(budget - at)
    for again in range(1, math.ceil(most)):
        taken = taken + part_of(budget - F.col("source_size") * again - at)
    return rows.select(*[f"mx_c{i}" for i in range(len(carry))], "mx_size", "source_size", "target", taken.cast("long").alias("mx_taken"))


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=0, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, its columns as they were, whatever their names.
    A document cut short at a budget keeps its first words, joined by single spaces.

    Defined cases: as in `mix`; a document without words is never taken, so it goes; repeated rows are documents
    of their own; an empty table gives an empty one.
    """
    own = docs.columns
    carry = [id_col, *[c for c in own if c != id_col]]
    place = {c: f"mx_c{i}" for i, c in enumerate(carry)}
    out = _mix(docs, carry, id_col, text_col, source_col, seed, weights, share, most)
    whole = F.floor(F.col("mx_taken") / F.greatest(F.col("mx_size"), F.lit(1))).cast("int")
    rest = F.col("mx_taken") - whole * F.col("mx_size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<bigint>)")))
    out = out.select(*place.values(), F.explode(copies).alias("mx_words"))
    text = F.col(place[text_col])
    words = F.filter(F.split(text, f"[{WHITE_CLASS}]+"), lambda x: x != "")
    cut = F.array_join(F.slice(words, 1, F.greatest(F.col("mx_words"), F.lit(1)).cast("int")), " ")
    return out.select(*[F.when(F.col("mx_words") < 0, text).otherwise(cut).alias(c) if c == text_col else F.col(place[c]).alias(c) for c in own])


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents

    return mix(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size / w AS ratio, sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER lower, 0) AS held, sum(w) OVER rest AS left_w FROM r
      WINDOW lower AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             rest AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, (1.5::DOUBLE * total - 2 * held) / left_w AS level FROM c),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT first(level ORDER BY ratio, source NULLS LAST) FILTER (ratio > level) FROM v)) AS target FROM v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - pos)) + greatest(0, least(size, floor(target) - source_size - pos)) AS BIGINT) AS taken
FROM p
"""
