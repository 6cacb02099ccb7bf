"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition becomes one sorted run of digests, cut into digest ranges. In each round the
partitions of a range exchange runs binomially: run i goes to the task of run i >> FAN_BITS, which
merges the sorted runs that meet there (the JVM's external sort is the multiway merge; a streaming
pass in Arrow batches folds equal neighbours). A fold keeps, for each digest, the smallest identifier
by the keeping rule and the number of rows, and only folds rows whose second fingerprint agrees.
A text that a third of all rows share is one row of each run, so no task ever gets its group; its rows
learn their group from a bounded broadcast, those of smaller groups by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import WHITE, met, named, parts_for, text_of, written

FAN_BITS = 3
RUN = ["xd_range", "xd_run", "xd_sha", "xd_len", "xd_check"]
RUN_SCHEMA = "xd_range int, xd_run long, xd_sha binary, xd_len int, xd_check long, xd_chars int, xd_null boolean, xd_id long, xd_uid long, xd_count long"


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds neighbours of a sorted run that agree in digest and fingerprint: the first one stays (the
    sort has put the row to keep first), and counts are added. One open row is carried between batches."""
    held: pa.Table | None = None
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RUN_SCHEMA.split(", ")])
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_arrays(b.columns, schema=schema)
        if held is not None:
            t = pa.concat_tables([held, t])
        n = t.num_rows
        t = t.combine_chunks()
        sha = np.frombuffer(b"".join(t.column("xd_sha").to_pylist()), dtype="S32").reshape(-1)
        sha = np.frombuffer(sha.tobytes(), dtype=np.uint64).reshape(n, 4)
        other = np.stack([t.column(c).to_numpy() for c in ("xd_range", "xd_run", "xd_len", "xd_check")], 1).astype(np.int64)
        first = np.ones(n, bool)
        first[1:] = (sha[1:] != sha[:-1]).any(1) | (other[1:] != other[:-1]).any(1)
        at = np.flatnonzero(first)
        counts = np.add.reduceat(t.column("xd_count").to_numpy(), at)
        t = t.take(pa.array(at)).set_column(schema.get_field_index("xd_count"), schema.field("xd_count"), pa.array(counts, pa.int64()))
        held = t.slice(t.num_rows - 1, 1)
        if t.num_rows > 1:
            yield from t.slice(0, t.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merged(runs: DataFrame, n: int) -> DataFrame:
    """One round: rows meet by (range, run), are merged in digest order, and folded."""
    order = [*RUN, F.col("xd_chars").desc(), F.col("xd_null"), F.col("xd_id"), F.col("xd_uid")]
    return runs.repartition(n, "xd_range", "xd_run").sortWithinPartitions(*order).mapInArrow(fold, RUN_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size (long), kept (boolean), text_sha256 (hex).

    Texts are equal when they are identical after all of space, \\t, \\n, \\v, \\f, \\r are deleted. Of
    equal texts the row with the most code points in its original text stays, then the smallest id
    (null last), then the first of repeated rows: exactly one row of a group has kept = true.

    Defined cases: a null text is empty, and empty or white texts are equal to each other; a null id can
    stay only if all of its group's are null; an empty table gives an empty one; other columns of the
    input play no part.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    bare = F.translate(text, WHITE, "")
    ids = docs.schema[id_col].dataType
    # the row number is fixed by being written: it tells repeated rows apart
    rows = docs.select(
        named(id_col).cast("long").alias("xd_id"), F.length(text).alias("xd_chars"), bare.alias("xd_bare"),
    ).select(
        "xd_id", "xd_chars", F.unhex(F.sha2("xd_bare", 256)).alias("xd_sha"), F.length("xd_bare").alias("xd_len"), F.xxhash64("xd_bare").alias("xd_check"),
        F.monotonically_increasing_id().alias("xd_uid"),
    )
    rows = written(rows, "digests")
    total = rows.count()
    n = parts_for(spark, 100 * total)  # a row of a run has about 100 bytes
    digest_range = F.pmod(F.conv(F.hex(F.substring("xd_sha", 1, 4)), 16, 10).cast("long"), F.lit(8 * n)).cast("int")
    runs = rows.select(
        digest_range.alias("xd_range"), F.shiftright("xd_uid", 33).alias("xd_run"), "xd_sha", "xd_len", "xd_check", "xd_chars",
        F.col("xd_id").isNull().alias("xd_null"), "xd_id", "xd_uid", F.lit(1).cast("long").alias("xd_count"),
    )
    # level 0: the run of each partition, sorted and folded where it lies
    order = [*RUN, F.col("xd_chars").desc(), F.col("xd_null"), F.col("xd_id"), F.col("xd_uid")]
    runs = runs.sortWithinPartitions(*order).mapInArrow(fold, RUN_SCHEMA)
    last = rows.agg(F.max(F.shiftright("xd_uid", 33))).first()[0] or 0
    while True:
        runs = merged(runs.withColumn("xd_run", F.shiftright("xd_run", FAN_BITS)), n)
        last >>= FAN_BITS
        if not last:
            break
    best = runs.select(
        F.col("xd_sha").alias("xd_sha_b"), F.col("xd_len").alias("xd_len_b"), F.col("xd_check").alias("xd_check_b"),
        F.col("xd_id").alias("keep_id"), F.col("xd_uid").alias("xd_best"), F.col("xd_count").alias("group_size"),
    )
    best = written(best, "groups")
    on = (F.col("xd_sha") == F.col("xd_sha_b")) & (F.col("xd_len") == F.col("xd_len_b")) & (F.col("xd_check") == F.col("xd_check_b"))
    return met(rows, best, on, "group_size", total).select(
        F.col("xd_id").cast(ids).alias(id_col), F.col("keep_id").cast(ids).alias("keep_id"), "group_size",
        (F.col("xd_uid") == F.col("xd_best")).alias("kept"), F.lower(F.hex("xd_sha")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents

    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)
"""
