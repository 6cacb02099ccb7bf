"""Line dedup, DataFrame functions only.

Lines are exploded with their positions, normalised and hashed; the documents of each hash are
counted; frequent lines are dropped everywhere but in one document, and the text is put together
again by position.

Shape of the plan: only 128-bit hashes travel for the counting (a hot line meets in one row per map
task before its shuffle), and each text travels at most once, when its document takes its list of
dropped positions. Texts without a dropped line pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.llm.common import WHITE, met, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent lines up to this many are sent to all executors (32 bytes each); of more, those that most rows hold are, and the
#: others are joined by a shuffle.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased (other letters as they are)."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """docs with the kept text in `text_col`, and n_lines and n_dropped (long).

    A line's key of at least `min_chars` code points that at least `min_docs` documents hold loses all
    its lines except those in the largest id holding it (all of that document's lines with it stay).

    Defined cases: a null or empty text is one empty line and stays empty. Rows with equal ids are one
    document for the count; a null id is a document of its own and never the largest beside others.
    Repeated rows get equal results. If every line is dropped the text becomes empty. Columns of the
    input other than the text pass through; those named n_lines or n_dropped are replaced.
    """
    out = _kept(docs, id_col, text_col, min_chars, min_docs, broadcast_lines)
    own = [F.col(f"__ld_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")]
    return out.select(*own, F.col("__ld_lines").alias("n_lines"), F.col("__ld_dropped").alias("n_dropped"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the kept texts, all other columns as they were, whatever their names.

    Defined cases: as in `line_dedup`; a document that loses all its lines stays, with an empty text, and a null
    text becomes empty.
    """
    out = _kept(docs, id_col, text_col, min_chars, min_docs, BROADCAST_LINES)
    return out.select(*[F.col(f"__ld_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, broadcast_lines: int) -> DataFrame:
    """__ld_c0, __ld_c1, ... (the columns of docs by position, the text being the kept one), __ld_lines, __ld_dropped."""
    place = {c: f"__ld_c{i}" for i, c in enumerate(docs.columns)}
    docs, id_col, text_col = docs.toDF(*place.values()), place[id_col], place[text_col]
    text = text_of(text_col)
    # equal (id, text) rows have equal decisions, so the pair of id and text hash finds them again
    mark = [F.col(id_col).alias("__ld_id"), F.xxhash64(text).alias("__ld_h"), F.length(text).alias("__ld_n")]
    lines = docs.select(*mark, F.posexplode(F.split(text, "\n")).alias("__ld_pos", "__ld_line"))
    lines = lines.withColumn("__ld_key", line_key(F.col("__ld_line"))).filter(F.length("__ld_key") >= min_chars)
    lines = written(
        lines.select(
            "__ld_id", "__ld_h", "__ld_n", "__ld_pos",
            F.xxhash64("__ld_key").alias("__ld_k1"), F.xxhash64(F.lit(7), "__ld_key").alias("__ld_k2"),
        ),
        "lines",
    )
    hot = (
        lines.groupBy("__ld_k1", "__ld_k2", "__ld_id").agg(F.count(F.lit(1)).alias("__ld_rows"))
        .groupBy("__ld_k1", "__ld_k2").agg(F.count(F.lit(1)).alias("__ld_docs"), F.max("__ld_id").alias("__ld_keep"), F.sum("__ld_rows").alias("__ld_rows"))
        .filter(F.col("__ld_docs") >= min_docs).drop("__ld_docs")
    )
    hot = written(hot, "hot-lines")
    size = hot.agg(F.count(F.lit(1)).alias("n"), F.sum("__ld_rows").alias("rows")).first()
    key = ["__ld_k1", "__ld_k2"]
    held = lines.join(F.broadcast(hot), key) if size["n"] <= broadcast_lines else met(lines, hot, key, "__ld_rows", size["rows"], broadcast_lines)
    dropped = (
        held.filter(~F.col("__ld_id").eqNullSafe(F.col("__ld_keep")))
        .groupBy("__ld_id", "__ld_h", "__ld_n").agg(F.collect_set("__ld_pos").alias("__ld_drop"))
    )
    own = docs.columns
    left = docs.select(*own, F.xxhash64(text).alias("__ld_h0"), F.length(text).alias("__ld_n0"))
    on = F.col(id_col).eqNullSafe(F.col("__ld_id")) & (F.col("__ld_h0") == F.col("__ld_h")) & (F.col("__ld_n0") == F.col("__ld_n"))
    both = left.join(dropped, on, "left")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    all_pos = F.sequence(F.lit(0), (n_lines - 1).cast("int"))
    # positions kept and dropped, sorted together, give one flag for each line
    flags = F.transform(
        F.array_sort(
            F.concat(
                F.transform(F.array_except(all_pos, F.col("__ld_drop")), lambda p: F.struct(p.alias("p"), F.lit(False).alias("d"))),
                F.transform(F.col("__ld_drop"), lambda p: F.struct(p.alias("p"), F.lit(True).alias("d"))),
            )
        ),
        lambda s: s["d"],
    )
    kept = F.array_join(F.zip_with(F.split(text, "\n"), flags, lambda line, d: F.when(~d, line)), "\n")
    return both.select(
        *[F.when(F.col("__ld_drop").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in own],
        n_lines.cast("long").alias("__ld_lines"),
        F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long").alias("__ld_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents

    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, u.line AS line, u.pos AS pos
      FROM d, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                              generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.pos, k.line, (hot.key IS NOT NULL AND k.doc_id <> hot.keep) AS drop_it
      FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN drop_it THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT drop_it THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
