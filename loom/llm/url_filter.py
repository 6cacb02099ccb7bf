"""URL rules through a Bloom filter cascade.

A rule is a host and the beginning of a path, and it stands for one key, host and beginning written together. A URL asks for
a few keys: its host's last labels with its path's first characters, in the shapes (labels, characters) that any rule has. The
longest key that is a rule's decides.

Which keys are rules' is what the cascade knows. Level 0 is a Bloom filter of all rules' keys; level 1 one of the keys of the
corpus that level 0 takes for rules' and that aren't; level 2 one of the rules' keys that level 1 takes for those; and so on,
alternately, until a level takes nothing wrongly. For every key of the corpus, which is all that is ever asked, the first level
that doesn't hold it tells exactly whether it is a rule's. URLs are judged where they lie, without a join or a shuffle; only
keys that level 0 takes wrongly are shuffled, once, while the cascade is built, each as one row of a map task.

A level's bits are set on the executors. They are cut into parts by the keys' hashes, so that what is broadcast at a time is
PART_BYTES of a level at most; more parts are asked one after the other, each pass being written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rate of wrong answers of the first level and of the others.
FIRST_RATE, REST_RATE = 1 / 256, 1 / 2
PART_BYTES = 32 << 20
CHUNK_BITS = 1 << 19
#: Two keys whose 128 bits of hash agree would never part; beyond so many levels that is what has happened.
MOST_LEVELS = 128


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of x that differs with the seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def part_of(a: np.ndarray, n: int) -> np.ndarray:
    return mixed(a, 1 << 20) % np.uint64(n)


def places(a: np.ndarray, b: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    """The k bits of each key at a level: (k, keys)."""
    x, y = mixed(a, 2 * level + 1), mixed(b, 2 * level + 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(x + np.uint64(i) * y) % np.uint64(bits) for i in range(k)])


def shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits and functions of a filter for so many keys."""
    bits = max(64, math.ceil(keys * math.log2(1 / rate) / math.log(2)))
    return bits, max(1, round(bits / max(1, keys) * math.log(2))) if keys else 1


def in_levels(levels: list[tuple[np.ndarray, int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is one of the listed, by the levels (bits, functions) of its part."""
    out, alive = np.zeros(len(a), bool), np.arange(len(a))
    for i, (bits, k) in enumerate(levels):
        at = places(a[alive], b[alive], i, 8 * len(bits), k)
        held = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
        out[alive[~held]] = i % 2 == 1
        alive = alive[held]
    out[alive] = len(levels) % 2 == 1
    return out


class Cascade:
    """Levels of Bloom filters by part. `holds` asks one part of the levels from `first` on."""

    def __init__(self, spark, n_parts: int):
        self.spark, self.n_parts, self.parts, self.n_levels = spark, n_parts, [[] for _ in range(n_parts)], 0

    def add(self, keys: DataFrame, count: int, rate: float) -> None:
        """A level that holds `keys` (columns a, b). Bits are set on the executors and come here a chunk a row."""
        bits, k = shape(-(-count // self.n_parts), rate)
        bits, level, n = -(-bits // 8) * 8, self.n_levels, self.n_parts

        def spread(batches):
            for t in batches:
                a, b = (t.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
                for part in range(n):
                    own = part_of(a, n) == part
                    at = np.unique(places(a[own], b[own], level, bits, k).ravel()).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at // CHUNK_BITS), pa.array(at % CHUNK_BITS)], names=["part", "chunk", "at"])

        def packed(key, t):
            flags = np.zeros(CHUNK_BITS, np.uint8)
            flags[t.column("at").to_numpy()] = 1
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()]), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

        places_set = keys.select("a", "b").mapInArrow(spread, "part int, chunk long, at long")
        chunks = places_set.groupBy("part", "chunk").applyInArrow(packed, "part int, chunk long, bits binary")
        chunks = written(chunks, "url-bits") if n > 1 else chunks
        for part, levels in enumerate(self.parts):
            filled = np.zeros(bits // 8, np.uint8)
            for r in chunks.filter(F.col("part") == part).collect():  # PART_BYTES at most
                at = r.chunk * CHUNK_BITS // 8
                filled[at : at + CHUNK_BITS // 8] = np.frombuffer(r.bits, np.uint8)[: len(filled) - at]
            levels.append((filled, k))
        self.n_levels += 1

    def holds(self, keys: DataFrame, level: int) -> DataFrame:
        """The rows of `keys` (columns a, b) that one level holds."""
        for part in range(self.n_parts):
            sent, n = self.spark.sparkContext.broadcast(self.parts[part][level]), self.n_parts

            @F.arrow_udf("boolean")
            def held(a: pa.Array, b: pa.Array) -> pa.Array:
                a, b = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
                bits, k = sent.value  # noqa: B023
                own, out = np.flatnonzero(part_of(a, n) == part), np.ones(len(a), bool)  # noqa: B023
                at = places(a[own], b[own], level, 8 * len(bits), k)
                out[own] = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
                return pa.array(out)

            keys = keys.filter(held("a", "b"))
            if self.n_parts > 1:
                keys = written(keys, "url-part")
        return keys

    def first_listed(self, rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
        """rows with `name` (int): the place from 1 of the first listed key in the arrays a and b, 0 where none is."""
        rows, n = rows.withColumn(name, F.lit(0)), self.n_parts
        for part in range(n):
            sent = self.spark.sparkContext.broadcast(self.parts[part])

            @F.arrow_udf("int")
            def first(a: pa.Array, b: pa.Array, known: pa.Array) -> pa.Array:
                sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x, y = (v.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for v in (a, b))
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                own = np.flatnonzero(part_of(x, n) == part)  # noqa: B023
                own = own[in_levels(sent.value, x[own], y[own])]  # noqa: B023
                out = np.where((old := known.to_numpy(zero_copy_only=False)) == 0, np.iinfo(np.int32).max, old)
                np.minimum.at(out, row[own], place[own])
                return pa.array(np.where(out == np.iinfo(np.int32).max, 0, out).astype(np.int32))

            rows = rows.withColumn(name, first(a, b, name))
            if n > 1:
                rows = written(rows, "url-part")
        return rows


def cascade(listed: DataFrame, universe: DataFrame, first: float = FIRST_RATE, rest: float = REST_RATE, part_bytes: int = PART_BYTES) -> Cascade:
    """A cascade that tells the keys of `listed` from the others of `universe` (both: column key, string; repeated rows and null
    keys play no part). It is exact for every key of either.

    Defined cases: without listed keys nothing is listed; listed keys need not be in the universe; an empty universe makes one
    level."""
    spark = listed.sparkSession
    hashed = lambda df: df.filter(F.col("key").isNotNull()).select("key", *[h.alias(c) for h, c in zip(hashes(F.col("key")), "ab")])
    encode = written(hashed(listed).distinct(), "url-listed")
    count = encode.count()
    out = Cascade(spark, max(1, -(-shape(count, first)[0] // (8 * part_bytes))))
    out.add(encode, count, first)
    passed = out.holds(hashed(universe), 0).select("key", "a", "b", F.lit(False).alias("listed"))
    both = passed.unionByName(encode.withColumn("listed", F.lit(True)))
    wrong = written(both.groupBy("key", "a", "b").agg(F.max("listed").alias("listed")).filter(~F.col("listed")).drop("listed"), "url-wrong")
    while count := wrong.count():
        if out.n_levels >= MOST_LEVELS:
            raise ValueError("two keys have the same 128 bits of hash")
        out.add(wrong, count, rest)
        encode, wrong = wrong, written(out.holds(encode, out.n_levels - 1), "url-wrong")
    return out


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path: the host is what follows the first :// up to /, ?, # or the end, A-Z lower-cased; the path goes on up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL in the given shapes (labels of the host, characters of the path) that it has, the longest first."""
    if not shapes:
        return F.array().cast("array<string>")
    labels = F.when(host != "", F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).otherwise(0)

    def key(s: Column) -> Column:
        of_host = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        whole = F.concat(of_host, F.substr(path, F.lit(1), s["chars"]))
        fits = (labels >= s["labels"]) & (F.length(path) >= s["chars"])
        return F.when(fits, F.struct((-F.length(whole)).alias("a"), (-F.length(of_host)).alias("b"), whole.alias("key")))

    known = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(m).alias("chars")) for n, m in shapes])
    found = F.filter(F.transform(known, key), lambda x: x.isNotNull())
    return F.transform(F.array_sort(found), lambda x: x["key"])


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", **sizes) -> DataFrame:
    """pages with host, path, rule (string, null where none fits) and verdict.

    rules: host, path, verdict (strings, "allow" or "block"). A rule fits the URLs of its host and of all its subdomains whose
    path begins with the rule's; of those that fit, the longest (host and path together, in code points; then the one with the
    longer host) decides. A URL that no rule fits isn't listed and gets `default`.

    Defined cases: a null URL, an empty one, or one without :// has an empty host and path, which no rule fits. Rules' hosts
    are lower-cased (A-Z); rules with a null or empty host or a path that is neither empty nor begins with / are a ValueError;
    of rules alike but for the verdict, block holds. Repeated rows get equal results. Columns of pages pass through, but for
    those named host, path, rule and verdict. An empty table gives an empty one.
    """
    rules = written(rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"), "url-rules")
    bad = (F.coalesce("host", F.lit("")).isin("")) | F.col("host").rlike("[/?#]") | ((F.col("path") != "") & ~F.col("path").startswith("/")) | ~F.coalesce("verdict", F.lit("")).isin("allow", "block")
    if not rules.filter(bad).isEmpty():
        raise ValueError("a rule needs a host, a path that is empty or begins with /, and allow or block as its verdict")
    key = F.concat("host", "path").alias("key")
    labels = (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels")
    # as many shapes as label counts and path lengths that rules have: bounded by the length of URLs, not by the number of rules
    shapes = sorted({(r.labels, r.chars) for r in rules.select(labels, F.length("path").alias("chars")).distinct().collect()}, reverse=True)
    rows = pages.toDF(*(own := [f"__uf_c{i}" for i in range(len(pages.columns))]))
    url = F.col(own[pages.columns.index(url_col)]).cast("string")
    host, path = parts_of(url)
    rows = rows.withColumns({"__uf_host": host, "__uf_path": path})
    rows = rows.withColumn("__uf_keys", keys_of(F.col("__uf_host"), F.col("__uf_path"), shapes))
    listed = cascade(rules.select(key), rows.select(F.explode("__uf_keys").alias("key")), **sizes)
    blocked = cascade(rules.filter(F.col("verdict") == "block").select(key), rules.select(key), **sizes)
    ask = lambda df, keys, name, by: by.first_listed(df.withColumns({f"{name}_{i}": F.transform(keys, lambda k: hashes(k)[i]) for i in range(2)}), f"{name}_0", f"{name}_1", name)  # noqa: E731, B023
    rows = ask(rows, F.col("__uf_keys"), "__uf_at", listed)
    rows = rows.withColumn("__uf_rule", F.when(F.col("__uf_at") > 0, F.get("__uf_keys", F.col("__uf_at") - 1)))
    rows = ask(rows, F.when(F.col("__uf_rule").isNotNull(), F.array("__uf_rule")).otherwise(F.array().cast("array<string>")), "__uf_block", blocked)
    verdict = F.when(F.col("__uf_at") == 0, F.lit(default)).when(F.col("__uf_block") > 0, F.lit("block")).otherwise(F.lit("allow"))
    kept = [F.col(c).alias(name) for c, name in zip(own, pages.columns) if name not in ("host", "path", "rule", "verdict")]
    return rows.select(*kept, F.col("__uf_host").alias("host"), F.col("__uf_path").alias("path"), F.col("__uf_rule").alias("rule"), verdict.alias("verdict"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT p.page_id, p.host, p.path, rules.host || rules.path AS rule, rules.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(rules.host || rules.path) DESC NULLS LAST, length(rules.host) DESC) AS n
      FROM p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
