"""Nearest neighbours by a block matrix join.

Queries and indexed vectors are dealt into blocks, and every pair of a query block and an index block is
one tile. A tile multiplies int8 codes (as floats, where these integers are exact) to get each distance
with an error bound: a vector is its code within a known radius, so a true distance lies within the two
radii of the codes' distance. A pair whose lower bound is above the k-th smallest upper bound can't be
among the k nearest; the pairs that survive are computed again from the original vectors in double
precision. Heaps merge the sorted lists of the tiles, FAN tiles a round.

Equal vectors are one entry of the index with their k + 1 smallest ids (no list needs more of them), so
a vector that a third of all rows share costs one row of work. No row is left out: the search is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loom.llm.common import table, written

QUERY_BLOCK, INDEX_BLOCK, FAN, MERGE_QUERIES = 16_384, 4096, 64, 512
PRODUCT_DIMS = 1024  # 127 * 127 * 1024 < 2**24: exact in float32
TILE = "ann_bucket long, ann_rep long, ann_hash long, ann_run long, ann_ids array<long>, ann_dists array<double>"


def cleaned(width: str):
    """Arrow function: (id, array) -> (vec_id, vec): raw little-endian numbers of `width`; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(width)
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            out_id, out_vec = [], []
            flat = np.asarray(vecs.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)).astype(kind) + kind.type(0)
            sizes = np.asarray(vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(sizes)
            for i, (n, e, known) in enumerate(zip(sizes, ends, ids.is_valid().to_pylist())):
                v = flat[e - n : e]
                if known and n and np.isfinite(v).all() and v.any():
                    out_id.append(ids[i].as_py())
                    out_vec.append(v.tobytes())
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_vec, pa.binary())], names=["vec_id", "vec"])

    return run


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, and the distance of each vector from its code (a little more, for rounding)."""
    scale = np.abs(x).max(1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    radius = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
    return q, scale, radius * (1 + 1e-9) + 1e-12 * np.sqrt((x * x).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, in float64."""
    out = None
    for d in range(0, a.shape[1], PRODUCT_DIMS):
        p = a[:, d : d + PRODUCT_DIMS].astype(np.float32) @ b[:, d : d + PRODUCT_DIMS].astype(np.float32).T
        out = p.astype(np.float64) if out is None else out + p
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, in double precision."""
    with np.errstate(over="ignore", under="ignore"):
        d = x - y
        out = np.sqrt((d * d).sum(1))
        far = ~np.isfinite(out) | ((out < 1e-140) & d.any(1))
        if far.any():
            top = np.abs(d[far]).max(1, keepdims=True)
            out[far] = top[:, 0] * np.sqrt(((d[far] / top) ** 2).sum(1))
    return out


def nearest_in_tile(x: np.ndarray, y: np.ndarray, k: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of x: rows of y that can be among its k nearest (ties included), and their exact distances."""
    yq, ys, yr = codes(y)
    y2 = (yq.astype(np.float64) ** 2).sum(1) * ys**2
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        xq, xs, xr = codes(part)
        with np.errstate(over="ignore", invalid="ignore"):
            x2 = (xq.astype(np.float64) ** 2).sum(1) * xs**2
            d2 = x2[:, None] + y2[None, :] - 2 * products(xq, yq) * xs[:, None] * ys[None, :]
            slack = 1e-7 * np.sqrt(x2[:, None] + y2[None, :])  # for the subtraction above
            mid = np.sqrt(np.maximum(d2, 0))
            wide = xr[:, None] + yr[None, :] + slack
            if len(y) > k:
                most = np.partition(mid + wide, k - 1, axis=1)[:, k - 1]
                alive = ~(mid - wide > most[:, None])
            else:
                alive = np.ones(mid.shape, bool)
        for i in range(len(part)):
            js = np.flatnonzero(alive[i])
            yield a + i, js, distances(np.broadcast_to(part[i], (len(js), x.shape[1])), y[js])


def tile(k: int, width: str):
    """Cogroup function over (query block, index block, dimension)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            read = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist()), np.dtype(width)).reshape(t.num_rows, -1).astype(np.float64)
            members = right.column("members").to_pylist()
            heads = [left.column(c).to_pylist() for c in ("bucket", "rep", "hash")]
            block = key[1].as_py()
            for i, js, d in nearest_in_tile(read(left), read(right), k):
                nearest = heapq.nsmallest(k, ((dist, one) for dist, j in zip(d.tolist(), js.tolist()) for one in members[j]))
                found.append((*(h[i] for h in heads), block, [x[1] for x in nearest], [x[0] for x in nearest]))
        names = [f.split()[0] for f in TILE.split(", ")]
        types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.float64())]
        cols = list(zip(*found)) if found else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def heaped(k: int):
    """Group function: the lists of each query from several tiles, merged."""

    def run(t: pa.Table) -> pa.Table:
        lists: dict[tuple, list] = {}
        for bucket, rep, h, go, ids, dists in zip(*(c.to_pylist() for c in t.columns)):
            lists.setdefault((bucket, rep, h, go), []).append(list(zip(dists, ids)))
        rows = []
        for q, runs in lists.items():
            best = [x for x, _ in zip(heapq.merge(*runs), range(k))]
            rows.append((*q, [x[1] for x in best], [x[0] for x in best]))
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, t.schema)], names=t.schema.names)

    return run


def search(vectors: DataFrame, id_col="vec_id", vec_col="embedding", k=10, every=100) -> DataFrame:
    """The k nearest other rows of each row whose id is divisible by `every`: query_id, rank (int, from 1),
    the neighbour's id as vec_id, score (Euclidean distance in double precision), nearest first, ties to
    the smaller id; all other rows, if there are fewer.

    Defined cases: vectors that are null, empty, all zero or hold null or non-finite components take no
    part, neither do rows without an id; vectors of another dimension are no candidates; repeated rows
    count once; an empty table gives an empty one; other columns of the input play no part.
    """
    width = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    item = "float" if width == "<f4" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{item}>").alias("vec"))
    rows = rows.mapInArrow(cleaned(width), "vec_id long, vec binary").distinct()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    index = first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    index = written(index.select("vec", "members", F.col("members")[0].alias("rep"), F.xxhash64("vec").alias("hash"), F.octet_length("vec").alias("width")), "index")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = written(asked.select(F.col("vec_id").alias("query_id"), "vec", F.xxhash64("vec").alias("hash"), F.octet_length("vec").alias("width")), "queries")
    different = asked.select("vec", "hash", "width").distinct().join(index.select("vec", "rep"), "vec")
    n_index, n_asked = index.count(), asked.count()
    blocks, query_blocks, buckets = (max(1, math.ceil(n / m)) for n, m in ((n_index, INDEX_BLOCK), (n_asked, QUERY_BLOCK), (n_asked, MERGE_QUERIES)))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = different.select(deal(1, query_blocks).alias("q"), each(blocks).alias("b"), "width", deal(2, buckets).alias("bucket"), "rep", "hash", "vec")
    right = index.select(each(query_blocks).alias("q"), deal(3, blocks).alias("b"), "width", "members", "vec")
    lists = left.groupBy("q", "b", "width").cogroup(right.groupBy("q", "b", "width")).applyInArrow(tile(k + 1, width), TILE)
    while True:
        lists = lists.withColumn("ann_run", F.floor(F.col("ann_run") / FAN)).groupBy("ann_bucket", "ann_run").applyInArrow(heaped(k + 1), TILE)
        blocks = math.ceil(blocks / FAN)
        if blocks <= 1:
            break
    ids = vectors.schema[id_col].dataType
    found = F.slice(F.filter(F.arrays_zip("ann_ids", "ann_dists"), lambda x: x["ann_ids"] != F.col("query_id")), 1, k)
    known = asked.select("query_id", "vec").join(index.select("vec", "rep", "hash"), "vec").drop("vec")
    out = known.join(lists, (F.col("rep") == F.col("ann_rep")) & (F.col("hash") == F.col("ann_hash")))
    out = out.select("query_id", F.posexplode(found).alias("at", "x"))
    return out.select(F.col("query_id").cast(ids).alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ann_ids").cast(ids).alias("vec_id"), F.col("x.ann_dists").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
