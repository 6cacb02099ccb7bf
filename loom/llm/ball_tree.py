"""Centroid clustering by ball-tree filtering, exact in integers.

Every partition deals its vectors into trees of at most TREE points. A node of a tree is a ball: the mean of its points, the
distance of the farthest of them, their number and their integer sum. Trees are built and written once. In a round a task asks
each tree from its root, a level at a time: a centroid that is farther from the ball's centre than the nearest one by more
than twice the radius is nearest to none of its points. If one centroid is left, the ball goes to it whole, by its number and
sum; otherwise its halves are asked, and at leaves every point is compared with the centroids in integers. Rounding can't change
a result: balls are decided with room for it, and points exactly.

A round sends a number and a sum a centroid and task, summed on the executors, so the driver gets k x D numbers whatever the
rows are. Equal vectors, however many, are one ball of radius 0 in each tree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, single_thread, table, written

TREE, LEAF = 8192, 32
NODES = ("first", "last", "left")  # int32 columns of a tree's nodes; the right half follows the left one


def largest(dims: int) -> int:
    """Components up to this have squared distances that fit a long."""
    return math.isqrt((1 << 63) // max(1, dims)) // 2 - 1


def tree(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A metric tree over integer rows: their order, and the arrays of its nodes, the root first."""
    order, todo, nodes = np.arange(len(x)), [(0, len(x))], []
    f = x.astype(np.float64)
    for a, z in todo:  # grows while it is read
        own = f[order[a:z]]
        mean = own.mean(0)
        far = np.sqrt(((own - mean) ** 2).sum(1))
        split = z - a > LEAF and far.max() > 0
        nodes.append((a, z, len(todo) if split else -1, mean, far.max() * (1 + 1e-9), x[order[a:z]].sum(0)))
        if split:
            p = own[far.argmax()]
            q = own[((own - p) ** 2).sum(1).argmax()]
            side = halved(own @ (q - p))
            order[a:z] = np.concatenate([order[a:z][side], order[a:z][~side]])
            half = int(side.sum())
            todo += [(a, a + half), (a + half, z)]
    first, last, left, mean, radius, total = zip(*nodes)
    return order, {"first": np.array(first, np.int32), "last": np.array(last, np.int32), "left": np.array(left, np.int32), "mean": np.array(mean), "radius": np.array(radius), "total": np.array(total, np.int64)}


def halved(v: np.ndarray) -> np.ndarray:
    """Which of the values are in the lower half, cut where that parts no equal ones, so that equal vectors stay together."""
    half = len(v) // 2
    middle = np.partition(v, half)[half]
    sides = [x for x in (v < middle, v <= middle) if 0 < x.sum() < len(v)]
    return min(sides, key=lambda x: abs(int(x.sum()) - half), default=np.arange(len(v)) < half)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in doubles while these hold them, else in longs."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)


def asked(t: dict[str, np.ndarray], x: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, their centroid, True) for balls decided whole, those of equal points among them, and (points, their centroid, False) for those of other leaves."""
    front, centres = np.zeros(1, np.int64), c.astype(np.float64)
    while len(front):
        d = np.sqrt(((t["mean"][front][:, None, :] - centres[None, :, :]) ** 2).sum(2))
        best = d.min(1)
        room = 2 * t["radius"][front] + 1e-9 * (best + t["radius"][front] + np.abs(centres).max(initial=0)) + 1e-9
        alone = (d <= (best + room)[:, None]).sum(1) == 1
        yield front[alone], d[alone].argmin(1), True
        rest = front[~alone]
        same = t["radius"][rest] == 0
        if same.any():  # equal points, decided by one of them
            yield rest[same], squared(x[t["first"][rest[same]]], c).argmin(1), True
            rest = rest[~same]
        leaf = t["left"][rest] < 0
        if leaf.any():
            points = np.concatenate([np.arange(a, z) for a, z in zip(t["first"][rest[leaf]], t["last"][rest[leaf]])])
            yield points, squared(x[points], c).argmin(1), False
        left = t["left"][rest[~leaf]].astype(np.int64)
        front = np.concatenate([left, left + 1])


TREES = "n int, dims int, ids array<{id}>, points binary, first binary, last binary, left binary, mean binary, radius binary, total binary"


def planted(size: int, leaf_ids: pa.DataType):
    """Arrow function: rows (id, components) of a partition -> its trees."""

    def one(ids, rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(rows)
        order, t = tree(x)
        ids = pa.concat_arrays(ids).take(pa.array(order))
        cols = {"n": pa.array([len(x)], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        cols |= {"points": pa.array([x[order].astype("<i4").tobytes()])} | {k: pa.array([v.tobytes()]) for k, v in t.items()}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        ids, rows, held = [], [], 0
        for b in batches:
            a = 0
            while a < b.num_rows:
                z = min(b.num_rows, a + size - held)
                part = b.slice(a, z - a)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids.append(part.column(0).cast(leaf_ids))
                rows.append(flat.reshape(z - a, -1))
                held, a = held + z - a, z
                if held == size:
                    yield one(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield one(ids, rows)

    return run


def read_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    for b in batches:
        for i in range(b.num_rows):
            raw = lambda c, kind: np.frombuffer(b.column(b.schema.get_field_index(c))[i].as_buffer(), kind)  # noqa: B023, E731
            n, dims = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            t = {k: raw(k, np.int32) for k in NODES} | {"radius": raw("radius", np.float64), "mean": raw("mean", np.float64).reshape(-1, dims), "total": raw("total", np.int64).reshape(-1, dims)}
            yield b.column(2)[i].values, raw("points", "<i4").astype(np.int64).reshape(n, dims), t


def summed(sent):
    """Arrow function: trees -> (cluster, number, sums), a row for each centroid that got points, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        c = sent.value
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for _, x, t in read_trees(batches):
            for which, cluster, whole in asked(t, x, c):
                np.add.at(count, cluster, (t["last"] - t["first"])[which] if whole else 1)
                np.add.at(total, cluster, t["total"][which] if whole else x[which])
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(count[got]), pa.array(total[got].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def assigned(sent):
    """Arrow function: trees -> (id, cluster, distance) of every point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        c = sent.value
        for ids, x, t in read_trees(batches):
            of = np.zeros(len(x), np.int32)
            for which, cluster, whole in asked(t, x, c):
                if whole:
                    for a, z, k in zip(t["first"][which], t["last"][which], cluster):
                        of[a:z] = k
                else:
                    of[which] = cluster
            d = np.concatenate([((x[a : a + 1024] - c[of[a : a + 1024]]) ** 2).sum(1) for a in range(0, len(x), 1024)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(of), pa.array(d)], names=["id", "cluster", "distance"])

    return run


def ball_tree_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
    seed: int = 3, tree_size: int = TREE,
) -> DataFrame:
    """One row a vector that takes part: its id, cluster (int), distance (long, squared, of the integer vectors), cluster_inertia,
    inertia (long) and centroid_sha256.

    Components are floor(scale * x). Centroids start as the k vectors with the smallest sha256 of `<seed>:<id>`; a round assigns
    all vectors to the nearest centroid (ties: smaller number) and replaces every centroid that has any by the floor of their
    mean. After the rounds vectors are assigned once more.

    Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones take no part;
    neither do those with a component whose integer is beyond `largest(dims)` (about 2^27 at 64), as their squared distances don't fit a
    long. A vector without an id is clustered like others and starts no centroid while others can. Repeated rows each count. Fewer
    vectors than k make fewer centroids. An inertia beyond a long is null. Ids may be of any type. Other columns play no part; an empty table gives an empty one.
    """
    spark, most = vectors.sparkSession, largest(dims)
    ints = F.transform(named(vec_col).cast("array<double>"), lambda x: x * float(scale))
    rows = vectors.select(named(id_col).alias("id"), ints.alias("x"))
    inside = lambda x: x.isNotNull() & (F.abs(x) <= F.lit(float(most)))  # noqa: E731  NaN is above all numbers
    rows = rows.filter((F.size("x") == dims) & F.forall("x", inside)).select("id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("x"))
    kind = vectors.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    trees = written(rows.mapInArrow(planted(tree_size, to_arrow_type(kind)), TREES.format(id=kind.simpleString())), "ball-trees")
    begin = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), "x").limit(k).collect()
    c = np.array([r.x for r in begin], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(c) else 0):
        sums = trees.mapInArrow(summed(spark.sparkContext.broadcast(c)), "cluster int, n long, total array<long>")
        wide = sums.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at")
        for r in wide.agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():  # k x D rows
            c[r.cluster, r.at] = int(r.x) // r.n
    out = written(trees.mapInArrow(assigned(spark.sparkContext.broadcast(c)), f"id {kind.simpleString()}, cluster int, distance long"), "ball-assigned")
    names = [(i, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(c.tolist())]
    total = {r.cluster: int(r.x) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # k rows
    fit = lambda x: x if x < 1 << 63 else None
    # k rows, whatever the input
    about = spark.createDataFrame([(i, fit(total.get(i, 0)), fit(sum(total.values())), h) for i, h in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return ball_tree_clusters(table(spark, sf_dir, "embeddings"))


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, every round a pair of CTEs."""
    parts = [
        f"""e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
             WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM e
             ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})""",
    ]
    near = """SELECT vec_id, e.x, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance FROM (
        SELECT vec_id, e.x AS x, cluster, list_sum(list_transform(list_zip(e.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, {c} c) AS e,
        LATERAL (SELECT e.cluster) c GROUP BY vec_id, e.x"""
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        parts.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
             SELECT cluster, list(v ORDER BY i) AS x FROM (
               SELECT cluster, i, CAST(sum(x[i]) // count(*) - CASE WHEN sum(x[i]) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS v
               FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.cluster)"""
        )
    parts.append(f"a AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE = oracle()
