"""k-means over a vector table, one pass per iteration.

An iteration is one job: centroids (k x D) go out, each task returns the sums and counts of its rows by
cluster, and k x D sums come back. Nothing that grows with the rows is held anywhere."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.operators.ordering import uniform_number
from loom.operators.stored import dropped, fresh_path
from loom.operators.vectors import distance_block, metric_of, rows_of
from loom.sources.files import filesystem


def assign(x: DataFrame, centroids: np.ndarray, metric: str | int = 2, digits: int | None = None) -> DataFrame:
    """(id, cid, dist): the nearest centroid of each row of x (id, v); ties to the lowest number."""
    held = x.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distance_block(rows_of(b.column(1)), held.value, metric)
                at = (d if digits is None else np.round(d, digits)).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int64)), pa.array(d[np.arange(len(at)), at])], names=["id", "cid", "dist"])

    return x.select("id", "v").mapInArrow(run, "id long, cid long, dist double")


def cluster_sums(x: DataFrame, centroids: np.ndarray, metric: str | int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts, sum of least distances) by nearest centroid."""
    held = x.sparkSession.sparkContext.broadcast(centroids)
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, inertia = np.zeros((k, width)), np.zeros(k), np.zeros(k)
        for b in batches:
            if b.num_rows:
                m = rows_of(b.column(0))
                d = distance_block(m, held.value, metric)
                at = d.argmin(1)
                np.add.at(sums, at, m)
                counts += np.bincount(at, minlength=k)
                inertia += np.bincount(at, d[np.arange(len(at)), at], k)
        yield pa.RecordBatch.from_pydict({"cid": np.arange(k), "n": counts, "d": inertia, "s": list(sums)})

    parts = x.select("v").mapInArrow(run, "cid long, n double, d double, s array<double>")
    total = parts.select("cid", "n", "d", F.posexplode("s").alias("p", "x")).groupBy("cid", "p").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("x").alias("x")).collect()
    sums, counts, inertia = np.zeros((k, width)), np.zeros(k), np.zeros(k)
    for r in total:
        sums[r["cid"], r["p"]], counts[r["cid"]], inertia[r["cid"]] = r["x"], r["n"], r["d"]
    return sums, counts, float(inertia.sum())


def update(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means, whatever the metric; an empty cluster keeps its centroid."""
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)


#: Rows of a chunk of k-means++: 8 bytes each are written a pick.
CHUNK = 4096


def random_rows(x: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k rows in the order of md5(seed:id)."""
    got = x.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(k).select("v").collect()
    if len(got) < k:
        raise ValueError(f"{k} clusters of {len(got)} rows")
    return np.array([r["v"] for r in got], float)


def chunked(x: DataFrame) -> str:
    """Writes (id, v) as chunks of rows in the order of their ids, in folders by range of ids; where they lie."""
    n = max(1, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = x.select("id", "v").repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while t.num_rows >= CHUNK:
                yield one(t.slice(0, CHUNK), at)
                t, at = t.slice(CHUNK), at + 1
            held = t
        if held is not None and held.num_rows:
            yield one(held, at)

    def one(t: pa.Table, at: int) -> pa.RecordBatch:
        m = rows_of(t.column(1).combine_chunks())
        return pa.RecordBatch.from_pydict({"range": pa.array([t.column(2)[0].as_py()], pa.int32()), "chunk": pa.array([at], pa.int32()), "ids": [t.column(0).to_numpy().astype("<i8").tobytes()], "rows": [m.astype("<f8").tobytes()]})

    path = fresh_path(x.sparkSession, "chunks")
    rows.mapInArrow(run, "range int, chunk int, ids binary, rows binary").write.partitionBy("range").parquet(path)
    return path


def of_range(path: str, at: int, columns: list[str]) -> list[dict]:
    """The rows of one range's folder, read where they are needed: by a task for the chunks it has, by the driver for one range."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, root = filesystem(path)
    found = fs.get_file_info(FileSelector(f"{root}/range={at}", allow_not_found=True))
    return [r for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet") for r in pq.ParquetFile(fs.open_input_file(f.path)).read(columns).to_pylist()]


def plus_plus(x: DataFrame, k: int, seed: int = 0, metric: str | int = 2, power: float = 1.0) -> list[int]:
    """Ids of k rows: the first by md5 order, each further one with a chance in proportion to its distance
    to the nearest row so far (to the power given). Rows stand in the order of their ids; a pick is where the
    cumulative weight passes a uniform number made of seed and step.

    A pick is two jobs. The first takes every row's distance to the newest pick alone and writes the least so far, 8 bytes a row,
    a chunk beside each chunk of vectors; vectors are written once. The second sums weights by range of ids. The range that is hit,
    one folder of the least distances, is looked at by itself. With fewer rows of any weight than asked for, the last are taken."""
    spark = x.sparkSession
    first = x.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").select("id", "v").first()
    picks, newest = [first["id"]], np.array([first["v"]], float)
    path, before = chunked(x), None
    base = spark.read.parquet(path)
    while len(picks) < k:
        u, least = uniform_number(seed, 1_000_000 + len(picks)), fresh_path(spark, "least")
        held = spark.sparkContext.broadcast((newest, before))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            newest, before = held.value  # noqa: B023
            known: tuple = (None, {})
            for b in batches:
                for i in range(b.num_rows):
                    at, chunk, rows = (b.column(c)[i].as_py() for c in range(3))
                    if before and known[0] != at:
                        known = (at, {r["chunk"]: r["least"] for r in of_range(before, at, ["chunk", "least"])})
                    d = distance_block(np.frombuffer(rows, "<f8").reshape(-1, newest.shape[1]), newest, metric)[:, 0]
                    if before:
                        d = np.minimum(d, np.frombuffer(known[1][chunk], "<f8"))
                    w = float((np.round(d, 9) ** power).sum())
                    yield pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "least": [d.astype("<f8").tobytes()], "w": [w]})

        base.select("range", "chunk", "rows").mapInArrow(run, "range int, chunk int, least binary, w double").write.partitionBy("range").parquet(least)
        totals = spark.read.parquet(least).groupBy("range").agg(F.sum("w").alias("w")).orderBy("range").collect()
        aim, passed = u * sum(t["w"] for t in totals), 0.0
        at = len(totals) - 1
        for i, t in enumerate(totals):
            if passed + t["w"] > aim:
                at = i
                break
            passed += t["w"] if i < len(totals) - 1 else 0.0
        at = totals[at]["range"]
        chunks = sorted(of_range(least, at, ["chunk", "least"]), key=lambda r: r["chunk"])
        weights = np.concatenate([np.round(np.frombuffer(r["least"], "<f8"), 9) ** power for r in chunks])
        over = np.flatnonzero(passed + np.cumsum(weights) > aim)
        hit = int(over[0]) if len(over) else len(weights) - 1  # sums of another order fell short
        row = next(r for r in of_range(path, at, ["chunk", "ids", "rows"]) if r["chunk"] == chunks[hit // CHUNK]["chunk"])
        picks.append(int(np.frombuffer(row["ids"], "<i8")[hit % CHUNK]))
        newest = np.frombuffer(row["rows"], "<f8").reshape(-1, newest.shape[1])[hit % CHUNK][None, :].copy()
        if before:
            dropped(before)
        before = least
    dropped(path, *([before] if before else []))
    return picks


@dataclass
class KMeans:
    """fit(x) on a table (id long, v array<double>), then predict(x).

    Stops when no centroid changes by more than `tolerance` or after max_iter passes."""

    n_clusters: int
    max_iter: int = 1000
    init: str | np.ndarray = "kmeans++"
    dist: str | int = "euclidean"
    random_state: int = 0
    tolerance: float = 1e-12
    power: float = 1.0
    centroids: np.ndarray | None = field(default=None, repr=False)
    inertia: float = float("nan")
    n_iter: int = 0

    def __post_init__(self) -> None:
        metric_of(self.dist)
        if self.n_clusters < 1 or self.max_iter < 0:
            raise ValueError("n_clusters must be at least 1 and max_iter at least 0")
        if isinstance(self.init, str) and self.init not in ("random", "kmeans++"):
            raise ValueError(f"unknown init {self.init!r}")

    def fit(self, x: DataFrame) -> "KMeans":
        if isinstance(self.init, np.ndarray):
            c = self.init.astype(float)
        elif self.init == "random":
            c = random_rows(x, self.n_clusters, self.random_state)
        else:
            ids = plus_plus(x, self.n_clusters, self.random_state, self.dist, self.power)
            found = {r["id"]: r["v"] for r in x.filter(F.col("id").isin(ids)).collect()}
            c = np.array([found[i] for i in ids], float)
        for self.n_iter in range(1, self.max_iter + 1):
            sums, counts, self.inertia = cluster_sums(x, c, self.dist)
            new = update(c, sums, counts)
            done = np.abs(new - c).max() <= self.tolerance
            c = new
            if done:
                break
        self.centroids = c
        return self

    def predict(self, x: DataFrame) -> DataFrame:
        if self.centroids is None:
            raise ValueError("fit first")
        return assign(x, self.centroids, self.dist)

    def labels(self, x: DataFrame) -> DataFrame:
        """(id, cid): the cluster of each row."""
        return self.predict(x).select("id", "cid")

    def distances(self, x: DataFrame) -> DataFrame:
        """(id, dist): each row's distance to the centroid of its cluster."""
        return self.predict(x).select("id", "dist")

    def mask(self, x: DataFrame, cluster: int) -> DataFrame:
        """(id, inside): whether a row is in that cluster."""
        if not 0 <= cluster < self.n_clusters:
            raise ValueError(f"there is no cluster {cluster} of {self.n_clusters}")
        return self.predict(x).select("id", (F.col("cid") == cluster).alias("inside"))

    def fit_predict(self, x: DataFrame) -> DataFrame:
        return self.fit(x).predict(x)

    def distance_matrix(self, x: DataFrame) -> DataFrame:
        from loom.operators.vectors import over_block

        c, metric = self.centroids, self.dist

        def work(i, a, j, b) -> pa.Table:
            return pa.table({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)).astype(np.int64), "dist": distance_block(a, b, metric).ravel()})

        return over_block(x.select("id", "v"), np.arange(len(c)), c, work, "i long, j long, dist double")
