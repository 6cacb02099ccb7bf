"""Mergeable statistics and scoring kernels over vector tables and parameter tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loom.operators.stored import written
from loom.operators.vectors import SIDE_BYTES, _against, rows_of, vector_products


#: A task hands on the sums of its groups when they are so large.
SUM_BYTES = 64 << 20


def outer_sums(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] i, j, x): sum of b[i] * a[j] over rows (by, a, b): one matrix per group and task (more where
    a task's groups are many), then one per group."""
    key = by or "k"
    kind = dict(pairs.dtypes)[by] if by else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        size = 0

        def held() -> Iterator[pa.RecordBatch]:
            for k, m in sums.items():
                i, j = np.indices(m.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, key_type), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=[key, "i", "j", "x"])

        for t in batches:
            if not t.num_rows:
                continue
            key_type, codes = t.column(0).type, t.column(0).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.flatnonzero(np.diff(code[order], append=-1)) + 1
            a, b, names = rows_of(t.column(1))[order], rows_of(t.column(2))[order], codes.dictionary.to_pylist()
            begin = 0
            for end in ends:
                k = names[code[order[begin]]]
                m = b[begin:end].T @ a[begin:end]
                size += 0 if k in sums else m.nbytes
                sums[k] = sums.get(k, 0) + m
                begin = end
            if size > SUM_BYTES:
                yield from held()
                sums, size = {}, 0
        yield from held()

    rows = pairs.select(F.col(by) if by else F.lit(0).cast("long").alias("k"), "a", "b")
    out = rows.mapInArrow(run, f"{key} {kind}, i int, j int, x double").groupBy(key, "i", "j").agg(F.sum("x").alias("x"))
    return out if by else out.drop("k")


def unit_blocks(m: DataFrame, by: str, rows_in_block: int, floor: float = 1e-12) -> DataFrame:
    """(by, i, j, x) with each block of rows scaled to unit Frobenius norm."""
    block = F.floor(F.col("i") / rows_in_block)
    norms = m.groupBy(F.col(by).alias("__k"), block.alias("__b")).agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(floor)).alias("__n"))
    return m.join(norms, (F.col(by) == F.col("__k")) & (block == F.col("__b"))).select(by, "i", "j", (F.col("x") / F.col("__n")).alias("x"))


#: Products of a task that are in memory at once.
PRODUCTS, MOST_GRAM = 1 << 20, 1024


def pair_sums(x: DataFrame, y: DataFrame, power: int, most: int) -> DataFrame:
    """(s): sum of |x_i . y_j| ** power over all pairs: one number per block of pairs, PRODUCTS of them at a time; null without pairs. Squares need no
    pairs: their sum is that of the products of X'X and Y'Y, cell by cell (for rows of up to MOST_GRAM numbers)."""
    width = x.agg(F.max(F.size(x.columns[1]))).first()[0] if power == 2 else None
    if width is not None and width <= MOST_GRAM:
        (n, _, g), (m, _, h) = (vector_products(t) for t in (x, y))
        return x.sparkSession.createDataFrame([(float((g * h).sum()) if n and m else None,)], "s double")

    def work(i, a, j, b) -> pa.Table:
        total, step = 0.0, 512
        for s in range(0, len(i), step):
            for t in range(0, len(j), PRODUCTS // step):
                d = a[s : s + step] @ b[t : t + PRODUCTS // step].T
                np.abs(d, out=d)
                total += float((d if power == 1 else d**power).sum())
        return pa.table({"s": pa.array([total if len(i) and len(j) else None], pa.float64())})

    return _against(x, y, work, "s double", most, SIDE_BYTES).agg(F.sum("s").alias("s"))


def softmax(logits: DataFrame, row: str, col: str, value: str, temperature: float = 1.0) -> DataFrame:
    """(row, col, p, logp) over the columns of each row."""
    from pyspark.sql import Window

    w = Window.partitionBy(row)
    z = F.col(value) / temperature
    top = logits.withColumn("__z", z).withColumn("__top", F.max("__z").over(w))
    norm = top.withColumn("__l", F.col("__top") + F.log(F.sum(F.exp(F.col("__z") - F.col("__top"))).over(w)))
    return norm.select(row, col, F.exp(F.col("__z") - F.col("__l")).alias("p"), (F.col("__z") - F.col("__l")).alias("logp"))


def distillation(old: DataFrame, new: DataFrame, row: str, col: str, value: str, temperature: float) -> DataFrame:
    """(loss): T^2 times the mean over rows of KL(softmax(old / T) || softmax(new / T))."""
    p = softmax(old, row, col, value, temperature)
    q = softmax(new, row, col, value, temperature).select(row, col, F.col("logp").alias("logq"))
    rows = p.join(q, [row, col]).groupBy(row).agg(F.sum(F.col("p") * (F.col("logp") - F.col("logq"))).alias("kl"))
    return rows.agg((F.avg("kl") * temperature**2).alias("loss"))


def ewc_penalty(theta: DataFrame, star: DataFrame, fisher: DataFrame, key: str, lam: float) -> DataFrame:
    """(penalty): lam / 2 * sum of F (theta - star)^2 over parameters that all three tables have."""
    d = F.col("theta") - F.col("star")
    return theta.join(star, key).join(fisher, key).agg((F.lit(lam / 2) * F.sum(F.col("f") * d * d)).alias("penalty"))


def scanned(value: np.ndarray, begins: np.ndarray, gamma: float) -> np.ndarray:
    """f_t = gamma * f_(t-1) + value_t, anew from every place where `begins` is true: by doubling, all places together."""
    f, place = value.astype(float), np.arange(len(value))
    place = place - np.maximum.accumulate(np.where(begins, place, 0))
    step = 1
    while step <= place.max(initial=0):
        reach = place >= step
        f[reach] += (gamma**step * np.concatenate([np.zeros(step), f[:-step]]))[reach]
        step *= 2
    return f


def running_fold(terms: DataFrame, key: str, order: str, value: str, gamma: float) -> DataFrame:
    """(key, order, f): f_t = gamma * f_(t-1) + value_t along `order` within each key; of equal places the smaller value comes first.

    Steps compose: a stretch of n steps takes f to gamma^n f + b. Rows are dealt into ranges of (key, order), every range is
    folded by itself, and what precedes a range in its key is composed from one row for each key and range. So a key of any
    number of steps is worked on by many tasks, and nothing is folded twice. A null value counts as 0."""
    n = max(1, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {f.name: f.dataType.simpleString() for f in terms.schema.fields}
    rows = terms.select(F.col(key).alias("k"), F.col(order).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    rows = rows.repartitionByRange(n, "k", "t", "v").sortWithinPartitions("k", "t", "v").withColumn("range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, steps = None, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()  # sorted: a key's rows are together
            begins = np.diff(code, prepend=-1) != 0
            f = scanned(b.column(2).to_numpy(), begins, gamma)
            place = np.arange(1, len(f) + 1)
            place = place - np.maximum.accumulate(np.where(begins, place - 1, 0))
            first = b.column(0)[0].as_py()
            if last is not None and last[0] == first:  # goes on from the batch before
                own = int(np.flatnonzero(begins)[1]) if begins.sum() > 1 else len(f)
                f[:own] += gamma ** place[:own] * carried
                place[:own] += steps
            last, carried, steps = (b.column(0)[-1].as_py(),), f[-1], place[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(place), pa.array(f)], names=["k", "t", "range", "steps", "f"])

    rows = written(rows.mapInArrow(run, f"k {kinds[key]}, t {kinds[order]}, range int, steps long, f double"), "fold")
    ends = rows.groupBy("k", "range").agg(F.max_by("f", "steps").alias("b"), F.max("steps").alias("n"))
    # a row for each range that a key has rows in: no more than there are ranges
    lists = ends.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("range", "n", "b"))).alias("s")).filter(F.size("s") > 1)
    start = F.array(F.struct(F.lit(-1).alias("range"), F.lit(0.0).alias("f")))
    one = lambda done, x: F.concat(done, F.array(F.struct(x["range"].alias("range"), (F.element_at(done, -1)["f"] * F.pow(F.lit(float(gamma)), x["n"]) + x["b"]).alias("f"))))
    after = F.aggregate("s", start, one)
    before = lists.select("k", F.explode(F.zip_with(F.slice(after, 1, F.size("s")), "s", lambda f, x: F.struct(x["range"].alias("range"), f["f"].alias("f")))).alias("x"))
    before = before.select(F.col("k").alias("bk"), F.col("x.range").alias("brange"), F.col("x.f").alias("bf"))
    out = rows.join(before, F.col("k").eqNullSafe(F.col("bk")) & (F.col("range") == F.col("brange")), "left")
    f = F.col("f") + F.coalesce(F.col("bf"), F.lit(0.0)) * F.pow(F.lit(float(gamma)), F.col("steps"))
    return out.select(F.col("k").alias(key), F.col("t").alias(order), f.alias("f"))


def coda_weights(q: Column, a: Column, k: Column) -> Column:
    """cos(q * a, k) of array columns; norms count as at least 1e-12."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    seen = F.zip_with(q, a, lambda x, y: x * y)
    norm = lambda v: F.greatest(F.sqrt(total(F.transform(v, lambda x: x * x))), F.lit(1e-12))
    return total(F.zip_with(seen, k, lambda x, y: x * y)) / (norm(seen) * norm(k))


def shard_bounds(total: int, world: int, ceil: bool = True) -> list[tuple[int, int]]:
    """[begin, end) of each rank's rows; sizes rounded up (the last shard shorter) or down (the rest dropped)."""
    if world < 1:
        raise ValueError("world must be at least 1")
    size = -(-total // world) if ceil else total // world
    return [(min(size * r, total), min(size * (r + 1), total)) for r in range(world)]


def sharded_lookup(asked: DataFrame, id_col: str, rows: DataFrame, row_col: str, value: str, bounds: list[tuple[int, int]]) -> DataFrame:
    """asked with the value of its row, 0 where no shard has it: each shard gives its rows or 0, and the shards' answers add
    up. An id lies in one shard at most, so the sum is one left join."""
    inside = F.lit(False)
    for a, b in bounds:
        inside = inside | ((F.col(id_col) >= a) & (F.col(id_col) < b))
    return asked.join(rows.select(F.col(row_col).alias("__r"), F.col(value).alias("__v")), inside & (F.col(id_col) == F.col("__r")), "left").withColumn(value, F.coalesce("__v", F.lit(0.0))).drop("__r", "__v")


def block_matmul(x: DataFrame, weight: np.ndarray, shards: int, bias: np.ndarray | None = None) -> DataFrame:
    """(id, o, y): rows of x (id, v) times weight (D, O), the inner dimension cut into shards whose partial products are
    summed; the bias is added once."""
    from loom.operators.vectors import over_block

    bounds = shard_bounds(weight.shape[0], shards)

    def work(ids, m, shift, w) -> pa.Table:
        y = sum(m[:, a:b] @ w[a:b] for a, b in bounds) + shift
        return pa.table({"id": np.repeat(ids, w.shape[1]), "o": np.tile(np.arange(w.shape[1], dtype=np.int32), len(ids)), "y": y.ravel()})

    return over_block(x, np.zeros(weight.shape[1]) if bias is None else bias, weight, work, "id long, o int, y double")


def gathered(rows: DataFrame, rank: str, order: str) -> DataFrame:
    """(pos, rank, order): the ranks' rows one after the other, ragged sizes and all."""
    from loom.operators.ordering import in_order

    own = in_order(rows, "__at", order, (rank,))
    sizes = own.groupBy(F.col(rank).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    start = (F.sum("__n").over(Window.orderBy("__k")) - F.col("__n")).alias("__start")  # a row for each rank
    return own.join(sizes.select("__k", start), F.col(rank).eqNullSafe(F.col("__k"))).select((F.col("__start") + F.col("__at")).alias("pos"), rank, order)


def reduced(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sum, avg, product) over ranks."""
    return rows.groupBy(key).agg(F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.product(value).alias("product"))


def class_sums(x: DataFrame, hold: Column, classes: int) -> dict[bool, tuple[np.ndarray, np.ndarray, int]]:
    """{held out: (H'H, H'Y, rows)} of rows (v, label) and a boolean column, labels one-hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = None, {False: 0, True: 0}
        for b in batches:
            if b.num_rows:
                m, y, h = rows_of(b.column(0)), b.column(1).to_numpy(), np.asarray(b.column(2).to_pylist(), bool)
                both = np.concatenate([m, np.eye(classes)[y]], 1)
                sums = sums or {k: np.zeros((m.shape[1], both.shape[1])) for k in count}
                for k in count:
                    sums[k] += m[h == k].T @ both[h == k]
                    count[k] += int((h == k).sum())
        for k in count if sums else ():
            yield pa.RecordBatch.from_pydict({"h": [k], "s": [[float(count[k]), *sums[k].ravel().tolist()]]})

    parts = x.select("v", "label", hold.alias("h")).mapInArrow(run, "h boolean, s array<double>")
    got = parts.select("h", F.posexplode("s").alias("p", "x")).groupBy("h", "p").agg(F.sum("x").alias("x")).collect()
    size = max((r["p"] for r in got), default=0)  # width * (width + classes)
    width = (math.isqrt(classes * classes + 4 * size) - classes) // 2
    out = {h: np.zeros(1 + size) for h in (False, True)}
    for r in got:
        out[r["h"]][r["p"]] = r["x"]
    cut = {h: (int(m[0]), m[1:].reshape(width, width + classes)) for h, m in out.items()}
    return {h: (m[:, :width], m[:, width:], n) for h, (n, m) in cut.items()}


def relu_projection(x: DataFrame, weight: np.ndarray | None = None) -> DataFrame:
    """(id, v): max(v W, 0); without W, v as it is."""
    if weight is None:
        return x.select("id", "v")
    from loom.operators.vectors import over_block

    def work(ids, m, _, w) -> pa.Table:
        return pa.table({"id": ids, "v": list(np.maximum(m @ w, 0))})

    return over_block(x, np.zeros(1), weight, work, "id long, v array<double>")


def targets(modules: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Rows whose name one of the patterns matches from its beginning; no pattern matches all."""
    return modules.filter(F.col(name).rlike("^(?:" + "|".join(patterns) + ")")) if patterns else modules


def active_sum(deltas: DataFrame, task: int) -> DataFrame:
    """(i, j, x): the adapters of tasks up to this one, added up."""
    return deltas.filter(F.col("task") <= task).groupBy("i", "j").agg(F.sum("x").alias("x"))


def fresh_block(old: np.ndarray | None, rows: int, width: int, seed: int) -> np.ndarray:
    """`rows` orthonormal rows, orthogonal to the rows of `old`."""
    new = np.random.default_rng(seed).standard_normal((rows, width))
    if old is not None and len(old):
        q = np.linalg.qr(old.T)[0]
        new = new - (new @ q) @ q.T
    return np.linalg.qr(new.T)[0].T


def weighted_draws(u: list[Column], weights: list[float]) -> Column:
    """Numbers of the choices that uniforms in [0, 1) fall on, in proportion to the weights, with replacement."""
    ends = np.cumsum(np.array(weights, float) / sum(weights))

    def one(x: Column) -> Column:
        out = F.lit(len(ends) - 1)
        for k in range(len(ends) - 2, -1, -1):
            out = F.when(x < float(ends[k]), k).otherwise(out)
        return out

    return F.array(*[one(x) for x in u])


def ridge_scores(x: DataFrame, weights: np.ndarray, digits: int | None = None) -> DataFrame:
    """(id, cid, score): the class whose row of `weights` (classes, width) has the largest product with the vector of each
    row of (id, v), ties to the smaller class. The weights have a fixed size and go to every task."""
    from loom.operators.vectors import over_block

    def work(ids, m, _, w) -> pa.Table:
        z = m @ w.T
        z = z if digits is None else np.round(z, digits)
        best = z.argmax(1)
        return pa.table({"id": ids, "cid": best.astype(np.int64), "score": z[np.arange(len(z)), best]})

    return over_block(x.select("id", "v"), np.arange(len(weights)), weights, work, "id long, cid long, score double")
