"""Pairwise distances, nearest neighbours and column statistics of vector tables.

A vector table has an id column and an array column. Two physical paths for everything that meets all rows
of another table: up to BLOCK_BYTES the other table is a NumPy block that every task gets; beyond that both
sides are dealt into blocks and every pair of blocks is one task (blocks_of). Either way a task's memory is
bounded, and distances are computed a block of rows at a time, not pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 4096
#: Where a task returns less than its pairs, a block's bytes on the left side (on the right: BLOCK_BYTES), and the pairs of rows
#: for which one task is made where the right side is one block.
SIDE_BYTES, TASK_PAIRS = 16 << 20, 1 << 28
METRICS = {"cosine": 0, "manhattan": 1, "euclidean": 2}


def metric_of(metric: str | int) -> int:
    """0 is cosine, p >= 1 the Lp norm. Names: cosine, manhattan, euclidean."""
    if isinstance(metric, str):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}, or an int from 0 to 127")
        return METRICS[metric]
    if not 0 <= metric <= 127:
        raise ValueError("a metric given as a number is 0 (cosine) or the p of Lp, at most 127")
    return metric


def distance_block(x: np.ndarray, y: np.ndarray, metric: str | int) -> np.ndarray:
    """(rows of x, rows of y) distances; cosine's denominator has 1e-8 added."""
    p = metric_of(metric)
    if p == 0:
        sim = (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :] + 1e-8)
        return 1 - np.clip(sim, -1, 1)
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for a in range(0, len(x), step):
        d = np.abs(x[a : a + step, None, :] - y[None, :, :])
        out[a : a + step] = d.sum(2) if p == 1 else np.sqrt((d * d).sum(2)) if p == 2 else (d**p).sum(2) ** (1 / p)
    return out


def distance(a: Column, b: Column, metric: str | int) -> Column:
    """The same for two array columns of one row, without Python."""
    p = metric_of(metric)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if p == 0:
        dot = total(F.zip_with(a, b, lambda x, y: x * y))
        norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
        return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norms + 1e-8)))
    powered = total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))
    return powered if p == 1 else F.sqrt(powered) if p == 2 else F.pow(powered, F.lit(1.0 / p))


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of a list column hold finite numbers only, and these as a matrix)."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    held = column.filter(pa.array(known)) if not known.all() else column
    m = rows_of(held)
    good = np.isfinite(m).all(1)
    known[known] = good
    return known, m if good.all() else m[good]


def collected(df: DataFrame, most: int = BLOCK_BYTES, finite: bool = False) -> tuple[np.ndarray, ...] | None:
    """(ids, matrix, further columns ...) of a table (id long, v array<double>, ...) in id order, or None where it is beyond
    `most` bytes. finite: without the rows whose vector is null or holds null, NaN or infinite numbers.

    The size is measured before anything is collected."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(df.columns[1]))).first()
    more = len(df.columns) - 2
    if n * ((width or 0) * 8 + 8 + 8 * more) > most:
        return None
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, 0)), *[np.zeros(0, np.int64)] * more
    got = df.toArrow()
    ids, column = got.column(0).to_numpy(), got.column(1).combine_chunks()
    known, values = finite_rows(column) if finite else (np.ones(n, bool), rows_of(column))
    order = np.argsort(ids[known], kind="stable")
    return ids[known][order], values[order], *[got.column(c + 2).to_numpy()[known][order] for c in range(more)]


def blocks_of(x: DataFrame, y: DataFrame, work, schema: str, rows: int = BLOCK_ROWS, finite: bool = False, side: int = 0) -> DataFrame:
    """work(ids of x, matrix of x, ids of y, matrix of y) -> Arrow table, for every pair of blocks of x and y. finite: of the
    rows that hold finite numbers only. side: blocks are not of `rows` rows but of so many bytes of x and four times as many of
    y, so that tables travel seldom; for work whose memory doesn't grow with the pairs."""
    if side:
        sizes = [t.agg(F.count(F.lit(1)), F.max(F.size(t.columns[1]))).first() for t in (x, y)]
        nx, ny = (max(1, math.ceil(n * (8 * (width or 0) + 8) / most)) for (n, width), most in zip(sizes, (side, 4 * side)))
    else:
        nx, ny = (max(1, math.ceil(t.count() / rows)) for t in (x, y))
    deal = lambda t, n: F.pmod(F.xxhash64(t.columns[0]), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.select(deal(x, nx).alias("bx"), each(ny).alias("by"), F.col(x.columns[0]).alias("id"), F.col(x.columns[1]).alias("v"))
    right = y.select(each(nx).alias("bx"), deal(y, ny).alias("by"), F.col(y.columns[0]).alias("id"), F.col(y.columns[1]).alias("v"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = [t.column("id").to_numpy() for t in (a, b)]
        both = [rows_of(t.column("v").combine_chunks()) if t.num_rows and not finite else np.zeros((0, 0)) for t in (a, b)]
        for i, t in enumerate((a, b)):
            if finite and t.num_rows:
                known, both[i] = finite_rows(t.column("v").combine_chunks())
                ids[i] = ids[i][known]
        return work(ids[0], both[0], ids[1], both[1])

    return left.groupBy("bx", "by").cogroup(right.groupBy("bx", "by")).applyInArrow(tile, schema)


def over_block(x: DataFrame, ids: np.ndarray, y: np.ndarray, work, schema: str, finite: bool = False) -> DataFrame:
    """work(ids of x, matrix of x, ids, y) -> Arrow table, a batch of x at a time."""
    held = x.sparkSession.sparkContext.broadcast((ids, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y_ids, block = held.value
        for b in batches:
            if b.num_rows and finite:
                known, m = finite_rows(b.column(1))
                yield from work(b.column(0).to_numpy()[known], m, y_ids, block).to_batches()
            elif b.num_rows:
                yield from work(b.column(0).to_numpy(), rows_of(b.column(1)), y_ids, block).to_batches()

    return x.mapInArrow(run, schema)


def dealt(x: DataFrame, others: int) -> DataFrame:
    """x in as many parts as its pairs with so many other rows ask for; as it is where these are few."""
    tasks = math.ceil(x.count() * others / TASK_PAIRS) if others > BLOCK_ROWS else 0
    return x.repartition(tasks, x.columns[0]) if tasks > 1 else x


def _against(x: DataFrame, y: DataFrame, work, schema: str, most: int, side: int = 0) -> DataFrame:
    """side: see blocks_of."""
    small = collected(y, most)
    if small is None:
        return blocks_of(x, y, work, schema, side=side)
    return over_block(dealt(x, len(small[0])) if side else x, *small, work, schema)


def same_ids(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in i, places in j) of all pairs of equal ids."""
    order = np.argsort(j, kind="stable")
    first, last = (np.searchsorted(j[order], i, at) for at in ("left", "right"))
    many = last - first
    return np.repeat(np.arange(len(i)), many), order[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]


def distance_matrix(x: DataFrame, y: DataFrame, metric: str | int, most: int = BLOCK_BYTES) -> DataFrame:
    """All pairs as rows (i, j, dist). x and y: (id long, v array<double>)."""
    metric = metric_of(metric)

    def work(i, a, j, b) -> pa.Table:
        d = distance_block(a, b, metric) if len(i) and len(j) else np.zeros((len(i), len(j)))
        return pa.table({"i": np.repeat(i, len(j)).astype(np.int64), "j": np.tile(j, len(i)).astype(np.int64), "dist": d.ravel()})

    return _against(x, y, work, "i long, j long, dist double", most)


def candidates(a: np.ndarray, b: np.ndarray, k: int, p: int, skip: tuple[np.ndarray, np.ndarray] | None, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) of pairs that hold every row's k nearest and all ties with them: by a matrix product where the
    metric has one, with room for its rounding and for `slack`, by how much distances may be rounded later. Rows are finite;
    where their powers wouldn't be, all are scaled down together, which leaves the order."""
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if p and top > 1e-20 and top > (1e300 ** (1 / p)) / 1e4:
        a, b, slack = a / top, b / top, slack / top
    if p == 2:
        x, y = (a * a).sum(1), (b * b).sum(1)
        far = y[None, :] - 2 * (a @ b.T) + x[:, None]
        error = 1e-12 * (x[:, None] + y[None, :])
    else:
        far = distance_pairs_block(a, b, p)
        error = 1e-12 * (1 + far)
    if skip is not None:
        far[skip] = np.inf
    if len(b) <= k:
        return np.nonzero(np.isfinite(far))
    last = np.partition(far + error, k - 1, axis=1)[:, k - 1]  # no less than the k-th distance (p = 2: its square)
    known = np.where(np.isfinite(last), np.maximum(last, 0), np.inf)
    room = 4 * slack * (np.sqrt(known) + slack) if p == 2 else np.full(len(known), 2 * slack)
    return np.nonzero((far - error <= (known + room)[:, None]) & np.isfinite(far))


def distance_pairs_block(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """distance_block, where norms beyond double are no obstacle to cosines."""
    if p:
        return distance_block(a, b, p)
    small = lambda m: m / np.where((t := np.abs(m).max(1, initial=0.0, keepdims=True)) > 1e150, t * 1e-100, 1.0)
    return distance_block(small(a), small(b), 0)


def distance_pairs(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Distances of a's rows to the same rows of b; those whose powers are beyond double, or below it, from scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        if p == 0:
            small = lambda m: m / np.where((t := np.abs(m).max(1, initial=0.0, keepdims=True)) > 1e150, t * 1e-100, 1.0)
            a, b = small(a), small(b)
            return 1 - np.clip((a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)) + 1e-8), -1, 1)
        d = np.abs(a - b)
        out = d.sum(1) if p == 1 else np.sqrt((d * d).sum(1)) if p == 2 else (d**p).sum(1) ** (1 / p)
        top = d.max(1, initial=0.0)
        odd = np.isfinite(top) & (top > 0) & (~np.isfinite(out) | (top < 1e-290 ** (1 / p)))
        if odd.any():
            out[odd] = top[odd] * ((d[odd] / top[odd][:, None]) ** p).sum(1) ** (1 / p)
        return out


def quick_candidates(a: np.ndarray, b: np.ndarray, k: int, skip: tuple[np.ndarray, np.ndarray] | None, slack: float) -> tuple[np.ndarray, np.ndarray] | None:
    """candidates for Euclidean distances by one product in single precision, b being `augmented`. None where its rounding
    leaves too many of them.

    A product gives x.y - |y|^2 / 2, which falls with the distance. The k-th largest of the maxima of groups of columns is no
    larger than a row's k-th largest value, so what is below that by more than the rounding is none of the k nearest."""
    block, scale, norm, n, groups = b
    if n <= k:
        return None
    own = a * scale
    x = (own * own).sum(1)
    s = np.concatenate([own.astype(np.float32), np.ones((len(a), 1), np.float32)], 1) @ block
    if skip is not None:
        s[skip] = -np.inf
    best = s.reshape(len(a), groups, -1).max(1)
    last = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k].astype(float)
    error = (own.shape[1] + 16) * 2.0**-24 * (np.sqrt(x) * norm + norm * norm / 2) + 1e-30
    some, slack = last > -1e30, slack * scale
    last = np.where(some, last, 0)
    known = np.sqrt(np.maximum(x - 2 * (last - error), 0))
    least = np.where(some, last - 2 * error - 2 * slack * (known + slack), -1e30).astype(np.float32)
    least = np.nextafter(least, np.float32(-np.inf))[:, None]
    r, c = np.nonzero(best >= least)
    if len(r) > 16 * k * len(a) + 4096:
        return None
    c = (c[:, None] + best.shape[1] * np.arange(groups)[None, :]).ravel()
    r = np.repeat(r, groups)
    ok = s[r, c] >= least[r, 0]
    return (r[ok], c[ok]) if ok.sum() <= 16 * k * len(a) + 4096 else None


def augmented(b: np.ndarray, k: int, top: float) -> tuple:
    """What quick_candidates takes of b; top: the largest absolute number of both sides."""
    groups = max(1, min(32, len(b) // (8 * k)))
    width = -(-len(b) // groups)
    scale = 2.0 ** -np.ceil(np.log2(top)) if top > 1e-300 else 1.0
    own = b * scale
    y = (own * own).sum(1)
    block = np.zeros((b.shape[1] + 1, width * groups), np.float32)
    block[:-1, : len(b)] = own.T
    block[-1, : len(b)], block[-1, len(b) :] = -y / 2, -2e30
    return block, scale, float(np.sqrt(y.max(initial=0.0))), len(b), groups


def without_copies(j: np.ndarray, b: np.ndarray, k: int) -> np.ndarray | None:
    """Places of the rows of b without those that k + 1 equal rows of smaller ids come before, which are nobody's k nearest
    even where a row's own id takes no part. None where that leaves none out."""
    with np.errstate(over="ignore"):
        norm = (b * b).sum(1)
    order = np.argsort(norm)
    first = np.flatnonzero(np.append(True, norm[order][1:] != norm[order][:-1]))
    many = np.diff(np.append(first, len(b)))
    if not (many > k + 1).any():
        return None
    some = order[np.repeat(many > k + 1, many)]  # only rows of equal norms are compared
    whole = np.ascontiguousarray(b[some] + 0.0)
    _, of = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.lexsort((j[some], of))
    of, ids = of[by], j[some][by]
    new = np.append(True, of[1:] != of[:-1])
    number = np.cumsum(np.append(True, new[1:] | (ids[1:] != ids[:-1])))  # rows of one id count once
    keep = np.ones(len(b), bool)
    keep[some[by]] = number - number[new][np.cumsum(new) - 1] <= k
    return None if keep.all() else np.flatnonzero(keep)


#: Products that a task has in memory at once, and pairs whose distances it computes one by one.
TILE, ONE_BY_ONE = 1 << 23, 1 << 15


def nearest_rows(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, k: int, metric: int, exclude_same: bool, digits: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows of a, rows of b, distances, ranks from 0) of the k nearest, in order, some rows of a at a time."""
    if len(b) > k + 1 and b.shape[1] and (kept := without_copies(j, b, k)) is not None:
        for r, c, *rest in nearest_rows(i, a, j[kept], b[kept], k, metric, exclude_same, digits):
            yield r, kept[c], *rest
        return
    slack = 0.0 if digits is None else 10.0**-digits
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    quick = augmented(b, k, top) if metric == 2 and len(b) > k and top < 1e300 else None
    step = max(1, TILE // max(1, len(j)))
    for s in range(0, len(i) if len(j) else 0, step):
        ids, own = i[s : s + step], a[s : s + step]
        skip = same_ids(ids, j) if exclude_same else None
        found = quick_candidates(own, quick, k, skip, slack) if quick else None
        if found is None:  # fewer at once, as double precision has several such blocks
            parts = [(u, candidates(own[u : u + step // 8 + 1], b, k, metric, None if skip is None else _within(skip, u, step // 8 + 1), slack)) for u in range(0, len(own), step // 8 + 1)]
            found = tuple(np.concatenate(z) for z in zip(*[(r + u, c) for u, (r, c) in parts]))
        r, c = found
        d = np.concatenate([distance_pairs(own[r[u : u + ONE_BY_ONE]], b[c[u : u + ONE_BY_ONE]], metric) for u in range(0, max(1, len(r)), ONE_BY_ONE)])
        d = d if digits is None else np.round(d, digits)
        ok = np.isfinite(d)
        r, c, d = r[ok], c[ok], d[ok]
        order = np.lexsort((j[c], d, r))
        r, c, d = r[order], c[order], d[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        ok = rank < k
        yield r[ok] + s, c[ok], d[ok], rank[ok]


def _within(skip: tuple[np.ndarray, np.ndarray], begin: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    some = (skip[0] >= begin) & (skip[0] < begin + many)
    return skip[0][some] - begin, skip[1][some]


def nearest(x: DataFrame, y: DataFrame, k: int, metric: str | int = 2, exclude_same: bool = False, most: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """The k nearest rows of y for each row of x: (i, rank from 1, j, dist); ties to the smaller j. With `digits`,
    distances are rounded before they are compared, so that engines that sum in other orders agree on ties.

    Vectors that are null, or hold null, NaN or infinite components, are nobody's neighbours and have none; neither are pairs whose
    distance is beyond double.

    A matrix product finds the candidates of a block, a few more than k for each row; their distances are then computed
    one by one. Where y is one block that every task gets, a row's neighbours are final there; only x is dealt into parts by its pairs."""
    from pyspark.sql import Window

    metric = metric_of(metric)
    schema = "i long, j long, dist double, rank int"

    def work(i, a, j, b) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))]
        for r, c, d, rank in nearest_rows(i, a, j, b, k, metric, exclude_same, digits):
            found.append((i[r], j[c], d, rank + 1))
        return pa.table({n: np.concatenate(v).astype(t) for n, v, t in zip(("i", "j", "dist", "rank"), zip(*found), ("i8", "i8", "f8", "i4"))})

    small = collected(y, most, finite=True)
    if small is not None:
        return over_block(dealt(x, len(small[0])), *small, work, schema, finite=True).select("i", "rank", "j", "dist")
    best = Window.partitionBy("i").orderBy("dist", "j")
    return blocks_of(x, y, work, schema, finite=True, side=SIDE_BYTES).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("i", "rank", "j", "dist")


def label_votes(x: DataFrame, k: int, metric: str | int = 2, most: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """(id, label, predicted) of a table (id, v, label int): the label that most of a row's k nearest others have, ties to the
    smaller; rows without neighbours (see `nearest`) are left out.

    Where the table is one block, labels travel in it and votes are counted where neighbours are found; only large tables are dealt into parts."""
    from pyspark.sql import Window

    rows, metric = x.select("id", "v", "label"), metric_of(metric)
    small = collected(rows, most, finite=True)
    if small is not None:
        held = rows.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            j, block, of = held.value
            names, code = np.unique(of, return_inverse=True)
            for batch in batches:
                known, a = finite_rows(batch.column(1))
                batch = batch.filter(pa.array(known))
                ids = batch.column(0).to_numpy()
                for r, c, *_ in nearest_rows(ids, a, j, block, k, metric, True, digits):
                    own, at = np.unique(r, return_inverse=True)
                    votes = np.bincount(at * len(names) + code[c], minlength=len(own) * len(names)).reshape(len(own), len(names))
                    some = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(names[votes.argmax(1)].astype(np.int32))], names=["id", "label", "predicted"])

        return dealt(rows, len(small[0])).mapInArrow(run, "id long, label int, predicted int")
    labels = rows.select("id", "label")
    near = nearest(rows.select("id", "v"), rows.select("id", "v"), k, metric, exclude_same=True, most=most, digits=digits)
    votes = near.join(labels, F.col("j") == F.col("id")).groupBy("i", F.col("label").alias("predicted")).agg(F.count(F.lit(1)).alias("votes"))
    first = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("votes"), "predicted"))
    return votes.withColumn("rk", first).filter("rk = 1").join(labels, F.col("i") == F.col("id")).select("id", "label", "predicted")


def column_sums(x: DataFrame, columns: list[str], products: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, sums, sums of products) of numeric columns: one pass, one row per partition, then one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2)
        for b in batches:
            m = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns], 1)
            n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_pydict({"i": np.append(i.ravel(), [-1]).astype(np.int32), "j": np.append(j.ravel(), [-1]).astype(np.int32), "x": np.append(g.ravel(), [float(n)])})
        yield pa.RecordBatch.from_pydict({"i": np.full(len(s), -2, np.int32), "j": np.arange(len(s), dtype=np.int32), "x": s})

    got = x.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    n, s, g = 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2)
    for r in got:
        if r["i"] == -1:
            n = int(r["x"])
        elif r["i"] == -2:
            s[r["j"]] = r["x"]
        else:
            g[r["i"], r["j"]] = r["x"]
    return n, s, g


def vector_products(x: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of rows, column sums, Gram matrix XᵀX) of a table (id, v): one job, 1 + D + D x D partial sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if b.num_rows:
                m = rows_of(b.column(b.num_columns - 1))
                n, s, g = n + len(m), m.sum(0) + (0 if s is None else s), m.T @ m + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_pydict({"s": [[float(n), *s.tolist(), *g.ravel().tolist()]]})

    parts = x.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("p", "x"))
    got = parts.groupBy("p").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(got.num_rows)
    total[got.column(0).to_numpy()] = got.column(1).to_numpy()
    if not len(total):
        return 0, np.zeros(0), np.zeros((0, 0))
    width = (math.isqrt(4 * len(total) - 3) - 1) // 2  # of 1 + D + D * D
    return int(total[0]), total[1 : 1 + width], total[1 + width :].reshape(width, width)
