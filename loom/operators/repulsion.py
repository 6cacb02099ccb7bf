"""t-SNE's partition function and repulsion over a table of points, by a tree of cells that Spark builds: table in, table out.

1. Points of equal places are one atom with a number. Atoms get the interleaved bits of their cells at the deepest level, so a
   cell of any level is a range of codes.
2. A grouping by level and code prefix counts every cell. Cells that more than `leaf` atoms share are opened, level by level;
   the cells that stay are few, whatever the rows are, as `leaf` grows with them: at most about MOST_CELLS go to every task.
3. A task asks the tree for its atoms, all pairs of an atom and an open cell of a level together. A cell counts as its centre of
   mass where width^2 < angle^2 distance^2. Leaves that are too near are left: a row for each such atom and leaf.
4. These rows meet the leaf's atoms by a shuffle, a leaf's askers being dealt into so many groups that none is large; there every
   atom counts by itself. Sums come back by atom and from atoms to points.

Angle 0 is exact. It would open every cell, so each atom would ask every leaf; there the atoms meet in tiles instead, each of which
returns a row of sums an atom (`pushes`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.operators.stored import written
from loom.operators.vectors import BLOCK_BYTES, SIDE_BYTES, _against, rows_of, same_ids

DEPTH, LEAF, MOST_CELLS = 16, 256, 200_000
#: Pairs of an atom and a cell that a task works on together, and askers of a leaf in one group.
PAIRS, ASKERS = 1 << 20, 65_536
#: Pairs of two atoms that a task works on together.
TILE = 1 << 17
ATOM = "atom long, z double, f array<double>"


def codes_of(y: np.ndarray, low: np.ndarray, width: float) -> np.ndarray:
    """Interleaved bits of the cells at the deepest level."""
    cells = np.clip(((y - low) / width * (1 << DEPTH)).astype(np.int64), 0, (1 << DEPTH) - 1)
    code = np.zeros(len(y), np.int64)
    for level in range(DEPTH - 1, -1, -1):
        for k in range(y.shape[1]):
            code = code << 1 | (cells[:, k] >> level & 1)
    return code


class Cells:
    """Cells of a tree, by level and code: their numbers of points, centres of mass, and which are leaves."""

    def __init__(self, level: np.ndarray, code: np.ndarray, points: np.ndarray, mean: np.ndarray, atoms: np.ndarray, leaf: int, width: float):
        order = np.lexsort((code, level))
        self.level, self.code, self.points, self.mean, self.width = level[order], code[order], points[order].astype(float), mean[order], width
        self.leaf = (atoms[order] <= leaf) | (self.level == DEPTH)
        self.starts = np.searchsorted(self.level, np.arange(DEPTH + 2))

    def children(self, cells: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the cells given, child) for all children of cells of one level."""
        below = int(self.level[cells[0]]) + 1
        a, z = self.starts[below], self.starts[below + 1]
        first, last = (a + np.searchsorted(self.code[a:z], (self.code[cells] + i) << d) for i in (0, 1))
        many = last - first
        return np.repeat(np.arange(len(cells)), many), np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())

    def walk(self, y: np.ndarray, inside: np.ndarray, angle: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(points of y, cells, True) of cells far enough, (points, leaves, False) of leaves that aren't. inside: codes of y."""
        d = y.shape[1]
        point, cell = np.arange(len(y)), np.zeros(len(y), np.int64)
        while len(point):
            level = int(self.level[cell[0]])
            diff = y[point] - self.mean[cell]
            far = ((self.width / (1 << level)) ** 2 < angle * angle * (diff * diff).sum(1)) & (inside[point] >> d * (DEPTH - level) != self.code[cell])
            yield point[far], cell[far], True
            near = ~far & self.leaf[cell]
            yield point[near], cell[near], False
            point, cell = point[~far & ~near], cell[~far & ~near]
            if len(point):
                opened, back = np.unique(cell, return_inverse=True)
                parent, child = self.children(opened, d)
                many = np.bincount(parent, minlength=len(opened))
                first, times = (np.cumsum(many) - many)[back], many[back]
                cell = child[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                point = np.repeat(point, times)


def added(y: np.ndarray, point: np.ndarray, other: np.ndarray, count: np.ndarray, z: np.ndarray, f: np.ndarray) -> None:
    """Adds count * w and count * w^2 (y - other) to z and f at `point`."""
    diff = y[point] - other
    w = 1 / (1 + (diff * diff).sum(1))
    z += np.bincount(point, count * w, len(z))
    for k in range(y.shape[1]):
        f[:, k] += np.bincount(point, count * w * w * diff[:, k], len(z))


def pushes(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over b's rows, each counting n, of w and of w^2 (a - b), without rows of the same id: some rows of a at a time, so
    that a block of pairs stays near the processor."""
    z, f = np.zeros(len(a)), np.zeros(a.shape)
    own, other = same_ids(i, j)
    step = max(1, TILE // max(1, len(b)))
    for s in range(0, len(a) if len(b) else 0, step):
        e = min(len(a), s + step)
        w = np.ones((e - s, len(b)))
        for k in range(a.shape[1]):
            diff = np.subtract.outer(a[s:e, k], b[:, k])
            np.multiply(diff, diff, out=diff)
            w += diff
        np.reciprocal(w, out=w)
        first, last = np.searchsorted(own, [s, e])
        w[own[first:last] - s, other[first:last]] = 0
        z[s:e] = w @ n
        w *= w
        for k in range(a.shape[1]):
            diff = np.subtract.outer(a[s:e, k], b[:, k])
            diff *= w
            f[s:e, k] = diff @ n
    return z, f


def repulsion_exact(y: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(i, z, f) of a table (id, v) or (id, v, n), n being how many points lie there: all pairs, in tiles of bounded memory. The
    others at a row's own place count nothing."""

    def work(i, a, j, b, n=None) -> pa.Table:
        if not len(i) or not len(j):
            return pa.table({"i": pa.array([], pa.int64()), "z": pa.array([], pa.float64()), "f": pa.array([], pa.list_(pa.float64()))})
        z, f = pushes(i, a, j, b, np.ones(len(j)) if n is None else n)
        return pa.table({"i": i, "z": z, "f": list(f)})

    if len(y.columns) == 2:
        parts = _against(y, y, work, "i long, z double, f array<double>", most, SIDE_BYTES)
    else:
        # the count travels as a last number of the vector
        held = y.select(y.columns[0], F.concat(F.col(y.columns[1]), F.array(F.col(y.columns[2]).cast("double"))).alias("v"))
        parts = _against(held, held, lambda i, a, j, b: work(i, a[:, :-1], j, b[:, :-1], b[:, -1]), "i long, z double, f array<double>", most, SIDE_BYTES)
    sums = parts.select("i", "z", F.posexplode("f").alias("p", "x")).groupBy("i", "p").agg(F.sum("z").alias("z"), F.sum("x").alias("x"))
    return sums.groupBy("i").agg(F.max("z").alias("z"), F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("f"))


def repulsion(y: DataFrame, angle: float = 0.5, leaf: int = LEAF, most_cells: int = MOST_CELLS) -> DataFrame:
    """(i, z, f) of a table (id long, v array<double> of 1 to 3 numbers): the sums over all other points of w and of
    w^2 (y_i - y_j), w = 1 / (1 + |y_i - y_j|^2). Exact at angle 0.

    Defined cases: points with a null or non-finite number are nobody's and have no row; points of equal places see each other at
    distance 0; one point has z = 0; an empty table gives an empty one."""
    spark = y.sparkSession
    rows = y.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))).select("id", F.transform("v", lambda x: x + 0.0).alias("v"))
    atoms = written(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("atom", F.monotonically_increasing_id()), "atoms")
    d = atoms.select(F.max(F.size("v"))).first()[0]
    if d is None:
        return y.select(F.col("id").alias("i"), F.lit(0.0).alias("z"), "v").limit(0).toDF("i", "z", "f")
    if not 1 <= d <= 3:
        raise ValueError("a tree is of 1 to 3 dimensions")
    if not angle:
        others = repulsion_exact(atoms.select("atom", "v", "n")).withColumnRenamed("i", "atom").join(atoms, "atom")
        return rows.join(others.select("v", (F.col("z") + F.col("n") - 1).alias("z"), "f"), "v").select(F.col("id").alias("i"), "z", "f")
    box = atoms.agg(F.count(F.lit(1)), *[g(F.col("v")[k]) for k in range(d) for g in (F.min, F.max)]).first()
    low, high = np.array(box[1::2]), np.array(box[2::2])
    width = max(float((high - low).max()), 1e-300) * (1 + 1e-6)
    leaf = max(leaf, -(-4 * 2**d * box[0] // most_cells))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes_of(rows_of(b.column(1)), low, width))], names=["atom", "v", "n", "code"])

    atoms = written(atoms.select("atom", "v", "n").mapInArrow(coded, "atom long, v array<double>, n long, code long"), "atoms")
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")
    cells = atoms.select("v", "n", "code", levels).withColumn("at", F.expr(f"shiftright(code, {d} * ({DEPTH} - level))"))
    sums = [F.sum(F.col("v")[k] * F.col("n")).alias(f"s{k}") for k in range(d)]
    cells = written(cells.groupBy("level", "at").agg(F.count(F.lit(1)).alias("atoms"), F.sum("n").alias("n"), *sums), "cells")
    crowded = cells.filter(F.col("atoms") > leaf).select((F.col("level") + 1).alias("level"), F.col("at").alias("up"))
    held = cells.withColumn("up", F.expr(f"shiftright(at, {d})")).join(crowded, ["level", "up"], "left_semi")
    top = cells.filter("level = 0").withColumn("up", F.lit(0).cast("long")).select(held.columns)
    got = held.unionByName(top).toArrow()  # at most about most_cells: a cell here has a parent of over `leaf` atoms
    col = lambda c: got.column(c).to_numpy()
    tree = Cells(col("level").astype(np.int64), col("at"), col("n"), np.stack([col(f"s{k}") for k in range(d)], 1) / col("n")[:, None], col("atoms"), leaf, width)
    sent = spark.sparkContext.broadcast(tree)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        step = max(1, PAIRS // 4096)
        for b in batches:
            ids, m, n, code = b.column(0), rows_of(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            for a in range(0, len(m), step):
                own, z, f = m[a : a + step], n[a : a + step] - 1.0, np.zeros((len(m[a : a + step]), d))  # the others at the same place
                left: list[tuple[np.ndarray, np.ndarray]] = []
                for point, cell, far in tree.walk(own, code[a : a + step], angle):
                    if far:
                        added(own, point, tree.mean[cell], tree.points[cell], z, f)
                    elif len(point):
                        left.append((point, cell))
                point, cell = (np.concatenate(x) for x in zip(*left)) if left else (np.zeros(0, np.int64),) * 2
                # a row with its sums, and one for each leaf to be asked
                at = np.concatenate([np.arange(len(own)), point])
                which = np.concatenate([np.full(len(own), -1), cell])
                some = ids.slice(a, len(own)).take(pa.array(at))
                sums = [np.concatenate([z, np.zeros(len(point))]), np.concatenate([f, np.zeros((len(point), d))])]
                yield pa.RecordBatch.from_arrays([some, pa.array(which), pa.array(list(own[at]), pa.list_(pa.float64())), pa.array(sums[0]), pa.array(list(sums[1]), pa.list_(pa.float64()))], names=["atom", "cell", "v", "z", "f"])

    answers = written(atoms.mapInArrow(asked, "atom long, cell long, v array<double>, z double, f array<double>"), "asked")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaf of every atom."""
        tree = sent.value
        for b in batches:
            code = b.column(3).to_numpy()
            of = np.full(len(code), -1, np.int64)
            for level in range(DEPTH + 1):
                a, z = tree.starts[level], tree.starts[level + 1]
                if z > a:
                    at = np.minimum(a + np.searchsorted(tree.code[a:z], code >> d * (DEPTH - level)), z - 1)
                    of = np.where((of < 0) & tree.leaf[at] & (tree.code[at] == code >> d * (DEPTH - level)), at, of)
            yield pa.RecordBatch.from_arrays([pa.array(of), b.column(0), b.column(1), b.column(2)], names=["cell", "atom", "v", "n"])

    askers = answers.filter("cell >= 0").select("cell", "atom", "v")
    groups = askers.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("groups"))
    askers = askers.join(groups, "cell").select("cell", F.pmod(F.xxhash64("atom"), F.col("groups")).cast("int").alias("g"), "atom", "v")
    inside = atoms.mapInArrow(placed, "cell long, atom long, v array<double>, n long").join(groups, "cell")
    inside = inside.select("cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "atom", "v", "n")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"atom": pa.array([], pa.int64()), "z": pa.array([], pa.float64()), "f": pa.array([], pa.list_(pa.float64()))})
        own, other = (rows_of(t.column("v").combine_chunks()) for t in (left, right))
        ids, theirs, n = left.column("atom").to_numpy(), right.column("atom").to_numpy(), right.column("n").to_numpy()
        z, f = pushes(ids, own, theirs, other, n)
        return pa.table({"atom": ids, "z": z, "f": list(f)})

    found = askers.groupBy("cell", "g").cogroup(inside.groupBy("cell", "g")).applyInArrow(near, ATOM)
    parts = answers.filter("cell < 0").select("atom", "z", "f").unionByName(found)
    total = parts.groupBy("atom").agg(F.sum("z").alias("z"), *[F.sum(F.col("f")[k]).alias(f"f{k}") for k in range(d)])
    total = total.join(atoms.select("atom", "v"), "atom").select("v", "z", F.array(*[F.col(f"f{k}") for k in range(d)]).alias("f"))
    return rows.join(total, "v").select(F.col("id").alias("i"), "z", "f")


def partition_sum(y: DataFrame, angle: float = 0.5) -> float:
    """Z, the sum of w over all ordered pairs of points."""
    return repulsion(y, angle).agg(F.sum("z")).first()[0] or 0.0
