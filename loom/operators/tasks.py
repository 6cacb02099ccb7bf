"""Splitting labelled samples into tasks: disjoint and blurry categories, exposure, shares and batches.

Random permutations are orders of md5(seed:id). Samples are numbered by ranges (ordering.positions), so a
task or category that holds most samples is still many tasks' work; so are categories where there are many."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loom.operators.labels import UNLABELED
from loom.operators.ordering import in_order, numbered, shuffle_key, shuffled


def checked_axes(samples: DataFrame, axes: list[str]) -> DataFrame:
    """samples, if every axis is one of its columns (else AttributeError) and has a value in every row (else ValueError)."""
    lost = [a for a in axes if a not in samples.columns]
    if lost:
        raise AttributeError(f"the samples have no label axis {lost[0]!r}")
    row = samples.agg(*[F.count(F.lit(1)).alias("n"), *[F.count(F.col(a)).alias(f"n_{i}") for i, a in enumerate(axes)]]).first()
    for i, a in enumerate(axes):
        if row[f"n_{i}"] != row["n"]:
            raise ValueError(f"label axis {a!r} has {row[f'n_{i}']} values for {row['n']} samples")
    return samples


def categories(samples: DataFrame, key: str) -> DataFrame:
    """(category, at): sorted distinct keys without UNLABELED."""
    found = samples.select(F.col(key).alias("category")).filter(F.col("category") != UNLABELED if dict(samples.dtypes)[key] != "string" else F.lit(True)).distinct()
    return numbered(found, "at", ["category"])


def category_product(samples: DataFrame, axes: list[str]) -> DataFrame:
    """(at, axes...): all combinations of the axes' values, the first axis major; its size is the product of the
    numbers of distinct labels, never of samples."""
    parts = [samples.select(a).filter(F.col(a) != UNLABELED).distinct() for a in axes]
    both = reduce(lambda a, b: a.join(b), parts)
    return numbered(both, "at", axes)


def cut_sizes(total: int, tasks: int, seed: int) -> list[int]:
    """total cut at tasks - 1 points made of md5(seed:k)."""
    import hashlib

    if total == 0:
        return [0] * tasks
    u = [int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) / 4503599627370496.0 for k in range(1, tasks)]
    cuts = [0, *sorted(int(x * total) for x in u), total]
    return [b - a for a, b in zip(cuts, cuts[1:])]


def split_categories(cats: DataFrame, tasks: int, n: int, seed: int, varying: bool = False) -> DataFrame:
    """(category, at, kind, task): n percent of the categories disjoint and the rest blurry, each kind shared out
    equally (or at cut points); what does not divide is in no task."""
    if tasks < 1 or not 0 <= n <= 100:
        raise ValueError("tasks must be at least 1 and n a percentage")
    c = cats.count()
    disjoint = c * n // 100 // tasks * tasks
    blurry = (c - disjoint) // tasks * tasks
    order = numbered(cats, "pos", [shuffle_key(seed, F.col("at")), "at"])
    kind = F.when(F.col("pos") < disjoint, "disjoint").when(F.col("pos") < disjoint + blurry, "blurry")
    place = F.when(F.col("pos") < disjoint, F.col("pos")).otherwise(F.col("pos") - disjoint)

    def task_of(total: int, s: int):
        sizes = cut_sizes(total, tasks, s) if varying else [total // tasks] * tasks
        out, end = F.lit(tasks - 1), total
        for t in range(tasks - 1, -1, -1):
            out = F.when(place < end, t).otherwise(out) if t < tasks - 1 else out
            end -= sizes[t]
        return out

    task = F.when(F.col("pos") < disjoint, task_of(disjoint, seed + 1)).otherwise(task_of(blurry, seed + 2)).cast("int")
    return order.withColumn("kind", kind).withColumn("task", task).filter(F.col("kind").isNotNull()).select("category", "at", "kind", "task")


def configured(cats: DataFrame, config: list[list]) -> DataFrame:
    """The same from explicit lists of categories, all disjoint; a category listed twice is in the last task."""
    home = {c: t for t, task in enumerate(config) for c in task}
    kind = cats.schema["category"].dataType.simpleString()
    listed = cats.sparkSession.createDataFrame(list(home.items()), f"category {kind}, task int")
    out = cats.join(F.broadcast(listed), "category").select("category", "at", F.lit("disjoint").alias("kind"), "task")
    known = {r["category"] for r in out.select("category").collect()}  # at most the listed ones
    lost = [c for c in home if c not in known]
    if lost:
        raise ValueError(f"unknown categories: {lost[:8]}")
    return out


def homes(samples: DataFrame, key: str, split: DataFrame, id_col: str = "idx") -> DataFrame:
    """(idx, kind, task): samples whose category is in a task."""
    return samples.select(id_col, F.col(key).alias("category")).join(split.select("category", "kind", "task"), "category").select(id_col, "kind", "task")


def exchanged(home: DataFrame, m: int, seed: int, id_col: str = "idx", counts: list[int] | None = None) -> DataFrame:
    """home with the first m percent of each task's blurry samples pooled, permuted, and dealt back in equal numbers
    (or counts[task], at most what the task has)."""
    blurry = in_order(home.filter("kind = 'blurry'"), "pos", id_col, ("task",))
    sizes = {r["task"]: r["n"] for r in blurry.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each task
    give = {t: n * m // 100 if counts is None else min(n, counts[t]) for t, n in sorted(sizes.items())}
    if not give:
        return home.filter("kind = 'disjoint'").select(id_col, "kind", "task")
    given = F.element_at(F.create_map(*[F.lit(x) for pair in give.items() for x in pair]), F.col("task"))
    stay = blurry.filter(F.col("pos") >= given).select(id_col, "kind", "task")
    pool = shuffled(blurry.filter(F.col("pos") < given).select(id_col, "kind"), "at", seed, id_col)
    # the task of a place in the pool: that of the first end beyond it
    ends = F.array(*[F.struct(F.lit(e).alias("end"), F.lit(t).cast("int").alias("task")) for t, e in zip(give, accumulate(give.values()))])
    dealt = pool.select(id_col, "kind", F.element_at(F.filter(ends, lambda e: e["end"] > F.col("at")), 1)["task"].alias("task"))
    return home.filter("kind = 'disjoint'").select(id_col, "kind", "task").unionByName(stay).unionByName(dealt)


def task_order(home: DataFrame, seed: int, id_col: str = "idx") -> DataFrame:
    """(task, pos, idx): each task's samples in a permutation of their own."""
    return shuffled(home, "pos", seed, id_col, ("task",)).select("task", "pos", id_col)


def online_batches(order: DataFrame, batch: int, repeats: int, id_col: str = "idx") -> DataFrame:
    """(task, pos, idx): every batch `repeats` times in a row, the short last one too."""
    if batch < 1 or repeats < 1:
        raise ValueError("batch and repeats must be at least 1")
    sizes = order.groupBy(F.col("task").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    out = order.join(F.broadcast(sizes), F.col("task") == F.col("t")).withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    b = F.floor(F.col("pos") / batch)
    width = F.least(F.lit(batch).cast("long"), F.col("n") - b * batch)
    return out.select("task", (b * batch * repeats + F.col("again") * width + F.col("pos") % batch).cast("long").alias("pos"), id_col)


def replica_share(order: DataFrame, replicas: int, id_col: str = "idx") -> DataFrame:
    """(task, rank, pos, idx): every replicas-th sample from each rank on; the tail that does not divide is dropped."""
    sizes = order.groupBy(F.col("task").alias("t")).agg(F.floor(F.count(F.lit(1)) / replicas).alias("share"))
    out = order.join(F.broadcast(sizes), F.col("task") == F.col("t")).filter(F.col("pos") < F.col("share") * replicas)
    return out.select("task", (F.col("pos") % replicas).cast("int").alias("rank"), F.floor(F.col("pos") / replicas).alias("pos"), id_col)


def exposed(samples: DataFrame, axes: list[str], seen: DataFrame) -> DataFrame:
    """Samples whose key is among the rows of `seen` (same axes). An UNLABELED axis matches anything, a sample with no
    labelled axis nothing. One equi semi join for each set of labelled axes, so that none is a nested loop."""
    out = []
    for mask in range(1, 1 << len(axes)):
        on = [a for i, a in enumerate(axes) if mask >> i & 1]
        own = samples
        for i, a in enumerate(axes):
            own = own.filter((F.col(a) != UNLABELED) if mask >> i & 1 else (F.col(a) == UNLABELED))
        out.append(own.join(seen.select(*on).distinct(), on, "left_semi").select(*samples.columns))
    return reduce(DataFrame.unionByName, out)
