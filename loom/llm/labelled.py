"""Rows to learn from: a bounded, hash-chosen sample of the labelled training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, text_of, written

#: At most so many labelled rows of either class are learned from; a classifier needs no more.
MOST_PER_CLASS = 6000


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `fold`; a null id is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, id_col="doc_id", text_col="text", most=MOST_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(rows of tr_id, tr_text, tr_label; how many labelled training ids each class has).

    Ids are taken in the order of a hash. At most 2 * most ids are broadcast, which bounds that join. Null
    labels and ids are left out; an id with several labels counts as 1 if any is."""
    ids = labels.filter(named(id_col).isNotNull() & named(label_col).isNotNull() & ~held_out(named(id_col), folds, fold))
    ids = written(ids.groupBy(named(id_col).alias("tr_id")).agg(F.max((named(label_col) > 0).cast("int")).alias("tr_label")), "labels")
    counts = {r["tr_label"]: r["n"] for r in ids.groupBy("tr_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for k in (0, 1):
        own = ids.filter(F.col("tr_label") == k).orderBy(F.xxhash64("tr_id"), "tr_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(named(id_col).alias("tr_id"), text_of(text_col).alias("tr_text")).join(F.broadcast(written(chosen, "sample")), "tr_id")
    return rows.select("tr_id", "tr_text", "tr_label"), {0: counts.get(0, 0), 1: counts.get(1, 0)}


def unlabelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, id_col="doc_id", text_col="text", most=2 * MOST_PER_CLASS) -> DataFrame:
    """(tr_id, tr_text) of training rows without a label, by hash: of the `most` ids that come first in the order of
    another hash, those that have none. Only ids are sorted, and the first ones of each map task travel."""
    ids = docs.select(named(id_col).alias("tr_id")).filter(F.col("tr_id").isNotNull() & ~held_out(F.col("tr_id"), folds, fold))
    chosen = written(ids.orderBy(F.xxhash64(F.lit(3), "tr_id"), "tr_id").limit(most).distinct(), "other-sample")
    known = labels.filter(named(label_col).isNotNull()).select(named(id_col).alias("known_id")).join(F.broadcast(chosen), F.col("known_id") == F.col("tr_id")).select("tr_id")
    chosen = written(chosen.join(known.distinct(), "tr_id", "left_anti"), "unlabelled")
    return docs.select(named(id_col).alias("tr_id"), text_of(text_col).alias("tr_text")).join(F.broadcast(chosen), "tr_id")


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x, dense, y, weight, l2: float = 1.0, rounds: int = 30, block: int = 1024):
    """Weights (of x, then of dense) and intercept of a ridge logistic regression by Newton steps. x may be of a
    narrow type: only `block` rows at a time are widened, so memory is that of x and of one Hessian."""
    import numpy as np

    n, d = len(x), x.shape[1] + dense.shape[1] + 1
    w, ridge = np.zeros(d), np.full(d, l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        g, h = ridge * w, np.diag(ridge)
        for a in range(0, n, block):
            some = slice(a, a + block)
            x1 = np.concatenate([x[some].astype(float), dense[some], np.ones((len(x[some]), 1))], 1)
            p = sigmoid(x1 @ w)
            g += x1.T @ (weight[some] * (p - y[some]))
            h += x1.T @ (x1 * np.maximum(weight[some] * p * (1 - p), 1e-9)[:, None])
        step = np.linalg.solve(h, g)
        big = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(big, 1e-12))
        if big < 1e-6:
            break
    return w[:-1], float(w[-1])
