"""Hierarchies as tables: the nodes of paths, the closure of any parent table, and what is asked of them by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.operators.stored import dropped, written

#: Doublings at most: no path is longer than 2^MOST_ROUNDS.
MOST_ROUNDS = 32


def nodes(files: DataFrame, path_col: str = "path", size_col: str | None = None, depth: int | None = None) -> DataFrame:
    """(path, name, parent, depth, kind, size): the files and the directories above them, each once, the root being "". A path
    deeper than `depth` ends there, as a leaf that has the sizes of all below it.

    Defined cases: empty and null paths are no nodes; repeated paths are one file with their sizes together; a path that is a file and
    also lies above another is a directory with its own size added."""
    size = F.col(size_col).cast("long") if size_col else F.lit(0).cast("long")
    rows = files.filter(F.length(path_col) > 0).select(F.split(F.col(path_col), "/").alias("parts"), size.alias("size"))
    if depth is not None:
        rows = rows.select(F.slice("parts", 1, depth).alias("parts"), "size")
    level = lambda k: F.array_join(F.slice("parts", 1, k), "/")
    n = F.size("parts")
    each = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.when(k > 0, level(k)).otherwise("").alias("path"), k.alias("depth"), (k < n).alias("above"), F.when(k == n, F.col("size")).otherwise(F.lit(0)).alias("own")))
    # a directory is one row of a map task, however many files it has
    found = rows.select(F.inline(each)).groupBy("path", "depth").agg(F.max("above").alias("above"), F.sum("own").cast("long").alias("size"))
    name, up = F.element_at(F.split("path", "/"), -1), F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)) - 1)")
    return found.select("path", name.alias("name"), F.when(F.col("depth") > 1, up).when(F.col("depth") == 1, F.lit("")).alias("parent"), "depth", F.when(F.col("above"), "directory").otherwise("file").alias("kind"), "size")


def closure(parents: DataFrame, node: str = "path", parent: str = "parent") -> DataFrame:
    """(ancestor, descendant, distance) of a table of nodes and their parents (null at a root), every node being its own ancestor at
    distance 0. By doubling: a round joins all pairs so far with the ancestors twice as far, so paths of length n take log n.

    Raises ValueError where parents lead back to a node."""
    up = parents.select(F.col(node).alias("node"), F.col(parent).alias("far")).filter("far is not null")
    pairs = written(parents.select(F.col(node).alias("descendant"), F.col(node).alias("ancestor"), F.lit(0).cast("long").alias("distance")), "closure")
    jump = written(up, "closure-jump")
    for k in range(MOST_ROUNDS):
        if jump.isEmpty():
            return pairs.select("ancestor", "descendant", "distance")
        if not pairs.filter("distance > 0 and ancestor = descendant").isEmpty():
            break
        further = pairs.join(jump, F.col("ancestor") == F.col("node")).select("descendant", F.col("far").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
        last = (pairs, jump)
        pairs = written(pairs.unionByName(further), "closure")
        jump = written(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("next")), "far").select("node", F.col("next").alias("far")), "closure-jump")
        dropped(*last)
    raise ValueError("parents lead back to a node")


def children(tree: DataFrame, of: str) -> DataFrame:
    """Nodes right below one."""
    return tree.filter(F.col("parent") == of)


def below(tree: DataFrame, pairs: DataFrame, of: DataFrame, col: str) -> DataFrame:
    """(top, the columns of tree ...): the nodes at or below each of the nodes asked for in a column of `of`."""
    asked = pairs.join(of.select(F.col(col).alias("ancestor")).distinct(), "ancestor")
    return asked.select(F.col("ancestor").alias("top"), F.col("descendant").alias("path"), "distance").join(tree, "path").select("top", "distance", *tree.columns)


def found(tree: DataFrame, name: str) -> DataFrame:
    """Leaves of exactly that name; if there are none, those whose names contain it."""
    leaves = tree.filter(F.col("kind") == "file")
    if not leaves.filter(F.col("name") == name).isEmpty():
        return leaves.filter(F.col("name") == name)
    return leaves.filter(F.contains("name", F.lit(name)))


def sizes(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, size, files) of all nodes: the files at or below them."""
    own = tree.select(F.col("path").alias("descendant"), "size", (F.col("kind") == "file").cast("long").alias("file"))
    return pairs.join(own, "descendant").groupBy(F.col("ancestor").alias("path")).agg(F.sum("size").cast("long").alias("size"), F.sum("file").cast("long").alias("files"))
