"""Signatures of file sets, directory sizes, and the dataset registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loom.functions.scalars import content_hash

_IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
_HALF = ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))
#: Name, (channel means, channel deviations), number of classes.
_TABLE = [
    ("cifar10", ((0.4914, 0.4822, 0.4465), (0.2470, 0.2435, 0.2616)), 10),
    ("cifar100", ((0.5071, 0.4867, 0.4408), (0.2675, 0.2565, 0.2761)), 100),
    ("svhn", ((0.4377, 0.4438, 0.4728), (0.1980, 0.2010, 0.1970)), 10),
    ("fashionmnist", ((0.2860,), (0.3530,)), 10),
    ("mnist", ((0.1307,), (0.3081,)), 10),
    ("tinyimagenet", ((0.4802, 0.4481, 0.3975), (0.2302, 0.2265, 0.2262)), 200),
    ("notmnist", ((0.1307,), (0.3081,)), 10),
    ("cub200", _IMAGENET, 200),
    ("imagenet", _IMAGENET, 1000),
    ("imagenet-r", _IMAGENET, 200),
    ("core50", _IMAGENET, 50),
    ("domainnet", _IMAGENET, 345),
    ("clear100", _IMAGENET, 100),
    ("syndigit", _HALF, 10),
    ("mnistm", _HALF, 10),
    ("mnist_rgb", _HALF, 10),
    ("flowers102", _HALF, 102),
    ("idigits", _HALF, 10),
    ("ucf101", _IMAGENET, 101),
]
DATASETS = [(name, classes) for name, _, classes in _TABLE]


def registry(spark) -> DataFrame:
    """(name, mean, std, n_classes)"""
    rows = [(n, list(m), list(s), c) for n, (m, s), c in _TABLE]
    return spark.createDataFrame(rows, "name string, mean array<double>, std array<double>, n_classes int")


def find_datasets(asked: DataFrame, col: str) -> DataFrame:
    """asked with the registry's row of that name, whatever its case."""
    return asked.join(F.broadcast(registry(asked.sparkSession)), F.lower(F.col(col)) == F.col("name"))


def hidden(path: Column) -> Column:
    """Whether a component of the path begins with a dot."""
    return path.rlike(r"(^|/)\.")


def signature(files: DataFrame, path_col: str, content_col: str, kind: str = "sha256") -> DataFrame:
    """(rel, hash) of all files that are not hidden."""
    return files.filter(~hidden(F.col(path_col))).select(F.col(path_col).alias("rel"), content_hash(F.col(content_col), kind).alias("hash"))


def signature_lines(signed: DataFrame) -> DataFrame:
    """The lines of a signature file, in order: "path: hash"."""
    return signed.orderBy("rel").select(F.concat_ws(": ", "rel", "hash").alias("value"))


def sign_folder(spark, folder: str, kind: str = "sha256", to: str | None = None) -> str:
    """Writes the signature file of all files below a folder that are not hidden, `to` being <folder>/.<kind> where it isn't
    given; hashes are computed by tasks, and the lines pass through the driver one partition at a time."""
    to = to or f"{folder.rstrip('/')}/.{kind}"
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(to)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    for line in signature_lines(folder_signature(spark, folder, kind, to)).toLocalIterator():
        out.write(bytearray(f"{line['value']}\n".encode()))
    out.close()
    return to


def folder_signature(spark, folder: str, kind: str = "sha256", but: str | None = None) -> DataFrame:
    """(rel, hash) of all files below a folder that are not hidden, without the file `but`."""
    from loom.sources.files import directory

    names = directory(spark, folder).select("path", "rel")
    if but:
        names = names.filter(~F.regexp_replace("path", "^file:/+", "/").eqNullSafe(F.regexp_replace(F.lit(but), "^file:/+", "/")))
    return file_hashes(names.filter(~hidden(F.col("rel"))), "path", kind).select("rel", "hash")


#: Bytes of a file that a task holds at a time.
PIECE = 4 << 20


def file_hashes(files: DataFrame, path_col: str, kind: str = "sha256") -> DataFrame:
    """files with `hash`: the digest of each file's bytes, read a piece at a time by the task that has its path."""
    import hashlib

    if kind not in ("sha256", "sha1", "md5"):
        raise ValueError(f"unknown kind {kind!r} of hash")
    at = files.columns.index(path_col)

    def run(batches):
        import pyarrow as pa

        from loom.sources.files import opened

        for b in batches:
            out = []
            for path in b.column(at).to_pylist():
                digest = hashlib.new(kind)
                with opened(path) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "hash"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(files.schema.fields))
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = files.toDF(*[f"c{i}" for i in range(len(files.columns))]).repartition(n).mapInArrow(run, f"{schema}, hash string")
    return out.toDF(*files.columns, "hash")


def validate_folder(spark, folder: str, kind: str = "sha256", signed: str | None = None) -> None:
    """Raises ValueError with the first files that were added, are missing or were changed since the folder was signed."""
    signed = signed or f"{folder.rstrip('/')}/.{kind}"
    lines = spark.read.option("pathGlobFilter", "*").text(signed)
    found = changes(read_signature(lines), folder_signature(spark, folder, kind, signed)).orderBy("change", "rel").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['change']}: {r['rel']}" for r in found))


def read_signature(lines: DataFrame) -> DataFrame:
    """(rel, hash) from such lines; the last colon divides, blank lines are skipped."""
    v = F.col("value")
    kept = lines.filter(F.trim(v) != "")
    return kept.select(F.trim(F.regexp_extract(v, r"^(.*):", 1)).alias("rel"), F.trim(F.element_at(F.split(v, ":"), -1)).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, change): added, missing or changed."""
    o, n = old.select(F.col("rel").alias("o_rel"), F.col("hash").alias("o_hash")), new.select(F.col("rel").alias("n_rel"), F.col("hash").alias("n_hash"))
    both = o.join(n, F.col("o_rel") == F.col("n_rel"), "full_outer")
    change = F.when(F.col("o_rel").isNull(), "added").when(F.col("n_rel").isNull(), "missing").when(F.col("o_hash") != F.col("n_hash"), "changed")
    return both.select(F.coalesce("o_rel", "n_rel").alias("rel"), change.alias("change")).filter(F.col("change").isNotNull())


def directory_sizes(files: DataFrame, path_col: str, size_col: str, depth: int) -> DataFrame:
    """(dir, size, files): sums over all files below each directory, to `depth` levels. A file counts once for each
    of its ancestors, summed in the map tasks first."""
    if depth < 1:
        raise ValueError("depth is at least 1")
    parts = F.split(F.col(path_col), "/")
    levels = F.least(F.size(parts) - 1, F.lit(depth))
    above = files.select(F.explode(F.when(levels > 0, F.transform(F.sequence(F.lit(1), levels), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array(F.lit("")))).alias("dir"), F.col(size_col).alias("size"))
    root = files.select(F.lit("").alias("dir"), F.col(size_col).alias("size")) if depth else None
    rows = above.filter("dir <> ''").unionByName(root)
    return rows.groupBy("dir").agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("files"))
