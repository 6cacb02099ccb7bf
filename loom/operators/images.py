"""Image arrays as rows: frames of any axis order as height, width, channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of channels by which an axis is taken for them where no layout is given.
CHANNELS = (1, 3, 4)


def guessed(shape: Column) -> Column:
    """The axes of one frame: HW, HWC or CHW."""
    last, first = F.element_at(shape, -1), F.element_at(shape, 1)
    return F.when(F.size(shape) == 2, "HW").when((F.size(shape) == 3) & last.isin(*CHANNELS), "HWC").when((F.size(shape) == 3) & first.isin(*CHANNELS), "CHW")


def as_frames(rows: DataFrame, layout: str | None = None, color: bool = False) -> DataFrame:
    """rows (... shape array<int>, data array<double>) of an array of frames with height, width and channels (int), data in the order
    of rows, columns and channels, and without shape. Pick frames by a condition on idx before, which reaches the source.

    layout: the letters of a frame's axes, H, W and perhaps C, in any order; guessed for each row where not given, and a row whose axes
    can't be is an error. color: one channel becomes three."""
    if layout is not None and sorted(layout) not in (["H", "W"], ["C", "H", "W"]):
        raise ValueError(f"the layout {layout!r} isn't made of H, W and perhaps C")
    have = F.lit(layout) if layout is not None else guessed(F.col("shape"))
    fits = have.isNotNull() & (F.length(have) == F.size("shape"))
    axes = F.when(fits, have).otherwise(F.raise_error(F.concat(F.lit("no layout of a frame of shape "), F.to_json("shape"))))
    place = lambda axis: F.instr(F.col("__axes"), axis)  # noqa: E731  0 where there is none
    size = lambda axis: F.when(place(axis) > 0, F.get("shape", place(axis) - 1)).otherwise(1)
    after = lambda axis: F.slice("shape", place(axis) + 1, F.size("shape"))
    stride = lambda axis: F.when(place(axis) > 0, F.aggregate(after(axis), F.lit(1), lambda a, x: a * x)).otherwise(0)
    rows = rows.withColumn("__axes", axes).withColumns({"height": size("H"), "width": size("W"), "channels": size("C"), "__h": stride("H"), "__w": stride("W"), "__c": stride("C")})
    h, w, c = (F.col(x) for x in ("height", "width", "channels"))
    total = h * w * c
    at = lambda p: F.floor(p / (w * c)) * F.col("__h") + F.floor(p / c) % w * F.col("__w") + p % c * F.col("__c")
    data = F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), lambda p: F.element_at("data", (at(p) + 1).cast("int")))).otherwise(F.slice("data", 1, 0))
    if color:
        data = F.when(c == 1, F.flatten(F.transform(data, lambda x: F.array_repeat(x, 3)))).otherwise(data)
        rows = rows.withColumn("__data", data).withColumn("channels", F.when(c == 1, 3).otherwise(c))
    else:
        rows = rows.withColumn("__data", data)
    return rows.withColumn("data", F.col("__data")).drop("shape", "__axes", "__h", "__w", "__c", "__data")
