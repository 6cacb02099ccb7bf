"""Array containers as Spark data sources.

    register(spark)                                             # once per session
    spark.read.format("arrays").option("path", p).load()        # idx, MAT-file 5, safetensors by their first bytes; gzip too
    spark.read.format("arrays").option("path", p).option("index", "0:1000:2, ..., -1").load()
    spark.read.format("arrays").option("path", p).load().filter("key = 'w' and idx between 10 and 19")

Rows are (path, key, idx, shape, data, whole): one for each index of an array's first axis, data its values as doubles in
row-major order, whole the same as longs where they are integers, shape the remaining axes.

Options: path (files, comma-separated), paths (the same as a JSON list, for names with commas), keys (only these arrays; a JSON
list or comma-separated), records (JSON list of fields, for files of plain records), index (as NumPy writes it: rows, then the
axes of a row; positions of rows are taken once and idx stays that of the whole array), gap (runs with so many bytes between
them are one read).

Partitions are planned from headers: an array of a file that isn't packed is read by as many tasks as it has blocks of
BLOCK_BYTES, each its own byte runs. Conditions on path, key and idx are applied before anything is read. Given a schema of
some of the columns, only these are made, and without data and whole no values are read.

A gzip file is one task, which holds a block at a time; a compressed MAT variable, whose columns come one after the other, is
unpacked by every task for its own block of rows."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from loom.sources import indexing
from loom.sources.blocks import Place, Rows, places
from loom.sources.readers import TensorFile

SCHEMA = "path string, key string, idx long, shape array<int>, data array<double>, whole array<long>"
BLOCK_BYTES = 32 << 20
#: A block of a compressed variable: each costs a pass over all of it.
PACKED_BYTES = 128 << 20
#: Headers read at a time while partitions are planned.
PLANNERS = 16


def rows_as_batches(path: str, key: str, values: np.ndarray, idx: np.ndarray, names: list[str]):
    """The rows of an array, in batches of bounded size. `names`: the columns to make."""
    shape = list(values.shape[1:])
    width = math.prod(shape)
    step = max(1, BLOCK_BYTES // max(1, 8 * width))
    for a in range(0, len(values), step):
        n = len(values[a : a + step])
        cols = {"path": lambda: pa.array([path] * n), "key": lambda: pa.array([key] * n), "idx": lambda: pa.array(idx[a : a + step]), "shape": lambda: pa.array([shape] * n, pa.list_(pa.int32()))}  # noqa: B023
        if "data" in names or "whole" in names:
            own = np.ascontiguousarray(values[a : a + step]).reshape(-1)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            cols["data"] = lambda: pa.ListArray.from_arrays(ends, pa.array(own.astype(np.float64)))  # noqa: B023
            cols["whole"] = lambda: whole_numbers(own, ends, key)  # noqa: B023
        yield pa.RecordBatch.from_arrays([cols[c]() for c in names], names=names)


def whole_numbers(values: np.ndarray, ends: pa.Array, key: str) -> pa.Array:
    if values.dtype.kind not in "iu":
        return pa.nulls(len(ends) - 1, pa.list_(pa.int64()))
    if values.dtype.itemsize == 8 and values.dtype.kind == "u" and len(values) and values.max() >> np.uint64(63):
        raise ValueError(f"array {key!r} has integers of over 63 bits")
    return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int64)))


class _Part(InputPartition):
    """Rows of a file's arrays: (place, positions). Positions are a range where they follow each other."""

    def __init__(self, path: str, pieces: list[tuple[Place, range | np.ndarray | None]]):
        self.path, self.pieces = path, pieces


def _paths(options: dict) -> list[str]:
    if options.get("paths"):
        return json.loads(options["paths"])
    if not options.get("path"):
        raise ValueError("the option path is needed")
    return [p.strip() for p in options["path"].split(",") if p.strip()]


def _keys(options: dict) -> set[str] | None:
    text = options.get("keys") or options.get("key")
    if not text:
        return None
    return set(json.loads(text)) if text.lstrip().startswith("[") else {k.strip() for k in text.split(",")}


class _ArraysReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.names, self.files, self.keys = names, _paths(options), _keys(options)
        self.records = json.loads(options["records"]) if options.get("records") else None
        index = indexing.parsed(options.get("index") or options.get("slice") or "")
        self.index = index if index else (slice(None),)
        if self.index[0] is Ellipsis:
            self.index = (slice(None), *self.index)
        self.gap = int(options.get("gap") or 0)
        self.low, self.high, self.among = 0, None, None  # of idx

    def pushFilters(self, filters):
        """Conditions on path, key and idx are kept whole; all others stay with Spark."""
        for f in filters:
            attribute = getattr(f, "attribute", ())  # Not has none
            column = attribute[0] if len(attribute) == 1 else None
            if isinstance(f, IsNotNull) and column in ("path", "key", "idx"):
                continue  # none of them is ever null
            values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, (EqualTo, EqualNullSafe)) else None
            if values is not None and None in values:
                yield f
            elif column in ("path", "key") and values is not None:
                wanted = set(values)
                if column == "path":
                    self.files = [p for p in self.files if p in wanted]
                else:
                    self.keys = wanted if self.keys is None else self.keys & wanted
            elif column == "idx" and values is not None:
                self.among = set(values) if self.among is None else self.among & set(values)
            elif column == "idx" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == "idx" and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def wanted(self, place: Place) -> range | np.ndarray:
        """Ascending positions of the rows to read."""
        (own,), _ = indexing.compact(self.index[0], (place.rows,))
        own = own[np.searchsorted(own, self.low) : None if self.high is None else np.searchsorted(own, max(self.high, self.low))]
        if self.among is not None:
            own = own[np.isin(own, [i for i in self.among if isinstance(i, int)])]
        return range(int(own[0]), int(own[-1]) + 1) if len(own) and own[-1] - own[0] + 1 == len(own) else own

    def plan(self, path: str) -> list[_Part]:
        parts: list[_Part] = []
        streamed: list = []
        for place in places(path, self.keys, self.records):
            if place.rows is None:  # the end of the stream tells
                streamed.append((place, None))
                continue
            rows = self.wanted(place)
            if place.layers and not place.columns:
                streamed.append((place, rows))
                continue
            each = place.width * place.item if place.columns else place.row_bytes
            step = max(1, (PACKED_BYTES if place.layers else BLOCK_BYTES) // max(1, each))
            parts += [_Part(path, [(place, rows[a : a + step])]) for a in range(0, len(rows), step)]
        return parts + ([_Part(path, streamed)] if streamed else [])

    def partitions(self):
        with ThreadPoolExecutor(PLANNERS) as pool:
            parts = [p for some in pool.map(self.plan, self.files) for p in some]
        return parts or [_Part("", [])]

    def read(self, partition):
        if not partition.pieces:
            return
        with Rows(partition.path, BLOCK_BYTES) as rows:
            for place, positions in partition.pieces:
                for idx, values in self.blocks(rows, place, positions):
                    yield from rows_as_batches(place.path, place.key, values, idx, self.names)

    def blocks(self, rows: Rows, place: Place, positions):
        """(positions, values) of blocks of the rows, the rest of the index applied to each row."""
        inner = self.index[1:]
        if "data" not in self.names and "whole" not in self.names and positions is not None:  # shapes alone, of arrays without values
            shape = np.broadcast_to(np.zeros((), np.int8), place.inner)[inner].shape if place.inner or inner else ()
            yield np.asarray(positions, np.int64), np.broadcast_to(np.zeros((), np.int8), (len(positions), *shape))
            return
        if not place.layers and not place.columns and place.row_bytes == place.width * place.item and (inner or not isinstance(positions, range)):
            step = max(1, BLOCK_BYTES // max(1, place.row_bytes))
            for a in range(0, len(positions), step):
                own = np.asarray(positions[a : a + step], np.int64)
                of_row, small = indexing.compact(inner, place.inner) if place.inner else ([], inner)
                runs = indexing.byte_runs([own, *of_row], (place.rows, *place.inner), place.item)
                data = indexing.read_runs(lambda at, size: rows.file.read_at(size, place.at + at), *runs, self.gap)
                block = place.typed(np.frombuffer(data, place.stored)).reshape(len(own), *map(len, of_row))
                yield own, each_row(block, small)
            return
        if positions is None:  # rows of a stream whose end isn't known yet
            if self.index[0] != slice(None):
                raise ValueError("records of a packed file have no index of rows: their number isn't known")
            for first, block in rows.of(place):
                own = np.arange(first, first + len(block), dtype=np.int64)
                mask = np.ones(len(own), bool) if self.among is None else np.isin(own, list(self.among))
                mask &= (own >= self.low) & (own < (self.high if self.high is not None else first + len(own)))
                yield from self.picked(own[mask], block[mask], inner)
            return
        if len(positions):
            first, last = int(positions[0]), int(positions[-1]) + 1
            for a, block in rows.of(place, first, last):
                own = np.arange(a, a + len(block), dtype=np.int64)
                mask = slice(None) if isinstance(positions, range) else np.isin(own, positions)
                yield from self.picked(own[mask], block[mask], inner)

    def picked(self, own: np.ndarray, block: np.ndarray, inner: tuple):
        if len(own):
            yield own, each_row(block, inner)


def each_row(block: np.ndarray, inner: tuple) -> np.ndarray:
    """block with an index applied to every row of it."""
    if any(isinstance(x, (list, np.ndarray)) for x in inner):  # NumPy may put axes of arrays before the rows'
        return np.stack([row[inner] for row in block]) if len(block) else block[(slice(None), *inner)]
    return block[(slice(None), *inner)] if inner else block


def _names(schema) -> list[str]:
    known = [c.split()[0] for c in SCHEMA.split(", ")]
    unknown = [f.name for f in schema.fields if f.name not in known]
    if unknown:
        raise ValueError(f"unknown columns {', '.join(unknown)}; there are {', '.join(known)}")
    return [f.name for f in schema.fields]


class ArraysSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ArraysReader(dict(self.options), _names(schema))


class TensorsSource(ArraysSource):
    """The same for safetensors files alone, with the options key and slice for keys and index."""

    @classmethod
    def name(cls) -> str:
        return "tensors"


class _HeaderPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _paths(options)

    def partitions(self):
        return [_HeaderPart(p) for p in self.files]

    def read(self, partition):
        for name, info in TensorFile(partition.path).header.items():
            yield (partition.path, name, info["dtype"], info["shape"], *info["data_offsets"])


class TensorHeaderSource(DataSource):
    """Names, types, shapes and offsets of a safetensors file's tensors, without their values."""

    @classmethod
    def name(cls) -> str:
        return "tensor_header"

    def schema(self) -> str:
        return "path string, name string, dtype string, shape array<long>, begin long, end long"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(dict(self.options))


def register(spark) -> None:
    for source in (ArraysSource, TensorsSource, TensorHeaderSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
