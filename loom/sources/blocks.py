"""Where the arrays of container files lie, and their rows a block at a time.

`places` reads headers only: of every array its type, shape, and where in the file, or in the stream packed in it, its values
begin. `Rows` reads a range of an array's rows from there, in blocks of bounded size. What isn't packed is read by byte ranges,
so its rows can be dealt to many tasks. What is packed (a gzip file, a compressed variable of a MAT-file) is unpacked
from its beginning, and what is skipped is never held."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from loom.sources.files import opened
from loom.sources.readers import COMPRESSED, IDX_TYPES, MAT_NUMERIC, MAT_STORED, MATRIX, TENSOR_TYPES, MatFile, container_of, tensor_header, widened

PIECE = 256 << 10
BLOCK_BYTES = 32 << 20


class Raw:
    """The bytes of a file from its beginning; counts those it reads."""

    def __init__(self, file):
        self.file, self.at, self.read = file, 0, 0

    def take(self, n: int) -> bytes:
        self.file.seek(self.at)
        out = self.file.read(n)
        self.at, self.read = self.at + len(out), self.read + len(out)
        return out

    def skip(self, n: int) -> None:
        self.at += n


class Unpacked:
    """The bytes of what is packed in the next `size` bytes of a source (all of them if None), in order. A piece of the source
    is looked at at a time, and no more is unpacked than is taken or skipped. Members of a gzip file follow each other."""

    def __init__(self, source, gz: bool, size: int | None = None):
        self.source, self.bits, self.left = source, 31 if gz else 15, size
        self.inflate, self.ready, self.at = zlib.decompressobj(self.bits), b"", 0

    def more(self, n: int) -> bytes:
        """Up to n bytes; none at the end."""
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                if self.bits != 31 or not (rest := rest or self.pull()) or not rest.strip(b"\0"):
                    return b""
                self.inflate = zlib.decompressobj(self.bits)
            else:
                rest = self.inflate.unconsumed_tail or self.pull()
                if not rest:
                    raise ValueError("a packed stream is cut off")
            out = self.inflate.decompress(rest, n)
            if out:
                return out

    def pull(self) -> bytes:
        got = self.source.take(PIECE if self.left is None else min(PIECE, self.left))
        self.left = None if self.left is None else self.left - len(got)
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.ready], len(self.ready)
        while have < n and (got := self.more(min(n - have, PIECE))):
            parts.append(got)
            have += len(got)
        all_of = b"".join(parts)
        out, self.ready = all_of[:n], all_of[n:]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        while n > 0 and (got := self.take(min(n, PIECE))):
            n -= len(got)


@dataclass(frozen=True)
class Place:
    """An array in a file. layers: (start, gzip or not, size) of what it is packed in, from the outside; `at` counts in the innermost.
    rows is None where only the end of the stream tells. A row's values are `row_bytes` after the last row's; in column-major order,
    a column's are."""

    path: str
    key: str
    stored: str
    rows: int | None
    inner: tuple[int, ...]
    at: int
    row_bytes: int
    layers: tuple = ()
    columns: bool = False
    to: str = ""

    @property
    def width(self) -> int:
        return math.prod(self.inner)

    @property
    def item(self) -> int:
        return np.dtype(self.stored).itemsize

    def typed(self, values: np.ndarray) -> np.ndarray:
        return widened(values, "BF16") if self.to == "BF16" else values.astype(self.to) if self.to else values

    def source(self, file):
        out = Raw(file)
        for start, gz, size in self.layers:
            out.skip(start)
            out = Unpacked(out, gz, size)
        return out


def places(path: str, keys: set | None = None, records: list | None = None) -> list[Place]:
    """The arrays of a file, or those of the given names, in the order in which they lie there."""
    with opened(path) as f:
        size = f.size()
        raw = Raw(f)
        gz = raw.take(2) == b"\x1f\x8b"
        layers = ((0, True, None),) if gz else ()
        begin = lambda: Place(path, "", "u1", None, (), 0, 1, layers).source(f)
        if records is not None:
            found = record_places(path, records, None if gz else size, layers)
        else:
            head = begin().take(16)
            kind = container_of(head, None if gz else size)
            found = {"idx": idx_places, "mat": mat_places, "safetensors": tensor_places}[kind](path, begin(), layers, keys)
    found = [p for p in found if keys is None or p.key in keys]
    if not gz:
        for p in found:
            # what is packed in a plain file is known to be whole only when it is unpacked
            if not p.layers and p.rows and p.at + p.rows * p.width * p.item > size and records is None:
                raise ValueError(f"array {p.key!r} of {path} is cut off")
    return found


def record_places(path: str, fields: list, size: int | None, layers: tuple) -> list[Place]:
    kind = np.dtype([tuple(tuple(x) if isinstance(x, list) else x for x in f) for f in fields])
    if size is not None and size % kind.itemsize:
        raise ValueError(f"{size} bytes aren't records of {kind.itemsize}")
    out = []
    for name in kind.names:
        of, at = kind.fields[name][:2]
        out.append(Place(path, name, of.base.str, None if size is None else size // kind.itemsize, of.shape, at, kind.itemsize, layers))
    return out


def idx_places(path: str, source, layers: tuple, keys) -> list[Place]:
    head = source.take(4)
    shape = struct.unpack(f">{head[3]}I", source.take(4 * head[3]))
    kind, inner = IDX_TYPES[head[2]], tuple(shape[1:])
    return [Place(path, "0", kind, shape[0] if shape else 1, inner, 4 + 4 * head[3], math.prod(inner) * np.dtype(kind).itemsize, layers)]


def tensor_places(path: str, source, layers: tuple, keys) -> list[Place]:
    header, at = tensor_header(source.take(8), source.take)
    out = []
    for name, info in header.items():
        kind, shape = TENSOR_TYPES[info["dtype"]], info["shape"]
        inner = tuple(shape[1:])
        out.append(Place(path, name, kind, shape[0] if shape else 1, inner, at + info["data_offsets"][0], math.prod(inner) * np.dtype(kind).itemsize, layers, to="BF16" if info["dtype"] == "BF16" else ""))
    return sorted(out, key=lambda p: p.at)


def mat_places(path: str, source, layers: tuple, keys) -> list[Place]:
    """A variable's head alone is read and, where it is compressed, unpacked; the sources' counters tell where its values begin."""
    mat = MatFile(source.take(128))
    out = []
    while tag := mat.tag(source):
        kind, size, _ = tag
        begin = source.at
        end = begin + size + (0 if kind == COMPRESSED else -size % 8)
        own, inside = layers, source
        if kind == COMPRESSED:
            own, inside = (*layers, (begin, False, size)), Unpacked(source, False, size)
            kind, *_ = mat.tag(inside) or (0,)
        if kind == MATRIX and size:
            (_, flags), (_, sizes), (_, name) = (mat.element(inside) for _ in range(3))
            of, name = int(np.frombuffer(flags, mat.order + "u4")[0]) % 256, name.decode("latin-1")
            if of in MAT_NUMERIC and (keys is None or name in keys):
                stored, _, short = mat.tag(inside) or (0, 0, None)
                if stored not in MAT_STORED:
                    raise ValueError(f"the values of {name!r} in {path} are cut off or of no known type")
                shape = np.frombuffer(sizes, mat.order + "i4").tolist()
                type_of = np.dtype(MAT_STORED[stored]).newbyteorder(mat.order)
                out.append(Place(path, name, type_of.str, shape[0], tuple(shape[1:]), inside.at - (4 if short is not None else 0), shape[0] * type_of.itemsize, own, True, MAT_NUMERIC[of]))
        source.skip(end - source.at)
    return out


class Rows:
    """Rows of one file's places; counts the bytes it reads from the file."""

    def __init__(self, path: str, block_bytes: int = BLOCK_BYTES):
        self.path, self.block_bytes, self.read, self.open = path, block_bytes, 0, None

    def __enter__(self) -> "Rows":
        self.file = opened(self.path).__enter__()
        return self

    def __exit__(self, *e) -> None:
        self.file.close()

    def of(self, place: Place, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, block) of the rows from begin to end, in order."""
        end = place.rows if end is None else end
        reads = self._columns if place.columns else self._rows
        yield from reads(place, begin, end)

    def _source(self, place: Place, at: int):
        """The source of a place, moved on to a place in it. One that has been read less far than that goes on from there."""
        if self.open and self.open[0] == place.layers and place.layers and self.open[1].at <= at:
            source = self.open[1]
        else:
            source = place.source(self.file)
        self.open = (place.layers, source)
        source.skip(at - source.at)
        return source

    def _taken(self, source, n: int, place: Place) -> bytes:
        before = getattr(source, "read", 0)
        out = source.take(n)
        self.read += getattr(source, "read", 0) - before
        return out

    def _rows(self, place: Place, begin: int, end: int | None) -> Iterator[tuple[int, np.ndarray]]:
        own = place.width * place.item
        gaps = place.row_bytes != own  # records: other fields lie between
        step = max(1, self.block_bytes // max(1, place.row_bytes))
        while end is None or begin < end:
            n = step if end is None else min(step, end - begin)
            # the last record is whole though its other fields follow the one read
            want = n * place.row_bytes - (place.row_bytes - own if gaps and end is not None else 0)
            data = self._taken(self._source(place, place.at + begin * place.row_bytes), want, place)
            if end is None and len(data) < want:  # the stream ends with a record, of which `at` bytes come before the field
                n, rest = divmod(len(data) + place.at, place.row_bytes)
                if rest:
                    raise ValueError(f"{self.path} doesn't end with a record")
            elif len(data) < want:
                raise ValueError(f"array {place.key!r} of {self.path} is cut off")
            if not n:
                return
            if gaps:
                data = bytes(data) + bytes(max(0, n * place.row_bytes - len(data)))
                block = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (n, own), (place.row_bytes, 1)).tobytes()
            else:
                block = data[: n * own]
            yield begin, place.typed(np.frombuffer(block, place.stored)).reshape(n, *place.inner)
            begin += n
            if end is None and n < step:
                return

    def _columns(self, place: Place, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, self.block_bytes // max(1, place.width * place.item))
        for a in range(begin, end, step):
            n = min(step, end - a)
            block = np.empty((n, place.width), place.stored)
            for j in range(place.width):
                data = self._taken(self._source(place, place.at + j * place.row_bytes + a * place.item), n * place.item, place)
                if len(data) < n * place.item:
                    raise ValueError(f"array {place.key!r} of {self.path} is cut off")
                block[:, j] = np.frombuffer(data, place.stored)
            inner = place.inner[::-1]
            axes = (0, *range(len(inner), 0, -1))
            yield a, place.typed(block).reshape(n, *inner).transpose(axes)
