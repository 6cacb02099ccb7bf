"""Array containers as files: idx, MAT-file version 5, safetensors and plain records of a table of vectors.

A partition becomes files of about FILE_BYTES, so a task holds the rows of one file at most; they are written under the name of the
task's attempt. The manifest of committed files is a written table, so a task that is run again leaves at most files that nobody
reads."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loom.operators.stored import fresh_path, written
from loom.sources.files import filesystem


def idx_bytes(m: np.ndarray) -> bytes:
    return struct.pack(f">HBB{m.ndim}I", 0, 0x0E, m.ndim, *m.shape) + m.astype(">f8").tobytes()


def safetensors_bytes(m: np.ndarray, name: str = "rows") -> bytes:
    head = json.dumps({name: {"dtype": "F64", "shape": list(m.shape), "data_offsets": [0, 8 * m.size]}}).encode()
    return struct.pack("<Q", len(head)) + head + m.astype("<f8").tobytes()


def mat_bytes(m: np.ndarray, name: str = "rows") -> bytes:
    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)

    flags, sizes = struct.pack("<II", 6, 0), np.array(m.shape, "<i4").tobytes()  # 6 is the class of doubles
    inner = element(6, flags) + element(5, sizes) + element(1, name.encode("latin-1")) + element(9, m.astype("<f8").tobytes(order="F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + element(14, inner)


def record_bytes(m: np.ndarray) -> bytes:
    return m.astype("<f8").tobytes()


#: What writes a matrix, by the container's name.
KINDS = {"idx": idx_bytes, "mat": mat_bytes, "safetensors": safetensors_bytes, "records": record_bytes}


FILE_BYTES = 64 << 20


def matrices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The rows (id, values) of Arrow batches as matrices of about `most` bytes, in order."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        m = np.column_stack([b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)])
        step = max(1, most // max(1, 8 * m.shape[1]))
        for a in range(0, len(m), step):
            piece = m[a : a + step]
            if held and size + piece.nbytes > most:
                yield np.concatenate(held)
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield np.concatenate(held)


def write_vectors(df: DataFrame, kind: str, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a table (id long, v array<double>) as matrices whose first column is the id: (file, rows)."""
    encode = KINDS[kind]
    folder = folder or fresh_path(df.sparkSession, "arrays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, (fs, root) = TaskContext.get(), filesystem(folder)
        for i, m in enumerate(matrices(batches, file_bytes)):
            fs.create_dir(root, recursive=True)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{i:04d}.{kind}"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(encode(m))
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "rows": [len(m)]})

    return written(df.mapInArrow(run, "file string, rows long"), "manifest")
