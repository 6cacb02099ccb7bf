"""Packing documents into training sequences along a space-filling curve.

Each document's token ids are hashed into a vector, which is projected to four dimensions and placed on
a Hilbert curve. Documents are range-sorted by their place on the curve, and neighbours are packed one
after the other, cut wherever a sequence is full; so a sequence holds documents of like vocabulary.

The ids are written once (the range sort samples its input and would tokenise twice); long documents are
rows of at most CHUNK ids from then on, so a document of any length is cut between tasks like others.
Each range packs its own rows. Its last, unfilled sequence is cut into sequences of powers of two, which
need no padding, so nothing has to be known of other ranges and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, parts_for, slices, text_of, texts_of, written

LENGTH, END_ID, CHUNK = 2048, 1, 1 << 16
DIMS, BITS, HASHED, SEED = 4, 12, 1024, 11
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(vocabulary: int) -> np.ndarray:
    """(vocabulary, DIMS): each id's signed hash bucket, already projected to DIMS."""
    r = np.random.default_rng(SEED)
    plane = r.standard_normal((HASHED, DIMS)).astype(np.float32)
    h = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    sign = np.where(h & np.uint64(1 << 40), 1, -1).astype(np.float32)
    return plane[(h % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n, d), integers below 2**bits, as int64.

    Gray-code form: from the highest bit down, each axis either inverts or exchanges the lower bits of
    the first axis; the bits of all axes interleaved are the Gray code of the place."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(d):
            turned = (x[axis] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[axis] ^= swap if axis else 0
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            out = (out << 1) | ((x[axis] >> level) & 1)
    return out


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected vectors; each coordinate is squashed to (0, 1) before it becomes a cell."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    cells = np.clip(((np.arcsin(np.clip(unit, -1, 1)) / np.pi + 0.5) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells)


def stored(size: int) -> str:
    """The narrowest number that holds ids below `size`."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenised(path: str, end_id: int):
    """Arrow function: (pk_id, pk_text) -> rows of at most CHUNK ids with their document's curve key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loom.llm.tokens import tokenizer

        cache = tokenizer(path)
        size = max(cache.tok.get_vocab_size(with_added_tokens=True), end_id + 1)
        table, kind = projection(size), stored(size)
        for b in slices(batches, most=1 << 20):
            some = [np.append(x, np.uint32(end_id)) for x in cache.encode(texts_of(b.column(1)))]
            sums = np.stack([sum(table[x[s : s + CHUNK]].sum(0) for s in range(0, len(x), CHUNK)) for x in some])
            rows = [
                (int(k), i, s, len(x), x[s : s + CHUNK].astype(kind).tobytes())
                for k, i, x in zip(curve_keys(sums), b.column(0).to_pylist(), some) for s in range(0, len(x), CHUNK)
            ]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                names=["pk_key", "pk_id", "pk_start", "pk_tokens", "pk_ids"],
            )

    return run


def packed(length: int, kind: str):
    """Arrow function over the sorted rows of one range: the pieces of its sequences, numbered from 0."""

    def powers(rest: int) -> list[int]:
        return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        seq = 0
        held: list[tuple] = []  # pieces of the open sequence: id, start, document's ids, bytes
        room = length

        def closed(rows: list[tuple], number: int) -> list[tuple]:
            out, off = [], 0
            for i, s, n, data in rows:
                k = len(data) // 4
                if out and out[-1][0] == i and out[-1][1] + out[-1][2] == s and out[-1][4] == n:  # the next chunk of a document
                    p = out[-1]
                    out[-1] = (i, p[1], p[2] + k, zlib.crc32(data, p[3]), n, p[5], p[6])
                else:
                    out.append((i, s, k, zlib.crc32(data), n, base + number, off))
                off += k
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names = [f.split()[0] for f in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in slices(batches):
            out: list[tuple] = []
            rows = zip(*(b.column(k).to_pylist() for k in ("pk_id", "pk_start", "pk_tokens", "pk_ids")))
            for i, s, n, data in rows:
                data = np.frombuffer(data, kind).astype("<u4").tobytes()
                view, at, k = memoryview(data), 0, len(data) // 4
                while at < k:
                    take = min(room, k - at)
                    held.append((i, s + at, n, view[4 * at : 4 * (at + take)]))
                    at += take
                    room -= take
                    if not room:
                        out += closed(held, seq)
                        held, room, seq = [], length, seq + 1
            held = [(*h[:3], bytes(h[3])) for h in held]
            if out:
                yield batch(out)
        out = []
        for size in powers(length - room):
            rows, room = [], size
            while room:
                i, s, n, data = held.pop(0)
                take = min(room, len(data) // 4)
                rows.append((i, s, n, data[: 4 * take]))
                if take < len(data) // 4:
                    held.insert(0, (i, s + take, n, data[4 * take :]))
                room -= take
            out += closed(rows, seq)
            seq += 1
        if out:
            yield batch(out)

    return run


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    A document is the ids of its text and then `end_id`. Sequences hold exactly `length` ids, but for the
    last ones of each range, whose lengths are powers of two; so no sequence is padded at all.

    Defined cases: null and empty texts are the single id `end_id`; a null id passes through; repeated
    rows are packed each by itself; an empty table gives an empty one; other columns play no part. Ranges
    are cut by (key, id, start), so many equal texts spread over tasks.
    """
    spark = docs.sparkSession
    ids = docs.schema[id_col].dataType
    rows = docs.select(named(id_col).cast("long").alias("pk_id"), text_of(text_col).alias("pk_text"))
    rows = rows.mapInArrow(tokenised(tokenizer_path, end_id), "pk_key long, pk_id long, pk_start long, pk_tokens long, pk_ids binary")
    rows = written(rows, "ids").withColumn("pk_crc", F.crc32("pk_ids"))
    kind = stored(max(vocabulary_size(tokenizer_path), end_id + 1))
    order = ["pk_key", "pk_id", "pk_tokens", "pk_start", "pk_crc"]
    stored_bytes = (rows.filter("pk_start = 0").agg(F.sum("pk_tokens")).first()[0] or 0) * np.dtype(kind).itemsize
    sorted_rows = rows.repartitionByRange(parts_for(spark, stored_bytes), "pk_key", "pk_id", "pk_start").sortWithinPartitions(*order)
    out = sorted_rows.select("pk_id", "pk_start", "pk_tokens", "pk_ids").mapInArrow(packed(length, kind), PIECES)
    return out.select(F.col("doc_id").cast(ids).alias(id_col), *[f.split()[0] for f in PIECES.split(", ")[1:]])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loom.llm.common import documents

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
