import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from loom.sources import arrays as sa
from loom.sources import readers as rd
from loom.sources.json_text import parsed
from pyspark.sql import functions as F


def idx_bytes(a, code, kind):
    return bytes([0, 0, code, a.ndim]) + struct.pack(f">{a.ndim}I", *a.shape) + a.astype(kind).tobytes()


@pytest.mark.parametrize("code,kind", list(rd.IDX_TYPES.items()))
@pytest.mark.parametrize("shape", [(5,), (2, 3, 4)])
def test_idx(code, kind, shape):
    a = np.arange(np.prod(shape)).reshape(shape).astype(kind)
    data = idx_bytes(a, code, kind)
    for d in (data, gzip.compress(data)):
        assert np.array_equal(rd.read_arrays(d)[0], a)
    with pytest.raises(ValueError):
        rd.read_arrays(data[:-1])


def element(kind, body, o, small=False):
    if small:
        return struct.pack(o + "I", len(body) << 16 | kind) + body.ljust(4, b"\0")
    return struct.pack(o + "II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def matrix(name, a, o, cls=6, stored=9, kind="f8", small=False):
    body = element(6, struct.pack(o + "II", cls, 0), o) + element(5, np.array(a.shape, o + "i4").tobytes(), o)
    body += element(1, name.encode(), o, small and len(name) <= 4)
    body += element(stored, a.astype(np.dtype(kind).newbyteorder(o)).tobytes(order="F"), o, small and a.nbytes <= 4)
    return struct.pack(o + "II", rd.MATRIX, len(body)) + body


def packed(m, o):
    z = zlib.compress(m)
    return struct.pack(o + "II", rd.COMPRESSED, len(z)) + z  # no padding


def mat_file(parts, o):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(o + "H", 0x0100) + (b"IM" if o == "<" else b"MI")
    return head + b"".join(parts)


@pytest.mark.parametrize("o", ["<", ">"])
def test_mat(o):
    a = np.arange(2 * 3 * 4 * 2, dtype=float).reshape(2, 3, 4, 2)
    b = np.array([[1, 2]])
    parts = [matrix("a", a, o), packed(matrix("b", b, o, 6, 2, "u1", small=True), o), matrix("text", b, o, cls=4, stored=4, kind="u2"), packed(matrix("n" * 600, b, o), o), matrix("last", b, o, 12, 3, "i2")]
    data = mat_file(parts, o)
    got = rd.read_arrays(data)
    assert set(got) == {"a", "b", "n" * 600, "last"}  # char isn't numbers
    assert np.array_equal(got["a"], a) and got["b"].dtype == np.dtype("f8") and got["b"].tolist() == [[1, 2]] and got["last"].dtype == np.dtype("i4")
    assert set(rd.read_arrays(data, keys=["b"])) == {"b"}
    assert set(rd.read_arrays(data, keys=["n" * 600])) == {"n" * 600}
    with pytest.raises(ValueError, match="7.3"):
        rd.read_arrays(b"MATLAB 7.3 MAT-file".ljust(128))


def tensors(items, metadata=True):
    header, values, at = ({"__metadata__": {"a": "b"}} if metadata else {}), b"", 0
    for name, (dtype, a) in items.items():
        raw = a.tobytes()
        header[name] = {"dtype": dtype, "shape": list(a.shape), "data_offsets": [at, at + len(raw)]}
        values, at = values + raw, at + len(raw)
    h = json.dumps(header).encode()
    return struct.pack("<Q", len(h)) + h + values


@pytest.mark.parametrize("dtype,kind", [(d, k) for d, k in rd.TENSOR_TYPES.items() if d != "BF16"])
def test_tensor_types(dtype, kind):
    a = (np.arange(12) % 2 if kind == "?" else np.arange(12)).astype(kind).reshape(3, 4)
    assert np.array_equal(rd.read_arrays(tensors({"w": (dtype, a)}))["w"], a)


def test_bf16():
    x = np.array([1.0, -2.5, 0.15625], np.float32)
    half = (x.view(np.uint32) >> 16).astype("<u2")
    assert np.array_equal(rd.read_arrays(tensors({"w": ("BF16", half)}))["w"], x)


def test_tensor_blocks(tmp_path):
    a = np.arange(4 * 5 * 6, dtype="<f4").reshape(4, 5, 6)
    path = str(tmp_path / "t")
    with open(path, "wb") as f:
        f.write(tensors({"w": ("F32", a), "s": ("I64", np.array(7)), "e": ("F32", np.zeros((0, 3), "<f4"))}))
    t = rd.TensorFile(path)
    assert t.keys() == ["e", "s", "w"] and t.info("w")["shape"] == [4, 5, 6]
    for i in (None, 2, -1, slice(1, 3), slice(-3, 99), slice(3, 1), (1, slice(2, 4)), (slice(1, 4), 2, slice(0, 3)), (slice(0, 2), slice(None), 5), (0, 0, 0)):
        want = a if i is None else a[i]
        assert np.array_equal(t.read("w", i), want), i
    assert t.read("s") == 7 and t.read("e").shape == (0, 3) and t.read("w", 0, dtype="f8").dtype == np.float64
    for bad, error in ((4, IndexError), (-5, IndexError), ((0, 0, 0, 0), IndexError), (slice(0, 4, 2), ValueError), ("x", TypeError), (True, TypeError)):
        with pytest.raises(error):
            t.read("w", bad)
    with pytest.raises(KeyError):
        t.read("missing")


def test_runs_are_joined():
    assert rd.runs_of([(0, 4), (0, 5)], [4, 5], 4) == [(0, 80)]
    assert rd.runs_of([(1, 3), (0, 5)], [4, 5], 4) == [(20, 40)]
    assert rd.runs_of([(1, 3), (2, 4)], [4, 5], 4) == [(28, 8), (48, 8)]
    assert rd.runs_of([(1, 1), (2, 4)], [4, 5], 4) == []


@pytest.mark.parametrize("info", [{"dtype": "F32", "shape": [2]}, {"dtype": "F32", "shape": [2], "data_offsets": [0, 4]}, {"dtype": "F32", "shape": [-2], "data_offsets": [0, 8]}, {"dtype": "X", "shape": [2], "data_offsets": [0, 8]}, {"dtype": "F32", "shape": [2], "data_offsets": [8, 0]}, {"dtype": "F32", "shape": [2], "data_offsets": [0]}, 5])
def test_bad_tensor_headers(info):
    h = json.dumps({"w": info}).encode()
    with pytest.raises(ValueError):
        rd.read_safetensors(struct.pack("<Q", len(h)) + h + b"\0" * 8)


def test_header_guards():
    for size in (0, rd.MOST_HEADER + 1):
        with pytest.raises(ValueError):
            rd.tensor_header(struct.pack("<Q", size), lambda n: b"")
    with pytest.raises(ValueError, match="cut off"):
        rd.tensor_header(struct.pack("<Q", 9), lambda n: b"{}")
    with pytest.raises(ValueError):
        rd.tensor_header(b"\1", lambda n: b"")


def test_records_and_unknown():
    kind = np.dtype([("label", "u1"), ("image", "u1", (3, 2, 2))])
    a = np.zeros(4, kind)
    a["label"], a["image"] = np.arange(4), np.arange(48).reshape(4, 3, 2, 2)
    fields = [("label", "u1"), ("image", "u1", (3, 2, 2))]
    got = rd.read_arrays(a.tobytes(), records=fields)
    assert np.array_equal(got["label"], a["label"]) and np.array_equal(got["image"], a["image"])
    assert set(rd.read_arrays(a.tobytes(), keys=["label"], records=fields)) == {"label"}
    with pytest.raises(ValueError, match="records"):
        rd.read_arrays(a.tobytes()[:-1], records=fields)
    with pytest.raises(ValueError, match="idx, MAT-file version 5, safetensors"):
        rd.read_arrays(b"what is this")


def test_layouts():
    a = np.arange(2 * 3 * 5 * 4).reshape(2, 3, 5, 4)
    assert np.array_equal(rd.frames_of(a, "NCHW"), a.transpose(0, 2, 3, 1))
    assert np.array_equal(rd.frames_of(a, "CWNH"), a.transpose(2, 3, 1, 0))
    assert rd.frames_of(np.zeros((7, 9))).shape == (1, 7, 9, 1) or rd.frames_of(np.zeros((7, 9))).shape[-1] == 1
    assert rd.layout_of((3, 9, 9)) == "CHW" and rd.layout_of((9, 9, 3)) == "HWC" and rd.layout_of((5, 9, 9)) == "NHW"
    with pytest.raises(ValueError):
        rd.frames_of(a, "NHW")


def test_spark_sources(spark, tmp_path):
    sa.register(spark)
    a = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    one, two = str(tmp_path / "a.idx.gz"), str(tmp_path / "b.safetensors")
    with open(one, "wb") as f:
        f.write(gzip.compress(idx_bytes(a, 0x0C, ">i4")))
    w = np.arange(1000, dtype="<f4").reshape(100, 10)
    with open(two, "wb") as f:
        f.write(tensors({"w": ("F32", w), "s": ("F64", np.array(2.5))}))
    rows = spark.read.format("arrays").option("path", f"{one}, {two}").load().collect()
    got = {(r.key, r.idx): r for r in rows}
    assert got[("0", 1)].data == a[1].ravel().tolist() and got[("0", 1)].shape == [3, 4]
    assert got[("s", 0)].data == [2.5] and len(got) == 2 + 100 + 1
    assert {r.key for r in spark.read.format("arrays").option("path", two).option("keys", "s").load().collect()} == {"s"}
    part = spark.read.format("tensors").option("path", two).option("key", "w").option("slice", "-5:").load()
    assert {r.idx: r.data for r in part.collect()} == {i: w[i].tolist() for i in range(95, 100)}
    head = spark.read.format("tensor_header").option("path", two).load().orderBy("name").collect()
    assert [(r.name, r.dtype, r.shape, r.begin, r.end) for r in head] == [("s", "F64", [], 4000, 4008), ("w", "F32", [100, 10], 0, 4000)]


def test_json_with_comments(spark):
    rows = [('{"k": 1} // x',), ('/* a */ {"k": /* b */ 2}',), ("nonsense",), ('{"k": 3,}',)]
    df = spark.createDataFrame(rows, "t string").select(parsed(F.col("t"), "k long")["k"].alias("k"))
    assert [r.k for r in df.collect()][:3] == [1, 2, None]
