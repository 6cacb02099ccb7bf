"""Arrays read by blocks and by any index, against NumPy."""

import gzip
import itertools
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loom.sources import arrays as sa
from loom.sources import blocks, indexing
from loom.sources import readers as rd
from tests.test_sources import idx_bytes, mat_file, matrix, packed, tensors


@st.composite
def indexed(draw):
    shape = tuple(draw(st.lists(st.integers(0, 5), min_size=0, max_size=4)))
    items = []
    for size in shape[: draw(st.integers(0, len(shape)))]:
        kinds = [st.builds(slice, *[st.one_of(st.none(), st.integers(-7, 7))] * 2, st.sampled_from([None, 1, 2, 3, -1, -2]))]
        if size:
            kinds += [st.integers(-size, size - 1), st.lists(st.integers(-size, size - 1), min_size=0, max_size=4), st.lists(st.booleans(), min_size=size, max_size=size).map(np.array)]
        items.append(draw(st.one_of(kinds)))
    if draw(st.booleans()):
        items.insert(draw(st.integers(0, len(items))), Ellipsis)
    if draw(st.booleans()):
        items.insert(draw(st.integers(0, len(items))), None)
    return shape, tuple(items)


@settings(max_examples=400, deadline=None)
@given(indexed(), st.integers(0, 40))
def test_any_index_is_numpys(case, gap):
    shape, index = case
    a = np.arange(int(np.prod(shape)), dtype="<i4").reshape(shape)
    try:
        want = a[index]
    except IndexError:  # arrays that don't go together
        return
    positions, inner = indexing.compact(index, shape)
    offsets, sizes = indexing.byte_runs(positions, shape, 4)
    raw = a.tobytes()
    assert (offsets[1:] > offsets[:-1]).all() and sizes.sum() == 4 * np.prod([len(p) for p in positions])
    got = indexing.read_runs(lambda at, size: raw[at : at + size], offsets, sizes, gap)
    assert np.array_equal(np.frombuffer(got, "<i4").reshape([len(p) for p in positions])[inner], want)


def test_indices_as_text():
    got = indexing.parsed("1:10:2, ..., -1, [0, 3], ::-1, :")
    assert got == (slice(1, 10, 2), Ellipsis, -1, [0, 3], slice(None, None, -1), slice(None)) and indexing.parsed("") == ()


@pytest.mark.parametrize("bad,error", [((0,) * 4, IndexError), (9, IndexError), (-5, IndexError), ("x", TypeError), (True, TypeError), ((..., ...), IndexError), (1.5, TypeError), ([9], IndexError)])
def test_impossible_indices(bad, error):
    with pytest.raises(error):
        indexing.compact(bad, (4, 5, 6))


def test_slices_read_their_runs_only(tmp_path, monkeypatch):
    a = np.arange(40 * 50 * 6, dtype="<f4").reshape(40, 50, 6)
    path = str(tmp_path / "t")
    with open(path, "wb") as f:
        f.write(tensors({"x": ("F32", a), "h": ("BF16", (a[0].astype("<f4").view("<u4") >> 16).astype("<u2"))}))
    read = []
    opened = rd.opened

    class Counted:
        def __init__(self, path):
            self.f = opened(path)

        def __enter__(self):
            return self

        def __exit__(self, *e):
            self.f.close()

        def read(self, n):
            return self.f.read(n)

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    monkeypatch.setattr(rd, "opened", Counted)
    t = rd.TensorFile(path)
    for index, runs, size in [
        ((slice(None, None, 3), slice(10, 20), slice(1, 3)), 14 * 10, 14 * 10 * 2 * 4),
        ((slice(None, None, -4), ...), 10, 10 * 50 * 6 * 4),
        (([3, 4, 5, -1],), 2, 4 * 50 * 6 * 4),
        ((..., 5), 40 * 50, 40 * 50 * 4),
        ((7, slice(None), None, slice(None)), 1, 50 * 6 * 4),
        ((np.arange(40) % 20 == 3, slice(2, 4)), 2, 2 * 2 * 6 * 4),
    ]:
        read.clear()
        assert np.array_equal(t.get_slice("x", index), a[index]) and (len(read), sum(read)) == (runs, size), index
    read.clear()
    assert np.array_equal(t.get_slice("x", (..., 5), gap=20), a[..., 5]) and len(read) == 1
    assert np.array_equal(t.get_slice("h", (slice(1, 9, 2), 2)), t.read("h")[1:9:2, 2]) and t.get_slice("x", 0, dtype="f8").dtype == np.float64


def one(source):
    """All rows of a file by key, read a small block at a time, and the bytes of it that were read."""
    path, places = source
    out = {}
    with blocks.Rows(path, 64) as rows:
        for p in places:
            parts = [b for _, b in rows.of(p)]
            out[p.key] = np.concatenate(parts) if parts else np.zeros((0, *p.inner))
        return out, rows.read


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("o", ["<", ">"])
def test_blocks_of_all_formats(tmp_path, gz, o):
    a = np.arange(7 * 3 * 4, dtype=float).reshape(7, 3, 4)
    small, text = np.array([[1, 2]]), np.array([[65, 66]])
    mat = mat_file([matrix("text", text, o, cls=4, stored=4, kind="u2"), packed(matrix("a", a, o), o), matrix("b", a, o, 10, 4, "u2"), packed(matrix("s", small, o, 6, 2, "u1", small=True), o), matrix("t", small, o, 12, 3, "i2", small=True)], o)
    kind = np.dtype([("label", "u1"), ("image", ">i2", (3, 2)), ("end", "f4")])
    records = np.zeros(29, kind)
    records["label"], records["image"], records["end"] = np.arange(29), np.arange(29 * 6).reshape(29, 3, 2), np.arange(29) / 2
    fields = [["label", "u1"], ["image", ">i2", [3, 2]], ["end", "f4"]]
    files = {
        "idx": (idx_bytes(a, 0x0C, ">i4"), None, {"0": a.astype("i4")}),
        "mat": (mat, None, {"a": a, "b": a.astype("u2"), "s": small.astype(float), "t": small.astype("i4")}),
        "tensors": (tensors({"w": ("F32", a.astype("<f4")), "s": ("I64", np.array(7)), "e": ("F32", np.zeros((0, 3), "<f4"))}), None, {"w": a.astype("f4"), "s": np.array([7]), "e": np.zeros((0, 3))}),
        "records": (records.tobytes(), fields, {n: records[n] for n in kind.names}),
    }
    for name, (data, declared, want) in files.items():
        path = str(tmp_path / name)
        with open(path, "wb") as f:
            f.write(gzip.compress(data[:50]) + gzip.compress(data[50:]) if gz else data)  # members follow each other
        places = blocks.places(path, None, declared)
        got, _ = one((path, places))
        assert got.keys() == want.keys(), name
        for k in want:
            assert np.array_equal(got[k], want[k]) and got[k].shape == want[k].shape, (name, k)
        some = next(iter(want))
        assert [p.key for p in blocks.places(path, {some}, declared)] == [some]
        with open(path, "wb") as f:
            f.write(gzip.compress(data[:-12]) if gz else data[:-12])
        with pytest.raises((ValueError, zlib.error, EOFError)):
            one((path, blocks.places(path, None, declared)))


def test_a_packed_variable_is_held_a_block_at_a_time(tmp_path):
    """80 MB of a compressed variable, and of an idx file in gzip, within a few MB; 1,000 rows of a plain file by their own bytes."""
    a = np.tile(np.arange(1000.0), (10_000, 1))
    mat = str(tmp_path / "m")
    with open(mat, "wb") as f:
        f.write(mat_file([packed(matrix("a", a, "<"), "<")], "<"))
    gz, plain = str(tmp_path / "g"), str(tmp_path / "p")
    with gzip.open(gz, "wb", 1) as f:
        f.write(idx_bytes(a, 0x0E, ">f8"))
    with open(plain, "wb") as f:
        f.write(idx_bytes(a, 0x0E, ">f8"))
    for path in (mat, gz):
        (place,) = blocks.places(path)
        tracemalloc.start()
        with blocks.Rows(path, 1 << 20) as rows:
            part = rows.of(place, 5000, 5100) if place.columns else rows.of(place)
            for first, block in itertools.islice(part, 30):
                assert np.array_equal(block, a[first : first + len(block)])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 8 << 20, (path, most)
    (place,) = blocks.places(plain)
    with blocks.Rows(plain) as rows:
        assert sum(len(b) for _, b in rows.of(place, 100, 1100)) == 1000 and rows.read == 1000 * 8000
    reader = sa._ArraysReader({"path": plain}, ["idx", "data"])
    assert len(reader.partitions()) == -(-80_000_000 // sa.BLOCK_BYTES)


def test_conditions_reach_the_reader(spark, tmp_path):
    sa.register(spark)
    w = np.arange(3000, dtype="<i4").reshape(300, 10)
    one, two = str(tmp_path / "a"), str(tmp_path / "b.gz")
    with open(one, "wb") as f:
        f.write(tensors({"w": ("I32", w), "v": ("I32", w[:5] + 7)}))
    with open(two, "wb") as f:
        f.write(gzip.compress(idx_bytes(w, 0x0C, ">i4")))
    rows = spark.read.format("arrays").option("path", f"{one},{two}").load()
    df = rows.filter("key = 'w' and idx between 10 and 19 and idx <> 12")
    assert {r.idx: r.whole for r in df.collect()} == {i: w[i].tolist() for i in range(10, 20) if i != 12}
    assert {(r.key, r.idx) for r in rows.filter("idx in (3, 299, 1000)").collect()} == {("w", 3), ("v", 3), ("w", 299), ("0", 3), ("0", 299)}
    assert rows.filter(f"path = '{two}' and idx > 297").count() == 2 and rows.filter("key = 'none'").count() == 0
    assert rows.filter("idx is not null and key in ('v', 'x') and idx < 2").count() == 2
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = sa._ArraysReader({"path": one}, ["idx", "data"])
    left = list(reader.pushFilters([EqualTo(("key",), "w"), GreaterThanOrEqual(("idx",), 10), LessThan(("idx",), 20), EqualTo(("shape",), [10])]))
    (part,) = reader.partitions()
    assert [f.attribute for f in left] == [("shape",)] and [(p.key, own) for p, own in part.pieces] == [("w", range(10, 20))]
    plan = rows.filter("key = 'w' and idx > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    only = spark.read.format("arrays").schema("idx long, key string").option("path", one).load()
    assert only.columns == ["idx", "key"] and only.count() == 305


def test_an_index_of_every_row(spark, tmp_path):
    sa.register(spark)
    a = np.arange(20 * 6 * 5).reshape(20, 6, 5)
    names = {"i": idx_bytes(a, 0x0C, ">i4"), "g": gzip.compress(idx_bytes(a, 0x0C, ">i4")), "t": tensors({"w": ("I32", a.astype("<i4"))}), "m": mat_file([packed(matrix("w", a.astype(float), "<"), "<")], "<"), "p": mat_file([matrix("w", a.astype(float), ">")], ">")}
    for name, data in names.items():
        with open(tmp_path / name, "wb") as f:
            f.write(data)
    paths = ",".join(str(tmp_path / n) for n in names)
    for text, index in [("2:19:4, ::-2, 1:3", (slice(2, 19, 4), slice(None, None, -2), slice(1, 3))), ("[3, -1], ..., 0", ([3, -1], ..., 0)), ("5", (slice(5, 6),)), ("::3, [0, 2], :, ", (slice(None, None, 3), [0, 2])), ("..., [4, 4, 0]", (..., [4, 4, 0])), (":, [1, 2], [3, 0]", (slice(None), [1, 2], [3, 0]))]:
        got = {}
        for r in spark.read.format("arrays").option("path", paths).option("index", text).load().collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.idx] = np.array(r.data).reshape(r.shape)
        rows = np.arange(20)[index[0]] if index[0] is not Ellipsis else np.arange(20)
        inner = index[1:] if index[0] is not Ellipsis else index
        want = {int(i): a[i][inner] for i in rows}
        assert got.keys() == names.keys()
        for name in names:
            assert got[name].keys() == want.keys() and all(np.array_equal(got[name][i], want[i]) and got[name][i].shape == want[i].shape for i in want), (text, name)
    shapes = spark.read.format("arrays").schema("idx long, shape array<int>").option("path", paths).option("index", "::7, ::2, 1").load().collect()
    assert len(shapes) == 15 and all(r.shape == [3] for r in shapes)


@pytest.mark.parametrize("kind", ["idx", "mat", "safetensors", "records"])
def test_files_roll(spark, tmp_path, kind):
    """A partition is several files, none of more than the bound, and all rows come back."""
    import json

    from loom.sources.writers import write_vectors

    sa.register(spark)
    df = spark.range(1000).repartition(2).selectExpr("id", "transform(sequence(1, 9), i -> cast(id * i as double)) as v")
    out = write_vectors(df, kind, str(tmp_path), file_bytes=80 * 64).collect()
    assert len(out) >= 14 and max(r.rows for r in out) <= 64 and sum(r.rows for r in out) == 1000
    source = spark.read.format("arrays").option("paths", json.dumps([r.file for r in out]))
    rows = (source.option("records", json.dumps([["rows", "<f8", [10]]])) if kind == "records" else source).load().collect()
    assert {int(r.data[0]): r.data[1:] for r in rows} == {i: [float(i * j) for j in range(1, 10)] for i in range(1000)}


def test_matrices_of_one_batch_are_bounded():
    import pyarrow as pa

    from loom.sources.writers import matrices

    b = pa.RecordBatch.from_pydict({"id": np.arange(1000), "v": [[1.0, 2.0, 3.0]] * 1000})
    got = list(matrices(iter([b, b]), 3200))
    assert max(len(m) for m in got) == 100 and sum(map(len, got)) == 2000
