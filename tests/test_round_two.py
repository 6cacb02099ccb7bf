import numpy as np
import pytest
from loom.functions import scalars as sc
from loom.operators import kmeans as km
from loom.operators import manifest as mf
from loom.operators import ordering, stats, vectors
from loom.operators import tasks as tk
from loom.operators import tsne as ts
from loom.sources import writers
from loom.sources.files import directory
from loom.sources.readers import read_arrays
from pyspark.sql import functions as F


@pytest.mark.parametrize("metric", [0, 1, 2, 3])
@pytest.mark.parametrize("most", [1 << 26, 0])
def test_nearest_equals_brute_force(spark, metric, most):
    rng = np.random.default_rng(metric)
    m = rng.integers(-2, 3, (90, 3)).astype(float) * rng.choice([1e-5, 1.0, 1e4], 90)[:, None]  # ties, small and large rows
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, v array<double>")
    got = {}
    for r in vectors.nearest(x, x, 4, metric, exclude_same=True, digits=6, most=most).collect():
        got.setdefault(r.i, {})[r.rank] = (r.dist, r.j)
    d = np.round(vectors.distance_block(m, m, metric), 6)
    for i in range(90):
        want = sorted((d[i, j] + 0.0, j) for j in range(90) if j != i)[:4]
        assert [got[i][k + 1][1] for k in range(4)] == [j for _, j in want] and np.allclose([got[i][k + 1][0] for k in range(4)], [w for w, _ in want])


def test_positions_with_far_ids(spark):
    ids = [*range(1000), 1 << 61]
    got = {r.idx: r.p for r in ordering.in_order(spark.createDataFrame([(i,) for i in ids], "idx long"), "p", "idx").collect()}
    assert got == {i: k for k, i in enumerate(ids)}


@pytest.mark.parametrize("kind", ["idx", "mat", "safetensors", "records"])
def test_containers_round_trip(kind):
    m = np.random.default_rng(1).standard_normal((7, 5))
    found = read_arrays(writers.KINDS[kind](m), records=[("rows", "<f8", (5,))] if kind == "records" else None)
    assert np.array_equal(next(iter(found.values())), m)


def test_whole_numbers_stay_whole(spark, tmp_path):
    from loom.sources.arrays import register

    values = np.array([[2**53 + 1], [2**62 + 1], [-5]], "<i8")
    (tmp_path / "a,b.bin").write_bytes(values.tobytes())
    register(spark)
    df = spark.read.format("arrays").option("paths", f'["file://{tmp_path}/a,b.bin"]').option("records", '[["n", "<i8", [1]]]').load()
    assert sorted(r.whole[0] for r in df.collect()) == sorted(values.ravel().tolist())


def test_signed_folder(spark, tmp_path):
    for name in ("a.txt", "d/b.txt", ".hidden"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted((r.rel, r["size"]) for r in directory(spark, str(tmp_path)).collect() if not r.rel.startswith(".")) == [("a.txt", 5), ("d/b.txt", 7)]
    mf.sign_folder(spark, str(tmp_path), to=str(tmp_path / "signed"))
    mf.validate_folder(spark, str(tmp_path), signed=str(tmp_path / "signed"))
    (tmp_path / "a.txt").write_text("other")
    (tmp_path / "new").write_text("x")
    with pytest.raises(ValueError, match="added: new; changed: a.txt"):
        mf.validate_folder(spark, str(tmp_path), signed=str(tmp_path / "signed"))


def test_checks_of_axes_and_metadata(spark):
    df = spark.createDataFrame([(1, 2), (2, None)], "idx long, key int")
    assert tk.checked_axes(df, ["idx"]) is df
    with pytest.raises(AttributeError):
        tk.checked_axes(df, ["other"])
    with pytest.raises(ValueError, match="1 values for 2"):
        tk.checked_axes(df, ["key"])
    step = sc.requiring(lambda m: {"height": m["width"]}, "width")
    assert step({"width": 3}) == {"height": 3}
    with pytest.raises(ValueError, match="width"):
        step({"height": 1})


def test_listed_categories(spark):
    samples = spark.createDataFrame([(i, i % 5) for i in range(20)], "idx long, key int")
    got = tk.configured(tk.categories(samples, "key"), [[3, 1], [1, 4]])
    assert {(r.category, r.at, r.kind, r.task) for r in got.collect()} == {(3, 3, "disjoint", 0), (1, 1, "disjoint", 1), (4, 4, "disjoint", 1)}
    with pytest.raises(ValueError, match="unknown"):
        tk.configured(tk.categories(samples, "key"), [[9]])


def test_kmeans_accessors_and_scores(spark):
    x = spark.createDataFrame([(i, [float(i // 5), 1.0]) for i in range(10)], "id long, v array<double>")
    m = km.KMeans(2, init=np.array([[0.0, 1.0], [1.0, 1.0]]))
    m.fit(x)
    assert {r.id: r.cid for r in m.labels(x).collect()} == {i: i // 5 for i in range(10)}
    assert all(r.dist == 0 for r in m.distances(x).collect()) and sum(r.inside for r in m.mask(x, 1).collect()) == 5
    with pytest.raises(ValueError):
        m.mask(x, 2)
    got = {r.id: (r.cid, r.score) for r in stats.ridge_scores(x, np.array([[1.0, 0.5], [1.0, 0.5], [2.0, 0.0]])).collect()}
    assert got[0] == (0, 0.5) and got[9] == (2, 2.0)


def test_springs_solve():
    rng = np.random.default_rng(2)
    i, j = np.nonzero(np.triu(rng.random((30, 30)) < 0.3, 1))
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    p = np.tile(rng.random(len(i) // 2), 2)
    b = rng.standard_normal((30, 2))
    b -= b.mean(0)
    m = np.zeros((30, 30))
    m[i, j] = -3 * p
    m += np.diag(ts.Springs(30, i, j, p, 3.0, dense=False).diagonal)
    for dense in (True, False):
        assert np.allclose(m @ ts.Springs(30, i, j, p, 3.0, dense).solve(b), b, atol=5e-3)
