import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loom.functions import scalars as sc
from loom.operators import kmeans as km
from loom.operators import labels as lb
from loom.operators import linalg as la
from loom.operators import manifest as mf
from loom.operators import ordering
from loom.operators import stats
from loom.operators import tasks as tk
from loom.operators import tsne as ts
from loom.operators import vectors as ve

rng = np.random.default_rng(0)


def frame(spark, m, start=0):
    return spark.createDataFrame([(i + start, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")


def table_of(rows):
    return {(r[0], r[1]): r[2] for r in rows}


@pytest.mark.parametrize("metric", ["cosine", "manhattan", "euclidean", 3])
def test_distances_by_both_paths(spark, metric, monkeypatch):
    x, y = rng.standard_normal((23, 4)), np.concatenate([rng.standard_normal((6, 4)), np.zeros((1, 4))])
    p = ve.metric_of(metric)
    if p == 0:
        want = 1 - np.clip(x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1) + 1e-8), -1, 1)
    else:
        want = (np.abs(x[:, None] - y[None]) ** p).sum(2) ** (1 / p)
    a, b = frame(spark, x), frame(spark, y, 100)
    one = table_of(ve.distance_matrix(a, b, metric).collect())
    monkeypatch.setattr(ve, "BLOCK_ROWS", 5)
    two = table_of(ve.blocks_of(a, b, lambda i, m, j, n: pa.table({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "d": ve.distance_block(m, n, metric).ravel()}) if len(i) and len(j) else pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())}), "i long, j long, d double", rows=5).collect())
    assert one.keys() == two.keys() and len(one) == 23 * 7
    for (i, j), d in one.items():
        assert math.isclose(d, want[i, j - 100], abs_tol=1e-12) and math.isclose(d, two[i, j], abs_tol=1e-12)
    both = a.join(b.select(F.col("id").alias("j"), F.col("v").alias("w")))
    assert all(math.isclose(r.d, want[r.id, r.j - 100], abs_tol=1e-12) for r in both.select("id", "j", ve.distance(F.col("v"), F.col("w"), metric).alias("d")).collect())


def test_metric_names():
    assert ve.metric_of("cosine") == ve.metric_of(0) == 0
    for bad in ("taxi", -1, 128):
        with pytest.raises(ValueError):
            ve.metric_of(bad)


def test_nearest_ties_and_sizes(spark):
    x = frame(spark, [[0], [1], [2], [3], [4], [5]])
    for most in (1 << 20, 0):  # one block for all, pairs of blocks
        got = {(r.i, r["rank"]): r.j for r in ve.nearest(x, x, 2, exclude_same=True, most=most).collect()}
        assert got[2, 1] == 1 and got[2, 2] == 3 and got[0, 2] == 2 and len(got) == 12
        assert ve.nearest(x, x.limit(0), 2, most=most).count() == 0


def test_products(spark):
    m = rng.standard_normal((50, 3))
    n, s, g = ve.vector_products(frame(spark, m).repartition(4).select("v"))
    assert n == 50 and np.allclose(s, m.sum(0)) and np.allclose(g, m.T @ m)
    n, s, g = ve.column_sums(spark.createDataFrame(m.tolist(), "a double, b double, c double"), list("abc"))
    assert n == 50 and np.allclose(s, m.sum(0)) and np.allclose(g, m.T @ m)


def test_kmeans(spark):
    m = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    x = frame(spark, m)
    for init in ("random", "kmeans++"):
        model = km.KMeans(3, init=init, random_state=1).fit(x)
        assert model.n_iter < 100 and model.centroids.shape == (3, 2)
    found = {r.id: r.cid for r in model.predict(x).collect()}
    assert len(set(found.values())) <= 3
    # inertia doesn't rise from pass to pass
    c, last = m[:3].copy(), np.inf
    for _ in range(5):
        sums, counts, inertia = km.cluster_sums(x, c)
        d2 = ((m[:, None] - c[None]) ** 2).sum(2)
        assert np.isclose(inertia, np.sqrt(d2.min(1)).sum())
        new = km.update(c, sums, counts)
        assert ((m[:, None] - new[None]) ** 2).sum(2).min(1).sum() <= d2.min(1).sum() + 1e-9
        c = new
    ties = km.assign(frame(spark, [[1.0]]), np.array([[0.0], [2.0]])).first()
    assert ties.cid == 0
    same = km.KMeans(2, init="kmeans++", max_iter=3).fit(frame(spark, [[1.0, 1.0]] * 5))
    assert np.isfinite(same.centroids).all()
    for bad in (dict(n_clusters=0), dict(n_clusters=2, init="x"), dict(n_clusters=2, dist="x")):
        with pytest.raises(ValueError):
            km.KMeans(**bad)


def test_linear_algebra():
    a = rng.standard_normal((3, 4, 4))
    assert np.allclose(la.inverse(a) @ a, np.eye(4)) and np.allclose(la.inverse(a), np.linalg.inv(a))
    with pytest.raises(ValueError):
        la.inverse(np.ones((2, 2)))
    with pytest.raises(ValueError):
        la.inverse(np.ones((2, 3)))
    low = rng.standard_normal((8, 8))
    low = low + low.T  # indefinite
    values, vectors = la.eigen(low)
    assert np.allclose(low @ vectors, vectors * values) and (np.diff(values) <= 0).all()
    v3, w3 = la.eigen(low, 3)
    assert sorted(np.abs(v3)) == sorted(sorted(np.abs(values))[-3:]) and (np.diff(v3) <= 0).all()
    assert all(w3[np.argmax(np.abs(w3[:, k])), k] > 0 for k in range(3))
    with pytest.raises(ValueError):
        la.eigen(rng.standard_normal((3, 3)))
    m = rng.standard_normal((6, 4))
    q = la.orthogonalize(m)
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(q, np.linalg.qr(m)[0] * np.sign(np.diag(np.linalg.qr(m)[1])))
    m[:, 2] = m[:, 0]
    assert np.isfinite(la.orthogonalize(m)).all()


def test_svd_and_pca(spark):
    m = rng.standard_normal((40, 5)) @ np.diag([5, 3, 1, 0.5, 0])
    s, v, _ = la.svd_of(frame(spark, m))
    assert np.allclose(s, np.linalg.svd(m)[1], atol=1e-6) and np.allclose(m @ v @ v.T, m)
    y, parts = la.pca(frame(spark, m), 2)
    centred = m - m.mean(0)
    u, sv, _ = np.linalg.svd(centred, full_matrices=False)
    got = np.array([r.y for r in y.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * sv[:2])) and parts.shape == (5, 2)


def test_ridge_choice():
    h = rng.standard_normal((200, 6))
    y = np.eye(3)[np.argmax(h[:, :3] + 0.3 * rng.standard_normal((200, 3)), 1)]
    hold = np.arange(200) % 5 == 4
    sums = [(h[k].T @ h[k], h[k].T @ y[k]) for k in (~hold, hold)]
    got = la.choose_ridge(*sums[0], *sums[1], float((y[hold] ** 2).sum()), int(hold.sum()))
    errors = [((h[hold] @ la.ridge(*sums[0], 10.0**p) - y[hold]) ** 2).sum() for p in range(-8, 9)]
    assert got == 10.0 ** (int(np.argmin(errors)) - 8)
    assert la.choose_ridge(*sums[0], *sums[1], 0.0, 0) == 1.0


def test_energy_and_basis():
    c = np.diag([5.0, 3.0, 1.0, 1.0])
    assert la.energy_rank(np.diag(c), 0, 10, 0.5) == 1 and la.energy_rank(np.diag(c), 0, 10, 0.81) == 3
    b = la.grown_basis(c, None, 0.75)
    assert b.shape == (4, 2) and np.allclose(b @ b.T, np.diag([1, 1, 0, 0]))
    assert la.grown_basis(c, b, 0.8) is b
    bigger = la.grown_basis(c, b, 0.85)
    assert bigger.shape == (4, 3) and np.allclose(bigger.T @ bigger, np.eye(3))
    assert np.allclose(la.project_out(c, b), np.diag([0, 0, 1, 1]))
    d = la.designed(c, None, 2)
    assert np.allclose(d.T @ d, np.eye(2) / 3)


def test_perplexity():
    d = ((lambda m: ((m[:, None] - m[None]) ** 2).sum(2))(rng.standard_normal((30, 3)))) + np.diag([np.inf] * 30)
    p = ts.conditional(d, 7.0)
    h = -(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)).sum(1)
    assert np.allclose(p.sum(1), 1) and np.allclose(h, np.log(7), atol=1e-4) and not np.diag(p).any()


def exact_repulsion(y):
    diff = y[:, None] - y[None]
    w = 1 / (1 + (diff**2).sum(2))
    np.fill_diagonal(w, 0)
    return w.sum(1), (w[..., None] ** 2 * diff).sum(1)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_tree_is_exact_at_angle_zero(d):
    y = np.concatenate([rng.standard_normal((300, d)), np.zeros((20, d)), rng.standard_normal((50, d)) * 1e-7])
    z, f = ts.Tree(y).repulsion(0.0)
    z0, f0 = exact_repulsion(y)
    assert np.allclose(z, z0) and np.allclose(f, f0, atol=1e-9)
    z, f = ts.Tree(y).repulsion(0.5)
    assert np.allclose(z, z0, rtol=0.06) and np.linalg.norm(f - f0) < 0.05 * np.linalg.norm(f0)


def test_gradient_is_that_of_the_objective():
    y = rng.standard_normal((12, 2))
    i, j = np.nonzero(~np.eye(12, dtype=bool))
    p = rng.random(len(i))
    p /= p.sum()
    m = np.zeros((12, 12))
    m[i, j] = p
    p = ((m + m.T) / 2)[i, j]
    t = ts.TSNE(tsne_method="exact")
    f, g = t.objective(y, i, j, p, 1.0)
    for at in ((0, 0), (5, 1), (11, 0)):
        z = y.copy()
        z[at] += 1e-6
        assert np.isclose((t.objective(z, i, j, p, 1.0)[0] - f) / 1e-6, g[at], atol=1e-4)


@pytest.mark.parametrize("method", ["exact", "barnes_hut"])
def test_tsne_keeps_neighbours(spark, method):
    m = np.concatenate([rng.normal(c, 0.2, (20, 5)) for c in (0, 4, 8)])
    t = ts.TSNE(perplexity=8, max_iter=60, tsne_method=method)
    y = np.array([r.y for r in t.fit_transform(frame(spark, m)).orderBy("id").collect()])
    d = ((y[:, None] - y[None]) ** 2).sum(2) + np.diag([np.inf] * 60)
    assert (np.arange(60) // 20 == d.argmin(1) // 20).mean() > 0.95
    assert 0 <= t.kl_divergence < 1.5 and t.n_iter > 5
    for bad in (dict(perplexity=60), dict(perplexity=8, n_components=4), dict(perplexity=8, learning_rate=0), dict(perplexity=8, tsne_method="x")):
        with pytest.raises(ValueError):
            ts.TSNE(**bad).fit_transform(frame(spark, m))


def test_distributed_objective_equals_the_driver(spark):
    y = rng.standard_normal((25, 2))
    i, j = np.nonzero(~np.eye(25, dtype=bool))
    p = np.full(len(i), 1 / len(i))
    edges = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, p)], "i long, j long, p double")
    f, grad = ts.evaluate(edges, frame(spark, y))
    f0, g0 = ts.TSNE(tsne_method="exact").objective(y, i, j, p, 1.0)
    assert np.isclose(f, f0) and all(np.isclose(r.g, g0[r.id, r.c]) for r in grad.collect())


def test_positions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in [*range(0, 100, 7), 10_000]], "idx long, task int")
    got = ordering.in_order(df, "p", "idx").orderBy("idx").collect()
    assert [r.p for r in got] == list(range(len(got)))
    by = ordering.shuffled(df, "p", 5, "idx", ("task",)).collect()
    for t in range(3):
        assert sorted(r.p for r in by if r.task == t) == list(range(sum(r.task == t for r in by)))
    assert ordering.in_order(df.limit(0), "p", "idx").count() == 0


def split_of(spark, n_classes, tasks, n, m, counts=7):
    rows = [(i, i % n_classes) for i in range(n_classes * counts)]
    samples = spark.createDataFrame(rows, "idx long, key int")
    split = tk.split_categories(tk.categories(samples, "key"), tasks, n, 1)
    home = tk.homes(samples, "key", split)
    return split.collect(), home, tk.exchanged(home, m, 2)


@pytest.mark.parametrize("n,m,tasks", [(50, 30, 3), (100, 50, 3), (0, 100, 2), (50, 0, 3), (50, 100, 1)])
def test_task_split_properties(spark, n, m, tasks):
    split, home, after = split_of(spark, 10, tasks, n, m)
    disjoint = 10 * n // 100 // tasks * tasks
    kinds = [r.kind for r in split]
    assert kinds.count("disjoint") == disjoint and kinds.count("blurry") == (10 - disjoint) // tasks * tasks
    a, b = {r.idx: r for r in home.collect()}, {r.idx: r for r in after.collect()}
    assert a.keys() == b.keys()  # a partition of the assigned samples
    for t in range(tasks):
        assert sum(r.task == t for r in a.values()) == sum(r.task == t for r in b.values())
    moved = [i for i in a if a[i].task != b[i].task]
    assert all(a[i].kind == "blurry" for i in moved)
    if m == 0 or n == 100 or tasks == 1:
        assert not moved


def test_batches_and_shares(spark):
    order = spark.createDataFrame([(t, p, 100 * t + p) for t, n in ((0, 10), (1, 3)) for p in range(n)], "task int, pos long, idx long")
    got = sorted((r.task, r.pos, r.idx) for r in tk.online_batches(order, 4, 2).collect())
    assert [x[2] for x in got if x[0] == 0] == [0, 1, 2, 3, 0, 1, 2, 3, 4, 5, 6, 7, 4, 5, 6, 7, 8, 9, 8, 9]
    assert [x[2] for x in got if x[0] == 1] == [100, 101, 102] * 2
    share = tk.replica_share(order, 4).collect()
    assert sorted((r.rank, r.idx) for r in share if r.task == 0) == [(k % 4, k) for k in sorted(range(8), key=lambda k: (k % 4, k))]
    assert not [r for r in share if r.task == 1]
    for bad in (dict(batch=0, repeats=1), dict(batch=1, repeats=0)):
        with pytest.raises(ValueError):
            tk.online_batches(order, **bad)


def test_exposure(spark):
    rows = [(0, 1, 1), (1, 1, 2), (2, -1, 2), (3, 3, -1), (4, -1, -1), (5, -1, 9)]
    got = tk.exposed(spark.createDataFrame(rows, "idx long, a int, b int"), ["a", "b"], spark.createDataFrame([(1, 1), (3, 2)], "a int, b int"))
    assert {r.idx for r in got.collect()} == {0, 2, 3}


@given(st.integers(0, 500), st.integers(1, 9), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_cuts_add_up(total, tasks, seed):
    sizes = tk.cut_sizes(total, tasks, seed)
    assert len(sizes) == tasks and sum(sizes) == total and min(sizes) >= 0


@given(st.integers(0, 200), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_shards_cover(total, world):
    up, down = stats.shard_bounds(total, world), stats.shard_bounds(total, world, ceil=False)
    assert sum(b - a for a, b in up) == total and sum(b - a for a, b in down) == total // world * world


def test_label_errors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, name string")
    with pytest.raises(ValueError):
        lb.looked_up(rows, spark.createDataFrame([("a", 1)], "k string, y int"), "name", "k")
    with pytest.raises(ValueError):
        lb.ratio_split(rows, "idx", 1.5)
    with pytest.raises(ValueError):
        tk.configured(tk.categories(rows, "name"), [["zzz"]])


def test_signature_lines(spark):
    files = spark.createDataFrame([("b/x: y.txt", "1"), ("a.txt", "2"), (".hid/z", "3"), ("c/.DS", "4")], "path string, text string")
    signed = mf.signature(files, "path", "text", "md5")
    lines = mf.signature_lines(signed)
    assert [r.value.split(": ")[0] for r in lines.collect()] == ["a.txt", "b/x"]
    assert mf.changes(signed, mf.read_signature(lines)).count() == 0
    with pytest.raises(ValueError):
        sc.content_hash(F.lit("x"), "crc")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(sc.bytes_human(F.lit(1024))) == "1024.00 B" and one(sc.bytes_human(F.lit(1025))) == "1.00 KB"
    assert one(sc.bytes_human_exact(F.lit(512))) == "512 B" and one(sc.bytes_human_exact(F.lit(1024))) == "1.00 KB"
    assert [one(sc.seconds_human(F.lit(x))) for x in (0.007, 5.25, 65.5, 3600.0)] == ["  7ms", "05.250", "01:05.500", "01:00:00.000"]
    assert [one(x) for x in sc.version_compare(F.lit("v1.2.3"), F.lit("1.0.4")).values()] == [False, False, True]
    assert one(sc.warmup_cosine(F.lit(200), 0.1, 50, 200)) == pytest.approx(0.1)
    assert one(sc.progress_bar(F.lit(0.5), 4)) == "██  "
    assert one(sc.repeat_channels(F.array(F.lit(1), F.lit(2)))) == [1, 1, 1, 2, 2, 2]
    assert one(sc.normalized(F.array(F.lit(1.0), F.lit(4.0)), [1.0, 2.0], [1.0, 2.0])) == [0.0, 1.0]
    assert one(sc.subframes(F.lit(10), F.lit(30.0), 4)["frames"]) == [0, 2, 4, 6]


def test_kernels(spark):
    old, new = rng.standard_normal((5, 3)), rng.standard_normal((5, 3))
    long = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(3)], "i long, j int, x double")
    soft = lambda m: np.exp(m / 2) / np.exp(m / 2).sum(1, keepdims=True)
    want = 4 * (soft(old) * np.log(soft(old) / soft(new))).sum() / 5
    assert np.isclose(stats.distillation(long(old), long(new), "i", "j", "x", 2.0).first().loss, want)
    m, w, b = rng.standard_normal((7, 5)), rng.standard_normal((5, 2)), np.array([1.0, -1.0])
    got = {(r.id, r.o): r.y for r in stats.block_matmul(frame(spark, m), w, 3, b).collect()}
    assert all(np.isclose(got[i, o], (m @ w + b)[i, o]) for i in range(7) for o in range(2))
    pairs = spark.createDataFrame([(k % 2, [float(x) for x in m[k][:3]], [float(x) for x in m[k][3:]]) for k in range(7)], "t long, a array<double>, b array<double>")
    sums = {(r.t, r.i, r.j): r.x for r in stats.outer_sums(pairs, "t").collect()}
    for t in (0, 1):
        d = m[t::2, 3:].T @ m[t::2, :3]
        assert all(np.isclose(sums[t, i, j], d[i, j]) for i in range(2) for j in range(3))


def test_every_query_runs_and_matches(spark):
    """All registered queries of the library against their SQL, on the smallest tables."""
    import duckdb

    from loom.plans import registry

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "orders lineitem events documents embeddings pages labels conversations".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    same = lambda v: tuple(map(same, v)) if isinstance(v, (list, tuple)) else v + 0.0 if isinstance(v, float) else v
    assert len(registry.queries()) > 80 and registry.queries().keys() == registry.oracle_sql().keys()
    for name, f in registry.queries().items():
        df = f(spark, d)
        r = con.execute(registry.oracle_sql()[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns), name
        want = sorted(map(repr, (same(x) for x in r.fetchall())))
        assert sorted(map(repr, (same(tuple(x)) for x in df.select(*[f"`{c}`" for c in cols]).collect()))) == want, name
