"""Steps that meet all pairs of rows: bounded memory, right ties, widths that Newton's method alone doesn't find."""

import numpy as np

from loom.operators import tsne as ts


def test_width_beside_a_level_stretch():
    """Fourteen near copies and two far rows: the entropy is level between the two scales."""
    rng = np.random.default_rng(1)
    d = np.abs(np.concatenate([0.01 * (1 + 0.1 * rng.standard_normal((60_000, 14))), 1.07 + 0.05 * rng.standard_normal((60_000, 2))], 1))
    p = ts.conditional(d, 5.0)
    h = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1)
    assert np.abs(h - np.log(5)).max() < 1e-4


def test_rebuilt_ties_round_as_the_input(spark, tmp_path):
    """Values that end in a tie at six digits: many odd multiples of 1 / 128."""
    import __spark_entry__ as entry

    m = (2 * np.random.default_rng(2).integers(-60, 60, (300, 64)) + 1) / 128
    rows = spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.v for r in entry.queries()["svd_rebuilt"](spark, str(tmp_path)).collect()}
    scaled = m * (1 + np.arange(300) % 5)[:, None]
    assert (np.array([got[i] for i in range(300)]) == np.sign(scaled) * np.floor(np.abs(scaled) * 1e6 + 0.5) / 1e6).all()


def test_pairs_in_bounded_memory(monkeypatch):
    """20 million pairs of two numbers each: four blocks of all pairs would be 640 MB."""
    import tracemalloc

    from loom.operators import repulsion as rp

    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((400, 2)), rng.standard_normal((50_000, 2))
    i, j, n = np.arange(400), np.arange(50_000), rng.integers(1, 4, 50_000).astype(float)
    tracemalloc.start()
    z, f = rp.pushes(i, a, j, b, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    diff = a[7] - b
    w = np.where(j == 7, 0, 1 / (1 + (diff**2).sum(1)))
    assert np.isclose(z[7], w @ n, rtol=1e-12) and np.allclose(f[7], (w * w * n) @ diff, rtol=1e-10)


def test_angle_zero_makes_no_row_a_pair(spark, monkeypatch):
    """The tree's rows to ask for are one an atom and leaf at angle 0: nothing of the kind is written."""
    from loom.operators import repulsion as rp

    names = []
    monkeypatch.setattr(rp, "written", lambda df, name, f=rp.written: (names.append(name), f(df, name))[1])
    m = np.random.default_rng(4).standard_normal((300, 2))
    m[200:] = m[:100]
    x = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>")
    zero = {r.i: (r.z, *r.f) for r in rp.repulsion(x, 0.0, leaf=4).collect()}
    assert "asked" not in names
    tree = {r.i: (r.z, *r.f) for r in rp.repulsion(x, 1e-9, leaf=4).collect()}
    tiles = {r.i: (r.z, *r.f) for r in rp.repulsion_exact(x, 0).collect()}
    assert all(np.allclose(zero[k], tree[k], rtol=1e-9, atol=1e-12) and np.allclose(zero[k][1:], tiles[k][1:]) for k in range(300)) and len(zero) == 300


def test_pair_sums_by_tiles(spark, monkeypatch):
    from loom.operators import stats

    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((700, 6)), rng.standard_normal((900, 6))
    x, y = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>").coalesce(1) for m in (a, b))
    monkeypatch.setattr(stats, "PRODUCTS", 512 * 100)
    for power in (1, 2, 3):
        want = (np.abs(a @ b.T) ** power).sum()
        for most in (0, 1 << 26):
            assert np.isclose(stats.pair_sums(x, y, power, most).first().s, want, rtol=1e-11)
    assert stats.pair_sums(x, y.limit(0), 1, 1 << 26).first().s is None and stats.pair_sums(x, y.limit(0), 2, 1 << 26).first().s is None


def test_quick_candidates_hold_all_neighbours():
    """Rows beside brute force: large groups of near copies, exact copies, an outlier that spoils single precision, tiny and huge."""
    from loom.operators import vectors as ve

    rng = np.random.default_rng(6)
    for scale, dim, k, n, digits in ((1, 64, 16, 6000, 6), (1, 64, 10, 3000, None), (1e-9, 5, 3, 2000, None), (1e200, 3, 10, 900, None), (1, 2, 1, 400, 6)):
        b = rng.standard_normal((n, dim)) * scale
        b[n // 2 : n // 2 + 30] = b[0]
        b[100 : n // 6] = b[100] * (1 + 1e-7 * rng.standard_normal((n // 6 - 100, dim))) if n > 1000 else b[100 : n // 6]
        if k == 10:
            b[5] *= 1e6
        j = rng.permutation(n)
        got = {(r, z): (j[c], d) for part in ve.nearest_rows(j[:200], b[:200], j, b, k, 2, True, digits) for r, c, d, z in zip(*part)}
        assert len(got) == 200 * k
        for q in range(200):
            d = ve.distance_pairs(np.repeat(b[q : q + 1], n, 0), b, 2)
            d = d if digits is None else np.round(d, digits)
            near = np.lexsort((j, d))
            near = near[near != q][:k]
            assert [got[q, z] for z in range(k)] == [(j[w], d[w]) for w in near]


def test_quick_candidates_are_few():
    """The product in single precision leaves little to be computed again."""
    from loom.operators import vectors as ve

    b = np.random.default_rng(7).standard_normal((20_000, 64))
    r, c = ve.quick_candidates(b[:50], ve.augmented(b, 16, np.abs(b).max()), 16, None, 1e-6)
    assert 50 * 16 <= len(r) < 50 * 64


def test_copies_cost_no_more_than_other_rows(monkeypatch):
    """Ten vectors, 300 copies each, and a group of 2,000: single precision still does, and the smallest ids win all ties."""
    from loom.operators import vectors as ve

    def never(*a):
        raise AssertionError("products in double")

    monkeypatch.setattr(ve, "candidates", never)
    rng = np.random.default_rng(8)
    few = rng.standard_normal((11, 16))
    few[3, 0] = 0.0
    b = np.concatenate([np.repeat(few[:10], 300, 0), np.repeat(few[10:], 2000, 0), rng.standard_normal((1000, 16))])
    b[900:1000, 0] = -0.0  # of the copies of few[3]
    b = np.tile(b, (2, 1))
    j = rng.permutation(len(b)).astype(np.int64)
    j[7] = j[8] = j[9]  # one id thrice
    asked = np.r_[0:40, 890:910, 3000:3020, 5500:5540]
    for digits in (6, None):
        got = {(r, z): (j[c], d) for part in ve.nearest_rows(j[asked], b[asked], j, b, 10, 2, True, digits) for r, c, d, z in zip(*part)}
        assert len(got) == 10 * len(asked)
        for r, q in enumerate(asked):
            d = ve.distance_pairs(np.repeat(b[q : q + 1], len(b), 0), b, 2)
            d = d if digits is None else np.round(d, digits)
            near = np.lexsort((j, d))
            near = near[j[near] != j[q]][:10]
            assert [got[r, z] for z in range(10)] == [(j[w], d[w]) for w in near]


def test_joint_works_its_edges_out_once(spark):
    edges = spark.createDataFrame([(0, 1, 0.25), (0, 2, 0.75), (1, 0, 1.0), (2, 1, 1.0)], "i long, j long, p double")
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    joint = {(r.i, r.j): r.p for r in ts.joint_edges(edges.mapInArrow(run, edges.schema), 3).collect()}
    assert joint == {(0, 1): 1.25 / 6, (1, 0): 1.25 / 6, (0, 2): 0.125, (2, 0): 0.125, (2, 1): 1 / 6, (1, 2): 1 / 6}
    assert made.value == 4
