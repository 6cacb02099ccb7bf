"""Neighbours with broken rows, sums in one pass, recurrences, and what else has no query of its own."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.operators import stats, vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, v array<double>")


@pytest.mark.parametrize("metric", [0, 1, 2, 3])
@pytest.mark.parametrize("most", [1 << 26, 0])
def test_nearest_with_broken_and_huge_rows(spark, metric, most):
    rng = np.random.default_rng(metric)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((40, 3)))]
    nan, inf = float("nan"), float("inf")
    broken = [(100, None), (101, [nan, 1, 1]), (102, [1, inf, 1]), (103, [1, 1, -inf]), (104, [None, 1, 1])]
    x = frame(spark, good + broken)
    got = {(r.i, r["rank"]): (r.j, r.dist) for r in vectors.nearest(x, x, 3, metric, exclude_same=True, most=most).collect()}
    m = np.array([v for _, v in good])
    d = vectors.distance_block(m, m, metric)
    for i in range(40):
        want = sorted((d[i, j], j) for j in range(40) if j != i)[:3]
        assert [got[i, k + 1][0] for k in range(3)] == [j for _, j in want]
    assert len(got) == 120
    huge = frame(spark, [(0, [1e200, 0, 0]), (1, [1.5e200, 0, 0]), (2, [0, 1e-200, 0]), (3, [0, 3e-200, 0]), (4, [0, 0, 1.0])])
    near = {r.i: (r.j, r.dist) for r in vectors.nearest(huge, huge, 1, metric, exclude_same=True, most=most).collect()}
    if metric:
        assert near[0] == (1, pytest.approx(5e199)) and near[1][0] == 0 and near[2] == (3, pytest.approx(2e-200)) and near[3][0] == 2
    else:
        assert near[0] == (1, pytest.approx(0.0))


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_label_votes(spark, most):
    rng = np.random.default_rng(1)
    m, label = rng.integers(-2, 3, (60, 2)).astype(float), rng.integers(0, 3, 60)
    x = frame(spark, [*enumerate(m), (99, [float("nan"), 1.0])]).withColumn("label", F.coalesce(F.element_at(F.array(*[F.lit(int(v)) for v in label]), (F.least(F.col("id"), F.lit(59)) + 1).cast("int")), F.lit(0)))
    got = {r.id: r.predicted for r in vectors.label_votes(x, 5, most=most).collect()}
    d = vectors.distance_block(m, m, 2)
    for i in range(60):
        near = sorted((d[i, j], j) for j in range(60) if j != i)[:5]
        votes = np.bincount([label[j] for _, j in near], minlength=3)
        assert got[i] == votes.argmax()
    assert len(got) == 60


def test_sums_read_their_rows_once(spark):
    m = np.random.default_rng(2).standard_normal((50, 4))
    read = spark.sparkContext.accumulator(0)

    def tap(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    x = frame(spark, enumerate(m)).mapInArrow(tap, "id long, v array<double>")
    n, s, g = vectors.vector_products(x)
    assert read.value == 50 and n == 50 and np.allclose(s, m.sum(0)) and np.allclose(g, m.T @ m)
    assert vectors.vector_products(x.limit(0))[0] == 0
    rows = x.withColumn("label", (F.col("id") % 3).cast("int"))
    read.value = 0
    out = stats.class_sums(rows, F.col("id") % 5 == 4, 3)
    assert read.value == 50
    hold = np.arange(50) % 5 == 4
    for h in (False, True):
        own, y = m[hold == h], np.eye(3)[np.arange(50)[hold == h] % 3]
        assert np.allclose(out[h][0], own.T @ own) and np.allclose(out[h][1], own.T @ y) and out[h][2] == len(own)
    assert stats.class_sums(rows.limit(0), F.lit(True), 3)[True][0].shape == (0, 0)


def test_outer_sums_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(stats, "SUM_BYTES", 10_000)
    n = 20_000
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, (n, 2)), rng.integers(0, 5, (n, 3))
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"g": np.arange(n) % 9000, "a": list(a.astype(float)), "b": list(b.astype(float))}))
    began = time.time()
    got = {(r.g, r.i, r.j): r.x for r in stats.outer_sums(df, "g").collect()}
    assert time.time() - began < 20 and len(got) == 9000 * 6
    for g in (0, 7, 8999):
        want = b[np.arange(n) % 9000 == g].T @ a[np.arange(n) % 9000 == g]
        assert all(got[g, i, j] == want[i, j] for i in range(3) for j in range(2))


@pytest.mark.parametrize("gamma", [0.9, 1.0, 0.0, -1.1])
def test_running_fold_over_ranges(spark, gamma):
    """One key of many steps over all tasks, short keys, a null key and null values."""
    rng = np.random.default_rng(4)
    rows = [(1, int(t), float(rng.standard_normal())) for t in range(3000)] + [(k, int(t), float(rng.standard_normal())) for k in range(2, 60) for t in range(3)]
    rows += [(None, 1, 2.0), (None, 2, None), (77, 5, 1.0)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "k long, t long, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {(r.k, r.t): r.f for r in stats.running_fold(df, "k", "t", "v", gamma).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, f = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        f[k] = f.get(k, 0.0) * gamma + (v or 0.0)
        want[k, t] = f[k]
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x], rtol=1e-9, atol=1e-9 * max(1, abs(gamma) ** 3000)) for x in want)


def test_singular_factors(spark):
    from loom.operators.lowrank import singular_factors

    rng = np.random.default_rng(5)
    for m in (rng.standard_normal((90, 7)), rng.standard_normal((9, 30)), rng.standard_normal((60, 4)) @ rng.standard_normal((4, 11)), np.zeros((5, 3)), rng.standard_normal((40, 6)) * 10.0 ** -np.arange(0, 12, 2)):
        x = frame(spark, enumerate(m)).repartition(3)
        f = singular_factors(x)
        s = np.linalg.svd(m, compute_uv=False)
        assert np.allclose(f.s, s, rtol=1e-6 if s[-1] > 1e-13 else 0, atol=1e-12 * max(1, s[0])) and f.residual <= 1e-10
        u = np.array([r.u for r in sorted(f.u.collect(), key=lambda r: r.id)])
        live = f.s > 0
        assert np.allclose(u.T @ u, np.diag(live.astype(float)), atol=1e-5) and np.allclose(f.v.T @ f.v, np.eye(len(s)), atol=1e-9)
        assert np.allclose([r.v for r in sorted(f.rebuilt().collect(), key=lambda r: r.id)], m, atol=1e-9)
    assert singular_factors(x.limit(0)).s.shape == (0,)
    m = rng.standard_normal((80, 5)) + 3
    f = singular_factors(frame(spark, enumerate(m)), 2, centred=True)
    assert np.allclose(f.s, np.linalg.svd(m - m.mean(0), compute_uv=False)[:2]) and np.allclose(f.mean, m.mean(0))


def test_low_rank_of_a_wide_table(spark):
    """20,000 columns: neither the driver nor a task holds a square of them."""
    import pyarrow as pa

    from loom.operators.lowrank import singular_factors

    rng = np.random.default_rng(6)
    s = 2.0 ** -np.arange(30)
    u, v = np.linalg.qr(rng.standard_normal((300, 30)))[0], np.linalg.qr(rng.standard_normal((20_000, 30)))[0]
    m = (u * s) @ v.T
    x = spark.createDataFrame(pa.table({"id": np.arange(300), "v": list(m)})).repartition(4)
    f = singular_factors(x, 16, threshold=1e-8)
    assert np.allclose(f.s, s[:16], rtol=1e-6) and f.iterations < 20 and f.v.shape == (20_000, 16)
    got = np.array([r.u for r in sorted(f.u.collect(), key=lambda r: r.id)])
    assert np.allclose(np.abs((got * u[:, :16]).sum(0)), 1, atol=1e-6)


def exact_repulsion(m):
    diff = m[:, None] - m[None]
    w = 1 / (1 + (diff * diff).sum(2))
    np.fill_diagonal(w, 0)
    return w.sum(1), ((w * w)[:, :, None] * diff).sum(1)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_repulsion_by_cells(spark, monkeypatch, d):
    from loom.operators import repulsion as rp

    monkeypatch.setattr(rp, "ASKERS", 100)
    rng = np.random.default_rng(d)
    m = np.concatenate([rng.standard_normal((150, d)), rng.standard_normal((150, d)) * 0.01 + 5, np.tile(np.full((1, d), 2.0), (60, 1)), [[0.0] * d, [-0.0] * d]])
    x = frame(spark, [*enumerate(m), (900, [float("nan")] * d), (901, [None] * d)])
    z, f = exact_repulsion(m)
    for angle, leaf, tol in ((0.0, 8, 1e-9), (0.0, 1000, 1e-9), (0.3, 8, 0.02), (0.5, 1, 0.05)):
        got = sorted((r.i, r.z, r.f) for r in rp.repulsion(x, angle, leaf).collect())
        assert [g[0] for g in got] == list(range(len(m)))
        assert np.allclose([g[1] for g in got], z, rtol=tol)
        off = np.linalg.norm(np.array([g[2] for g in got]) - f, axis=1)
        assert off.max() <= max(tol, 1e-9) * np.linalg.norm(f, axis=1).max() * 2
    assert rp.repulsion(frame(spark, [(1, m[0])])).first().z == 0 and rp.repulsion(x.limit(0)).count() == 0


def test_repulsion_of_coincident_points(spark):
    """100,000 points at one place and 20,000 others, in bounded memory."""
    import pyarrow as pa

    from loom.operators import repulsion as rp

    rng = np.random.default_rng(9)
    m = np.concatenate([np.full((100_000, 2), 0.25), rng.standard_normal((20_000, 2)) * 3])
    x = spark.createDataFrame(pa.table({"id": np.arange(len(m)), "v": list(m)})).repartition(8)
    got = {r.i: r.z for r in rp.repulsion(x, 0.5).filter("i % 5000 = 0").collect()}
    for i in got:
        w = 1 / (1 + ((m - m[i]) ** 2).sum(1))
        assert np.isclose(got[i], w.sum() - 1, rtol=0.02)
    assert len(got) == 24


@pytest.mark.parametrize("power", [1.0, 2.0])
def test_plus_plus_equals_running_sums(spark, monkeypatch, power):
    import hashlib

    from loom.operators import kmeans as km

    monkeypatch.setattr(km, "CHUNK", 13)
    rng = np.random.default_rng(10)
    ids = np.sort(rng.choice(10**12, 300, replace=False))
    m = np.concatenate([rng.standard_normal((200, 3)), np.ones((100, 3))])
    x = frame(spark, [(int(i), v) for i, v in zip(ids, m)]).repartition(5)
    h = lambda v: hashlib.md5(f"4:{v}".encode()).hexdigest()
    want = [min(ids.tolist(), key=h)]
    while len(want) < 6:
        d = vectors.distance_block(m, m[[ids.tolist().index(i) for i in want]], 2).min(1)
        run = np.cumsum(np.round(d, 9) ** power)
        want.append(int(ids[np.flatnonzero(run > run[-1] * int(h(1_000_000 + len(want))[:13], 16) / 2**52)[0]]))
    assert km.plus_plus(x, 6, seed=4, power=power) == want
    same = frame(spark, [(i, [1.0, 2.0]) for i in range(30)])
    assert len(km.plus_plus(same, 3)) == 3  # no distance at all


def test_hierarchy_of_paths(spark):
    from loom.operators import hierarchy as hi

    paths = ["a/b/c.txt", "a/b/d.txt", "a/e", "f", "a/b/g/h/i/j", "a/b/c.txt", "a/b", "", None]
    files = spark.createDataFrame([(p, 10 + i) for i, p in enumerate(paths)], "path string, size long")
    tree = hi.nodes(files, size_col="size").cache()
    got = {r.path: r for r in tree.collect()}
    assert set(got) == {"", "a", "a/b", "a/b/c.txt", "a/b/d.txt", "a/e", "f", "a/b/g", "a/b/g/h", "a/b/g/h/i", "a/b/g/h/i/j"}
    assert got["a/b/c.txt"].size == 25 and got["a/b"].size == 16 and got["a/b"].kind == "directory" and got["a/b/g"].parent == "a/b" and got["f"].parent == "" and got[""].parent is None
    pairs = hi.closure(tree).cache()
    want = {("", p, len(p.split("/")) if p else 0) for p in got} | {(p, q, q.count("/") - p.count("/")) for p in got if p for q in got if q == p or q.startswith(p + "/")}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)
    total = {r.path: (r["size"], r.files) for r in hi.sizes(tree, pairs).collect()}
    assert total[""] == (sum(10 + i for i in range(7)), 5) and total["a/b"] == (10 + 11 + 14 + 15 + 16, 3) and total["f"] == (13, 1)
    assert sorted(r.path for r in hi.children(tree, "a/b").collect()) == ["a/b/c.txt", "a/b/d.txt", "a/b/g"]
    asked = spark.createDataFrame([("a/b/g",), ("f",), ("f",), ("none",)], "p string")
    assert sorted((r.top, r.path, r.distance) for r in hi.below(tree, pairs, asked, "p").collect()) == [("a/b/g", "a/b/g", 0), ("a/b/g", "a/b/g/h", 1), ("a/b/g", "a/b/g/h/i", 2), ("a/b/g", "a/b/g/h/i/j", 3), ("f", "f", 0)]
    assert [r.path for r in hi.found(tree, "e").collect()] == ["a/e"] and sorted(r.name for r in hi.found(tree, ".txt").collect()) == ["c.txt", "d.txt"]
    cut = {r.path: (r.kind, r["size"]) for r in hi.nodes(files, size_col="size", depth=2).collect()}
    assert cut["a/b"] == ("file", 10 + 11 + 14 + 15 + 16) and "a/b/g" not in cut
    for loop in ([(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError, match="back"):
            hi.closure(spark.createDataFrame(loop, "path long, parent long"))
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "path long, parent long")
    assert hi.closure(chain).count() == 40 * 41 // 2


class Reader:
    """The rules of `strict`, one character after the other."""

    def __init__(self, text):
        self.t, self.i = text.split("\0")[0], 0

    def peek(self):
        return self.t[self.i] if self.i < len(self.t) else ""

    def want(self, ok):
        if not ok:
            raise ValueError(self.i)

    def space(self):
        while True:
            if self.peek() and self.peek() in " \t\n\v\f\r":
                self.i += 1
            elif self.t.startswith("//", self.i):
                while self.peek() not in ("", "\n"):
                    self.i += 1
            elif self.t.startswith("/*", self.i):
                end = self.t.find("*/", self.i + 2)
                self.want(end >= 0)
                self.i = end + 2
            else:
                return

    def string(self):
        self.want(self.peek() == '"')
        self.i += 1
        while self.peek() != '"':
            self.want(self.peek())
            if self.peek() == "\\":
                self.i += 1
                c = self.peek()
                self.want(c and c in '"\\/bfnrtu')
                if c == "u":
                    h = self.t[self.i + 1 : self.i + 5]
                    self.want(len(h) == 4 and all(x in "0123456789abcdefABCDEF" for x in h) and not 0xD800 <= int(h, 16) <= 0xDFFF)
                    self.i += 4
            self.i += 1
        self.i += 1

    def number(self):
        a = self.i
        digit = lambda: self.peek() and self.peek() in "0123456789"

        def digits():
            while digit():
                self.i += 1

        self.i += self.peek() == "-"
        if self.peek() == "0":
            self.i += 1
            self.want(not digit())
        digits()
        real = False
        if self.peek() == ".":
            self.i, real = self.i + 1, True
            self.want(digit())
            digits()
        if self.peek() and self.peek() in "eE":
            self.i, real = self.i + 1, True
            self.i += bool(self.peek() and self.peek() in "+-")
            self.want(digit())
            digits()
        n = self.t[a : self.i]
        self.want(n != "-")
        v = float(n)  # ValueError where there are no digits
        self.want(abs(v) < float("inf") and (abs(v) >= 2.2250738585072014e-308 or not any(c in "123456789" for c in n.lower().split("e")[0])) if real else -(2**63) <= int(n) < 2**63)

    def value(self):
        self.space()
        c = self.peek()
        if c == '"':
            return self.string()
        if c and c in "-0123456789":
            return self.number()
        for word in ("true", "false", "null"):
            if c == word[0]:
                self.want(self.t.startswith(word, self.i))
                self.i += len(word)
                return None
        self.want(c and c in "[{")
        close, self.i = {"[": "]", "{": "}"}[c], self.i + 1
        self.space()
        if self.peek() == close:
            self.i += 1
            return None
        while True:
            self.space()
            if close == "}":
                self.string()
                self.space()
                self.want(self.peek() == ":")
                self.i += 1
            self.value()
            self.space()
            if self.peek() == close:
                self.i += 1
                return None
            self.want(self.peek() == ",")
            self.i += 1

    def accepts(self):
        try:
            self.value()
            self.space()
            return self.i == len(self.t)
        except ValueError:
            return False


def test_strict_json(spark):
    import random

    from loom.sources.json_text import strict

    r = random.Random(11)
    bits = ["{", "}", "[", "]", ":", ",", '"a"', '"a"', "1", "0", "-", "-0", "01", "-.5", ".5", "1.", "1e5", "1E+2", "-e5", "1e400", "1e-310", "0.0e-999", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "true", "false", "null", "nul", "truex", " ", "\n", "\v", "\f", "// x\n", "// \"x", "/* \" */", "/* * */", "/*", "*/", "/", '"\\n"', '"\\x"', '"\\u00e9"', '"\\ud83d\\ude00"', '"\\u12"', '"\n\t"', '"\\\\"', '"\\"', '"', "\\", "é", "NaN", "Infinity", "'a'", "+1", "\0", "/**/", '"/*"', '"//"', "1 2", "s"]
    texts = ["", " ", "{}", "[]", "[1,]", '{"a":1,}', '{"a":1,"a":2}', "1]", "[1", "1, 2", "1] [2", '1},{"a":1', '{"a" 1}', "[,1]", '{"a":[{"b":[]},-.5e1,"x\\/"]} // end', "[" * 300 + "]" * 300, '"' + "\\n" * 20_000 + '"', "[" + "1," * 20_000 + "1]", "/*" + "*" * 20_000 + "*/ 1", "1\0 x", '"a\0"', "-", "--1", "1-1", "tru", "truefalse", "[true false]", "1/**/2", '"a""b"']
    for _ in range(1500):
        texts.append("".join(r.choice(bits) for _ in range(r.randrange(1, 7))))

    def made(depth):
        k = r.randrange(7)
        if k == 0 and depth < 4:
            return "[" + ",".join(made(depth + 1) for _ in range(r.randrange(3))) + r.choice(["]"] * 9 + [",]"])
        if k == 1 and depth < 4:
            return "{" + ",".join(r.choice(['"k"', ' "k" ', '/**/"k"']) + ":" + made(depth + 1) for _ in range(r.randrange(3))) + r.choice(["}"] * 9 + [",}"])
        return r.choice(bits)

    texts += [made(0) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").repartition(4)
    got = {x.i: x.ok for x in df.select("i", strict(F.col("t")).alias("ok")).collect()}
    assert got.pop(-1) is None
    wrong = [(t[:60], got[i]) for i, t in enumerate(texts) if got[i] != Reader(t).accepts()]
    assert not wrong, wrong[:10]
    assert sum(got.values()) > 200


def test_codes_of_many_classes(spark, monkeypatch):
    from loom.operators import labels, ordering

    monkeypatch.setattr(ordering, "FEW", 50)
    df = spark.range(1000).select("id", F.concat(F.lit("c"), F.col("id") % 300).alias("class"))
    names = sorted({f"c{i}" for i in range(300)})
    got = labels.class_index(df, "class").collect()
    assert len(got) == 1000 and all(names[r.target] == r["class"] for r in got)
    order = labels.numeric_first(spark.createDataFrame([(str(i),) for i in range(200)] + [("x",), ("a",)], "n string"), "n").collect()
    assert [r.n for r in sorted(order, key=lambda r: r.pos)] == [*map(str, range(200)), "a", "x"]


def test_file_hashes_by_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    from loom.operators import manifest as mf

    monkeypatch.setattr(mf, "PIECE", 7)
    (tmp_path / "a").write_bytes(b"0123456789" * 5)
    (tmp_path / "b").write_bytes(b"")
    df = spark.createDataFrame([(str(tmp_path / "a"), 1), (f"file://{tmp_path}/b", 2)], "path string, `x.y` int")
    for kind in ("sha256", "sha1", "md5"):
        got = {r["x.y"]: r.hash for r in mf.file_hashes(df, "path", kind).collect()}
        assert got == {1: hashlib.new(kind, b"0123456789" * 5).hexdigest(), 2: hashlib.new(kind, b"").hexdigest()}
    with pytest.raises(ValueError):
        mf.file_hashes(df, "path", "crc")


def test_frames_of_any_layout(spark, tmp_path):
    import itertools

    from loom.operators.images import as_frames
    from loom.sources import arrays as sa
    from loom.sources import readers as rd
    from tests.test_sources import idx_bytes

    sa.register(spark)
    for letters in [*itertools.permutations("HWC"), ("H", "W"), ("W", "H")]:
        size = {"H": 5, "W": 7, "C": 3}
        a = np.arange(4 * np.prod([size[x] for x in letters])).reshape(4, *[size[x] for x in letters])
        (tmp_path / "a").write_bytes(idx_bytes(a, 0x0C, ">i4"))
        rows = spark.read.format("arrays").option("path", str(tmp_path / "a")).load().filter("idx >= 2")
        want = rd.frames_of(a, "N" + "".join(letters))
        for r in as_frames(rows, "".join(letters)).collect():
            assert np.array_equal(np.array(r.data).reshape(r.height, r.width, r.channels), want[r.idx]) and r.idx >= 2
        if letters in (("H", "W", "C"), ("C", "H", "W"), ("H", "W")):
            out = as_frames(rows, color=True).first()
            three = np.repeat(want[out.idx], 3, 2) if len(letters) == 2 else want[out.idx]
            assert out.channels == 3 and np.array_equal(np.array(out.data).reshape(5, 7, 3), three)
    with pytest.raises(ValueError):
        as_frames(rows, "HHW")
    with pytest.raises(Exception, match="no layout"):
        as_frames(spark.createDataFrame([([2, 2, 5], [0.0] * 20)], "shape array<int>, data array<double>")).collect()


def test_rounds_leave_no_tables_behind(spark):
    import glob

    from loom.operators import hierarchy as hi
    from loom.operators import kmeans as km
    from loom.operators.stored import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "path long, parent long")
    before = set(glob.glob(f"{folder}/loom-*"))
    assert hi.closure(chain).count() == 45
    assert sorted(p.rsplit("/loom-", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/loom-*")) - before) == ["closure", "closure-jump"]
    before = set(glob.glob(f"{folder}/loom-*"))
    km.plus_plus(frame(spark, [(i, [float(i)]) for i in range(20)]), 4)
    assert set(glob.glob(f"{folder}/loom-*")) == before
