"""URL rules, spelling variants and ball-tree clusters against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.llm import ball_tree, spelling, url_filter

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(ABC)
    fit = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(fit)
    return host, path, best[3], "block" if best[2] else "allow"


def url_rows():
    r = random.Random(1)
    hosts = ["org", "a.org", "x.a.org", "A.Org", "b.com", ".com", "com.", "www.b.com:80", "", "u@b.com", "é.org"]
    paths = ["", "/", "/a", "/a/b", "/ab", "/a/b/c?x://y", "?q", "#f", "/a#b?c", "/A", "/ü\n/x", "//"]
    rows = [r.choice(["http", "", "x://y"]) + "://" + r.choice(hosts) + r.choice(paths) for _ in range(300)]
    rows += [None, "", "org/a", "http:/org/a", "://org/a", "http://" + "a." * 500 + "org/" + "p" * 100_000, *["http://b.com/a"] * 150]
    rules = [("org", "/", "allow"), ("a.org", "/a", "block"), ("x.a.org", "", "allow"), ("com", "/a/b", "block"), ("b.com", "/a", "allow"), ("b.com", "/a", "block"), ("org", "/ab", "block"), ("nowhere.net", "/", "block")]
    return rows, rules


@pytest.mark.parametrize("sizes", [{}, {"first": 0.9, "rest": 0.7}, {"first": 0.5, "part_bytes": 1}])
def test_urls_equal_brute_force(spark, sizes):
    """Also with filters that are mostly wrong, so that many levels are needed, and with many parts."""
    urls, rules = url_rows()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("a.b", F.lit("x"))
    df = url_filter.url_filter(pages, spark.createDataFrame([(h.upper(), p, v) for h, p, v in rules], "host string, path string, verdict string"), **sizes)
    assert df.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_for_its_universe(spark):
    listed = spark.range(400).selectExpr("cast(id * 3 as string) as key")
    universe = spark.range(3000).selectExpr("cast(id as string) as key")
    found = url_filter.cascade(listed, universe.unionByName(universe), first=0.6, rest=0.6)
    assert found.n_levels > 3
    rows = universe.select("key", *[F.array(h).alias(c) for h, c in zip(url_filter.hashes(F.col("key")), "ab")])
    got = {int(r.key): r.at for r in found.first_listed(rows, "a", "b", "at").collect()}
    assert all((got[i] == 1) == (i % 3 == 0 and i < 1200) for i in range(3000))


def test_url_defined_cases(spark):
    rules = spark.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    got = url_filter.url_filter(pages, rules.limit(0), default="block").first()
    assert (got.host, got.path, got.rule, got.verdict) == ("org", "/", None, "block")
    for bad in [("", "/", "allow"), (None, "/", "allow"), ("org", "x", "allow"), ("a/b", "/", "allow"), ("org", "/", "maybe"), ("org", "/", None)]:
        with pytest.raises(ValueError):
            url_filter.url_filter(pages, spark.createDataFrame([bad], "host string, path string, verdict string"))


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every=199, least=6, least_n=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = run.translate(ABC)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= least_n}


def brute_variants(n, ratio=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v.encode("utf-8")), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def crowded_texts():
    """Words in families, so that bigrams, halves and whole words but for a letter are crowded; chains of forms; ties."""
    r = random.Random(2)
    words = ["abcdefgh", "abcdefghi", "qzabcdefgh"]
    for base in ("zqxjkvwb", "aaaaaaaa", "étranger", "queueing"):
        for _ in range(60):
            w = list(base)
            for _ in range(r.choice([1, 1, 1, 2])):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], [r.choice("abzÉé")], [w[i], r.choice("abzq")]])
            words.append("".join(w))
    rows = []
    for i, w in enumerate(words):
        rows += [(i, " ".join([w.upper() if j % 2 else w for j in range(r.choice([4, 5, 6, 30, 160]))]))]
    rows += [(i, "chainsaw " * 2 + "chainsaws " * 12 + "chainsawss " * 70 + "chainsawsss " * 400) for i in [None, *range(500, 508)]]
    rows += [(1, None), (2, ""), (3, "ab " * 100), (4, "x" * 30_000 + " ÷×÷×÷× " * 7)]
    return rows + rows[:3]


@pytest.mark.parametrize("crowd", [256, 6, 1])
def test_spelling_equals_brute_force(spark, crowd):
    rows = crowded_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n.x", F.lit(1))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, crowd=crowd, every=7).collect()}
    want = brute_variants(brute_words(rows, every=7))
    assert got == want and sum(v[0] is not None for v in want.values()) > 10
    assert max(v[3] for v in want.values()) > 10 and any(v[0] != v[1] and v[0] is not None for v in want.values())


def test_spelling_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    assert spelling.spelling_variants(docs.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    ids = spark.createDataFrame([("a", "letters " * 9)], "`an.id` string, text string")
    got = spelling.spelling_variants(ids, "an.id").collect()
    assert [(r.word, r.n) for r in got] == [("letters", 9)]


def brute_clusters(rows, k, rounds, dims, scale, seed):
    good = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(scale * x) for x in v]))
    ranked = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [r[1] for r in ranked[:k]]
    near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in good:
            groups[near(x)[1]].append(x)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else y for j, y in enumerate(c)]
    out = [(i, *reversed(near(x))) for i, x in good]
    per = Counter()
    for _, j, d in out:
        per[j] += d
    name = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted((str(i), j, d, per[j], sum(per.values()), name(j)) for i, j, d in out)


def cluster_rows():
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal((i % 5) * 3, 0.3, 4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 1.0]) for i in range(300)]  # a vector that many rows share
    rows += [(2000 + i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(200)]  # ties
    rows += [(7, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [1.0, 1.0, 1.0, 1.0]), (3000, [1.0, 1.0]), (3001, None), (3002, []), (3003, [1.0, None, 1.0, 1.0])]
    return rows + [(3004, [float("nan"), 1.0, 1.0, 1.0]), (3005, [float("inf")] * 4), (3006, [-1e5, 1e5, 1e5, -1e5])]


@pytest.mark.parametrize("tree_size,scale", [(8192, 1024), (50, 1024), (64, 1), (100, 2000)])
def test_clusters_equal_brute_force(spark, tree_size, scale):
    rows = cluster_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    out = ball_tree.ball_tree_clusters(df, k=6, rounds=4, dims=4, scale=scale, tree_size=tree_size).collect()
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)
    assert got == brute_clusters(rows, 6, 4, 4, scale, 3)


def test_clusters_with_long_arithmetic_and_few_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 4e4, 3)]) for i in range(200)]  # beyond what doubles square exactly
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ball_tree.ball_tree_clusters(df, k=5, rounds=3, dims=3, scale=1024).collect()
    assert sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in out) == brute_clusters(rows, 5, 3, 3, 1024, 3)
    few = ball_tree.ball_tree_clusters(df.limit(2), k=5, rounds=3, dims=3).collect()
    assert sorted(x.cluster for x in few) == [0, 1] and all(x.distance == 0 for x in few)
    assert ball_tree.ball_tree_clusters(df.limit(0), dims=3).count() == 0
    too_large = spark.createDataFrame([("a", [1e300, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "`v.id` string, embedding array<double>")
    assert [x["v.id"] for x in ball_tree.ball_tree_clusters(too_large, "v.id", dims=3).collect()] == ["b"]


def test_balls_are_decided_as_their_points():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-50, 50, (300, 3)), r.integers(900, 950, (300, 3)), np.tile([[5, 5, 5]], (200, 1))])
    c = np.array([[0, 0, 0], [10, 0, 0], [920, 920, 920], [-5000, 0, 0]])
    order, t = ball_tree.tree(x)
    x = x[order]
    of, whole_points = np.full(len(x), -1), 0
    for which, cluster, whole in ball_tree.asked(t, x, c):
        for w, k in zip(which, cluster):
            a, z = (t["first"][w], t["last"][w]) if whole else (w, w + 1)
            assert (of[a:z] == -1).all()
            of[a:z] = k
            whole_points += (z - a) * whole
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (of == d.argmin(1)).all() and whole_points > 300
    assert t["last"][0] - t["first"][0] == len(x) and (t["total"][0] == x.sum(0)).all()


def test_equal_vectors_are_one_ball():
    """Wherever they lie among others, and where two centroids are as near."""
    for seed in range(5):
        r = np.random.default_rng(seed)
        x = r.permutation(np.concatenate([r.integers(-50, 50, (300, 3)), np.tile([[5, 5, 5]], (200, 1)), np.tile([[-9, 0, 7]], (90, 1))]))
        c = np.array([[0, 0, 0], [10, 0, 0]])
        order, t = ball_tree.tree(x)
        x, leaf = x[order], t["left"] < 0
        size, points = (t["last"] - t["first"])[leaf], x[t["first"]][leaf]
        for point, n in (((5, 5, 5), 200), ((-9, 0, 7), 90)):
            equal = np.flatnonzero((x == point).all(1))
            assert equal[-1] - equal[0] == len(equal) - 1 >= n - 1 and ((points == point).all(1) & (size >= n)).sum() == 1
        asked = [(which, cluster, whole) for which, cluster, whole in ball_tree.asked(t, x, c)]
        compared = np.concatenate([which for which, _, whole in asked if not whole])
        assert len(compared) <= 300 and not (x[compared] == (5, 5, 5)).all(1).any()
        assert sorted(np.concatenate([np.concatenate([np.arange(t["first"][w], t["last"][w]) for w in which] or [[]]) if whole else which for which, _, whole in asked])) == list(range(len(x)))
    assert ball_tree.halved(np.zeros(5)).tolist() == [True, True, False, False, False]
