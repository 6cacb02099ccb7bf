"""Distances, neighbours, k-means and matrix products over embeddings and lineitem."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.operators import kmeans as km
from loom.operators.vectors import collected, column_sums, distance_matrix, label_votes, nearest, vector_products
from loom.plans.registry import query
from loom.plans.views import C_SQL, V_SQL, centroids, load, r, uniform_sql, vectors

_COS = "1 - greatest(-1.0, least(1.0, list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)) + 1e-8)))"
_DIST = {
    "dist_cosine": ("cosine", _COS),
    "dist_l1": ("manhattan", "list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2])))"),
    "dist_l2": ("euclidean", "list_distance(v, c)"),
    "dist_lp3": (3, "pow(list_sum(list_transform(list_zip(v, c), lambda p: pow(abs(p[1] - p[2]), 3))), 1.0 / 3)"),
}


def _distances(metric):
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        c = centroids(v)
        return distance_matrix(v.select("id", "v"), c, metric).select(F.col("i").alias("vec_id"), F.col("j").alias("cid"), r("dist").alias("dist"))

    return run


for _name, (_metric, _sql) in _DIST.items():
    query(f"WITH {V_SQL}, {C_SQL} SELECT id AS vec_id, CAST(cid AS BIGINT) AS cid, round({_sql}, 6) + 0.0 AS dist FROM v, c", _name)(_distances(_metric))


@query(f"""WITH {V_SQL}, {C_SQL} SELECT id AS vec_id, CAST(arg_min(cid, struct_pack(d := d, c := cid)) AS BIGINT) AS cid, min(d) + 0.0 AS dist
    FROM (SELECT id, cid, round(list_distance(v, c), 6) AS d FROM v, c) GROUP BY id""")
def nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest(v.select("id", "v"), centroids(v), 1, digits=6).select(F.col("i").alias("vec_id"), F.col("j").alias("cid"), r("dist").alias("dist"))


_PAIRS = "p AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 6) AS d, b.label AS label FROM v a JOIN v b ON a.id <> b.id)"
K_VOTE = 10


@query(f"""WITH {V_SQL}, {_PAIRS},
n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM p),
t AS (SELECT i, label, count(*) AS votes FROM n WHERE rn <= {K_VOTE} GROUP BY i, label),
w AS (SELECT i, label AS predicted, row_number() OVER (PARTITION BY i ORDER BY votes DESC, label) AS rk FROM t)
SELECT v.label AS label, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN predicted = v.label THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       round(sum(CASE WHEN predicted = v.label THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM w JOIN v ON v.id = w.i WHERE rk = 1 GROUP BY v.label""")
def knn_label_vote(spark, sf_dir):
    votes = label_votes(vectors(spark, sf_dir), K_VOTE, digits=6)
    hit = F.sum((F.col("predicted") == F.col("label")).cast("long"))
    return votes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), F.round(hit / F.count(F.lit(1)), 6).alias("accuracy"))


@query(f"""WITH {V_SQL}, {_PAIRS}, k AS (SELECT least(count(*) - 1, 3 * 5 + 1) AS k FROM v)
SELECT i, j, d + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM p), k WHERE rn <= k""")
def knn_graph(spark, sf_dir):
    """Edges to the floor(3 * perplexity) + 1 nearest rows, perplexity 5."""
    x = vectors(spark, sf_dir).select("id", "v")
    k = min(max(x.count() - 1, 1), 3 * 5 + 1)
    return nearest(x, x, k, exclude_same=True, digits=6).select("i", "j", r("dist").alias("dist"))


@query(f"""WITH {V_SQL}, b AS (SELECT id, v FROM (SELECT id, id AS vec_id, v FROM v) WHERE vec_id % 7 NOT IN (3, 5)),
p AS (SELECT a.id AS i, c.id AS j, round(list_distance(a.v, c.v), 6) AS d FROM b a JOIN b c ON a.id <> c.id)
SELECT i, CAST(rn AS INTEGER) AS rank, j, d + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM p) WHERE rn <= 3""")
def knn_broken_rows(spark, sf_dir):
    """Neighbours where two rows of seven have a null vector, or one with a null, NaN or infinite component."""
    v = vectors(spark, sf_dir).select("id", "v")
    odd = F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(None).cast("double")), (F.col("id") % 4 + 1).cast("int"))
    broken = F.transform("v", lambda x, i: F.when(i == 1, odd).otherwise(x))
    x = v.select("id", F.when(F.col("id") % 7 == 5, broken).when(F.col("id") % 7 != 3, F.col("v")).alias("v"))
    return nearest(x, x, 3, exclude_same=True, digits=6).select("i", "rank", "j", r("dist").alias("dist"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) - 0.5) / 0.25, 6) + 0.0) AS v FROM embeddings""")
def normalize_vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: r((x.cast("double") - 0.5) / 0.25)).alias("v"))


@query(f"""WITH {V_SQL}, e AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM v)
SELECT id AS vec_id, CAST(p AS INTEGER) AS pos, round(x - avg(x) OVER (PARTITION BY p), 6) + 0.0 AS x FROM e""")
def centre_columns(spark, sf_dir):
    v = vectors(spark, sf_dir)
    n, sums, _ = vector_products(v.select("v"))
    mean = F.array(*[F.lit(float(m)) for m in sums / max(n, 1)])
    return v.select(F.col("id").alias("vec_id"), F.posexplode(F.zip_with("v", mean, lambda a, m: r(a - m))).alias("pos", "x"))


@query("""WITH m AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, l_discount AS c, l_tax AS d FROM lineitem)
SELECT 'gram' AS what, round(sum(a*a), 2) AS aa, round(sum(a*b), 2) AS ab, round(sum(a*c), 2) AS ac, round(sum(a*d), 2) AS ad, round(sum(b*b), 2) AS bb,
       round(sum(b*c), 2) AS bc, round(sum(b*d), 2) AS bd, round(sum(c*c), 2) AS cc, round(sum(c*d), 2) AS cd, round(sum(d*d), 2) AS dd FROM m""")
def gram_matrix(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"))
    names = "abcd"
    return m.agg(F.lit("gram").alias("what"), *[F.round(F.sum(F.col(x) * F.col(y)), 2).alias(x + y) for i, x in enumerate(names) for y in names[i:]])


@query("""WITH m AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, l_discount AS c, l_tax AS d FROM lineitem),
g AS (SELECT count(*) AS n, [[sum(a*a), sum(a*b), sum(a*c), sum(a*d)], [sum(b*a), sum(b*b), sum(b*c), sum(b*d)],
             [sum(c*a), sum(c*b), sum(c*c), sum(c*d)], [sum(d*a), sum(d*b), sum(d*c), sum(d*d)]] AS s FROM m),
ij AS (SELECT i, j FROM range(4) t(i), range(4) u(j))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(s[i + 1][j + 1] / n, 4) AS x FROM g, ij""")
def covariance_uncentred(spark, sf_dir):
    """Sum of outer products over the number of rows, partial sums per partition."""
    m = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"))
    n, _, g = column_sums(m, list("abcd"))
    rows = [(i, j, float(g[i, j] / max(n, 1))) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "i int, j int, x double").select("i", "j", F.round("x", 4).alias("x"))


@query(f"""WITH {V_SQL}, {C_SQL}, s AS (SELECT id, cid, c, round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 6) AS sim FROM v, c),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cid) AS rn FROM s)
SELECT id AS vec_id, CAST(rn AS INTEGER) AS rank, CAST(cid AS BIGINT) AS cid, sim + 0.0 AS sim, round(list_sum(c), 6) + 0.0 AS gathered FROM t WHERE rn <= 3""")
def prompt_topk(spark, sf_dir):
    """The three keys most similar to each query by cosine, and a value gathered from each."""
    v = vectors(spark, sf_dir)
    c = centroids(v)
    ids, m = collected(c)
    held = spark.sparkContext.broadcast(m)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column(1).to_pylist()).astype(float)
            sim = np.round((x @ held.value.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((held.value**2).sum(1))[None]), 6)
            order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :3]
            yield pa.RecordBatch.from_pydict({"vec_id": np.repeat(b.column(0).to_numpy(), 3), "rank": np.tile(np.arange(1, 4, dtype=np.int32), len(x)), "cid": ids[order].ravel(), "sim": np.take_along_axis(sim, order, 1).ravel()})

    top = v.select("id", "v").mapInArrow(run, "vec_id long, rank int, cid long, sim double")
    value = c.select(F.col("cid").alias("k"), r(F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias("gathered"))
    return top.join(F.broadcast(value), F.col("cid") == F.col("k")).select("vec_id", "rank", "cid", (F.col("sim") + 0.0).alias("sim"), "gathered")


# k-means: starts at the first k rows by md5 order; SQL has one CTE for each pass
K, PASSES, SEED = 5, 3, 7


def _kmeans_sql(start: str, passes: int, tail: str) -> str:
    ctes = [V_SQL, start]
    for t in range(passes):
        ctes.append(f"""a{t} AS (SELECT id, v, arg_min(cid, struct_pack(d := d, c := cid)) AS cid, min(d) AS d FROM (SELECT id, v, cid, list_distance(v, c) AS d FROM v, c{t}) GROUP BY id, v),
        m{t} AS (SELECT cid, p, avg(x) AS m FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{t}) GROUP BY cid, p),
        c{t + 1} AS (SELECT c{t}.cid, coalesce(n.c, c{t}.c) AS c FROM c{t} LEFT JOIN (SELECT cid, list(m ORDER BY p) AS c FROM m{t} GROUP BY cid) n ON n.cid = c{t}.cid)""")
    return "WITH " + ",\n".join(ctes) + tail


_START = f"c0 AS (SELECT row_number() OVER (ORDER BY h, id) - 1 AS cid, v AS c FROM (SELECT id, v, md5('{SEED}:' || CAST(id AS VARCHAR)) AS h FROM v ORDER BY h, id LIMIT {K}))"
_CELLS = " SELECT CAST(cid AS BIGINT) AS cid, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, round(unnest(c), 6) + 0.0 AS x FROM c{}"


def _cells(spark, c) -> DataFrame:
    rows = [(i, p, float(c[i, p])) for i in range(c.shape[0]) for p in range(c.shape[1])]
    return spark.createDataFrame(rows, "cid long, pos int, x double").select("cid", "pos", r("x").alias("x"))


@query(_kmeans_sql(_START, PASSES, _CELLS.format(PASSES)))
def kmeans_fixed_iters(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _cells(spark, km.KMeans(K, max_iter=PASSES, init="random", random_state=SEED).fit(v).centroids)


@query(_kmeans_sql(_START, PASSES, f" SELECT CAST(count(*) AS BIGINT) AS n, round(sum(d), 4) AS inertia FROM a{PASSES - 1}"))
def kmeans_inertia(spark, sf_dir):
    """Sum of least distances in the last pass."""
    v = vectors(spark, sf_dir)
    model = km.KMeans(K, max_iter=PASSES, init="random", random_state=SEED).fit(v)
    return v.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(model.inertia), 4).alias("inertia"))


_FAR = "c0 AS (SELECT 0::BIGINT AS cid, list_transform(range(64), lambda x: 0.0::DOUBLE) AS c UNION ALL SELECT 1, list_transform(range(64), lambda x: 1000.0::DOUBLE))"


@query(_kmeans_sql(_FAR, 1, _CELLS.format(1)))
def kmeans_empty_cluster_carry(spark, sf_dir):
    """The second start is far from all rows: its cluster stays empty and keeps it."""
    start = np.stack([np.zeros(64), np.full(64, 1000.0)])
    return _cells(spark, km.KMeans(2, max_iter=1, init=start).fit(vectors(spark, sf_dir)).centroids)


def _plus_sql(k: int) -> str:
    ctes = [V_SQL, f"p0 AS (SELECT 0 AS step, id, v FROM (SELECT id, v, md5('{SEED}:' || CAST(id AS VARCHAR)) AS h FROM v ORDER BY h, id LIMIT 1))"]
    for s in range(1, k):
        ctes.append(f"""w{s} AS (SELECT v.id, v.v, min(round(list_distance(v.v, p.v), 9)) AS w FROM v, p{s - 1} p GROUP BY v.id, v.v),
        s{s} AS (SELECT id, v, sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER () AS total FROM w{s}),
        p{s} AS (SELECT * FROM p{s - 1} UNION ALL (SELECT {s}, id, v FROM s{s} WHERE run > total * {uniform_sql(SEED, str(1_000_000 + s))} ORDER BY id LIMIT 1))""")
    return "WITH " + ",\n".join(ctes) + f" SELECT CAST(step AS INTEGER) AS step, id AS vec_id FROM p{k - 1}"


@query(_plus_sql(4))
def kmeanspp_pick(spark, sf_dir):
    picks = km.plus_plus(vectors(spark, sf_dir), 4, SEED)
    return spark.createDataFrame(list(enumerate(picks)), "step int, vec_id long")


def _container(kind):
    def run(spark, sf_dir):
        import json

        from loom.sources.arrays import register
        from loom.sources.writers import write_vectors

        v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        files = [r["file"] for r in write_vectors(v.repartition(3, "id"), kind).collect()]  # one of each partition
        register(spark)
        source = spark.read.format("tensors" if kind == "safetensors" else "arrays").option("paths", json.dumps(files))
        if kind == "records":
            width = v.select(F.size("v")).first()[0]
            source = source.option("records", json.dumps([["rows", "<f8", [width + 1]]]))
        rows = source.load()
        return rows.select(F.element_at("data", 1).cast("long").alias("vec_id"), F.transform(F.slice("data", F.lit(2), F.size("data") - 1), lambda x: F.round(x, 6) + 0.0).alias("v"))

    return run


for _kind in ("idx", "mat", "safetensors", "records"):
    query("SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6) + 0.0) AS v FROM embeddings", f"read_{_kind}")(_container(_kind))


def _stepped(index: str):
    """Some columns of the written arrays, by an index of every row: only their bytes are read."""

    def run(spark, sf_dir):
        import json

        from loom.sources.arrays import register
        from loom.sources.writers import write_vectors

        v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        files = [r["file"] for r in write_vectors(v.repartition(3, "id"), "safetensors").collect()]
        register(spark)
        rows = spark.read.format("arrays").option("paths", json.dumps(files)).option("index", index).schema("key string, data array<double>").load().filter("key = 'rows'")
        return rows.select(F.element_at("data", 1).cast("long").alias("vec_id"), F.transform(F.slice("data", F.lit(2), F.size("data") - 1), lambda x: F.round(x, 6) + 0.0).alias("v"))

    return run


_PICKED = "SELECT vec_id, [round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 FOR i IN {}] AS v FROM embeddings"
query(_PICKED.format("range(8, 65, 8)"), "read_stepped_columns")(_stepped("..., 0:65:8"))
query(_PICKED.format("[64, 3, 3, 17]"), "read_listed_columns")(_stepped(":, [0, 64, 3, -62, 17]"))


@query(f"""WITH {V_SQL}, {C_SQL} SELECT id AS vec_id, CAST(arg_min(cid, struct_pack(d := -d, c := cid)) AS BIGINT) AS cid, max(d) + 0.0 AS score
    FROM (SELECT id, cid, round(list_dot_product(v, c), 6) AS d FROM v, c) GROUP BY id""")
def ridge_classes(spark, sf_dir):
    """The class of largest score, the centroids standing for the solved weights."""
    from loom.operators.stats import ridge_scores

    v = vectors(spark, sf_dir)
    _, weights = collected(centroids(v))
    return ridge_scores(v, weights, digits=6).select(F.col("id").alias("vec_id"), "cid", r("score").alias("score"))
