"""Statistics, scoring kernels, decompositions and t-SNE pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from loom.operators import linalg as la
from loom.operators import stats as st
from loom.operators import tsne as ts
from loom.operators.vectors import BLOCK_BYTES, collected, vector_products
from loom.plans.registry import query
from loom.plans.views import C_SQL, V_SQL, centroids, load, r, vectors

_PAIR = "pr AS (SELECT a.id // 2 AS r, a.v AS a, b.v AS b FROM v a JOIN v b ON a.id % 2 = 0 AND b.id = a.id + 1)"
_OUTER = "SELECT {by} i, j, sum(b[i + 1] * a[j + 1]) AS x FROM pr, range(64) t(i), range(64) u(j) GROUP BY {by} i, j"


def pairs(spark, sf_dir):
    """(r, a, b): neighbouring vectors, even ids as columns of A, odd ids of B."""
    v = vectors(spark, sf_dir).select("id", "v")
    rank = F.floor(F.col("id") / 2).alias("r")
    a = v.filter("id % 2 = 0").select(rank, F.col("v").alias("a"))
    return a.join(v.filter("id % 2 = 1").select(rank, F.col("v").alias("b")), "r")


@query(f"WITH {V_SQL}, {_PAIR}, m AS ({_OUTER.format(by='')}) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(0.5 * x, 6) + 0.0 AS x FROM m")
def lora_delta(spark, sf_dir):
    """(alpha / r) B A' with alpha / r = 0.5."""
    return st.outer_sums(pairs(spark, sf_dir)).select("i", "j", r(F.col("x") * 0.5).alias("x"))


@query(f"""WITH {V_SQL}, {_PAIR.replace('a.id // 2 AS r', 'a.id // 2 % 3 AS task')}, m AS ({_OUTER.format(by='task,')}),
n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY task, i // 32)) AS norm FROM m)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum((task + 1) * x / greatest(norm, 1e-12)), 6) + 0.0 AS x FROM n GROUP BY i, j""")
def unit_directions(spark, sf_dir):
    """Each task's B A' with blocks of 32 rows scaled to unit norm, added up with magnitudes 1, 2, 3."""
    m = st.outer_sums(pairs(spark, sf_dir).withColumn("task", F.col("r") % 3), "task")
    unit = st.unit_blocks(m, "task", 32)
    return unit.groupBy("i", "j").agg(F.sum((F.col("task") + 1) * F.col("x")).alias("x")).select("i", "j", r("x").alias("x"))


@query(f"WITH {V_SQL} SELECT round(sum(abs(d)), 3) AS l1, round(sum(d * d), 2) AS l2 FROM (SELECT list_dot_product(a.v, b.v) AS d FROM v a, v b WHERE a.label < 5 AND b.label >= 5)")
def lora_overlap(spark, sf_dir):
    """Overlap of the columns of later tasks with those of earlier ones, by |.| and by squares."""
    v = vectors(spark, sf_dir)
    old, new = (v.filter(c).select("id", "v") for c in ("label < 5", "label >= 5"))
    one, two = (st.pair_sums(old, new, p, BLOCK_BYTES) for p in (1, 2))
    return one.select(F.round("s", 3).alias("l1")).join(two.select(F.round("s", 2).alias("l2")))


@query(f"""WITH {V_SQL}, {C_SQL}, k AS (SELECT a.cid, a.c AS a, b.c AS k FROM c a JOIN c b ON b.cid = (a.cid + 1) % 10),
s AS (SELECT id, cid, k, list_transform(list_zip(v, a), lambda p: p[1] * p[2]) AS q FROM v, k)
SELECT id AS vec_id, CAST(cid AS BIGINT) AS m, round(list_dot_product(q, k) / (greatest(sqrt(list_dot_product(q, q)), 1e-12) * greatest(sqrt(list_dot_product(k, k)), 1e-12)), 6) + 0.0 AS alpha FROM s""")
def coda_weights(spark, sf_dir):
    """Attention is a label's centroid, the key the next label's."""
    v = vectors(spark, sf_dir)
    c = centroids(v)
    k = c.join(c.select(((F.col("cid") + 9) % 10).alias("before"), F.col("c").alias("k")), F.col("cid") == F.col("before"))
    return v.join(F.broadcast(k)).select(F.col("id").alias("vec_id"), F.col("cid").alias("m"), r(st.coda_weights(F.col("v"), F.col("c"), F.col("k"))).alias("alpha"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT round(avg(pow(list_dot_product(a.v, b.v) - CASE WHEN a.id = b.id THEN 1 ELSE 0 END, 2)), 8) AS penalty FROM v a, v b""")
def ortho_penalty(spark, sf_dir):
    """mean((TT' - I)^2) = (|T'T|^2 - 2 tr + n) / n^2: the sums are D x D, whatever the number of rows."""
    n, _, g = vector_products(vectors(spark, sf_dir, scaled=False).select("v"))
    value = float(((g * g).sum() - 2 * np.trace(g) + n) / max(n, 1) ** 2)
    return spark.createDataFrame([(value,)], "penalty double").select(F.round("penalty", 8).alias("penalty"))


@query(f"""WITH {V_SQL}, {C_SQL} SELECT label, round(avg(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)))), 6) AS sim
FROM v JOIN c ON cid = label GROUP BY label""")
def prompt_similarity(spark, sf_dir):
    """Mean cosine of the queries of a task with its key."""
    v = vectors(spark, sf_dir)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    sq = lambda x: F.sqrt(total(F.transform(x, lambda y: y * y)))
    both = v.join(F.broadcast(centroids(v)), F.col("label") == F.col("cid"))
    return both.groupBy("label").agg(F.round(F.avg(total(F.zip_with("v", "c", lambda x, y: x * y)) / (sq(F.col("v")) * sq(F.col("c")))), 6).alias("sim"))


@query("""SELECT conv_id, round(avg(length(text)), 6) AS mean_size, CAST(max(CASE WHEN turn = 0 THEN length(text) END) AS BIGINT) AS first_size FROM conversations GROUP BY conv_id""")
def query_embed(spark, sf_dir):
    """A group's mean over its tokens, and its first token: turns of conversations."""
    t = load(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.round(F.avg(F.length("text")), 6).alias("mean_size"), F.max(F.when(F.col("turn") == 0, F.length("text"))).cast("long").alias("first_size"))


_LOGITS = "l AS (SELECT v.id, a.cid AS k, list_dot_product(v.v, a.c) AS old, list_dot_product(v.v, b.c) AS new FROM v, c a JOIN c b ON b.cid = (a.cid + 3) % 10 WHERE a.cid < 7)"


@query(f"""WITH {V_SQL}, {C_SQL}, {_LOGITS}, z AS (SELECT id, k, old / 2 AS o, new / 2 AS n FROM l),
s AS (SELECT *, o - ln(sum(exp(o)) OVER (PARTITION BY id)) AS lo, n - ln(sum(exp(n)) OVER (PARTITION BY id)) AS ln_ FROM z)
SELECT round(4 * sum(exp(lo) * (lo - ln_)) / count(DISTINCT id), 6) AS loss FROM s""")
def kl_distillation(spark, sf_dir):
    """Old and new logits of all rows on the first seven classes, temperature 2."""
    v = vectors(spark, sf_dir).select("id", "v")
    ids, c = collected(centroids(vectors(spark, sf_dir)))
    old, new = c[:7], np.roll(c, -3, axis=0)[:7]
    logits = [st.block_matmul(v, w.T, 4) for w in (old, new)]
    return st.distillation(logits[0], logits[1], "id", "o", "y", 2.0).select(F.round("loss", 6).alias("loss"))


@query("""WITH s AS (SELECT l_orderkey AS k, sum(l_quantity) AS star FROM lineitem GROUP BY l_orderkey), f AS (SELECT l_orderkey AS k, count(*) AS f FROM lineitem GROUP BY l_orderkey)
SELECT round(0.5 * 0.1 * sum(f * pow(o_totalprice / 1000 - star, 2)), 2) AS penalty FROM orders JOIN s ON s.k = o_orderkey JOIN f ON f.k = o_orderkey""")
def ewc_penalty(spark, sf_dir):
    """Parameters are orders: value total price, earlier value summed quantity, weight number of lines."""
    l = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    theta = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("theta"))
    return st.ewc_penalty(theta, l.agg(F.sum("l_quantity").alias("star")), l.agg(F.count(F.lit(1)).alias("f")), "k", 0.1).select(F.round("penalty", 2).alias("penalty"))


@query("""WITH y AS (SELECT o_orderpriority AS param, CAST(year(o_orderdate) AS INTEGER) AS task, avg(pow(o_totalprice / 1e5, 2)) AS g FROM orders GROUP BY 1, 2)
SELECT a.param, a.task, round(sum(pow(0.9, (SELECT count(*) FROM y c WHERE c.param = a.param AND c.task > b.task AND c.task <= a.task)) * b.g), 6) AS f
FROM y a JOIN y b ON b.param = a.param AND b.task <= a.task GROUP BY a.param, a.task""")
def fisher_running(spark, sf_dir):
    """F <- 0.9 F + mean(g^2) over the years' orders, for each priority."""
    o = load(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_orderpriority").alias("param"), F.year("o_orderdate").alias("task")).agg(F.avg(F.pow(F.col("o_totalprice") / 1e5, F.lit(2.0))).alias("g"))
    return st.running_fold(g, "param", "task", "g", 0.9).select("param", "task", F.round("f", 6).alias("f"))


@query(f"""WITH {V_SQL}, e AS (SELECT p, sum(x * x) AS e FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS p FROM v) GROUP BY p),
q AS (SELECT *, sum(e) OVER (ORDER BY e DESC, p ROWS UNBOUNDED PRECEDING) AS run, sum(e) OVER () AS total FROM e)
SELECT CAST(count(*) FILTER (run < 0.6 * total) + 1 AS BIGINT) AS k FROM q""")
def energy_threshold_k(spark, sf_dir):
    """The least number of columns that hold 60 percent of the energy."""
    _, _, g = vector_products(vectors(spark, sf_dir).select("v"))
    return spark.createDataFrame([(la.energy_rank(np.diag(g), 0.0, float(np.trace(g)), 0.6),)], "k long")


@query(f"""WITH {V_SQL}, {C_SQL} SELECT id AS vec_id, CAST(cid AS INTEGER) AS o, round(list_dot_product(v, c) + 0.25 * cid, 6) + 0.0 AS y FROM v, c""")
def block_matmul(spark, sf_dir):
    """Inner dimension in three shards, partial products summed, bias added once."""
    v = vectors(spark, sf_dir)
    _, c = collected(centroids(v))
    return st.block_matmul(v.select("id", "v"), c.T, 3, 0.25 * np.arange(len(c))).select(F.col("id").alias("vec_id"), "o", r("y").alias("y"))


@query("""SELECT e.event_id, coalesce(round(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))), 6), 0.0) + 0.0 AS x
FROM events e LEFT JOIN embeddings v ON v.vec_id = e.user_id * 7""")
def embedding_shard_lookup(spark, sf_dir):
    """Rows spread over four shards; ids beyond the table give 0."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", r(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("x"))
    asked = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 7).alias("want"))
    bounds = st.shard_bounds(rows.count(), 4)
    return st.sharded_lookup(asked, "want", rows, "vec_id", "x", bounds).select("event_id", "x")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), w AS (SELECT r, n, (n + 6) // 7 AS up, n // 7 AS down FROM n, range(7) t(r))
SELECT CAST(r AS INTEGER) AS rank, least(up * r, n) AS begin_up, least(up * (r + 1), n) AS end_up, down * r AS begin_down, down * (r + 1) AS end_down FROM w""")
def shard_boundaries(spark, sf_dir):
    n = load(spark, sf_dir, "documents").count()
    rows = [(k, *a, *b) for k, (a, b) in enumerate(zip(st.shard_bounds(n, 7), st.shard_bounds(n, 7, ceil=False)))]
    return spark.createDataFrame(rows, "rank int, begin_up long, end_up long, begin_down long, end_down long")


@query("""SELECT CAST(row_number() OVER (ORDER BY length(source), source, doc_id) - 1 AS BIGINT) AS pos, CAST(substr(source, 4) AS INTEGER) AS rank, doc_id FROM documents""")
def all_gather_ragged(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.substring("source", 4, 10).cast("int").alias("rank"), "doc_id")
    return st.gathered(rows, "rank", "doc_id")


@query("SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(product(1 + value / 1e6), 6) AS product FROM events GROUP BY event_type")
def all_reduce(spark, sf_dir):
    """Sum, mean and product over ranks of each key."""
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.product(1 + F.col("value") / 1e6), 6).alias("product"))


_HOLD = "h AS (SELECT id, label, list_transform(v, lambda x: greatest(x, 0.0)) AS v, (row_number() OVER (ORDER BY id) - 1) % 5 = 4 AS hold FROM v)"


@query(f"""WITH {V_SQL}, {_HOLD}, e AS (SELECT id, hold, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM h),
g AS (SELECT a.hold, a.p AS i, b.p AS j, sum(a.x * b.x) AS x FROM e a JOIN e b ON a.id = b.id GROUP BY 1, 2, 3),
q AS (SELECT hold, p AS i, 64 + label AS j, sum(x) AS x FROM e GROUP BY 1, 2, 3)
SELECT hold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(x, 4) + 0.0 AS x FROM g UNION ALL SELECT hold, CAST(i AS INTEGER), CAST(j AS INTEGER), round(x, 4) + 0.0 FROM q""")
def ranpac_sums(spark, sf_dir):
    """H'H and H'Y of rectified rows, every fifth row apart; columns from 64 on are classes."""
    sums = _ridge_sums(spark, sf_dir)
    rows = [(h, i, j, float(m[i, j])) for h, (g, q, _) in sums.items() for m in [np.concatenate([g, q], 1)] for i in range(m.shape[0]) for j in range(m.shape[1]) if j < 64 or m[:, j].any()]
    return spark.createDataFrame(rows, "hold boolean, i int, j int, x double").select("hold", "i", "j", r("x", 4).alias("x"))


def _ridge_sums(spark, sf_dir):
    from loom.operators.labels import every_nth

    v = vectors(spark, sf_dir)
    h = every_nth(v.select("id", "label", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v")), "id")
    return st.class_sums(h, F.col("holdout"), 10)


@query("SELECT 0.0::DOUBLE AS residual, true AS chosen")
def ridge_normal_equations(spark, sf_dir):
    """(G + rI) W = Q holds for the ridge chosen on the held-out sums."""
    sums = _ridge_sums(spark, sf_dir)
    (fg, fq, _), (hg, hq, n) = sums[False], sums[True]
    ridge = la.choose_ridge(fg, fq, hg, hq, float(n), n)
    g, q = fg + hg, fq + hq
    w = la.ridge(g, q, ridge)
    left = float(np.abs((g + ridge * np.eye(len(g))) @ w - q).max())
    return spark.createDataFrame([(left, 1e-8 <= ridge <= 1e8)], "residual double, chosen boolean").select(r("residual").alias("residual"), "chosen")


def _flag_matrices(spark, sf_dir):
    """(batch_id, m): a positive definite D x D matrix for each label: G + I of its rows."""
    rows = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("batch_id"), F.col("v").alias("a"), F.col("v").alias("b"))
    cells = st.outer_sums(rows, "batch_id").withColumn("x", F.col("x") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    in_order = lambda at, x: F.transform(F.array_sort(F.collect_list(F.struct(at, x))), lambda s: s[x])
    return cells.groupBy("batch_id", "i").agg(in_order("j", "x").alias("r")).groupBy("batch_id").agg(in_order("i", "r").alias("m"))


@query("SELECT DISTINCT CAST(label AS BIGINT) AS batch_id, 0.0::DOUBLE AS off FROM embeddings")
def inverse_identity(spark, sf_dir):
    return la.batched(_flag_matrices(spark, sf_dir), lambda m: [[float(np.abs(m @ la.inverse(m) - np.eye(len(m))).max())]]).select("batch_id", r(F.col("m")[0][0]).alias("off"))


@query("SELECT DISTINCT CAST(label AS BIGINT) AS batch_id, 0.0::DOUBLE AS off FROM embeddings")
def gram_schmidt_orthonormal(spark, sf_dir):
    def work(m):
        q = la.orthogonalize(m)
        return [[float(np.abs(q.T @ q - np.eye(len(m))).max())]]

    return la.batched(_flag_matrices(spark, sf_dir), work).select("batch_id", r(F.col("m")[0][0]).alias("off"))


@query("SELECT CAST(k AS INTEGER) AS k, 0.0::DOUBLE AS residual, true AS descending FROM range(64) t(k)")
def eigen_residual(spark, sf_dir):
    _, _, g = vector_products(vectors(spark, sf_dir).select("v"))
    values, vec = la.eigen((g + g.T) / 2)
    res = np.linalg.norm(g @ vec - vec * values, axis=0) / np.linalg.norm(g)
    rows = [(k, float(res[k]), bool(k == 0 or values[k] <= values[k - 1])) for k in range(len(values))]
    return spark.createDataFrame(rows, "k int, residual double, descending boolean").select("k", r("residual").alias("residual"), "descending")


@query("SELECT vec_id, 0.0::DOUBLE AS off FROM embeddings")
def svd_reconstruction(spark, sf_dir):
    """X V V' gives X back when all directions are kept; V from the Gram sums."""
    x = vectors(spark, sf_dir).select("id", "v")
    _, v, _ = la.svd_of(x)
    back = la.projected(x, v @ v.T)
    both = back.join(x, "id").select(F.col("id").alias("vec_id"), F.array_max(F.zip_with("y", "v", lambda a, b: F.abs(a - b))).alias("off"))
    return both.select("vec_id", r("off").alias("off"))


@query("SELECT 1.0::DOUBLE AS total, true AS symmetric")
def joint_p_sums_to_one(spark, sf_dir):
    p = _joint(spark, sf_dir)
    back = p.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("q"))
    return p.join(back, ["i", "j"], "left").agg(F.round(F.sum("p"), 6).alias("total"), F.every(F.coalesce(F.abs(F.col("p") - F.col("q")) < 1e-12, F.lit(False))).alias("symmetric"))


def _joint(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=False).select("id", "v")
    n = x.count()
    return ts.joint_edges(ts.conditional_edges(ts.neighbour_edges(x, min(n - 1, 16)), 5.0), n)


@query("SELECT vec_id, true AS ok FROM embeddings")
def perplexity_entropy(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=False).select("id", "v")
    p = ts.conditional_edges(ts.neighbour_edges(x, min(x.count() - 1, 16)), 5.0)
    h = p.groupBy(F.col("i").alias("vec_id")).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("h"))
    return h.select("vec_id", (F.abs(F.col("h") - float(np.log(5.0))) < 1e-4).alias("ok"))


# affinities with a fixed width, which SQL can follow: p(j|i) ~ exp(-d^2) over the ten nearest
_EDGES = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v), 6) AS d FROM v a JOIN v b ON a.id <> b.id),
nb AS (SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM d) WHERE rn <= 10),
cp AS (SELECT i, j, exp(-d * d) / sum(exp(-d * d)) OVER (PARTITION BY i) AS p FROM nb),
jp AS (SELECT i, j, sum(p) / (2.0 * (SELECT count(*) FROM v)) AS p FROM (SELECT i, j, p FROM cp UNION ALL SELECT j, i, p FROM cp) GROUP BY i, j)"""
_Y = "y AS (SELECT id, v[1] * 4 AS a, v[2] * 4 AS b FROM v)"
_W = "w AS (SELECT p.id AS i, q.id AS j, 1 / (1 + pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) AS w, p.a - q.a AS da, p.b - q.b AS db FROM y p JOIN y q ON p.id <> q.id)"


def fixed_edges(spark, sf_dir):
    x = vectors(spark, sf_dir, scaled=False).select("id", "v")
    near = ts.neighbour_edges(x, 10, digits=6)
    w = F.exp(-F.col("d"))
    cond = near.select("i", "j", (w / F.sum(w).over(Window.partitionBy("i"))).alias("p"))
    return ts.joint_edges(cond, x.count())


def plane(spark, sf_dir):
    return vectors(spark, sf_dir, scaled=False).select("id", F.transform(F.slice("v", 1, 2), lambda x: x * 4).alias("v"))


@query(f"WITH {_EDGES} SELECT i, j, round(p, 9) AS p FROM jp")
def tsne_edges_joint(spark, sf_dir):
    return fixed_edges(spark, sf_dir).select("i", "j", F.round("p", 9).alias("p"))


@query(f"""WITH {_EDGES}, {_Y}, {_W} SELECT round((SELECT sum(p * ln(p)) FROM jp) + (SELECT sum(p * ln(1 / w)) FROM jp JOIN w ON w.i = jp.i AND w.j = jp.j) + (SELECT ln(sum(w)) FROM w), 6) AS f""")
def tsne_exact_objective(spark, sf_dir):
    f, _ = ts.evaluate(fixed_edges(spark, sf_dir), plane(spark, sf_dir))
    return spark.createDataFrame([(f,)], "f double").select(F.round("f", 6).alias("f"))


@query(f"""WITH {_EDGES}, {_Y}, {_W}, z AS (SELECT sum(w) AS z FROM w),
g AS (SELECT w.i, sum((coalesce(jp.p, 0) - w / z) * w * da) AS ga, sum((coalesce(jp.p, 0) - w / z) * w * db) AS gb FROM w CROSS JOIN z LEFT JOIN jp ON jp.i = w.i AND jp.j = w.j GROUP BY w.i)
SELECT i AS vec_id, 0 AS c, round(4 * ga, 8) + 0.0 AS g FROM g UNION ALL SELECT i, 1, round(4 * gb, 8) + 0.0 FROM g""")
def tsne_exact_gradient(spark, sf_dir):
    _, g = ts.evaluate(fixed_edges(spark, sf_dir), plane(spark, sf_dir))
    return g.select(F.col("id").alias("vec_id"), "c", r("g", 8).alias("g"))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^(?:src1$|src2|rc3)')")
def lora_targets(spark, sf_dir):
    """Names are matched from their beginning."""
    return st.targets(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["src1$", "src2", "rc3"])


@query(f"""WITH {V_SQL}, {_PAIR.replace('a.id // 2 AS r', 'a.id // 2 % 3 AS task')}, m AS ({_OUTER.format(by='task,')})
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(x), 6) + 0.0 AS x FROM m WHERE task <= 1 GROUP BY i, j""")
def task_lora_active(spark, sf_dir):
    """Adapters of tasks 0 and 1 of three."""
    m = st.outer_sums(pairs(spark, sf_dir).withColumn("task", F.col("r") % 3), "task")
    return st.active_sum(m, 1).select("i", "j", r("x").alias("x"))


@query("""SELECT vec_id, list_transform(range(192), lambda k: round(CAST(embedding[k // 3 + 1] AS DOUBLE), 6) + 0.0) AS v FROM embeddings""")
def gray_channels(spark, sf_dir):
    """Every value three times in a row: gray to colour, channels last."""
    from loom.functions.scalars import repeat_channels

    return load(spark, sf_dir, "embeddings").select("vec_id", repeat_channels(F.transform("embedding", lambda x: r(x.cast("double")))).alias("v"))


@query("""WITH u AS (SELECT event_id, ('0x' || substr(md5('1:' || event_id), 1, 13))::BIGINT / 4503599627370496.0 AS a, ('0x' || substr(md5('2:' || event_id), 1, 13))::BIGINT / 4503599627370496.0 AS b FROM events)
SELECT event_id, [CASE WHEN a < 0.5 THEN 0 WHEN a < 0.75 THEN 1 ELSE 2 END, CASE WHEN b < 0.5 THEN 0 WHEN b < 0.75 THEN 1 ELSE 2 END] AS picks FROM u""")
def random_select(spark, sf_dir):
    """Two draws with replacement from three choices of weights 2, 1, 1."""
    from loom.plans.views import uniform

    e = F.col("event_id")
    return load(spark, sf_dir, "events").select("event_id", st.weighted_draws([uniform(1, e), uniform(2, e)], [2, 1, 1]).alias("picks"))
