"""Decompositions and trees whose results SQL computes by its own way: elimination, successive projection, bisection, closure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loom.operators import hierarchy as hi
from loom.operators import kmeans as km
from loom.operators import linalg as la
from loom.operators import stats as st
from loom.operators import tsne as ts
from loom.operators.lowrank import singular_factors
from loom.operators.repulsion import repulsion
from loom.operators.vectors import collected, vector_products
from loom.plans.label_queries import _PATHS, paths
from loom.plans.registry import query
from loom.plans.stat_queries import _W, _Y, _flag_matrices, _ridge_sums, plane
from loom.plans.views import C_SQL, V_SQL, centroids, load, r, uniform, uniform_sql, vectors

#: G + I of the rows of each label, as rows of lists.
_SPD = f"""{V_SQL}, cell AS (SELECT label, i, j, sum(v[i] * v[j]) + CASE WHEN i = j THEN 1 ELSE 0 END AS x FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY label, i, j),
m AS (SELECT label, list(r ORDER BY i) AS m FROM (SELECT label, i, list(x ORDER BY j) AS r FROM cell GROUP BY label, i) GROUP BY label)"""
_CELLS = "SELECT CAST(label AS BIGINT) AS batch_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(m[i + 1][j + 1], {digits}) + 0.0 AS x FROM {of}, range({rows}) a(i), range({cols}) b(j)"
#: Elimination without pivots, which a positive definite matrix doesn't need, on (label, [A | B]).
_ELIMINATED = """e(label, k, m) AS (SELECT label, 1, {start} UNION ALL
  SELECT label, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k])
    ELSE list_transform(list_zip(row, m[k]), lambda z: z[1] - row[k] / m[k][k] * z[2]) END) FROM e WHERE k <= 64),
done AS (SELECT label, list_transform(m, lambda row: row[65:]) AS m FROM e WHERE k = 65)"""


@query(f"""WITH RECURSIVE {_SPD}, {_ELIMINATED.format(start="list_transform(m, lambda row, i: row || list_transform(range(1, 65), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END)) FROM m")}
{_CELLS.format(of="done", digits=6, rows=64, cols=64)}""")
def inverse_cells(spark, sf_dir):
    """The inverses themselves."""
    return la.batched_cells(_flag_matrices(spark, sf_dir), la.inverse).select("batch_id", "i", "j", r("x").alias("x"))


@query(f"""WITH RECURSIVE {_SPD}, c AS (SELECT label, list_transform(range(1, 65), lambda j: list_transform(m, lambda row: row[j] / sqrt(list_sum(list_transform(m, lambda z: z[j] * z[j]))))) AS c FROM m),
g(label, k, c, q) AS (SELECT label, 1, c, CAST([] AS DOUBLE[][]) FROM c UNION ALL
  SELECT label, k + 1, c, q || [list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))] FROM (
    SELECT label, k, c, q, list_reduce(q, lambda v, u: list_transform(list_zip(v, u), lambda z: z[1] - list_dot_product(u, v) * z[2]), c[k]) AS v FROM g WHERE k <= 64)),
done AS (SELECT label, list_transform(range(1, 65), lambda i: list_transform(q, lambda u: u[i])) AS m FROM g WHERE k = 65)
{_CELLS.format(of="done", digits=5, rows=64, cols=64)}""")
def gram_schmidt_cells(spark, sf_dir):
    """The orthonormal columns themselves."""
    return la.batched_cells(_flag_matrices(spark, sf_dir), la.orthogonalize).select("batch_id", "i", "j", r("x", 5).alias("x"))


@query(f"""WITH RECURSIVE {_SPD}, c AS (SELECT label, m, list_transform(range(1, 65), lambda j: list_transform(m, lambda row: row[j] / sqrt(list_sum(list_transform(m, lambda z: z[j] * z[j]))))) AS c FROM m),
g(label, k, m, c, q) AS (SELECT label, 1, m, c, CAST([] AS DOUBLE[][]) FROM c UNION ALL
  SELECT label, k + 1, m, c, q || [list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))] FROM (
    SELECT label, k, m, c, q, list_reduce(q, lambda v, u: list_transform(list_zip(v, u), lambda z: z[1] - list_dot_product(u, v) * z[2]), c[k]) AS v FROM g WHERE k <= 4)),
t AS (SELECT label, m, q, list_transform(q, lambda u: list_transform(range(1, 65), lambda j: list_sum(list_transform(range(1, 65), lambda i: u[i] * m[i][j])))) AS t FROM g WHERE k = 5),
o AS (SELECT label, q, list_transform(m, lambda row, i: list_transform(row, lambda x, j: x - list_sum(list_transform(list_zip(q, t), lambda z: z[1][i] * z[2][j])))) AS m FROM t),
done AS (SELECT label, list_transform(m, lambda row: list_transform(row, lambda x, j: x - list_sum(list_transform(q, lambda u: list_dot_product(u, row) * u[j])))) AS m FROM o)
{_CELLS.format(of="done", digits=4, rows=64, cols=64)}""")
def projected_out_cells(spark, sf_dir):
    """(I - BB') C (I - BB'), B being four orthonormal directions of C's columns."""
    work = lambda m: la.project_out(m, la.orthogonalize(m)[:, :4])
    return la.batched_cells(_flag_matrices(spark, sf_dir), work).select("batch_id", "i", "j", r("x", 4).alias("x"))


@query(f"""WITH {V_SQL} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(v[i] * v[j]), 4) + 0.0 AS x, CAST(i = j AS DOUBLE) AS product, true AS descending
FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j""")
def eigen_parts(spark, sf_dir):
    """V L V' against the Gram matrix that SQL sums, V'V against the identity, and L in descending order."""
    _, _, g = vector_products(vectors(spark, sf_dir).select("v"))
    values, v = la.eigen((g + g.T) / 2)
    back, one, down = (v * values) @ v.T, v.T @ v, bool((np.diff(values) <= 0).all())
    rows = [(i, j, float(back[i, j]), float(one[i, j]), down) for i in range(len(g)) for j in range(len(g))]
    return spark.createDataFrame(rows, "i int, j int, x double, product double, descending boolean").select("i", "j", r("x", 4).alias("x"), r("product").alias("product"), "descending")


@query(f"WITH {V_SQL} SELECT id AS vec_id, list_transform(v, lambda x: round(x, 6) + 0.0) AS v FROM v")
def svd_rebuilt(spark, sf_dir):
    """U S V', from the three factors."""
    back = singular_factors(vectors(spark, sf_dir).select("id", "v")).rebuilt()
    return back.select(F.col("id").alias("vec_id"), F.transform("v", lambda x: r(x)).alias("v"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT i, j, sum(v[i] * v[j]) AS g FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j)
SELECT round(sum(CASE WHEN i = j THEN g ELSE 0 END), 5) AS s2, round(sum(g * g), 4) AS s4 FROM s""")
def singular_moments(spark, sf_dir):
    """Sums of the second and fourth powers of the singular values: the trace of the Gram matrix and that of its square."""
    s = singular_factors(vectors(spark, sf_dir, scaled=False).select("id", "v")).s
    return spark.createDataFrame([(float((s**2).sum()), float((s**4).sum()))], "s2 double, s4 double").select(F.round("s2", 5).alias("s2"), F.round("s4", 4).alias("s4"))


@query(f"""WITH RECURSIVE {V_SQL}, h AS (SELECT list_transform(v, lambda x: greatest(x, 0.0)) AS v, label FROM v),
cell AS (SELECT 0 AS label, i, j, sum(v[i] * CASE WHEN j <= 64 THEN v[j] WHEN label = j - 65 THEN 1.0 ELSE 0.0 END) + CASE WHEN i = j THEN 2.0 ELSE 0 END AS x
  FROM h, range(1, 65) a(i), range(1, 75) b(j) GROUP BY i, j),
m AS (SELECT label, list(r ORDER BY i) AS m FROM (SELECT label, i, list(x ORDER BY j) AS r FROM cell GROUP BY label, i) GROUP BY label), {_ELIMINATED.format(start="m FROM m")}
SELECT i, j, x FROM ({_CELLS.format(of="done", digits=6, rows=64, cols=10)})""")
def ridge_weights(spark, sf_dir):
    """(G + 2 I)^-1 Q, the weights themselves."""
    sums = _ridge_sums(spark, sf_dir)
    g, q = (sums[False][k] + sums[True][k] for k in (0, 1))
    w = la.ridge(g, q, 2.0)
    rows = [(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, x double").select("i", "j", r("x").alias("x"))


@query("""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.id AS i, b.id AS j, pow(round(list_distance(a.v, b.v), 6), 2) AS d FROM v a JOIN v b ON a.id <> b.id),
nb AS (SELECT i, list(j ORDER BY d, j)[1:16] AS js, list(d ORDER BY d, j)[1:16] AS ds FROM d GROUP BY i),
near AS MATERIALIZED (SELECT i, js, list_transform(ds, lambda x: x - ds[1]) AS ds FROM nb),
b(i, k, low, high) AS (SELECT i, 0, -60.0::DOUBLE, 60.0::DOUBLE FROM near UNION ALL
  SELECT i, k + 1, CASE WHEN gap > 0 THEN t ELSE low END, CASE WHEN gap > 0 THEN high ELSE t END FROM (
    SELECT i, k, low, high, t, ln(s) + exp(t) * list_sum(list_transform(list_zip(w, ds), lambda z: z[1] / s * z[2])) - ln(5) AS gap FROM (
      SELECT b.i, k, low, high, t, ds, w, list_sum(w) AS s FROM (SELECT b.i, k, low, high, (low + high) / 2 AS t, ds, list_transform(ds, lambda x: exp(-exp((low + high) / 2) * x)) AS w FROM b JOIN near ON near.i = b.i WHERE k < 100) b))),
w AS (SELECT b.i, js, list_transform(ds, lambda x: exp(-exp((low + high) / 2) * x)) AS w FROM b JOIN near ON near.i = b.i WHERE k = 100)
SELECT i, js[n] AS j, round(w[n] / list_sum(w), 6) + 0.0 AS p FROM w, range(1, 17) t(n)""")
def perplexity_edges(spark, sf_dir):
    """Conditional probabilities whose entropy is log 5; SQL finds each row's width by bisection."""
    x = vectors(spark, sf_dir, scaled=False).select("id", "v")
    edges = ts.conditional_edges(ts.neighbour_edges(x, 16, digits=6), 5.0, tolerance=1e-13)
    return edges.select("i", "j", r("p").alias("p"))


@query(f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), {_Y}, {_W}
SELECT i, round(sum(w), 6) AS z, round(sum(w * w * da), 6) + 0.0 AS fa, round(sum(w * w * db), 6) + 0.0 AS fb FROM w GROUP BY i""")
def tsne_repulsion(spark, sf_dir):
    """Partition sums and repulsion of every point at angle 0, which is exact: all pairs, in tiles."""
    out = repulsion(plane(spark, sf_dir), 0.0, leaf=32)
    return out.select("i", F.round("z", 6).alias("z"), r(F.col("f")[0]).alias("fa"), r(F.col("f")[1]).alias("fb"))


_TREE = f"""{_PATHS}, p AS (SELECT string_split(path, '/') AS parts FROM paths WHERE path <> ''),
node AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS path, k AS depth FROM p, LATERAL (SELECT unnest(range(0, len(parts) + 1)) AS k) t),
pair AS (SELECT DISTINCT array_to_string(parts[1:a], '/') AS ancestor, array_to_string(parts[1:d], '/') AS descendant, d - a AS distance
  FROM p, LATERAL (SELECT unnest(range(0, len(parts) + 1)) AS d) t, LATERAL (SELECT unnest(range(0, d + 1)) AS a) u)"""


def _tree(spark, sf_dir):
    return hi.nodes(paths(spark, sf_dir))


@query(f"WITH {_TREE} SELECT ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM pair")
def path_closure(spark, sf_dir):
    """Every node of the URLs' hierarchy with all above it."""
    return hi.closure(_tree(spark, sf_dir))


@query(f"WITH {_TREE} SELECT ancestor AS path, CAST(count(*) AS BIGINT) AS children FROM pair WHERE distance = 1 GROUP BY ancestor")
def path_children(spark, sf_dir):
    return _tree(spark, sf_dir).filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"))


@query(f"WITH {_TREE} SELECT ancestor AS top, descendant AS path, CAST(distance AS BIGINT) AS distance, CAST(node.depth AS INTEGER) AS depth FROM pair JOIN node ON node.path = descendant WHERE contains(ancestor, 'casino') AND NOT contains(ancestor, '/')")
def path_subtrees(spark, sf_dir):
    """All below some hosts."""
    tree = _tree(spark, sf_dir)
    return hi.below(tree, hi.closure(tree), tree.filter("depth = 1 and path like '%casino%'"), "path").select("top", "path", "distance", "depth")


@query("SELECT event_id, event_id % 8 IN (0, 1, 5, 6) AS ok FROM events")
def json_strict(spark, sf_dir):
    """Objects spoilt in some of eight ways: a comment, a trailing comma, more behind, a leading zero, a bare fraction, escapes."""
    props, n = F.col("props"), F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    spoilt = [props, text(props, " // end"), text("[", props, ",]"), text(props, " x"), text('{"k": 0', n.cast("string"), "}"), text('{"k": -.5e', (n % 3).cast("string"), "}"), text('["\\u00e9\\/", ', props, "/* , */]"), text('["\\ud83d", ', props, "]")]
    out = F.element_at(F.array(*spoilt), (n % 8 + 1).cast("int"))
    from loom.sources.json_text import strict

    return load(spark, sf_dir, "events").select("event_id", strict(out).alias("ok"))


@query(f"""WITH {V_SQL}, {C_SQL} SELECT id AS i, CAST(cid AS BIGINT) AS j, round(list_distance(v, c), 6) + 0.0 AS dist FROM v, c""")
def kmeans_distance_matrix(spark, sf_dir):
    """Distances of all rows to a model's centroids."""
    v = vectors(spark, sf_dir)
    _, c = collected(centroids(v))
    model = km.KMeans(len(c), init=c)
    model.centroids = c
    return model.distance_matrix(v).select("i", "j", r("dist").alias("dist"))


@query(f"""WITH {V_SQL}, {C_SQL}, d AS (SELECT id, CAST(arg_min(cid, struct_pack(d := d, c := cid)) AS BIGINT) AS cid, min(d) AS dist FROM (SELECT id, cid, list_distance(v, c) AS d FROM v, c) GROUP BY id)
SELECT id AS vec_id, cid, round(dist, 6) + 0.0 AS dist, cid = 3 AS inside FROM d""")
def kmeans_accessors(spark, sf_dir):
    """Labels, distances and the mask of one cluster."""
    v = vectors(spark, sf_dir)
    _, c = collected(centroids(v))
    model = km.KMeans(len(c), init=c)
    model.centroids = c
    out = model.labels(v).join(model.distances(v), "id").join(model.mask(v, 3), "id")
    return out.select(F.col("id").alias("vec_id"), "cid", r("dist").alias("dist"), "inside")


@query(f"""WITH {V_SQL}, {C_SQL} SELECT id AS vec_id, list(round(greatest(list_dot_product(v, c), 0.0), 6) + 0.0 ORDER BY cid) AS v FROM v, c GROUP BY id""")
def relu_projected(spark, sf_dir):
    """max(v W, 0), the centroids being the columns of W."""
    v = vectors(spark, sf_dir)
    _, c = collected(centroids(v))
    return st.relu_projection(v, c.T).select(F.col("id").alias("vec_id"), F.transform("v", lambda x: r(x)).alias("v"))


@query("""SELECT vec_id, 4 AS height, 4 AS width, 4 AS channels, [round(CAST(embedding[(p % 4 * 4 + p // 16) * 4 + p // 4 % 4 + 1] AS DOUBLE), 6) + 0.0 FOR p IN range(64)] AS data FROM embeddings""")
def image_frames(spark, sf_dir):
    """Vectors as frames of 4 channels by 4 rows by 4 columns, channels last."""
    from loom.operators.images import as_frames

    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.lit(4)] * 3).alias("shape"), F.transform("embedding", lambda x: r(x.cast("double"))).alias("data"))
    return as_frames(rows, "CHW")


@query(f"""WITH e AS (SELECT event_id, 64 + event_id % 100 AS w, 48 + event_id % 77 AS h, {uniform_sql(3, 'event_id')} AS ux, {uniform_sql(4, 'event_id')} AS uy FROM events),
c AS (SELECT *, CAST(floor(w * 0.75) AS BIGINT) AS cw, CAST(floor(h * 0.75) AS BIGINT) AS ch FROM e)
SELECT event_id, cw AS crop_w, ch AS crop_h, CAST(floor(ux * (w - cw + 1)) AS BIGINT) AS crop_x, CAST(floor(uy * (h - ch + 1)) AS BIGINT) AS crop_y FROM c""")
def random_crop_boxes(spark, sf_dir):
    """A crop of three quarters at a place that the event's number draws."""
    from loom.functions.scalars import random_crop

    e = F.col("event_id")
    box = random_crop(64 + e % 100, 48 + e % 77, 0.75, uniform(3, e), uniform(4, e))
    return load(spark, sf_dir, "events").select("event_id", *[box[c].cast("long").alias(c) for c in ("crop_w", "crop_h", "crop_x", "crop_y")])
