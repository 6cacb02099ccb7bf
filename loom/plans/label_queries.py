"""Labelled-sample catalogs and task splits over documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom.operators import labels as lb
from loom.operators import tasks as tk
from loom.operators.ordering import shuffled
from loom.plans.registry import query
from loom.plans.views import axes, load, r, uniform_sql

SEED = 3
MD5 = "md5('{}:' || CAST({} AS VARCHAR))"


def md5(seed, col):
    return MD5.format(seed, col)


def samples(spark, sf_dir):
    """(idx, lang, source)"""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang", "source")


@query("SELECT doc_id AS idx, lang AS class, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS target FROM documents")
def class_encode(spark, sf_dir):
    return lb.class_index(samples(spark, sf_dir).select("idx", F.col("lang").alias("class")), "class")


@query("SELECT doc_id AS idx, CAST(list_position(['fr', 'en'], lang) - 1 AS INTEGER) AS target FROM documents WHERE lang IN ('fr', 'en')")
def class_encode_listed(spark, sf_dir):
    return lb.class_index(samples(spark, sf_dir).select("idx", F.col("lang").alias("class")), "class", classes=["fr", "en"]).select("idx", "target")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def lang_class_counts(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_PATHS = r"paths AS (SELECT page_id AS idx, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS path FROM pages)"


def paths(spark, sf_dir):
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), lb.path_of(F.col("url")).alias("path"))


@query(f"WITH {_PATHS} SELECT idx, path, string_split(path, '/')[-2] AS class, 7 AS domain FROM paths WHERE lower(path) LIKE '%.html' OR lower(path) LIKE '%.pdf'")
def scan_extension(spark, sf_dir):
    return lb.scan(paths(spark, sf_dir), [".HTML", ".pdf"], domain=7).select("idx", "path", "class", "domain")


@query(f"WITH {_PATHS} SELECT idx, path, string_split(path, '/')[-2] AS class FROM paths WHERE path LIKE '%.html' AND path LIKE 'm.%'")
def scan_keep(spark, sf_dir):
    return lb.scan(paths(spark, sf_dir), [".html"], keep=F.startswith(F.col("path"), F.lit("m.")))


@query(f"""WITH {_PATHS}, leaf AS (SELECT idx, string_split(path, '/')[-1] AS name FROM paths), exact AS (SELECT * FROM leaf WHERE name = '25')
SELECT * FROM exact UNION ALL SELECT * FROM leaf WHERE name <> '25' AND contains(name, '25') AND NOT EXISTS (SELECT 1 FROM exact)""")
def path_find(spark, sf_dir):
    """Leaves of exactly this name, else those that contain it; a page is a leaf of its path."""
    from loom.operators import hierarchy as hi

    p = paths(spark, sf_dir)
    leaves = hi.found(p.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("kind"), "idx"), "25")
    return leaves.select("idx", "name")


@query("SELECT doc_id AS idx, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_listed(spark, sf_dir):
    return lb.listed(samples(spark, sf_dir), load(spark, sf_dir, "labels"), "idx", "doc_id")


@query("SELECT l.doc_id AS idx, d.lang, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def annotation_lookup(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality")
    return lb.looked_up(rows, samples(spark, sf_dir).select(F.col("idx").alias("doc"), "lang"), "idx", "doc").select("idx", "lang", "quality")


@query("SELECT vec_id, round(CAST(embedding[label + 1] AS DOUBLE), 6) + 0.0 AS x FROM embeddings")
def positional_lookup(spark, sf_dir):
    """An array of values gathered at an array of 0-based positions."""
    return load(spark, sf_dir, "embeddings").select("vec_id", r(F.element_at("embedding", F.col("label") + 1).cast("double")).alias("x"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY {md5(SEED, 'doc_id')}, doc_id) - 1 AS BIGINT) AS pos, doc_id AS idx, lang, source FROM documents")
def take_by_position(spark, sf_dir):
    """All axes reordered together by a list of positions, here a seeded permutation."""
    rows = samples(spark, sf_dir)
    return lb.taken(rows, shuffled(rows.select("idx"), "pos", SEED, "idx"), "idx").select("pos", "idx", "lang", "source")


@query("""SELECT doc_id AS id, 0 AS domain FROM documents UNION ALL SELECT page_id, 1 FROM pages UNION ALL SELECT vec_id, 2 FROM embeddings""")
def union_domain_tag(spark, sf_dir):
    parts = [("documents", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id")]
    return lb.union_domains([load(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in parts])


@query("""WITH a AS (SELECT doc_id AS id, dense_rank() OVER (ORDER BY lang) - 1 AS t FROM documents), b AS (SELECT vec_id AS id, label AS t FROM embeddings),
c AS (SELECT event_id AS id, dense_rank() OVER (ORDER BY event_type) - 1 AS t FROM events), na AS (SELECT max(t) + 1 AS n FROM a), nb AS (SELECT max(t) + 1 AS n FROM b)
SELECT id, CAST(t AS INTEGER) AS target, 0 AS part FROM a UNION ALL SELECT id, CAST(t + na.n AS INTEGER), 1 FROM b, na UNION ALL SELECT id, CAST(t + na.n + nb.n AS INTEGER), 2 FROM c, na, nb""")
def union_label_offset(spark, sf_dir):
    a = lb.class_index(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "lang").select("id", "target")
    b = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("target"))
    c = lb.class_index(load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type"), "event_type").select("id", "target")
    return lb.union_offsets([a, b, c])


@query(f"SELECT doc_id AS idx, row_number() OVER (ORDER BY {md5(SEED, 'doc_id')}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.8) AS train FROM documents")
def ratio_split(spark, sf_dir):
    return lb.ratio_split(samples(spark, sf_dir).select("idx"), "idx", 0.8, SEED)


@query("SELECT doc_id AS idx, (row_number() OVER (ORDER BY doc_id) - 1) % 5 = 4 AS holdout FROM documents")
def every_fifth_holdout(spark, sf_dir):
    return lb.every_nth(samples(spark, sf_dir).select("idx"), "idx")


_AXES = "axes AS (SELECT d.doc_id AS idx, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@query(f"WITH {_AXES} SELECT idx, quality FROM axes WHERE quality <> -1")
def unlabeled_filter(spark, sf_dir):
    return axes(spark, sf_dir).filter(F.col("quality") != lb.UNLABELED).select("idx", "quality")


@query("SELECT vec_id, ((label + 1) % 10 + 10) % 10 AS digit, label - 1 AS zero_based FROM embeddings")
def target_transform(spark, sf_dir):
    """Class 10 stands for 0; ids from 1 become ids from 0."""
    return load(spark, sf_dir, "embeddings").select("vec_id", F.pmod(F.col("label") + 1, F.lit(10)).alias("digit"), (F.col("label") - 1).alias("zero_based"))


@query("""WITH s AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE CAST(n_chars AS VARCHAR) END AS session FROM documents)
SELECT session, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(session, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(session AS BIGINT) NULLS FIRST, session) - 1 AS INTEGER) AS pos FROM s""")
def numeric_first_order(spark, sf_dir):
    s = load(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string")).alias("session"))
    return lb.numeric_first(s, "session")


# task splits: categories are sources, three tasks, half of the categories disjoint, 30 percent of the blurry samples move
T, N, M, BATCH, AGAIN, REPLICAS = 3, 50, 30, 16, 2, 4
_CATS = f"""cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS ci FROM (SELECT DISTINCT source AS category FROM documents)),
cn AS (SELECT count(*) AS c, (count(*) * {N} // 100) // {T} * {T} AS dj FROM cats),
bn AS (SELECT c, dj, (c - dj) // {T} * {T} AS bl FROM cn),
co AS (SELECT category, ci, row_number() OVER (ORDER BY {md5(SEED, 'ci')}, ci) - 1 AS pos FROM cats),
sp AS (SELECT category, CAST(ci AS INTEGER) AS "at", CASE WHEN pos < dj THEN 'disjoint' ELSE 'blurry' END AS kind,
              CAST(CASE WHEN pos < dj THEN pos // (dj // {T}) ELSE (pos - dj) // (bl // {T}) END AS INTEGER) AS task FROM co, bn WHERE pos < dj + bl)"""
_HOME = f"{_CATS}, home AS (SELECT doc_id AS idx, kind, task FROM documents JOIN sp ON sp.category = source)"
_DEALT = f"""{_HOME}, b AS (SELECT idx, task, row_number() OVER (PARTITION BY task ORDER BY idx) - 1 AS pos FROM home WHERE kind = 'blurry'),
g AS (SELECT task, count(*) * {M} // 100 AS give FROM b GROUP BY task),
ge AS (SELECT task, give, sum(give) OVER (ORDER BY task) AS upto FROM g),
pool AS (SELECT idx, row_number() OVER (ORDER BY {md5(SEED + 10, 'idx')}, idx) - 1 AS pa FROM b JOIN g ON g.task = b.task WHERE b.pos < g.give),
ex AS (SELECT idx, kind, task FROM home WHERE kind = 'disjoint' UNION ALL SELECT b.idx, 'blurry', b.task FROM b JOIN g ON g.task = b.task WHERE b.pos >= g.give
       UNION ALL SELECT pool.idx, 'blurry', ge.task FROM pool JOIN ge ON pa >= upto - give AND pa < upto)"""
_ORDER = f"{_DEALT}, ord AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY {md5(SEED + 20, 'idx')}, idx) - 1 AS pos, idx FROM ex)"


def _split(spark, sf_dir, varying=False):
    return tk.split_categories(tk.categories(samples(spark, sf_dir), "source"), T, N, SEED, varying)


def _home(spark, sf_dir):
    return tk.homes(samples(spark, sf_dir), "source", _split(spark, sf_dir))


def _order(spark, sf_dir):
    return tk.task_order(tk.exchanged(_home(spark, sf_dir), M, SEED + 10), SEED + 20)


@query(f"WITH {_AXES} SELECT quality AS category, CAST(row_number() OVER (ORDER BY quality) - 1 AS INTEGER) AS at FROM (SELECT DISTINCT quality FROM axes WHERE quality <> -1)")
def task_categories(spark, sf_dir):
    return tk.categories(axes(spark, sf_dir), "quality")


@query(f"""WITH {_AXES} SELECT q.quality, t.toxic, CAST(row_number() OVER (ORDER BY q.quality, t.toxic) - 1 AS INTEGER) AS at
FROM (SELECT DISTINCT quality FROM axes WHERE quality <> -1) q, (SELECT DISTINCT toxic FROM axes WHERE toxic <> -1) t""")
def category_product(spark, sf_dir):
    return tk.category_product(axes(spark, sf_dir), ["quality", "toxic"])


@query(f"WITH {_CATS} SELECT * FROM sp")
def disjoint_blurry_split(spark, sf_dir):
    return _split(spark, sf_dir)


def _cuts_sql(total: str, seed: int) -> str:
    return "list_sort([" + ", ".join(f"CAST(floor({uniform_sql(seed, str(k))} * {total}) AS BIGINT)" for k in range(1, T)) + "])"


@query(f"""WITH {_CATS}, cuts AS (SELECT dj, bl, {_cuts_sql('dj', SEED + 1)} AS dc, {_cuts_sql('bl', SEED + 2)} AS bc FROM bn)
SELECT category, CAST(ci AS INTEGER) AS "at", CASE WHEN pos < dj THEN 'disjoint' ELSE 'blurry' END AS kind,
  CAST(len(list_filter(CASE WHEN pos < dj THEN dc ELSE bc END, lambda c: c <= CASE WHEN pos < dj THEN pos ELSE pos - dj END)) AS INTEGER) AS task
FROM co, cuts WHERE pos < dj + bl""")
def varying_split(spark, sf_dir):
    """Tasks of unequal sizes, by cuts that the seed draws."""
    return _split(spark, sf_dir, varying=True)


@query(f"WITH {_HOME} SELECT * FROM home")
def task_assignment(spark, sf_dir):
    return _home(spark, sf_dir)


@query("SELECT doc_id AS idx, 'disjoint' AS kind, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS task FROM documents WHERE lang IN ('en', 'de', 'fr')")
def task_config_split(spark, sf_dir):
    """Tasks given as lists of categories; de is listed twice, so the last task has it; es is in none."""
    rows = samples(spark, sf_dir)
    return tk.homes(rows, "lang", tk.configured(tk.categories(rows, "lang"), [["de", "en"], ["fr", "de"]]))


@query(f"WITH {_DEALT.replace(f'count(*) * {M} // 100', 'least(count(*), [5, 400, 2][task + 1])')} SELECT idx, kind, task FROM ex")
def counted_exchange(spark, sf_dir):
    """So many samples of each task change hands, or all that it has."""
    return tk.exchanged(_home(spark, sf_dir), M, SEED + 10, counts=[5, 400, 2])


@query(f"WITH {_DEALT} SELECT idx, kind, task FROM ex")
def blurred_exchange(spark, sf_dir):
    return tk.exchanged(_home(spark, sf_dir), M, SEED + 10)


_CUT = "CAST(floor(('0x' || substr(md5('{s}:' || CAST(k AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 * {n}) AS BIGINT)"


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), cuts AS (SELECT 0 AS x UNION ALL SELECT {_CUT.format(s=SEED, n='n')} FROM n, range(1, 4) t(k) UNION ALL SELECT n FROM n),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS task FROM cuts)
SELECT CAST(a.task AS INTEGER) AS task, CAST(b.x - a.x AS BIGINT) AS size FROM o a JOIN o b ON b.task = a.task + 1""")
def varing_cuts(spark, sf_dir):
    """All samples cut into four consecutive parts at pseudo-random points."""
    sizes = tk.cut_sizes(samples(spark, sf_dir).count(), 4, SEED)
    return spark.createDataFrame(list(enumerate(sizes)), "task int, size long")


@query(f"WITH {_ORDER} SELECT task, CAST(pos AS BIGINT) AS pos, idx FROM ord")
def task_order(spark, sf_dir):
    return _order(spark, sf_dir)


@query(f"""WITH {_ORDER}, o AS (SELECT task, idx, pos // {BATCH} AS b, pos % {BATCH} AS pa, again FROM ord, range({AGAIN}) t(again))
SELECT task, CAST(row_number() OVER (PARTITION BY task ORDER BY b, again, pa) - 1 AS BIGINT) AS pos, idx FROM o""")
def online_batches(spark, sf_dir):
    return tk.online_batches(_order(spark, sf_dir), BATCH, AGAIN)


@query(f"""WITH {_ORDER}, n AS (SELECT task, count(*) // {REPLICAS} AS share FROM ord GROUP BY task)
SELECT ord.task, CAST(pos % {REPLICAS} AS INTEGER) AS rank, CAST(pos // {REPLICAS} AS BIGINT) AS pos, idx FROM ord JOIN n ON n.task = ord.task WHERE pos < share * {REPLICAS}""")
def replica_share(spark, sf_dir):
    return tk.replica_share(_order(spark, sf_dir), REPLICAS)


@query("SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS INTEGER) AS worker, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 4 AS BIGINT) AS turn, doc_id AS idx FROM documents")
def worker_stride(spark, sf_dir):
    from loom.operators.ordering import in_order

    rows = in_order(samples(spark, sf_dir).select("idx"), "pos", "idx")
    return rows.select((F.col("pos") % 4).cast("int").alias("worker"), F.floor(F.col("pos") / 4).alias("turn"), "idx")


@query(f"WITH {_ORDER} SELECT DISTINCT task, lang FROM ord JOIN documents ON doc_id = idx")
def task_classes(spark, sf_dir):
    return _order(spark, sf_dir).join(samples(spark, sf_dir).select("idx", "lang"), "idx").select("task", "lang").distinct()


@query(f"WITH {_CATS} SELECT doc_id AS idx, source FROM documents WHERE source IN (SELECT category FROM sp WHERE task < 2)")
def exposure_filter_scalar(spark, sf_dir):
    """Samples whose category the first two tasks have shown."""
    seen = _split(spark, sf_dir).filter("task < 2").select(F.col("category").alias("source"))
    return samples(spark, sf_dir).select("idx", "source").join(seen.distinct(), "source", "left_semi").select("idx", "source")


@query(f"""WITH {_AXES}, half AS (SELECT idx, quality, CASE WHEN idx % 3 = 0 THEN -1 ELSE toxic END AS toxic FROM axes), e AS (SELECT * FROM (VALUES (1, 0), (0, 1)) t(q, t))
SELECT idx, quality, toxic FROM half WHERE NOT (quality = -1 AND toxic = -1) AND EXISTS (SELECT 1 FROM e WHERE (quality = -1 OR quality = q) AND (toxic = -1 OR toxic = t))""")
def exposure_filter_wildcard(spark, sf_dir):
    rows = axes(spark, sf_dir).withColumn("toxic", F.when(F.col("idx") % 3 == 0, -1).otherwise(F.col("toxic")))
    seen = spark.createDataFrame([(1, 0), (0, 1)], "quality int, toxic int")
    return tk.exposed(rows, ["quality", "toxic"], seen)


@query("""WITH o AS (SELECT doc_id, lang, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b FROM documents)
SELECT CAST(b AS BIGINT) AS batch, list(doc_id ORDER BY doc_id) AS ids, list(lang ORDER BY doc_id) AS langs, list(n_chars ORDER BY doc_id) AS sizes FROM o GROUP BY b""")
def batch_collate(spark, sf_dir):
    """Samples of a batch zipped into one array for each field."""
    from loom.operators.ordering import in_order

    rows = in_order(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "pos", "doc_id")
    packed = rows.groupBy(F.floor(F.col("pos") / 64).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang", "n_chars"))).alias("s"))
    return packed.select("batch", F.col("s.doc_id").alias("ids"), F.col("s.lang").alias("langs"), F.col("s.n_chars").alias("sizes"))
