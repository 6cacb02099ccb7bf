"""Scalar functions, media metadata, manifests and path hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loom.functions import scalars as sc
from loom.operators import manifest as mf
from loom.plans.registry import query
from loom.plans.label_queries import _PATHS, paths
from loom.plans.views import load, r


def events(spark, sf_dir):
    return load(spark, sf_dir, "events")


_SIZES = "z AS (SELECT doc_id, n_chars * n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1024 * 1024 ELSE 0 END) + doc_id % 3 * 1024 AS size FROM documents)"


def sizes(spark, sf_dir):
    k = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1024, 1024 * 1024, 0)]), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") * k + F.col("doc_id") % 3 * 1024).alias("size"))


@query(f"""WITH {_SIZES} SELECT doc_id, CASE WHEN size <= 1024 THEN printf('%.2f B', size / 1.0) WHEN size / 1024.0 <= 1024 THEN printf('%.2f KB', size / 1024.0)
WHEN size / 1048576.0 <= 1024 THEN printf('%.2f MB', size / 1048576.0) WHEN size / 1073741824.0 <= 1024 THEN printf('%.2f GB', size / 1073741824.0)
WHEN size / 1099511627776.0 <= 1024 THEN printf('%.2f TB', size / 1099511627776.0) ELSE printf('%.2f PB', size / 1125899906842624.0) END AS shown FROM z""")
def bytes_human_py(spark, sf_dir):
    return sizes(spark, sf_dir).select("doc_id", sc.bytes_human(F.col("size")).alias("shown"))


@query(f"""WITH {_SIZES} SELECT doc_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024.0)
WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576.0) WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824.0) ELSE printf('%.2f TB', size / 1099511627776.0) END AS shown FROM z""")
def bytes_human_cpp(spark, sf_dir):
    return sizes(spark, sf_dir).select("doc_id", sc.bytes_human_exact(F.col("size")).alias("shown"))


_SECONDS = "s AS (SELECT event_id, (event_id % 5 = 0)::INT * (event_id % 977) / 1000.0::DOUBLE + (event_id % 5 <> 0)::INT * (event_id * 37 % (CASE event_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 400000 END)) + 0.5::DOUBLE * (event_id % 2) AS t FROM events)"


def seconds(spark, sf_dir):
    e = F.col("event_id")
    wide = F.when(e % 3 == 0, 60).when(e % 3 == 1, 3600).otherwise(400000)
    t = (e % 5 == 0).cast("int") * (e % 977) / 1000.0 + (e % 5 != 0).cast("int") * (e * 37 % wide) + F.lit(0.5) * (e % 2)
    return events(spark, sf_dir).select("event_id", t.alias("t"))


@query(f"""WITH {_SECONDS}, q AS (SELECT event_id, t, CAST(floor(t) AS BIGINT) AS w, CAST(floor((t - floor(t)) * 1000) AS INTEGER) AS ms FROM s)
SELECT event_id, CASE WHEN w >= 3600 THEN printf('%02d:%02d:%02d.%03d', w // 3600, w % 3600 // 60, w % 60, ms)
 WHEN w >= 60 THEN printf('%02d:%02d.%03d', w // 60, w % 60, ms) WHEN w > 0 THEN printf('%02d.%03d', w, ms) ELSE printf('%3dms', ms) END AS shown FROM q""")
def seconds_human(spark, sf_dir):
    return seconds(spark, sf_dir).select("event_id", sc.seconds_human(F.col("t")).alias("shown"))


@query("SELECT event_id, CAST(length(CAST(event_id - 500 AS VARCHAR)) AS INTEGER) AS digits FROM events")
def count_digits(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", sc.count_digits(F.col("event_id") - 500).alias("digits"))


_VERSIONS = """x AS (SELECT event_id AS id, event_id % 3 AS a0, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id // 3 % 3 END AS a1, CASE WHEN event_id % 4 < 2 THEN NULL ELSE event_id // 9 % 3 END AS a2,
 event_id // 2 % 3 AS b0, event_id // 5 % 3 AS b1, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id // 7 % 3 END AS b2 FROM events)"""


@query(f"""WITH {_VERSIONS}, c AS (SELECT *, coalesce(a1 <> 0 AND b1 <> 0, false) AS m, coalesce(a2 <> 0 AND b2 <> 0, false) AS p FROM x)
SELECT id, a0 = b0 AND NOT (m AND a1 <> b1) AND NOT (p AND a2 <> b2) AS eq,
 CASE WHEN a0 <> b0 THEN a0 > b0 WHEN m AND a1 <> b1 THEN a1 > b1 ELSE p AND a2 > b2 END AS gt,
 CASE WHEN a0 <> b0 THEN a0 < b0 WHEN m AND a1 <> b1 THEN a1 < b1 ELSE p AND a2 < b2 END AS lt FROM c""".replace("p AND a2 > b2 END", "coalesce(p AND a2 > b2, false) END").replace("p AND a2 < b2 END", "coalesce(p AND a2 < b2, false) END").replace("NOT (m AND a1 <> b1)", "NOT coalesce(m AND a1 <> b1, false)").replace("NOT (p AND a2 <> b2)", "NOT coalesce(p AND a2 <> b2, false)"))
def version_compare(spark, sf_dir):
    e = F.col("event_id")
    part = lambda n: F.floor(e / n) % 3
    a = F.concat_ws(".", F.concat(F.when(e % 2 == 0, "v").otherwise(""), (e % 3).cast("string")), F.when(e % 4 != 0, part(3).cast("string")), F.when(e % 4 >= 2, part(9).cast("string")))
    b = F.concat_ws(".", part(2).cast("string"), part(5).cast("string"), F.when(e % 7 != 0, part(7).cast("string")))
    rows = events(spark, sf_dir).select(e.alias("id"), a.alias("a"), b.alias("b"))
    return rows.select("id", *[c.alias(k) for k, c in sc.version_compare(F.col("a"), F.col("b")).items()])


@query("SELECT event_id, round(CASE WHEN event_id < 50 THEN 0.1 * (event_id + 1) / 51 ELSE 0.1 END, 9) AS lr FROM events")
def lr_warmup_constant(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(sc.warmup_constant(F.col("event_id"), 0.1, 50), 9).alias("lr"))


@query("SELECT event_id, round(CASE WHEN event_id < 50 THEN 0.1 * (event_id + 1) / 51 ELSE 0.5 * (1 + cos(pi() * ((event_id - 50) % 150) / 150)) * 0.1 END, 9) + 0.0 AS lr FROM events")
def lr_warmup_cosine(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r(sc.warmup_cosine(F.col("event_id"), 0.1, 50, 200), 9).alias("lr"))


@query("""WITH n AS (SELECT count(*) AS n FROM events), p AS (SELECT event_id, event_id * 0.25 AS elapsed, (event_id + 1.0) / (n + 1.0) AS progress FROM events, n)
SELECT event_id, round(elapsed * (1 / progress - 1), 3) + 0.0 AS left_s,
 rpad(repeat('█', CAST(floor(progress * 20) AS INTEGER)) || CASE WHEN floor((progress * 20 - floor(progress * 20)) * 8) > 0 AND progress < 1
  THEN substr(' ▏▎▍▌▋▊▉█', CAST(floor((progress * 20 - floor(progress * 20)) * 8) AS INTEGER) + 1, 1) ELSE '' END, 20, ' ') AS bar FROM p""".replace("0.25 AS elapsed", "0.25::DOUBLE AS elapsed").replace("(event_id + 1.0) / (n + 1.0)", "(event_id + 1)::DOUBLE / (n + 1)::DOUBLE"))
def eta_progress(spark, sf_dir):
    rows = events(spark, sf_dir)
    n = rows.count()
    p = (F.col("event_id") + 1).cast("double") / float(n + 1)
    return rows.select("event_id", r(sc.remaining(F.col("event_id") * 0.25, p), 3).alias("left_s"), sc.progress_bar(p, 20).alias("bar"))


# one media row for each event: sizes, rates and durations made of its columns
_MEDIA = "m AS (SELECT event_id AS id, 100 + event_id % 701 AS w, 80 + event_id % 503 AS h, (event_id % 400 + 1) / 8.0::DOUBLE AS dur, 8.0::DOUBLE * (1 + event_id % 4) AS fps, 8000 * (1 + event_id % 6) AS sr, event_id % 333 AS frames FROM events)"


def media(spark, sf_dir):
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        e.alias("id"), (100 + e % 701).alias("w"), (80 + e % 503).alias("h"), ((e % 400 + 1) / 8.0).alias("dur"), (F.lit(8.0) * (1 + e % 4)).alias("fps"), (8000 * (1 + e % 6)).alias("sr"), (e % 333).alias("frames"),
    )


def _meta(rows, columns: dict, names=None):
    return rows.select("id", *[c.alias(k) for k, c in columns.items() if names is None or k in names])


@query(f"""WITH {_MEDIA}, c AS (SELECT *, CAST(floor(w * 0.75) AS BIGINT) AS cw, CAST(floor(h * 0.75) AS BIGINT) AS ch FROM m)
SELECT id, cw AS crop_w, ch AS crop_h, (w - cw) // 2 AS crop_x, (h - ch) // 2 AS crop_y, w AS width, h AS height FROM c""")
def crop_geometry(spark, sf_dir):
    return _meta(media(spark, sf_dir), sc.center_crop(F.col("w"), F.col("h"), 0.75))


@query(f"WITH {_MEDIA} SELECT id, dur - 0.25::DOUBLE AS duration, CAST(floor((dur - 0.25::DOUBLE) * fps) AS BIGINT) AS \"count\" FROM m WHERE dur > 0.25")
def trim_metadata(spark, sf_dir):
    return _meta(media(spark, sf_dir).filter("dur > 0.25"), sc.trimmed(F.col("dur"), F.col("fps"), 0.25))


@query(f"""WITH {_MEDIA}, s AS (SELECT *, greatest(frames // 16, 1) AS step FROM m WHERE frames > 0)
SELECT id, list_slice(range(0, frames, step), 1, 16) AS frames, least(16, frames) AS nb_frames, round(fps * (least(16, frames) / frames), 9) AS frame_rate FROM s""")
def frame_subsample(spark, sf_dir):
    rows = media(spark, sf_dir).filter("frames > 0")
    out = sc.subframes(F.col("frames"), F.col("fps"), 16)
    return rows.select("id", out["frames"].alias("frames"), out["nb_frames"].alias("nb_frames"), F.round(out["frame_rate"], 9).alias("frame_rate"))


@query(f"WITH {_MEDIA} SELECT id, 16000::BIGINT AS sample_rate, CAST(floor(dur * 16000) AS BIGINT) AS nb_samples, 224::BIGINT AS width, 160::BIGINT AS height FROM m")
def resample_resize(spark, sf_dir):
    """Two steps composed: audio resampled, frames resized."""
    done = sc.composed([lambda m: sc.resampled(m["duration"], 16000), lambda m: sc.resized(224, 160)], {"duration": F.col("dur"), "width": F.col("w"), "height": F.col("h")})
    return _meta(media(spark, sf_dir), done, ("sample_rate", "nb_samples", "width", "height"))


@query(f"WITH {_MEDIA}, p AS (SELECT id, dur, CAST(floor(sr * pow(2.0, (id % 5 - 2) / 12.0)) AS BIGINT) AS sample_rate FROM m) SELECT id, sample_rate, CAST(floor(dur * sample_rate) AS BIGINT) AS nb_samples FROM p")
def pitch_metadata(spark, sf_dir):
    return _meta(media(spark, sf_dir), sc.pitched(F.col("dur"), F.col("sr"), F.col("id") % 5 - 2))


@query(f"WITH {_MEDIA} SELECT id, 32::BIGINT AS nb_frames, 32 / fps AS duration FROM m")
def temporal_crop(spark, sf_dir):
    return _meta(media(spark, sf_dir), sc.temporal_crop(F.col("fps"), 32))


@query(f"""WITH {_MEDIA} SELECT id, CASE WHEN id % 2 = 0 THEN frames ELSE CAST(round_even(dur * fps, 0) AS BIGINT) END AS video,
 CASE WHEN id % 3 = 0 THEN frames ELSE CAST(floor(dur * sr) AS BIGINT) END AS audio, frames / fps < dur AS ok FROM m""")
def count_fallback(spark, sf_dir):
    """Frame and sample counts where a container stores none, and whether a slice from 0 to the frames' end is inside."""
    some = lambda k: F.when(F.col("id") % k == 0, F.col("frames"))
    v, a = sc.count_fallback(some(2), F.col("dur"), F.col("fps"), False), sc.count_fallback(some(3), F.col("dur"), F.col("sr"), True)
    return media(spark, sf_dir).select("id", v.alias("video"), a.alias("audio"), (sc.valid_slice(F.lit(-0.0), F.col("frames") / F.col("fps"), F.col("dur")) & (F.col("frames") / F.col("fps") < F.col("dur")) | (F.col("frames") == 0)).alias("ok"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def content_hash(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", *[sc.content_hash(F.col("text"), k).alias(k) for k in ("sha256", "sha1", "md5")])


_SIGNED = "SELECT lang || '/' || doc_id || '.txt' AS rel, sha256(text) AS hash FROM documents"


@query(f"""WITH old AS (SELECT lang || '/' || doc_id || '.txt' AS rel, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0),
now AS (SELECT * FROM ({_SIGNED}) WHERE NOT (rel LIKE 'es/%5.txt'))
SELECT coalesce(old.rel, now.rel) AS rel, CASE WHEN old.rel IS NULL THEN 'added' WHEN now.rel IS NULL THEN 'missing' ELSE 'changed' END AS change
FROM old FULL JOIN now ON old.rel = now.rel WHERE old.rel IS NULL OR now.rel IS NULL OR old.hash <> now.hash""")
def manifest_diff(spark, sf_dir):
    """Files added, missing and changed between two signatures of the documents."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("rel"), "text")
    old = mf.signature(d.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "rel", "text")
    now = mf.signature(d, "rel", "text").filter(~F.col("rel").like("es/%5.txt"))
    return mf.changes(old, now)


@query(f"""WITH {_PATHS}, p AS (SELECT path, strlen(html) AS size, string_split(path, '/') AS parts FROM paths JOIN pages ON page_id = idx),
a AS (SELECT array_to_string(list_slice(parts, 1, k), '/') AS dir, size FROM p, range(0, 4) t(k) WHERE k < len(parts))
SELECT dir, CAST(sum(size) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS files FROM a GROUP BY dir""")
def path_rollup(spark, sf_dir):
    """Recursive size of every directory, to depth 3."""
    p = paths(spark, sf_dir).join(load(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.octet_length("html").alias("size")), "idx")
    return mf.directory_sizes(p, "path", "size", 3)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    from loom.sources.json_text import parsed

    return events(spark, sf_dir).select("event_id", parsed(F.concat(F.lit("/* props */ "), "props", F.lit(" // end")), "k long")["k"].alias("k"))


_REGISTRY = mf.DATASETS


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n.lower()}', {c})" for n, c in _REGISTRY) + ") t(name, n_classes)")
def dataset_registry(spark, sf_dir):
    """Names are looked up without regard to case."""
    asked = spark.createDataFrame([(n.upper(),) for n, _ in _REGISTRY], "asked string")
    return mf.find_datasets(asked, "asked").select("name", "n_classes")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'mnist' WHEN doc_id % 3 = 1 THEN 'cub200' END AS name,
CASE WHEN doc_id % 3 = 0 THEN [round((n_chars / 255.0 - 0.1307) / 0.3081, 6)]
WHEN doc_id % 3 = 1 THEN [round((n_chars / 255.0 - 0.485) / 0.229, 6), round((n_chars / 255.0 - 0.456) / 0.224, 6), round((n_chars / 255.0 - 0.406) / 0.225, 6)] END AS z FROM documents WHERE doc_id % 3 < 2""")
def dataset_scaling(spark, sf_dir):
    """A value scaled by the channel means and deviations of the dataset named; unknown names find none."""
    k = F.col("doc_id") % 3
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.when(k == 0, "MNIST").when(k == 1, "Cub200").otherwise("nothing").alias("asked"))
    z = F.zip_with("mean", "std", lambda m, s: F.round((F.col("n_chars") / 255.0 - m) / s, 6))
    return mf.find_datasets(docs, "asked").select("doc_id", "name", z.alias("z"))


@query("""SELECT doc_id, md5(substr(q, 2, length(q) - 2)) AS h FROM (SELECT doc_id, CAST(to_json(text || chr(9) || chr(34) || chr(92) || chr(1)) AS VARCHAR) AS q FROM documents)""")
def json_escape(spark, sf_dir):
    from loom.sources.json_text import escaped

    return load(spark, sf_dir, "documents").select("doc_id", F.md5(escaped(F.concat("text", F.lit('\t"\\\x01')))).alias("h"))


@query("""SELECT doc_id, CAST(to_json(struct_pack(lang := lang, n_chars := n_chars, source := nullif(source, 'src1'))) AS VARCHAR) AS line FROM documents""")
def json_dump(spark, sf_dir):
    """Keys in order; a null is kept."""
    from loom.sources.json_text import dumped

    docs = load(spark, sf_dir, "documents").withColumn("source", F.when(F.col("source") != "src1", F.col("source")))
    return docs.select("doc_id", dumped("source", "n_chars", "lang").alias("line"))
