import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.llm import exact_dedup, line_dedup, mixing, ngram_join, warc
from loom.llm.common import met, written
from loom.llm.words import Words

WHITE = " \t\n\x0b\x0c\r"
LONG = "a line that is long enough to count as one of the shared lines"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and white texts, a very long one, copies, repeated rows, ties, clashing names."""
    shared = "\n".join(["own %d", LONG, "  " + LONG.upper() + "\t", "tail"])
    words = lambda a, n: " ".join(f"w{a + i}" for i in range(n))
    rows = [(i, shared % i, "a", 1) for i in range(6)]
    rows += [(10, None, "a", 1), (11, "", None, 1), (12, " \t\n", "b", 1), (None, "no id " + words(0, 30), "b", 1), (13, None, None, None)]
    rows += [(20, words(0, 60), "b", 2), (21, words(0, 60), "b", 2), (22, words(0, 58) + " x y", "c", 2), (23, words(3, 60), "c", 2)]
    rows += [(30, "repeated row of some words here", "c", 3)] * 3
    rows += [(40, words(1000, 40000), "d", 4), (41, "one", "é", 4), (42, "one two three", "é", 4), (43, "one\n\ntwo  three", "é", 4)]
    rows += [(50 + i, words(5000, 80) if i % 2 else words(5000, 78) + f" end{i} z", "a", 5) for i in range(12)]
    schema = "doc_id long, text string, source string, size int"
    df = spark.createDataFrame(rows, schema)
    names = ["taken", "score", "n_lines", "kept", "links", "copies", "cls", "n", "rank", "target", "label", "hash", "pos", "predicted"]
    return written(df.withColumns({c: F.lit(7) for c in names}), "odd"), rows


def bare(t):
    return "".join(c for c in t or "" if c not in WHITE)


def test_exact_dedup(odd):
    df, rows = odd
    got = exact_dedup.exact_dedup(df).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(by) == len(groups)
    for t, g in groups.items():
        own = by[hashlib.sha256(t.encode()).hexdigest()]
        best = min(g)[3]
        assert sorted(map(str, (r.doc_id for r in own))) == sorted(str(x[3]) for x in g)
        assert {(r.keep_id, r.group_size) for r in own} == {(best, len(g))}
        assert sum(r.kept for r in own) == 1
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_takes_several_rounds_and_batches(spark):
    rows = [(i, f"t{i % 500}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20, "doc_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = exact_dedup.exact_dedup(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, i % 500, 12, i < 500) for i, _ in rows}


def lines_by_hand(rows, least_chars=40, least_docs=5):
    key = lambda x: x.strip(WHITE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    docs = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                docs[key(x)].add(i)
    hot = {k: max(i for i in d if i is not None) for k, d in docs.items() if len(d) >= least_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast", [0, 2, 1000])
def test_line_dedup(odd, broadcast):
    df, rows = odd
    out = line_dedup.line_dedup(df, broadcast_lines=broadcast)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert Counter(got) == Counter(lines_by_hand(rows))
    assert {x for _, _, x, _ in got} == {0, 1, 2}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    assert line_dedup.deduplicated(df).columns == df.columns


def test_keys_of_many_rows_meet_by_a_broadcast(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "i long, k long")
    groups = written(rows.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top")), "groups")
    for often in (0, 1, 2, 1000):
        got = met(rows, groups, F.col("k") == F.col("key"), "n", 300, often)
        assert sorted((r.i, r.top) for r in got.collect()) == [(i, 299 if i % 3 or not i else i) for i in range(300)]


def mix_by_hand(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * w[s]}
        if not full:
            break
        for s in full:
            target[s] = most * sizes[s]
        open_ -= full
    for s in open_:
        target[s] = level * w[s]
    out = []
    for s in order:
        own = [(hashlib.md5(":".join(["0", *([] if i is None else [str(i)]), t or ""]).encode()).hexdigest(), i, size(t)) for i, t, x, *_ in rows if x == s]
        at = 0
        for _, i, n in sorted(own, key=lambda x: x[0]):
            t = int(target[s])
            out.append((i, n, sizes[s], pytest.approx(target[s]), min(n, max(0, t - at)) + min(n, max(0, t - sizes[s] - at))))
            at += n
    return out


def test_mixing(odd, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    df, rows = odd
    got = [tuple(r) for r in mixing.mix(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(got, key=key) == sorted(mix_by_hand(rows), key=key)
    assert Counter(got) == Counter(tuple(r) for r in mixing.mix(df.repartition(7)).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    # the mixed documents themselves hold as many words as were taken
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    taken = Counter()
    for r in got:
        taken[r[0]] += r[4]
    assert +words == +taken


def jaccard_by_hand(rows, size=5, least=0.8):
    def shingles(t):
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t or "") if x]
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= least * len(a | b)] for i, a in enumerate(sets)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                k = todo.pop()
                if k not in group:
                    group.add(k)
                    todo += links[k]
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen |= dict.fromkeys(group, min(ids) if ids else None)
        copies = [rows[k][0] for k in range(len(rows)) if sets[k] == sets[i] and (sets[i] or k == i)]
        known = [c for c in copies if c is not None]
        out.append((rows[i][0], seen[i], min(known) if known else None, len(links[i]), len(copies)))
    return out


@pytest.mark.parametrize("tile,small,broadcast", [(512, 64, 1000), (3, 2, 0)])
def test_ngram_join(odd, monkeypatch, tile, small, broadcast):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "SMALL_NODE", small)
    monkeypatch.setattr(ngram_join, "LEAST_HOT", small)
    df, rows = odd
    got = [tuple(r) for r in ngram_join.near_duplicates(df, broadcast_classes=broadcast).collect()]
    assert Counter(got) == Counter(jaccard_by_hand(rows))
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_ngram_join_finds_pairs_at_the_threshold(spark):
    """Pairs just above the similarity are found with the recall asked for, pairs just below never."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(150):
        base = [f"v{rng.integers(1 << 30)}" for _ in range(104)]
        other = base[:]
        for at in range(0, 40 if k % 2 else 60, 20):  # each change alters five shingles of a hundred
            other[at + 10] = f"u{rng.integers(1 << 30)}"
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(other), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    links = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(df).collect()}
    near = [links[2 * k] for k in range(1, 150, 2)]  # 90 of 110 shingles
    far = [links[2 * k] for k in range(0, 150, 2)]  # 85 of 115
    assert sum(near) >= 0.98 * len(near) and sum(far) == 0


def test_crowded_nodes_miss_no_more(spark, monkeypatch):
    """Links don't depend on what counts as a crowded node, and one tree of prefixes of 4 finds what it must."""
    rng = np.random.default_rng(3)
    base, rows = [f"v{rng.integers(1 << 30)}" for _ in range(104)], []
    for k in range(140):  # any two have 90 of 110 shingles in common, or more
        own = base[:]
        own[5 + k % 95] = f"u{k}"
        rows.append((k, " ".join(own)))
    df, found = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), []
    s, off = Words([t for _, t in rows]).shingles(5)
    mins = np.ascontiguousarray(ngram_join.min_hashes(s, off, 5)[:, :4])  # paths are 5 long, prefixes shortened to 4
    together = Counter(map(bytes, mins))
    assert max(together.values()) > 64  # crowded
    for small in (1000, 64, 2):
        monkeypatch.setattr(ngram_join, "SMALL_NODE", small)
        found.append({r.doc_id: r.n_links for r in ngram_join.near_duplicates(df, trees=1, recall=0.3).collect()})
        assert found[-1] == {k: together[bytes(m)] - 1 for k, m in enumerate(mins)}


def test_depth_follows_recall():
    assert ngram_join.depth_for(0.8, 16, 0.995) == 5
    assert ngram_join.depth_for(0.8, 16, 0.9999) < 5 <= ngram_join.depth_for(0.9, 16, 0.995)


def test_prefixes_are_shortened_until_the_measured_recall():
    few, many = np.array([0, 1, 2, 3, 4, 5]), np.array([0, 1, 10, 40, 350, 9600])
    assert ngram_join.shortened(few, 5, 0.995) == (4, None)
    assert ngram_join.shortened(many, 5, 0.95) == (5, 9600 / 10001)
    assert [ngram_join.shortened(many, 5, r)[0] for r in (0.96, 0.99, 0.995, 0.999, 1.0)] == [4, 4, 3, 2, 1]
    assert ngram_join.shortened(many, 3, 0.5)[0] == 3 and ngram_join.shortened(np.array([300, 0]), 1, 0.9) == (1, 0.0)


def test_recall_is_measured_on_sampled_texts(spark):
    """Counts of links to the sample by their longest common prefix are those of a comparison of all pairs."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        base = [f"g{g}w{rng.integers(1 << 30)}" for _ in range(100)]
        for _ in range(30):
            own = base[:]
            for at in rng.integers(0, 100, rng.integers(0, 4)):
                own[at] = f"u{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(9000 + i, t) for i, t in enumerate(["", None, "one", "x " * 30_000])]
    df = spark.createDataFrame(rows, "ng_id long, ng_text string").withColumn("ng_mark", F.xxhash64("ng_text"))
    sample = ngram_join.sampled(df.select("ng_id", "ng_mark", "ng_text"), len(rows), 16, 5, 5)
    assert 40 <= len(sample.sets) <= 43 and sample.paths.shape == (len(sample.sets), 16, 5)
    got, want = np.zeros(6, np.int64), np.zeros(6, np.int64)
    sets = [np.unique(Words([t or ""]).shingles(5)[0]) for _, t in rows]
    for s in sets:
        if not len(s):
            continue
        m = ngram_join.min_hashes(s, np.array([0, len(s)]), 80).reshape(1, 16, 5)
        got += sample.longest(np.zeros(len(s), np.int64), s, np.array([0, len(s)]), m, 0.8)
        for j, other in enumerate(sample.sets):
            both = len(np.intersect1d(s, other))
            if not np.array_equal(s, other) and both >= 0.8 * (len(s) + len(other) - both):
                want[max(int(np.logical_and.accumulate(m[0, t] == sample.paths[j, t]).sum()) for t in range(16))] += 1
    assert (got == want).all() and want.sum() > 200


def test_components_on_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.cls: r.root for r in ngram_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é\r\nX: y", "same"), (5, "u", "same"), (3, None, "same"), (7, "u", ""), (8, "u", None), (9, "u", "é" * 700_001), (10, "u", "WARC/1.1\r\n\r\nWARC-Type: x"), (None, "u", "alone"), (11, "u", "z" * 3_000_000), (12, "u", "rep"), (12, "u", "rep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("payload", F.lit(2))
    got = warc.round_trip(df).collect()
    best = {}
    for i, _, t in rows:
        best[t or ""] = max((x for x, _, y in rows if (y or "") == (t or "") and x is not None), default=None)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        keep = best[t or ""]
        kind = "response" if i == keep else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else keep, len(raw) if kind == "response" else 0))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert {r.record_type for r in warc.round_trip(df, least=5).filter("page_id in (1, 3, 5, 12)").collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_chunk_table(spark, tmp_path):
    text = "".join(chr(33 + i % 90) for i in range(1000))
    df = spark.createDataFrame([(1, "u", text), (2, "u", "short")], "page_id long, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path), chunk=64)
    rows = sorted((r for r in warc.read_archives(manifest, chunk=100).collect() if r.page_id == 1), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in rows] == list(range(10)) and [r.last for r in rows] == [False] * 9 + [True]
    assert b"".join(bytes(r.chunk) for r in rows).decode() == text
    assert [r.crc32_so_far for r in rows] == [zlib.crc32(text[: 100 * (k + 1)].encode()) for k in range(10)]
    assert rows[-1].sha1 == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert sum(r["records"] for r in manifest.collect()) == 2


def test_queries_equal_their_sql(spark):
    import duckdb

    from loom.llm import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, d)
        got = Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())
        r = con.execute(sql)
        cols = [c[0] for c in r.description]
        assert got == Counter(tuple(dict(zip(cols, x))[c] for c in sorted(cols)) for x in r.fetchall()), name
