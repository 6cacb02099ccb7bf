import json
import os
import subprocess
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loom.llm import labelled, lm, quality, toxicity
from loom.llm.common import documents, table
from loom.llm.words import Words

SF = "/root/testdata/sf0.01"


def measured(spark, df, label):
    out = df.join(table(spark, SF, "labels").select("doc_id", label), "doc_id").filter("held_out").toPandas()
    return out[label].to_numpy(), out["score"].to_numpy(), out["predicted"].to_numpy()


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("module,label,folds,fold,least", [(toxicity, "toxic", 4, 2, 0.75), (quality, "quality", 5, 0, 0.95)])
def test_held_out_scores(spark, module, label, folds, fold, least):
    df = module.query(spark, SF).cache()
    rows = df.collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    y, s, p = measured(spark, df, label)
    assert auc(y, s) > least
    assert (p == y).mean() > 0.85


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, module):
    run, label = (module.toxicity, "toxic") if module is toxicity else (module.quality, "quality")
    schema = "doc_id long, text string, score int, tr_id int, label int, held_out string"
    rows = [(1, None, 1, 1, 1, "x"), (2, "", 1, 1, 1, "x"), (None, "no id", 1, 1, 1, "x"), (4, "word " * 60_000, 1, 1, 1, "x"), (5, "a b", 1, 1, 1, None), (5, "a b", 1, 1, 1, None)]
    rows += [(i, f"plain text number {i}", 0, 0, 0, "y") for i in range(10, 40)] + [(i, f"idiot text {i} !!", 0, 0, 0, "y") for i in range(40, 70)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(10, 70)] + [(None, 1), (11, None), (12, 0), (999, 1)], f"doc_id long, {label} int")
    got = run(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    one = {r.doc_id: r for r in got}
    assert one[1].score == one[2].score and one[None].held_out
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert run(docs.limit(0), labels).count() == 0
    for few in (labels.limit(0), labels.filter(f"{label} = 0")):  # no labels, one class
        assert all(0 <= r.score <= 1 for r in run(docs, few).collect())
    if module is toxicity:
        kept = toxicity.accepted(docs, labels)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.3}


def test_learning_uses_training_rows_only(spark):
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    rows, counts = labelled.training_rows(docs, labels, "toxic", 4, 2, most=30)
    got = rows.collect()
    assert all(zlib.crc32(str(r.tr_id).encode()) % 4 != 2 for r in got)
    assert sum(r.tr_label for r in got) == 30 and len(got) == 60 and counts[0] > 200
    # held-out labels change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    true = [0.95, 0.8, 0.7, 0.6]
    votes = [np.where(r.random(4000) < a, y, ~y) * 2 - 1 for a in true]
    votes = np.stack([*votes, votes[1], np.where(r.random(4000) < 0.97, y, ~y) * 2 - 1], 1).astype(np.float32)
    m = toxicity.LabelModel().fit(votes, np.where(votes[:, -1] > 0, 0.95, 0.05), np.ones(4000))
    assert np.allclose(m.accuracy[:4], true, atol=0.05)
    assert m.share[1] < 0.7 and m.share[0] > 0.7  # the voter that is there twice shares its say
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.97


def test_attention_gradient():
    r = np.random.default_rng(1)
    net = quality.Attention()
    x, off = r.standard_normal((9, quality.FEATURES)), np.array([0, 2, 3, 9])
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    loss = lambda: -(w * (y * np.log(f := net.forward(x, off)["out"]) + (1 - y) * np.log(1 - f))).sum() / w.sum()
    grad = net.gradient(net.forward(x, off), y, w)
    for k, p in net.p.items():
        for at in list(np.ndindex(p.shape))[::7]:
            keep, eps = p[at], 1e-6
            p[at] = keep + eps
            up = loss()
            p[at] = keep - eps
            down = loss()
            p[at] = keep
            assert np.isclose((up - down) / (2 * eps), grad[k][at], atol=1e-6), (k, at)


def test_passages_by_hand():
    words = [f"w{i}" for i in range(130)]
    x, off = quality.passages([" ".join(words), "", "AB!? | 12\n%%"])
    assert list(off) == [0, 3, 4, 5]
    k = len(quality._CLASSES)
    assert np.isclose(x[0, k + 3], 1) and np.isclose(x[2, k + 4], np.log1p(2) / 5) and not x[3].any()
    n = len("AB!? | 12\n%%")
    assert np.allclose(x[4, [0, 1, 2, 3, 4, 6]], [2 / n, 2 / n, 2 / n, 2 / n, 1 / n, 1 / n])


def test_words_and_shingles():
    texts = ["a bb  a\tbb a\x0bc é", "", "one two", "a bb a bb a c é", "x" * 300 + " y"]
    w = Words(texts)
    h = w.hashes()
    raw = [t.encode() for t in texts]
    want = [x for t in raw for x in t.split()]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == want
    assert len({bytes(x) for x in want}) == len(set(h.tolist())) and len(h) == len(want)
    s, off = w.shingles(5)
    assert list(np.diff(off)) == [3, 0, 1, 3, 1]
    assert list(s[off[0] : off[1]]) == list(s[off[3] : off[4]])
    assert list(Words(["one two"]).shingles(5)[0]) == list(s[off[2] : off[3]])


def test_pseudo_likelihood_equals_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("n_tokens"))
    extra = spark.createDataFrame([(900, None, 1, 2), (901, "", 1, 2), (None, "one", 1, 2), (902, "one", 1, 2), (902, "one", 1, 2)], docs.schema)
    docs = docs.unionByName(extra).coalesce(3).cache()
    hashes, flat = lm.train(docs)
    got = {r.doc_id: r for r in lm.pseudo_likelihood(docs).collect()}
    assert got[900].score == got[901].score == 0 and got[900].mean_score is None and got[900].n_tokens == 0
    assert got[902].score == got[None].score < 0
    net, words = lm.Window.of(flat), lm.Vocabulary(hashes)
    p = net.p
    for doc in (0, 7, 902):
        text = docs.filter(F.col("doc_id") == doc).first().text
        w = Words([text])
        ids = words(w)
        total = 0.0
        for t, y in enumerate(ids):
            h = p["e"].astype(float).copy()
            for k, o in enumerate(lm.OFFSETS):
                h += p["E"][k][ids[t + o] if 0 <= t + o < len(ids) else lm.EDGE]
            h = np.tanh(h)
            whole = []  # log p over the whole vocabulary, class by class
            top = h @ p["C"] + p["c"]
            top = top - np.log(np.exp(top).sum())
            for c in range(lm.CLASSES):
                z = h @ p["W"][c] + p["w"][c]
                whole.append(top[c] + z - np.log(np.exp(z).sum()))
            whole = np.concatenate(whole)
            assert np.isclose(np.exp(whole).sum(), 1)
            total += whole[y]
        assert got[doc].n_tokens == len(ids)
        assert np.isclose(got[doc].score, total, rtol=1e-3)
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_scores_dont_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_SHARD", 2000)
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    runs = [{r.doc_id: r.score for r in lm.pseudo_likelihood(docs.repartition(n, "text"), within=True).collect()} for n in (1, 7)]
    assert runs[0].keys() == runs[1].keys() and all(np.isclose(runs[0][i], runs[1][i], rtol=1e-6) for i in runs[0])


def test_training_raises_the_likelihood(spark):
    rows = [(i, " ".join(["red", "blue", "green"][(i + k) % 3] for k in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    start = lm.pseudo_likelihood(docs, epochs=0).agg(F.avg("mean_score")).first()[0]
    end = lm.pseudo_likelihood(docs, epochs=4).agg(F.avg("mean_score")).first()[0]
    assert end > start + 0.2


def test_window_gradient():
    net = lm.Window(seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, place = lm.padded(np.array([3, 70, 5, 3, 4000, 9], np.int32), np.array([0, 4, 6]))
    loss = lambda p: -lm.Window({k: v.astype(np.float64) for k, v in p.items()}).log_probabilities(ids, place).mean()
    before = {k: v.copy() for k, v in net.p.items()}
    memory = {k: np.ones(s) * 1e12 for k, s in lm.Window.SHAPES.items()}  # steps in proportion to the gradient
    net.step(ids, place, 1e6, memory)  # rate / sqrt(memory) = 1
    for k, at in (("e", (3,)), ("C", (2, 1)), ("c", (0,)), ("W", (1, 4, 6)), ("w", (62, 32)), ("E", (1, 3, 2)), ("E", (0, lm.EDGE, 5))):
        grad = before[k][at] - net.p[k][at]
        p, eps = {n: v.copy() for n, v in before.items()}, 1e-4
        p[k][at] += eps
        up = loss(p)
        p[k][at] -= 2 * eps
        assert np.isclose((up - loss(p)) / (2 * eps), grad, rtol=2e-2, atol=2e-6), (k, at)


def test_every_word_is_a_target_once(spark):
    for epochs in (1, 2, 3, lm.MASK):
        inside = np.arange(100)
        assert (sum(lm.masked(inside, e, epochs).astype(int) for e in range(epochs)) == 1).all()
    texts = documents(spark, "/root/testdata/sf0.001").select(F.coalesce("text", F.lit("")).alias("lm_text")).unionByName(spark.createDataFrame([("one",)], "lm_text string"))
    words = sum(len(r.lm_text.encode().split()) for r in texts.collect())
    sc, net = spark.sparkContext, lm.Window()
    vocabulary, flat = sc.broadcast(np.zeros(0, np.uint64)), sc.broadcast(net.flat())
    rows = lm.encoded(texts, "lm_text", "lm_text", vocabulary).select(F.lit(0).alias("shard"), "ids")
    seen = [rows.mapInArrow(lm.trained(flat, e, 2), lm.MODEL).agg(F.sum("weight")).first()[0] for e in range(2)]
    assert sum(seen) == words and min(seen) > 0.4 * words


def test_words_at_edges_are_learned(spark):
    docs = spark.createDataFrame([(i, "red" if i % 4 else "blue") for i in range(400)], "doc_id long, text string").coalesce(2)
    _, flat = lm.train(docs)
    before, after = lm.Window(), lm.Window.of(flat)
    assert all((after.p["E"][k][lm.EDGE] != before.p["E"][k][lm.EDGE]).any() for k in range(len(lm.OFFSETS)))


def test_words_in_buckets_have_their_shares(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, None), (None, "zyxwvut zyxwvut abczyxwvut"), (901, "zyxwvut")], docs.schema)).coalesce(2).cache()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    hashes, _ = lm.train(docs, epochs=0)
    keys = {i: lm.keys(Words([t])).tolist() for i, t in texts.items()}
    count, vocabulary = Counter(h for own in keys.values() for h in own), set(hashes.tolist())
    total = Counter()
    for h, n in count.items():
        total[h % lm.BUCKETS] += n * (h not in vocabulary)
    whole = {r.doc_id: r.score for r in lm.pseudo_likelihood(docs, epochs=0).collect()}
    want = {i: whole[i] + sum(np.log(count[h] / total[h % lm.BUCKETS]) for h in own if h not in vocabulary) for i, own in keys.items()}
    assert want[None] < whole[None] and len(count) > len(vocabulary) + 100
    for known in (0, 100, lm.KNOWN):  # all joined, some, none
        got = {r.doc_id: r for r in lm.pseudo_likelihood(docs, epochs=0, within=True, known=known).collect()}
        assert len(got) == len(want) and all(np.isclose(r.score, want[i], rtol=1e-6) for i, r in got.items())
        assert got[900].score == 0 and got[900].mean_score is None and np.isclose(got[901].mean_score, want[901])
    assert lm.pseudo_likelihood(docs.limit(0), within=True).count() == 0
    asked = {r.doc_id: r.score for r in lm.query(spark, "/root/testdata/sf0.001").collect()}
    full = {r.doc_id: r.score for r in lm.pseudo_likelihood(documents(spark, "/root/testdata/sf0.001"), within=True).collect()}
    assert all(np.isclose(asked[i], s) for i, s in full.items())


def test_bags_keep_all_passages():
    texts = [" ".join(f"w{i}" for i in range(64 * 100 + 1)), "", "a b"]
    got = pa.Table.from_batches(quality.bags_of([pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 0], pa.int32())], names=["tr_text", "tr_label"])]))
    bags = [np.frombuffer(x, np.float32).reshape(-1, quality.FEATURES) for x in got.column("bag").to_pylist()]
    assert [len(b) for b in bags] == [101, 1, 1] and got.column("label").to_pylist() == [1, 0, 0]
    assert np.allclose(np.concatenate(bags), quality.passages(texts)[0], atol=1e-6)


def test_pieces_add_up(monkeypatch):
    r = np.random.default_rng(2)
    bags = [r.standard_normal((n, quality.FEATURES)).astype(np.float32) for n in r.integers(1, 90, 40)]
    y, w = (np.arange(40) % 3 == 0).astype(float), r.random(40) + 0.5
    whole = quality.Attention().fit(bags, y, w, epochs=3)
    monkeypatch.setattr(quality, "PIECE", 64)
    cut = quality.Attention().fit(bags, y, w, epochs=3)
    assert np.allclose(whole.mean, np.concatenate(bags).mean(0), atol=1e-5) and np.allclose(whole.sd, np.concatenate(bags).std(0), atol=1e-5)
    assert all(np.allclose(whole.p[k], cut.p[k], atol=1e-6) for k in whole.p)


def test_natural_order_scores_above_shuffled_copies(spark):
    """Of 150 documents and their own copies in random word order, all trained on together, the natural ones score higher."""
    rng = np.random.default_rng(12)
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    natural = {r.doc_id: r.text for r in docs.filter("length(text) between 300 and 3000").orderBy("doc_id").limit(150).collect()}
    copies = [(i + 10**6, " ".join(rng.permutation(t.split()))) for i, t in natural.items()]
    both = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.pseudo_likelihood(both, within=True).collect()}
    assert sum(got[i] > got[i + 10**6] for i in natural) >= 0.9 * len(natural)


def plain_step(p, ids, place, rate, memory):
    """A step of the window network with both softmaxes normalised as they stand, words as columns."""

    def softmax(z):
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z

    def apply(name, x):
        memory[name] += x * x
        p[name] -= rate * x / (np.sqrt(memory[name]) + 1e-6)

    place, n = place[np.argsort(ids[place].astype(np.int16), kind="stable")], len(place)
    k, j, column = ids[place] // lm.SIZE, ids[place] % lm.SIZE, np.arange(n)
    ends = np.searchsorted(k, np.arange(lm.CLASSES + 1))
    some = np.flatnonzero(np.diff(ends))
    h = np.tile(p["e"], (n, 1))
    for o, off in enumerate(lm.OFFSETS):
        h += p["E"][o][ids[place + off]]
    h = np.ascontiguousarray(np.tanh(h).T)
    d = softmax(p["C"].T @ h + p["c"][:, None])
    d[k, column] -= 1
    grad = {"C": h @ d.T, "c": d.sum(1), "W": np.zeros_like(p["W"]), "w": np.zeros_like(p["w"])}
    dh = p["C"] @ d
    d = p["w"].T[:, k]
    for g in some:
        d[:, ends[g] : ends[g + 1]] += p["W"][g].T @ h[:, ends[g] : ends[g + 1]]
    d = softmax(d)
    d[j, column] -= 1
    grad["w"][some] = np.add.reduceat(d, ends[some], axis=1).T
    for g in some:
        own = slice(ends[g], ends[g + 1])
        grad["W"][g] = h[:, own] @ d[:, own].T
        dh[:, own] += p["W"][g] @ d[:, own]
    dh *= 1 - h * h
    grad["e"] = dh.sum(1)
    dh = np.ascontiguousarray(dh.T)
    for name, x in grad.items():
        apply(name, x / n)
    dh /= n
    for o, off in enumerate(lm.OFFSETS):
        c = ids[place + off].astype(np.int16)
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        seen, x = c[first], np.add.reduceat(dh[order], first)
        memory["E"][o][seen] += x * x
        p["E"][o][seen] -= rate * x / (np.sqrt(memory["E"][o][seen]) + 1e-6)


def timed_steps():
    """Two networks trained alike, by lm and plainly: (differences, CPU seconds of the quickest steps, by lm and plainly)."""
    r = np.random.default_rng(4)
    words = np.minimum(np.floor(np.exp(r.uniform(0, np.log(lm.VOCABULARY + 1), 200_000))).astype(np.int32), lm.VOCABULARY) - 1
    ids, place = lm.padded(words, np.arange(0, len(words) + 1, 400))
    place = r.permutation(place)
    nets = [lm.Window(seed=5), lm.Window(seed=5)]
    memories = [{k: np.full(s, 1e-8, np.float32) for k, s in lm.Window.SHAPES.items()} for _ in nets]
    best = [9e9, 9e9]
    for a in range(0, 20 * lm.BATCH, lm.BATCH):
        for i, step in enumerate((nets[0].step, lambda *x: plain_step(nets[1].p, *x))):
            start = time.process_time()
            step(ids, place[a : a + lm.BATCH], lm.RATE, memories[i])
            best[i] = min(best[i], time.process_time() - start)
    return [float(np.abs(nets[0].p[k] - nets[1].p[k]).max()) for k in lm.Window.SHAPES], *best


def test_a_step_is_the_plain_one_in_less_time():
    """On one thread, as in an executor."""
    code = "import json; from tests.llm.test_models import timed_steps; print(json.dumps(timed_steps()))"
    env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], env=env, capture_output=True, text=True, timeout=300, check=True)
    apart, took, plain = json.loads(got.stdout.splitlines()[-1])
    assert max(apart) < 2e-3 and took < 0.85 * plain, (apart, took, plain)


def test_scores_beyond_the_range_of_exponentials():
    """Where weights are so large that exponentials of scores overflow, steps and scores are those of double precision."""
    r = np.random.default_rng(6)
    net = lm.Window(seed=5)
    net.p["C"] *= 400
    net.p["w"][7] += 300
    ids, place = lm.padded(r.integers(0, lm.VOCABULARY, 6000).astype(np.int32), np.arange(0, 6001, 60))
    double = lm.Window({k: v.astype(np.float64) for k, v in net.p.items()})
    got, want = net.log_probabilities(ids, place), double.log_probabilities(ids, place)
    assert np.isfinite(got).all() and want.min() < -100 and np.allclose(got, want, rtol=1e-4, atol=1e-3)
    memory = [{k: np.full(s, 1e-8, t) for k, s in lm.Window.SHAPES.items()} for t in (np.float32, np.float64)]
    plain = {k: v.copy() for k, v in double.p.items()}
    net.step(ids, place, 0.01, memory[0])
    plain_step(plain, ids, place, 0.01, memory[1])
    assert all(np.isfinite(v).all() and np.mean(np.abs(v - plain[k]) > 1e-3) < 1e-3 for k, v in net.p.items())
