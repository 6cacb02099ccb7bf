"""Columns of any name, rows that repeat ids, whole scores against slow re-computation, very long texts."""

import re
import subprocess
import sys
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from loom.llm import exact_dedup, line_dedup, lm, mixing, ngram_join, quality, toxicity
from loom.llm.common import documents, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ["a.b", "__ld_id", "stay_id", "ng_c0", "tx_text", "mx_size", "we`ird", "lm_id", "ng_id", "score", "xd_id"]


@pytest.fixture(scope="module")
def named_docs(spark):
    docs = documents(spark, SF)
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)]).cache()


def test_columns_of_any_name(spark, named_docs):
    labels, n = table(spark, SF, "labels"), named_docs.count()
    for df in (toxicity.accepted(named_docs, labels), line_dedup.deduplicated(named_docs), mixing.mixed_documents(named_docs), ngram_join.representatives(named_docs)):
        rows = df.collect()
        assert df.dtypes == named_docs.dtypes and rows
        assert all(tuple(r)[-len(NAMES) :] == tuple(range(len(NAMES))) for r in rows)
    assert line_dedup.line_dedup(named_docs).count() == exact_dedup.exact_dedup(named_docs).count() == lm.pseudo_likelihood(named_docs, epochs=1).count() == n


def test_stages_keep_columns_of_any_name(spark, named_docs):
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, named_docs, SF)
        assert out.columns == named_docs.columns and out.count()


def test_near_duplicates_go_by_row(spark):
    a, b, c = ("%s " * 20 % tuple(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (7, c), (8, a), (7, a), (9, None), (9, None), (9, " "), (None, ""), (1, a), (20, b + "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SF).collect())
    assert got[(1, a)] == 1 and got[(7, c)] == 1 and got[(9, None)] == 1 and got[(9, " ")] == 1 and got[(None, "")] == 1
    assert got[(20, b + "more")] + got[(None, b)] >= 1 and sum(got.values()) <= 7
    assert not {(None, a), (8, a), (7, a)} & got.keys()


def test_toxicity_scores_by_hand(spark):
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    model = toxicity.trained(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    place, k = model["lexicon"], len(model["lexicon"])
    assert k and len(got) == docs.count()
    for r in docs.collect():
        text = r.text or ""
        terms = set()
        for w in re.findall(r"[^\W_]+", text.lower()):
            terms |= {w, *[w[:n] + "*" for n in (4, 5) if len(w) > n]}
        raw = text.encode()
        share = lambda some: sum(b in some for b in raw) / max(1, len(raw))
        dense = [share(range(65, 91)), share(b"!"), share(b"%&$#*@"), np.log1p(len(raw)) / 12]
        z = model["b"] + sum(model["w"][place[t]] for t in terms if t in place) + sum(w * x for w, x in zip(model["w"][k:], dense))
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-z)), atol=1e-9)


def test_labels_choose_the_class_alone():
    """Exchanging the annotators' labels leaves the label model as it is and exchanges the classes."""
    r = np.random.default_rng(0)
    y = (r.random(600) < 0.2).astype(np.int8)
    x = (r.random((600, 8)) < np.where(y[:, None], 0.4, 0.01)).astype(np.int8)
    dense, gold = np.zeros((600, toxicity.DENSE), np.float32), np.where(np.arange(600) < 200, y, -1)
    terms, lift, weight = [f"t{i}" for i in range(8)], np.full(8, 3.0), np.ones(600)
    a = toxicity.fitted(terms, lift, x, dense, gold, weight)
    b = toxicity.fitted(terms, lift, x, dense, np.where(gold >= 0, 1 - gold, -1), weight)
    assert a["voters"] == b["voters"] and np.allclose(a["w"], -b["w"], atol=1e-6)


def passages_by_hand(text):
    """Every passage's inputs, one byte and one word at a time."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
    out = []
    for at in range(0, len(words), quality.PASSAGE):
        own = words[at : at + quality.PASSAGE]
        body, x = text[own[0][0] : own[-1][1]], np.zeros(quality.FEATURES)
        k = len(quality._CLASSES)
        for i, members in enumerate(quality._CLASSES):
            x[i] = sum(b in members for b in body) / len(body)
        lengths = np.array([b - a for a, b in own], float)
        x[k], x[k + 1] = lengths.mean() / 10, lengths.std() / 10
        tokens = [text[a:b] for a, b in own]
        n = len(tokens)
        x[k + 2] = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
        x[k + 3], x[k + 4] = len(set(tokens)) / n, np.log1p(n) / 5
        x[k + 5] = len({tuple(tokens[i : i + 3]) for i in range(n - 2)}) / (n - 2) if n > 2 else 1
        x[k + 6] = sum(quality._TABLE[t[-1]] in (2, 3) for t in tokens) / n
        for h in quality.Words([b" ".join(tokens)]).hashes():
            x[quality.WORDS.start + (int(h) >> 40) % quality.BINS] += 1 / n
        for a, b in zip(body, body[1:]):
            x[quality.LETTERS.start + quality._PAIRS[256 * a + b]] += 1 / len(body)
        out.append(x)
    return out or [np.zeros(quality.FEATURES)]


def test_quality_scores_by_hand(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda *a, learn=quality.learn: seen.append(learn(*a)) or seen[-1])
    docs = documents(spark, SF)
    got = {r.doc_id: r.score for r in quality.quality(docs, table(spark, SF, "labels")).collect()}
    net = seen[0]
    p = net.p
    for r in docs.limit(60).collect():
        weights, inner = [], []
        for x in passages_by_hand((r.text or "").encode()):
            x = np.clip((x - net.mean) / net.sd, -6, 6)
            h = np.tanh(x @ p["E"] + p["e"])
            weights.append(np.exp(sum(a * np.tanh(h @ v) / (1 + np.exp(-h @ u)) for a, v, u in zip(p["a"], p["V"].T, p["U"].T))))
            inner.append(h @ p["c"])
        z = np.dot(weights, inner) / sum(weights) + p["b"][0]
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-z)), atol=1e-4)


LONG = """
import resource, sys
import numpy as np
r = np.random.default_rng(0)
text = b" ".join(r.choice(np.array([b"word", b"another", b"third,", b"x"]), 8_000_000).tolist())
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
what = sys.argv[1]
if what == "passages":
    from loom.llm.quality import passages
    n = len(passages([text])[0])
elif what == "shingles":
    from loom.llm.words import shingles_of
    n = len(shingles_of([text])[0])
else:
    import public_tokenizers
    from loom.llm.tokens import tokenizer
    n = len(tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode([text])[0])
print(n, len(text) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) >> 10)
"""


@pytest.mark.parametrize("what,most", [("passages", 500), ("shingles", 900), ("tokens", 700)])
def test_memory_of_a_long_text(what, most):
    n, size, mb = map(int, subprocess.run([sys.executable, "-c", LONG, what], capture_output=True, text=True, check=True).stdout.split()[-3:])
    assert n > 100_000 and size >= 38 and mb < most, (size, mb)
