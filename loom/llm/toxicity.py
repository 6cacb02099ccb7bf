"""Toxicity by weak supervision.

Voters look at a document and say toxic or nothing: one voter for each term of a mined lexicon (words and word
beginnings that training rows labelled toxic hold far more often than others, and seed insults), and pattern
voters over shouting and exclamation. A generative label model sees only their votes, on labelled and unlabelled
training rows alike: expectation maximisation over the unknown class estimates how often each voter speaks in
either class, and the correlations of voters within the classes; voters that nearly always speak together share
their say. The annotators' labels choose which of the two classes is toxic, and are otherwise no part of it. A
linear classifier is trained on the model's posterior labels and scores every document.

What learning needs is gathered on the executors: term counts of a bounded sample of labelled training
rows, then one row of bits per sampled document. Scoring reads whole texts, a stream of Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, slices, text_of, texts_of, written
from loom.llm.labelled import MOST_PER_CLASS, held_out, logistic, sigmoid, training_rows, unlabelled_rows

FOLDS, FOLD, THRESHOLD = 4, 2, 0.3
TERMS, VOTERS, LEAST_DOCS = 1500, 200, 4
#: A term is a voter if the logarithm of how much oftener toxic rows hold it is over LIFT, SURE standard errors below its estimate.
LIFT, SURE = 1.5, 1.64
#: A short list of common insults, the seed lexicon.
SEEDS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool jerk imbecile dummkopf trottel abschaum widerlich estúpido imbécil basura asqueroso crétin connard ordure minable".split()
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
DENSE = 4


def terms_of(chunk: str) -> tuple[str, ...]:
    """Terms of a lower-case, white-space separated chunk: its words, and word beginnings as "abcd*"."""
    out = []
    for w in _WORD.findall(chunk):
        out.append(w)
        if len(w) > 4:
            out += [w[:4] + "*", w[:5] + "*"] if len(w) > 5 else [w[:4] + "*"]
    return tuple(out)


class Terms:
    """Terms of texts by way of a bounded cache of chunks; with a lexicon, the places of its terms."""

    def __init__(self, lexicon: dict[str, int] | None = None, most: int = 150_000):
        self.lexicon, self.most, self.known = lexicon, most, {}

    def __call__(self, text: str) -> set:
        known, out = self.known, set()
        for c in set(text.lower().split()):
            t = known.get(c)
            if t is None:
                t = terms_of(c)
                if self.lexicon is not None:
                    t = tuple({self.lexicon[x] for x in t if x in self.lexicon})
                if len(known) < self.most:
                    known[c] = t
            if t:
                out.update(t)
        return out


_ALL = bytes(range(256))
_NOT_CAPITALS, _NOT_MARKS = (_ALL.translate(None, kept) for kept in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"%&$#*@"))


def dense_of(text: str) -> list[float]:
    """Pattern inputs: shares of capitals A-Z, exclamation marks and symbols, and length on a log scale."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    return [len(raw.translate(None, _NOT_CAPITALS)) / n, raw.count(b"!") / n, len(raw.translate(None, _NOT_MARKS)) / n, float(np.log1p(len(raw)) / 12)]


def count_terms(most: int = 500_000):
    """Arrow function: (tr_text, tr_label) -> (term, toxic, clean), summed over a partition in pieces of bounded size."""

    def batch(t: Counter, c: Counter) -> pa.RecordBatch:
        names = list(t.keys() | c.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([t[x] for x in names], pa.int64()), pa.array([c[x] for x in names], pa.int64())], names=["term", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, by = Terms(), (Counter(), Counter())
        for b in slices(batches, 0):
            for text, label in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                by[label].update(terms(text.decode("utf-8", "replace")))
                if len(by[0]) + len(by[1]) > most:
                    yield batch(by[1], by[0])
                    by = (Counter(), Counter())
        if by[0] or by[1]:
            yield batch(by[1], by[0])

    return run


def bits_of(lexicon: dict[str, int]):
    """Arrow function: (tr_text, tr_label) -> (label, bits, dense): a bounded row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(lexicon)
        for b in slices(batches, 0):
            bits, dense = [], []
            for raw in texts_of(b.column(0)):
                text = raw.decode("utf-8", "replace")
                row = np.zeros(len(lexicon), np.uint8)
                row[list(terms(text))] = 1
                bits.append(np.packbits(row).tobytes())
                dense.append(dense_of(text))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(bits, pa.binary()), pa.array(dense, pa.list_(pa.float64()))], names=["label", "bits", "dense"])

    return run


class LabelModel:
    """Votes in {-1 clean, 0 silent, 1 toxic} -> posterior of toxic.

    `table`: for each class the probabilities of a voter's three votes; `prior` of toxic; `share`, by which a
    voter's log-likelihood ratio counts: 1 / (1 + its correlations with other voters within the classes, those
    above TOGETHER), so that ten voters that always speak together count about as one; `accuracy`: how often a
    voter that speaks is right. A voter's word is never evidence against what it says."""

    TOGETHER = 0.9

    def __init__(self, rounds: int = 40, every: int = 10):
        self.rounds, self.every = rounds, every

    def fit(self, votes: np.ndarray, start: np.ndarray, weight: np.ndarray) -> "LabelModel":
        """start: a first guess of the posterior, such as the majority's word."""
        said = [(votes == v).astype(np.float32) for v in (-1, 0, 1)]
        post = start
        for r in range(self.rounds):
            by_class = np.stack([weight * (1 - post), weight * post])
            size = by_class.sum(1)
            self.prior = float(np.clip(size[1] / size.sum(), 1e-3, 1 - 1e-3))
            self.table = np.stack([(by_class @ x + 0.5) / (size[:, None] + 1.5) for x in said], 1)
            if r % self.every == 0:
                self.correlation = sum(p.sum() / size.sum() * self._within(votes, p) for p in by_class if p.sum() >= 1)
                np.fill_diagonal(self.correlation, 0)
                self.share = 1 / (1 + np.where(self.correlation > self.TOGETHER, self.correlation, 0).sum(1))
            post = self._posterior(said)
        joint = self.table * np.array([1 - self.prior, self.prior])[:, None, None]
        right = joint[0, 0] + joint[1, 2]
        self.accuracy = right / (right + joint[0, 2] + joint[1, 0])
        return self

    @staticmethod
    def _within(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Correlations of the votes of rows that count p."""
        x = votes - p @ votes / p.sum()
        cov = (x * (p / p.sum())[:, None]).T @ x
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        return cov / np.outer(sd, sd)

    def _posterior(self, said: list[np.ndarray]) -> np.ndarray:
        clean, silent, toxic = np.log(self.table[1]) - np.log(self.table[0])
        ratios = (np.minimum(clean, 0), silent, np.maximum(toxic, 0))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + sum(x @ (r * self.share) for x, r in zip(said, ratios)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior([(votes == v).astype(np.float32) for v in (-1, 0, 1)])


def oriented(posterior: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """The posterior, or its complement where labelled rows (gold 0 or 1, others -1) say the classes are exchanged."""
    known = gold >= 0
    return posterior if posterior[known & (gold == 1)].mean() >= posterior[known & (gold == 0)].mean() else 1 - posterior


def learn(rows: DataFrame, counts: dict[int, int], unlabelled: DataFrame | None = None, n_terms=TERMS, n_voters=VOTERS) -> dict:
    """Lexicon, linear classifier and label model from the training samples."""
    rows = written(rows.select("tr_text", "tr_label"), "train")
    seen = {r["tr_label"]: r["n"] for r in rows.groupBy("tr_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    base = (n1 + 0.5) / (n1 + n0 + 1)
    nothing = {"lexicon": {}, "w": np.zeros(DENSE), "b": float(np.log(base / (1 - base))), "voters": []}
    if not n1 or not n0:  # nothing to tell apart: the classes' share is all that is known
        return nothing
    found = rows.mapInArrow(count_terms(), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    p1, p0 = (F.col("t") + 0.5) / (n1 + 1), (F.col("c") + 0.5) / (n0 + 1)
    strength = (F.col("t") / n1 - F.col("c") / n0) * F.log(p1 / p0)  # symmetric information about the class
    found = found.filter(F.col("t") + F.col("c") >= LEAST_DOCS).withColumn("s", strength).orderBy(F.desc("s"), "term").limit(n_terms)
    found = found.collect()  # n_terms rows
    if not found:
        return nothing
    lexicon = {r["term"]: i for i, r in enumerate(found)}
    t, c = (np.array([r[k] for r in found]) + 0.5 for k in "tc")
    lift = np.log(t / n1) - np.log(c / n0) - SURE * np.sqrt(1 / t + 1 / c)
    if unlabelled is not None:
        rows = rows.unionByName(unlabelled.select("tr_text", F.lit(-1).alias("tr_label")))
    got = rows.mapInArrow(bits_of(lexicon), "label int, bits binary, dense array<double>").collect()  # 4 * MOST_PER_CLASS bounded rows
    gold = np.array([r["label"] for r in got], np.int8)
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(lexicon)) for r in got]).astype(np.int8, copy=False)
    dense = np.array([r["dense"] for r in got], np.float32)
    each = {0: max(n0, counts[0]) / n0, 1: max(n1, counts[1]) / n1}  # how many rows of its class a sampled one stands for
    each[-1] = (each[0] * n0 + each[1] * n1) / (n0 + n1)
    weight = np.array([each[int(k)] for k in gold])
    return fitted(list(lexicon), lift, x, dense, gold, weight / weight.mean(), n_voters) | {"lexicon": lexicon}


def votes_of(terms: list[str], lift: np.ndarray, x: np.ndarray, dense: np.ndarray, n_voters=VOTERS) -> tuple[list[str], np.ndarray]:
    """(names of the voters, their votes): the first terms that are whose lift is over LIFT or that are in the seed lexicon, and patterns."""
    chosen = [i for i, t in enumerate(terms) if lift[i] > LIFT or t in SEEDS][: n_voters - 2]
    patterns = {"shouting": dense[:, 0] > 0.5, "exclamation": dense[:, 1] > 0.02}
    return [*(f"has {terms[i]}" for i in chosen), *patterns], np.column_stack([x[:, chosen], *patterns.values()]).astype(np.float32)


def fitted(terms: list[str], lift: np.ndarray, x: np.ndarray, dense: np.ndarray, gold: np.ndarray, weight: np.ndarray, n_voters=VOTERS) -> dict:
    """Label model and linear classifier from the bits of the samples; gold: 0, 1, or -1 where there is no label."""
    names, votes = votes_of(terms, lift, x, dense, n_voters)
    model = LabelModel().fit(votes, np.where((votes > 0).any(1), 0.9, 0.05), weight)
    w, b = logistic(x, dense, oriented(model.posterior(votes), gold), weight)
    return {"w": w, "b": b, "voters": list(zip(names, model.accuracy.tolist(), model.share.tolist()))}


def scores(model: dict):
    """texts (UTF-8) -> their scores, with a cache of chunks of its own."""
    terms, w, b, k = Terms(model["lexicon"]), model["w"], model["b"], len(model["lexicon"])

    def run(texts: list[bytes]) -> np.ndarray:
        z = np.empty(len(texts))
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            z[i] = b + w[list(terms(text))].sum() + w[k:] @ dense_of(text)
        return sigmoid(z)

    return run


def scorer(model: dict, text_at: int, back: int):
    """Arrow function: rows -> their first `back` columns and the score of the text in column `text_at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scores(model)
        for b in slices(batches, text_at):
            yield pa.RecordBatch.from_arrays([*b.columns[:back], pa.array(score(texts_of(b.column(text_at))))], names=[*b.schema.names[:back], "score"])

    return run


def trained(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds=FOLDS, fold=FOLD, most=MOST_PER_CLASS) -> dict:
    rows, counts = training_rows(docs, labels, label_col, folds, fold, id_col, text_col, most)
    return learn(rows, counts, unlabelled_rows(docs, labels, label_col, folds, fold, id_col, text_col, 2 * most))


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds=FOLDS, fold=FOLD, most=MOST_PER_CLASS, threshold=THRESHOLD) -> DataFrame:
    """The id with held_out (boolean), score (0 to 1) and predicted (int, score >= threshold).

    Learned from rows with crc32(id as text) mod `folds` other than `fold`, by hash of the id: at most `most`
    labelled ones of either class, and 2 * `most` without a label, whose votes alone are learned from; only the
    text is an input of the score.

    Defined cases: null and empty texts are scored like any, by the intercept; a null id counts as held
    out; without labels of both classes, or without a term in LEAST_DOCS texts, every score is the smoothed share
    of toxic labels; repeated rows get equal scores; an empty table gives an empty one; other columns play no part.
    """
    model = trained(docs, labels, id_col, text_col, label_col, folds, fold, most)
    given = docs.select(named(id_col).alias("tx_id"), text_of(text_col).alias("tx_text"))
    out = given.mapInArrow(scorer(model, 1, 1), f"tx_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("tx_id").alias(id_col), held_out(F.col("tx_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", folds=FOLDS, fold=FOLD, most=MOST_PER_CLASS, threshold=THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they were, whose score is below the threshold.

    Defined cases: as in `toxicity`; columns may have any names; each text travels to Python once.
    """
    model = trained(docs, labels, id_col, text_col, label_col, folds, fold, most)
    given = docs.toDF(*[f"tx_{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)
    if docs.schema[text_col].dataType.simpleString() != "string":
        given, at = given.withColumn("tx_text", F.col(f"tx_{at}").cast("string")), len(docs.columns)
    kinds = ", ".join(f"tx_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = given.mapInArrow(scorer(model, at, len(docs.columns)), f"{kinds}, score double")
    return out.filter(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents, table

    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
