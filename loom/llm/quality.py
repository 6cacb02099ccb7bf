"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by what stands in it alone: shares
of byte classes, how much its words and word triples repeat, and hashed counts of its words and pairs of
bytes; a small layer encodes it. Gated attention (a tanh and a
sigmoid gate, multiplied) weighs the passages of a bag against each other, and the weighted sum of the
encodings is scored. Encoder, gates and score are learned together, from document labels only, by gradient
descent in numpy over a bounded sample of labelled training rows, with all their passages: those lie in a
file of the driver's, and a few thousand at a time are in memory.

Scoring describes all passages of all texts by array operations over joined bytes; the attention's softmax is
summed per document, so a text of any length is one pass and a few numbers per passage.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, slices, text_of, texts_of, written
from loom.llm.labelled import MOST_PER_CLASS, held_out, sigmoid, training_rows
from loom.llm.words import Words, cuts, grouped, mix, raw_bytes

FOLDS, FOLD, THRESHOLD = 5, 0, 0.3
PASSAGE, HIDDEN, GATES = 64, 16, 8
#: Training takes about so many passages at a time (one longer bag alone) and adds up their gradients.
PIECE = 8192
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"%&$#*@^~=_+<>{}[]\\", b"!?", b"|", b".,;:", b"\n", bytes(range(128, 256)), b"\"'()-/"]
#: Words and neighbouring bytes are counted in so many bins each, by hash.
BINS = 64
FEATURES = len(_CLASSES) + 7 + 2 * BINS
WORDS, LETTERS = slice(FEATURES - 2 * BINS, FEATURES - BINS), slice(FEATURES - BINS, FEATURES)
#: Bytes of text that are described together.
TEXT = 1 << 20


def _table() -> np.ndarray:
    t = np.full(256, len(_CLASSES), np.uint8)
    for k, members in enumerate(_CLASSES):
        t[list(members)] = k
    return t


_TABLE = _table()
_PAIRS = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.uint8)


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many different values each group has."""
    if not len(group):
        return np.zeros(groups)
    key = mix(group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + value)
    order = np.argsort(key, kind="stable")
    key, own = key[order], group[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount(own[new], minlength=groups).astype(float)


def _described(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages of the texts of w, offsets per text)."""
    n = np.diff(w.first)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(1, -(-n // PASSAGE)))])
    total = int(offsets[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(w.start):
        return out, offsets
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(text)) - w.first[text]
    which = offsets[text] + inside // PASSAGE
    share = lambda at, kinds, each: np.bincount(at, minlength=total * kinds).reshape(total, kinds) / np.maximum(each, 1)[:, None]
    words = np.bincount(which, minlength=total)
    # bytes of each passage, its first word's first byte to its last word's last
    head = np.flatnonzero(inside % PASSAGE == 0)
    begin, stop = w.start[head], w.end[np.append(head[1:], len(text)) - 1]
    place = np.repeat(which[head], stop - begin)
    at = np.repeat(begin - (np.cumsum(stop - begin) - (stop - begin)), stop - begin) + np.arange(len(place))
    size = np.bincount(place, minlength=total)
    k = len(_CLASSES)
    own = w.data[at]
    out[:, :k] = share(place * (k + 1) + _TABLE[own], k + 1, size)[:, :k]
    pairs = place[1:] * BINS + _PAIRS[own[:-1].astype(np.uint16) * 256 + own[1:]]
    out[:, LETTERS] = share(pairs[place[1:] == place[:-1]], BINS, size)
    del place, at, own, pairs
    length = (w.end - w.start).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(which, length, total) / per
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(np.bincount(which, length**2, total) / per - mean**2, 0)) / 10
    h = w.hashes()
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (which[1:] == which[:-1])
    out[:, k + 2] = np.bincount(which, same, total) / per
    out[:, k + 3] = _distinct(which, h, total) / per
    out[:, k + 4] = np.log1p(words) / 5
    whole = np.flatnonzero(which[2:] == which[:-2])  # word triples inside a passage
    triple = mix(h[whole] + np.uint64(3) * mix(h[whole + 1]) + np.uint64(7) * mix(mix(h[whole + 2])))
    out[:, k + 5] = np.where(words > 2, _distinct(which[whole], triple, total) / np.maximum(words - 2, 1), words > 0)
    last = _TABLE[w.data[w.end - 1]]
    out[:, k + 6] = np.bincount(which, (last == 2) | (last == 3), total) / per
    out[:, WORDS] = share(which * BINS + (h >> np.uint64(40)).astype(np.int64) % BINS, BINS, words)
    return out, offsets


def passages(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, offsets per text). A text without words is one passage of zeros. Passages don't
    cross the cuts, at white space, of a text of over TEXT bytes, which is described a piece at a time."""
    found, counts = [], []
    raw = [raw_bytes(t) for t in texts]
    for a, z in grouped(raw, TEXT):
        if len(raw[a]) <= TEXT:
            x, offsets = _described(Words(raw[a:z]))
            found.append(x)
            counts += np.diff(offsets).tolist()
            continue
        some = [_described(Words([raw[a][b:c]]))[0] for b, c in cuts(raw[a], TEXT)]
        found += some
        counts.append(sum(map(len, some)))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


class Attention:
    """encode: tanh(x E + e); weight of a passage: softmax over its bag of (tanh(h V) * sigmoid(h U)) a; score: weighted sum of encodings, times c, plus b."""

    SHAPES = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "b": (1,)}

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {k: r.standard_normal(s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) for k, s in self.SHAPES.items()}
        self.p["a"] = r.standard_normal(GATES) * 0.1
        self.p["c"] = r.standard_normal(HIDDEN) * 0.1
        self.mean, self.sd = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.sd, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        top = np.maximum.reduceat(s, offsets[:-1])
        q = np.exp(s - top[bag])
        alpha = q / np.add.reduceat(q, offsets[:-1])[bag]
        z = np.add.reduceat(alpha[:, None] * h, offsets[:-1], axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "bag": bag, "out": sigmoid(z @ p["c"] + p["b"])}

    def gradient(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        p, bag = self.p, f["bag"]
        d = weight * (f["out"] - y) / weight.sum()
        out = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = d[:, None] * p["c"]
        along = (f["h"] * dz[bag]).sum(1)
        bag_mean = np.bincount(bag, f["alpha"] * along)
        ds = f["alpha"] * (along - bag_mean[bag])
        out["a"] = (f["t"] * f["g"]).T @ ds
        dt = ds[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = f["alpha"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        out["E"], out["e"] = f["x"].T @ de, de.sum(0)
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> "Attention":
        r = np.random.default_rng(seed)
        size = np.array([len(b) for b in bags])
        joined = lambda some: np.concatenate([bags[i] for i in some]).astype(float)
        every = pieces(np.arange(len(bags)), size)
        self.mean = sum(joined(some).sum(0) for some in every) / size.sum()
        self.sd = np.maximum(np.sqrt(sum(((joined(some) - self.mean) ** 2).sum(0) for some in every) / size.sum()), 1e-3)
        base = float((weight * y).sum() / weight.sum())
        self.p["b"][:] = np.log(max(base, 1e-3) / max(1 - base, 1e-3))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for a in range(0, len(order), batch):
                grad = {k: np.zeros_like(x) for k, x in self.p.items()}
                whole = weight[order[a : a + batch]].sum()
                for some in pieces(order[a : a + batch], size):
                    off = np.concatenate([[0], np.cumsum(size[some])])
                    for k, g in self.gradient(self.forward(joined(some), off), y[some], weight[some]).items():
                        grad[k] += g * (weight[some].sum() / whole)
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def pieces(some: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """`some`, cut into runs of at most PIECE passages together (one longer bag alone). size: passages of each bag."""
    out, a, held = [], 0, 0
    for i, n in enumerate(size[some]):
        if held and held + n > PIECE:
            out.append(some[a:i])
            a, held = i, 0
        held += n
    return [*out, some[a:]]


def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (tr_text, tr_label) -> (label, all passages)."""
    for b in slices(batches, 0):
        x, off = passages(texts_of(b.column(0)))
        out = [x[a:z].tobytes() for a, z in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(out, pa.binary())], names=["label", "bag"])


def learn(rows: DataFrame, counts: dict[int, int]) -> Attention:
    bags = written(rows.select("tr_text", "tr_label").mapInArrow(bags_of, "label int, bag binary"), "bags")
    model, labels, ends = Attention(), [], [0]
    with tempfile.TemporaryFile() as f:
        for r in bags.toLocalIterator():  # 2 * MOST_PER_CLASS rows, a partition at a time
            labels.append(r["label"])
            ends.append(ends[-1] + len(r["bag"]) // (4 * FEATURES))
            f.write(r["bag"])
        if not labels:
            return model
        f.flush()
        flat = np.asarray(np.memmap(f, np.float32, "r")).reshape(-1, FEATURES)
        y = np.array(labels, float)
        seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
        weight = np.where(y == 1, (counts[1] or seen[1]) / seen[1], (counts[0] or seen[0]) / seen[0])
        return model.fit([flat[a:z] for a, z in zip(ends, ends[1:])], y, weight)


def scorer(model: Attention):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = model.forward(*passages(texts_of(b.column(b.num_columns - 1))))["out"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", folds=FOLDS, fold=FOLD, most=MOST_PER_CLASS, threshold=THRESHOLD) -> DataFrame:
    """The id with held_out (boolean), score (0 to 1) and predicted (int, score >= threshold).

    Labels are learned from rows with crc32(id as text) mod `folds` other than `fold`, at most `most` of
    either class by hash of the id; only the text is an input of the score.

    Defined cases: null and empty texts are one passage of zeros and scored by it; a null id counts as held
    out; with one class of labels, or none, scores tell that class's share (or the untrained network's
    0.5); repeated rows get equal scores; an empty table gives an empty one; other columns play no part.
    """
    rows, counts = training_rows(docs, labels, label_col, folds, fold, id_col, text_col, most)
    model = learn(rows, counts)
    given = docs.select(named(id_col).alias("ql_id"), text_of(text_col).alias("ql_text"))
    out = given.mapInArrow(scorer(model), f"ql_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("ql_id").alias(id_col), held_out(F.col("ql_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents, table

    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
