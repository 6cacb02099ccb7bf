"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network reads the WINDOW words on both sides of a masked position and predicts the
word there: position-specific embeddings are summed and squashed, and a two-level softmax gives first the
word's class and then its place in the class. A document's score is the sum of these conditional
log-probabilities over all its words.

Everything is gathered from all documents. Word counts are summed over the whole corpus; the CLASSES * SIZE
words of highest count, less the buckets, are the vocabulary, and other words fall into buckets by their
last bytes and length. Documents are written once as word numbers, and dealt into shards by a hash of id and
text, in the order of that hash; how many shards depends on the number of words alone, so parameters and scores
don't depend on how the input is partitioned. A word's place in its document is its phase of MASK; the phases
are dealt out to the epochs, so that every word of every document is masked in one of them. In each epoch, each
shard trains from the shared parameters, and the shards' parameters are averaged by their numbers of masked
words, in rounds of FAN. Only parameters, whose size is fixed, come to the driver and go out again.

A word in a bucket has the bucket's probability times its share of the bucket's count. The shares of up to
KNOWN words of highest count are sent to all executors; the others, which are rare and so never crowd a key,
are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loom.llm.common import named, slices, text_of, texts_of, written
from loom.llm.words import LONG, Words, cuts, grouped, mix

WINDOW, DIMS, CLASSES, SIZE, BUCKETS = 2, 16, 64, 64, 512
MASK, EPOCHS, BATCH, RATE, FAN = 16, 2, 8192, 0.25, 64
#: Words that are shuffled together; words of a shard, for parallel work on little data and at most.
GROUP, LEAST_SHARD, MOST_SHARD, SPREAD = 1 << 18, 1 << 20, 1 << 24, 64
VOCABULARY = CLASSES * SIZE
KNOWN = 1 << 20
#: Words of which each distinct one is looked up once, in the order of hashes.
DISTINCT = 1 << 20
#: Words whose scores are worked out together; scores within this bound need no shift before they are exponentiated.
PIECE, SAFE = 4096, 60.0
#: Stands before the first and after the last word of a text.
EDGE = VOCABULARY


def keys(w: Words) -> np.ndarray:
    """Hashes of words; the lowest bits are the bucket, by the last two bytes and the length."""
    last = w.data[np.maximum(w.end - 1, 0)].astype(np.uint64)
    prior = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    shape = mix(last * np.uint64(4096) + prior * np.uint64(16) + np.minimum((w.end - w.start) // 3, 15).astype(np.uint64))
    low = np.uint64(BUCKETS - 1)  # BUCKETS is a power of two
    return (w.hashes() & ~low) | (shape & low)


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words, where each text's begin and end); a long text is split a piece at a time."""
    found, counts = [np.zeros(0, np.uint64)], [0]
    for t0, t1 in grouped(texts, LONG):
        pieces = [texts[t0:t1]] if len(texts[t0]) <= LONG else [[texts[t0][a:z]] for a, z in cuts(texts[t0], LONG)]
        some = [Words(x) for x in pieces]
        found += [keys(w) for w in some]
        counts += np.diff(some[0].first).tolist() if len(some) == 1 else [sum(len(w.start) for w in some)]
    return np.concatenate(found), np.cumsum(counts)


def count_words(most: int = 1 << 21):
    """Arrow function: (text) -> (hash, count) by `keys`, summed in pieces of bounded size."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], np.add.reduceat(c, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        out = lambda h, c: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["hash", "n"])
        for b in slices(batches):
            h, c = np.unique(keys_of(texts_of(b.column(0)))[0], return_counts=True)
            if len(h):
                held.append((h, c))
                size += len(h)
            if size > most:
                held = [merged(held)]
                size = len(held[0][0])
                if size > most // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*merged(held))

    return run


class Vocabulary:
    """Ids of words by their hashes: the frequent ones in order of count, then buckets for the rest."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.buckets = VOCABULARY - BUCKETS

    def __call__(self, w: Words) -> np.ndarray:
        return self.of(keys(w))

    def of(self, h: np.ndarray) -> np.ndarray:
        """Ids by `keys`."""
        ids = (self.buckets + (h & np.uint64(BUCKETS - 1)).astype(np.int64)).astype(np.int32)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.ids[at], ids)
        return ids


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with WINDOW edges between texts, and the place of each word in them."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ids)) + WINDOW * (text + 1)
    out = np.full(len(ids) + WINDOW * (len(n) + 1), EDGE, np.int32)
    out[place] = ids
    return out, place


OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]


class Window:
    """Parameters and passes of the network; all arrays are float32."""

    SHAPES = {"E": (len(OFFSETS), VOCABULARY + 1, DIMS), "e": (DIMS,), "C": (DIMS, CLASSES), "c": (CLASSES,), "W": (CLASSES, DIMS, SIZE), "w": (CLASSES, SIZE)}

    def __init__(self, p: dict | None = None, seed: int = 3):
        if p is None:
            r = np.random.default_rng(seed)
            scale = {"E": 0.3, "C": 0.1, "W": 0.1}
            p = {k: (r.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p = p

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        """A row for each word of which `near` has the neighbours' ids, offset by offset, and a 1 that the biases go with."""
        h = np.ones((len(near[0]), DIMS + 1), self.p["e"].dtype)
        sums = self.p["E"][0].take(near[0], 0)
        for k in range(1, len(OFFSETS)):
            sums += self.p["E"][k].take(near[k], 0)
        sums += self.p["e"]
        np.tanh(sums, out=h[:, :DIMS])
        return h

    def joined(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights with their biases as a last row, of classes and of words, and whether no score can leave the numbers'
        range: what is hidden lies between -1 and 1, so the sums of the weights bound the scores."""
        p = self.p
        c, w = np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["W"], p["w"][:, None]], 1)
        return c, w, bool(max(np.abs(c).sum(0).max(), np.abs(w).sum(1).max()) < SAFE)

    @staticmethod
    def pieces(y: np.ndarray) -> Iterator[tuple[slice, list[tuple[int, int, int]]]]:
        """Sorted words in pieces of PIECE: (where the piece is, (class, begin, end) of the runs of one class in it)."""
        for at in range(0, len(y), PIECE):
            own = slice(at, min(at + PIECE, len(y)))
            ends = np.searchsorted(y[own], np.arange(CLASSES + 1) * SIZE).tolist()
            yield own, [(g, a, z) for g, (a, z) in enumerate(zip(ends, ends[1:])) if a < z]

    def log_probabilities(self, ids: np.ndarray, place: np.ndarray, step: int = 4096) -> np.ndarray:
        """log p(word | both sides) of the words at `place`."""
        out = np.empty(len(place))
        to_class, to_word, safe = self.joined()
        room = np.empty((PIECE, SIZE), to_word.dtype)
        for a in range(0, len(place), step):
            some = place[a : a + step]
            y = ids[some]
            # words in the order of their classes
            order = np.argsort(y.astype(np.int16), kind="stable")
            some, y = some[order], y[order]
            k, j = y // SIZE, y % SIZE
            for own, runs in self.pieces(y):
                h = self.hidden([ids[some[own] + o] for o in OFFSETS])
                z = room[: len(h)]
                score = self.chosen(np.matmul(h, to_class, out=z), k[own], safe)
                for g, b, e in runs:
                    np.matmul(h[b:e], to_word[g], out=z[b:e])
                out[a + order[own]] = score + self.chosen(z, j[own], safe)
        return out

    @staticmethod
    def exponentials(z: np.ndarray, safe: bool) -> np.ndarray:
        """Turns scores into what their probabilities are proportional to, in place; returns the sum of each row."""
        if not safe:
            z -= z.max(1)[:, None]
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], z.dtype)

    @classmethod
    def chosen(cls, z: np.ndarray, y: np.ndarray, safe: bool) -> np.ndarray:
        """Logarithms of the softmax of each row, at one place of it; works in place."""
        if not safe:
            z -= z.max(1)[:, None]
        own = z[np.arange(len(y)), y]
        return own - np.log(cls.exponentials(z, True))

    def step(self, ids: np.ndarray, place: np.ndarray, rate: float, memory: dict) -> None:
        """One descent step on the mean cross-entropy of the words at `place`, scaled by past gradients."""
        p, n = self.p, len(place)
        # words in the order of their classes
        place = place[np.argsort(ids[place].astype(np.int16), kind="stable")]
        y = ids[place]
        k, j = y // SIZE, y % SIZE
        near = [ids[place + o] for o in OFFSETS]
        h = self.hidden(near)
        to_class, to_word, safe = self.joined()
        from_class, from_word = to_class.T, to_word.transpose(0, 2, 1)
        by_class, by_word = np.zeros(from_class.shape, h.dtype), np.zeros(from_word.shape, h.dtype)
        dh, room, row = np.empty((n, DIMS), h.dtype), np.empty((PIECE, SIZE), h.dtype), np.arange(PIECE)
        for own, runs in self.pieces(y):
            # exponentials stay as they are: the narrower sides of the products are divided by their sums
            x, d = h[own], dh[own]
            z = room[: len(x)]
            total = self.exponentials(np.matmul(x, to_class, out=z), safe)
            z[row[: len(x)], k[own]] -= total
            share = (1 / total)[:, None]
            np.multiply(z @ from_class[:, :-1], share, out=d)
            by_class += z.T @ (x * share)
            for g, a, e in runs:
                np.matmul(x[a:e], to_word[g], out=z[a:e])
            total = self.exponentials(z, safe)
            z[row[: len(x)], j[own]] -= total
            share = (1 / total)[:, None]
            scaled, back = x * share, np.empty_like(d)
            for g, a, e in runs:
                by_word[g] += z[a:e].T @ scaled[a:e]
                np.matmul(z[a:e], from_word[g, :, :-1], out=back[a:e])
            back *= share
            d += back
        dh *= 1 - h[:, :DIMS] ** 2
        dh /= n
        for x in (by_class, by_word):
            x /= n
        for name, x in (("C", by_class[:, :-1].T), ("c", by_class[:, -1]), ("W", by_word[:, :, :-1].transpose(0, 2, 1)), ("w", by_word[:, :, -1]), ("e", dh.sum(0))):
            self.apply(name, x, rate, memory)
        wide = np.result_type(dh.dtype, np.complex64)  # two numbers are added as one
        for o, c in enumerate(near):
            c = c.astype(np.int16)  # EDGE is the largest; sorted by digits
            order = np.argsort(c, kind="stable")
            c = c[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            seen, x = c[first], np.add.reduceat(dh.take(order, 0).view(wide), first).view(dh.dtype)
            m = memory["E"][o][seen] + x * x
            memory["E"][o][seen] = m
            p["E"][o][seen] -= rate * x / (np.sqrt(m) + 1e-6)

    def apply(self, name: str, x: np.ndarray, rate: float, memory: dict) -> None:
        memory[name] += x * x
        self.p[name] -= rate * x / (np.sqrt(memory[name]) + 1e-6)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Window":
        p, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            p[k], at = flat[at : at + n].astype(np.float32).reshape(s), at + n
        return cls(p)


def masked(inside: np.ndarray, epoch: int, epochs: int) -> np.ndarray:
    """Which words, by their places in their documents, this epoch masks; all are masked over the epochs."""
    turns = min(epochs, MASK)
    return inside % MASK % turns == epoch % turns


def shards_of(words: int) -> int:
    """How many shards so many words make."""
    return max(1, -(-words // MOST_SHARD), min(SPREAD, -(-words // LEAST_SHARD)))


def trained(flat, epoch: int, epochs: int):
    """Arrow function: rows (shard, ids) in the order of their shards -> one row (group, run, weight, parameters) for each
    shard, its share of an epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, memory, seen, held, size = None, None, {}, 0, [], 0

        def learn() -> None:
            nonlocal seen, held, size
            first = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            if first[-1]:
                ids, place = padded(np.concatenate(held), first)
                inside = np.arange(len(place)) - np.repeat(first[:-1], np.diff(first))
                targets = np.random.default_rng([now, seen]).permutation(place[masked(inside, epoch, epochs)])
                for s in range(0, len(targets), BATCH):
                    some = targets[s : s + BATCH]
                    net.step(ids, some, RATE / (1 + epoch) * min(1.0, len(some) / BATCH + 0.1), memory)
                seen += len(targets)
            held, size = [], 0

        def model() -> Iterator[pa.RecordBatch]:
            learn()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([now]), pa.array([float(seen)]), pa.array([net.flat().tobytes()], pa.binary())], names=["g", "run", "weight", "p"])

        for b in slices(batches):
            for shard, ids in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if shard != now:
                    if now is not None:
                        yield from model()
                    now, net, seen = shard, Window.of(flat.value), 0
                    memory = {k: np.full(s, 1e-8, np.float32) for k, s in Window.SHAPES.items()}
                held.append(np.frombuffer(ids, np.int16).astype(np.int32))
                size += len(held[-1])
                if size >= GROUP:
                    learn()
        if now is not None:
            yield from model()

    return run


MODEL = "g long, run long, weight double, p binary"


def averaged(t: pa.Table) -> pa.Table:
    """Group function: the weighted mean of up to FAN parameter rows, in the order of their runs."""
    t = t.sort_by("run")
    weight = np.array(t.column("weight").to_pylist())
    total = np.zeros(len(t.column("p")[0].as_py()) // 4)
    for w, p in zip(weight, t.column("p")):
        total += w / weight.sum() * np.frombuffer(p.as_py(), np.float32)
    run = t.column("run")[0].as_py()
    return pa.table({"g": pa.array([0], pa.int64()), "run": pa.array([run], pa.int64()), "weight": pa.array([weight.sum()]), "p": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def counted(texts: DataFrame) -> DataFrame:
    """(hash, n) of all words of a one-column DataFrame, written."""
    return written(texts.mapInArrow(count_words(), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")


def shares(counts: DataFrame, vocabulary: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, DataFrame, float]:
    """Logarithms of the shares that words outside the vocabulary have in their buckets: (sorted hashes, values) of
    the at most `known` words of highest count, a table (hash, share) of the rest, the value of a word never counted."""
    bucket = F.col("hash").bitwiseAND(F.lit(BUCKETS - 1))
    top = F.broadcast(counts.sparkSession.createDataFrame([(int(h),) for h in vocabulary.view(np.int64)], "hash long"))
    counts = counts.join(top, "hash", "left_anti")
    sums = {r["b"]: r["n"] for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}  # BUCKETS rows
    total = np.array([sums.get(b, 1) for b in range(BUCKETS)], float)
    # the smallest count whose words, with those of higher counts, are `known` at most
    least, words = 0, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(known + 1).collect():
        words += r["words"]
        if words > known:
            least = r["n"] + 1
            break
    got = counts.filter(F.col("n") >= least).toArrow()
    h, n = got.column("hash").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    in_bucket = F.element_at(F.array(*[F.lit(x) for x in total.tolist()]), (bucket + 1).cast("int"))
    rest = counts.filter(F.col("n") < least).select("hash", F.log(F.col("n") / in_bucket).alias("share"))
    return h, np.log(n / total[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]), rest, -float(np.log(total.sum()))


def vocabulary_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of the vocabulary by falling count, their counts, the number of all words)."""
    top = counts.orderBy(F.desc("n"), "hash").limit(VOCABULARY - BUCKETS).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.array([r["hash"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], float), total


def encoder(vocabulary, known=None):
    """Arrow function: (id, key, text) -> (id, key, ids, more, rest): the word numbers as 16-bit integers; with `known`, a
    broadcast of hashes and shares, the sum of the shares of words in buckets and the hashes of those that aren't known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(vocabulary.value)
        for b in slices(batches):
            h, first = keys_of(texts_of(b.column(2)))
            ids, more, lacking = np.empty(len(h), np.int16), np.zeros(b.num_rows), [np.zeros(0, np.int64)]
            for a in range(0, len(h), DISTINCT):
                own, back = np.unique(h[a : a + DISTINCT], return_inverse=True)
                number = words.of(own)
                ids[a : a + DISTINCT] = number[back]
                if known is not None:
                    found, some = shared(known.value, own)
                    share = np.zeros(len(own))
                    share[found] = some
                    at = np.flatnonzero((number >= words.buckets)[back])
                    more += np.bincount(np.searchsorted(first, a + at, side="right") - 1, share[back[at]], b.num_rows)
                    lacking.append(a + at[~found[back[at]]])
            lacking = np.concatenate(lacking)
            rest, ends = h[lacking], np.searchsorted(lacking, first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([ids[a:z].tobytes() for a, z in zip(first, first[1:])], pa.binary()), pa.array(more, pa.float64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rest.view(np.int64)))],
                names=["lm_id", "lm_key", "ids", "more", "rest"],
            )

    return run


def encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary, known=None) -> DataFrame:
    """What `encoder` makes of docs, written; lm_key is a hash of id and text."""
    text = text_of(text_col)
    given = docs.select(named(id_col).alias("lm_id"), F.xxhash64(named(id_col), text).alias("lm_key"), text.alias("lm_text"))
    return written(given.mapInArrow(encoder(vocabulary, known), f"lm_id {docs.schema[id_col].dataType.simpleString()}, lm_key long, ids binary, more double, rest array<long>"), "encoded")


def fitted(rows: DataFrame, known: np.ndarray, total: int, epochs: int) -> np.ndarray:
    """Flat parameters, from rows (lm_key, ids); known: the counts of the vocabulary; total: the number of all words."""
    net = Window()
    # start the output biases at the words' shares
    share = np.full(VOCABULARY, 1.0)
    share[: len(known)] += known
    share[VOCABULARY - BUCKETS :] += (total - known.sum()) / BUCKETS
    share /= share.sum()
    share = share.reshape(CLASSES, SIZE)
    net.p["c"][:] = np.log(share.sum(1))
    net.p["w"][:] = np.log(share / share.sum(1, keepdims=True))
    flat, shards = net.flat(), shards_of(int(total))
    if epochs:  # each shard is a partition of its own
        shard = F.pmod(F.col("lm_key"), F.lit(shards)).cast("int")
        rows = rows.select(shard.alias("shard"), "lm_key", "ids").filter(F.octet_length("ids") > 0)
    for epoch in range(epochs):
        now = rows.sparkSession.sparkContext.broadcast(flat)
        own = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "lm_key", "ids").select("shard", "ids")
        models, n = written(own.mapInArrow(trained(now, epoch, epochs), MODEL), "models"), shards
        while True:
            models = models.withColumn("run", F.floor(F.col("run") / FAN).cast("long")).groupBy("g", "run").applyInArrow(averaged, MODEL)
            n = -(-n // FAN)
            if n <= 1:
                break
        got = models.collect()  # one row
        if got:
            flat = np.frombuffer(got[0]["p"], np.float32)
    return flat


def train(docs: DataFrame, id_col="doc_id", text_col="text", epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the vocabulary by falling count, flat parameters), from all rows."""
    hashes, known, total = vocabulary_of(counted(docs.select(text_of(text_col).alias("lm_text"))))
    rows = encoded(docs, id_col, text_col, docs.sparkSession.sparkContext.broadcast(hashes))
    return hashes, fitted(rows, known, total, epochs)


def scored(flat):
    """Arrow function: (id, more, rest, ids) -> (id, n_tokens, score, row, rest): the sum of the words' log-probabilities,
    with `more` added, and a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net, row = Window.of(flat.value), TaskContext.get().partitionId() << 33
        for b in slices(batches, most=1 << 19):
            own = [np.frombuffer(x, np.int16) for x in b.column(3).to_pylist()]
            count = np.array([len(x) for x in own], np.int64)
            first = np.concatenate([[0], np.cumsum(count)])
            ids, place = padded(np.concatenate(own), first)
            sums = np.concatenate([[0.0], np.cumsum(net.log_probabilities(ids, place))])
            score = sums[first[1:]] - sums[first[:-1]] + b.column(1).to_numpy()
            columns = {"lm_id": b.column(0), "n_tokens": pa.array(count), "score": pa.array(score), "row": pa.array(row + np.arange(len(own))), "rest": b.column(2)}
            row += len(own)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def shared(known: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes are known, the values of those)."""
    if not len(known[0]):
        return np.zeros(len(h), bool), np.zeros(0)
    at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
    found = known[0][at] == h
    return found, known[1][at[found]]


def pseudo_likelihood(docs: DataFrame, id_col="doc_id", text_col="text", epochs: int = EPOCHS, within: bool = False, known: int = KNOWN) -> DataFrame:
    """The id with n_tokens (long), score (sum of log p(word | both sides), double) and mean_score (score per
    word, null without words), the model being trained on all of docs.

    Defined cases: null and empty texts have no words and score 0; a text of one word is predicted from the
    edges alone; repeated rows train as often as they stand there and score alike; an empty table gives an
    empty one; other columns play no part. Words outside the vocabulary are predicted as their buckets; `within` adds
    log(count of the word / count of its bucket's words), so that the score is that of the words themselves
    (a word that was never counted, which rows that stay the same don't have, counts as one of all words in
    buckets). `known` bounds the words whose shares are broadcast, and changes no result. Scores don't depend on how
    the input is cut into partitions.
    """
    sc = docs.sparkSession.sparkContext
    counts = counted(docs.select(text_of(text_col).alias("lm_text")))
    hashes, frequent, total = vocabulary_of(counts)
    others, unseen, held = None, 0.0, None
    if within:
        h, share, others, unseen = shares(counts, hashes, known)
        held = sc.broadcast((h, share))
    rows = encoded(docs, id_col, text_col, sc.broadcast(hashes), held)
    flat = sc.broadcast(fitted(rows, frequent, total, epochs))
    schema = f"lm_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, score double, row long, rest array<long>"
    out = rows.select("lm_id", "more", "rest", "ids").mapInArrow(scored(flat), schema)
    if within:
        out = written(out, "scores")
        rest = out.select("row", F.explode("rest").alias("hash")).join(others, "hash", "left")
        rest = rest.groupBy("row").agg(F.sum(F.coalesce("share", F.lit(unseen))).alias("lacking"))
        out = out.join(rest, "row", "left").withColumn("score", F.col("score") + F.coalesce("lacking", F.lit(0.0)))
    return out.select(F.col("lm_id").alias(id_col), "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean_score"))


def query(spark, sf_dir: str) -> DataFrame:
    from loom.llm.common import documents

    return pseudo_likelihood(documents(spark, sf_dir), within=True)
